"""Substring dedup with repeated-phrase automata.

A window is ``size`` consecutive words of one document. A word goes if a window that covers it also starts in a document with
a smaller id.

1. Chunks send the hashes of their distinct windows, each with the least id that has it. Hashes that several documents have
   are candidates; the document with the least id owns them.
2. Owners send their runs of candidate windows as passages, the other documents send the regions they may share, both to the
   shard of the owner. A chunk sends equal regions once; an owner that very many chunks share has several shards.
3. A shard compiles an Aho-Corasick automaton of its passages' phrases (every ``size // 2 + 1``-th run of that many words, so that
   each window holds one whole) and streams its regions through it. Around every phrase found, words are compared; what is
   confirmed goes back to the chunks, word for word equal. A colliding hash confirms nothing; windows for which nothing was
   confirmed are then grouped by their words themselves, so a collision loses no link either.

Every document so passes the automata of just those passages it may contain, and automata stay small however many
passages there are.

Null texts have no words. A null id counts as larger than all others; rows of one id don't affect each other. Texts of any length are
cut into regions, none is cut short; other columns are carried as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import batch as B
from . import exchange as X

SIZE = 13
HASH_BITS = 64  # fewer bits make a smaller exchange, and more windows to be settled by their words
#: A window's owner has a shard more for each so many chunks that share it.
HOT = 2048
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LAST = np.iinfo(np.int64).max


class _Windows:
    """A chunk's words and windows; distinct hashes in order, with the least id of each."""

    def __init__(self, c: X.Chunk, size: int, bits: int):
        self.starts, self.ends, self.by = B.words(c.data, c.offsets, B.SPACE)
        h = B.hashes(c.data, self.starts, self.ends)
        w, self.at = B.windows(h, self.by, size)
        w >>= np.uint64(64 - bits)
        self.text = np.searchsorted(self.by, self.at, side="right") - 1
        self.value = np.where(c.id_null, _LAST, c.ids)
        self.id = self.value[self.text]
        order = np.argsort(w, kind="stable")
        s = w[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        self.keys = s[first]
        self.least = np.minimum.reduceat(self.id[order], first) if len(s) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.id[order], first) if len(s) else np.zeros(0, np.int64)
        self.code = np.empty(len(w), np.int64)
        self.code[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))


def _bounds(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """First place of each of n ranges of hashes (n + 1)."""
    step = (1 << bits) // n + 1
    edges = np.array([i * step for i in range(1, n) if i * step < 1 << 64], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), np.full(n - len(edges), len(keys))])


def _ask(n: int, size: int, bits: int):
    def ask(b, c):
        w = _Windows(c, size, bits)
        at = _bounds(w.keys, n, bits)
        ks = np.flatnonzero(np.diff(at))
        if len(ks):
            yield X.sent(b, ks, [X.join_blobs(X.pack_sorted(w.keys[at[k] : at[k + 1]]), X.pack_ints(w.least[at[k] : at[k + 1]])) for k in ks])

    return ask


def _candidates(hot: int):
    """For each chunk: places of those of its hashes that other chunks have too, the least id of each, and over how many shards each is spread."""

    def reply(k, chunks, blobs):
        parts = [X.split_blobs(x) for x in blobs]
        keys = [X.unpack_sorted(x) for x, _ in parts]
        ids = np.concatenate([X.unpack_ints(y) for _, y in parts])
        sizes = [len(x) for x in keys]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(first, len(s)))
        low, among = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(ids[order], first), count)
        among[order] = np.repeat(count, count)
        at = 0
        for b, n in zip(chunks, sizes, strict=True):
            own = np.flatnonzero(among[at : at + n] > 1)
            if len(own):
                yield b, X.join_blobs(X.pack_sorted(own.astype(np.uint64)), X.pack_ints(low[at : at + n][own]), X.pack_ints(1 + among[at : at + n][own] // hot))
            at += n

    return reply


def _runs(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of runs of windows that follow one another and are the same in all else."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1] + 1])
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def _send_texts(n: int, size: int, bits: int):
    blank = X.empty(X.SENT_SCHEMA)

    def done(b, c, answers):
        w = _Windows(c, size, bits)
        at = _bounds(w.keys, n, bits)
        least, elsewhere, shards = w.least.copy(), np.zeros(len(w.keys), bool), np.ones(len(w.keys), np.int64)
        for k, (blob,) in answers.items():
            own, low, over = X.split_blobs(blob)
            place = X.unpack_sorted(own).astype(np.int64) + at[k]
            least[place], shards[place] = X.unpack_ints(low), X.unpack_ints(over)
            elsewhere[place] = True
        shards = shards[w.code]
        owner = least[w.code]
        spread = (elsewhere | (w.most > w.least))[w.code]
        # all words, one space after each
        lens = w.ends - w.starts
        words, offs = B.gather(c.data, w.starts, lens)
        joined = np.full(len(words) + len(lens), 32, np.uint8)
        joined[np.arange(len(words)) + np.repeat(np.arange(len(lens)), lens)] = words
        edge = offs + np.arange(len(offs))
        # a region has its document's id with it
        cols = []
        for kind, pick in ((0, np.flatnonzero(spread & (owner == w.id))), (1, np.flatnonzero(owner < w.id))):
            lo, hi = _runs(w.at[pick], owner[pick], w.text[pick], shards[pick])
            lo, hi = pick[lo], pick[hi]
            # a passage goes to all of its owner's shards, a region to the one that its chunk falls to
            copies = shards[lo] if kind == 0 else np.ones(len(lo), np.int64)
            salt = B.spread(copies)[1] if kind == 0 else b % shards[lo]
            lo, hi = np.repeat(lo, copies), np.repeat(hi, copies)
            a, z = w.at[lo], w.at[hi] + size
            cols.append((np.full(len(lo), kind), owner[lo], w.text[lo], a - w.by[w.text[lo]], w.id[lo], edge[a], edge[z] - 1, salt))
        kind, own, text, start, ids, a, z, salt = (np.concatenate(x) for x in zip(*cols, strict=True))
        shard = (B.mix(own.astype(np.uint64) + B.mix(salt.astype(np.uint64))) % np.uint64(n)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        kind, own, text, start, ids, a, z, shard = (x[order] for x in (kind, own, text, start, ids, a, z, shard))
        said = B.binary(joined, a, z)
        cut = np.searchsorted(shard, np.arange(n + 1))
        ks = np.flatnonzero(np.diff(cut))
        blobs = []
        for k in ks:
            i, j = cut[k], cut[k + 1]
            codes, values = B.encode(said.slice(i, j - i))  # equal texts once
            blobs.append(X.join_blobs(*(X.pack_ints(x[i:j]) for x in (kind, own, text, start, ids)), X.pack_ints(codes), X.press(X.pack_words(values))))
        return pa.Table.from_batches([X.sent(b, ks, blobs)]) if len(ks) else blank

    return done


def confirm(passages: list[np.ndarray], owners: np.ndarray, regions: list[tuple[np.ndarray, int]], size: int) -> list[list[tuple[int, int]]]:
    """For each region (word codes, owner): the stretches that lie word for word in a passage of that owner or a smaller one.

    Only stretches made of whole windows count. The automaton finds phrases; the words around each are compared as far as a
    window around it reaches.
    """
    step = size // 2 + 1
    reach = size - step
    near: dict[tuple, dict[tuple, int]] = {}
    for p, own in zip(passages, owners.tolist(), strict=True):
        t = tuple(p.tolist())
        for i in range(0, len(t) - step + 1, step):
            around = near.setdefault(t[i : i + step], {})
            side = (t[max(0, i - reach) : i], t[i + step : i + step + reach])
            if own < around.get(side, own + 1):
                around[side] = own
    if not near:
        return [[] for _ in regions]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    sides = []
    for phrase, around in near.items():
        automaton.add_word(phrase, len(sides))
        sides.append(list(around.items()))
    near.clear()
    automaton.make_automaton()
    known: dict[tuple, list[tuple[int, int]]] = {}
    out = []
    for codes, owner in regions:
        t = (tuple(codes.tolist()), owner)
        if t not in known:
            known[t] = _stretches(t[0], owner, automaton, sides, size, step, reach)
        out.append(known[t])
    return out


def _stretches(t, owner, automaton, sides, size, step, reach):
    got = []
    for last, which in automaton.iter(t):
        i = last - step + 1
        left, right = t[max(0, i - reach) : i], t[last + 1 : last + 1 + reach]
        for (before, after), own in sides[which]:
            if own > owner:
                continue
            if before == left and after == right:
                a, z = len(left), len(right)
            else:
                a = z = 0
                while a < len(left) and a < len(before) and left[-1 - a] == before[-1 - a]:
                    a += 1
                while z < len(right) and z < len(after) and right[z] == after[z]:
                    z += 1
            if a + z + step >= size:
                lo, hi = i - a, last + 1 + z
                if got and got[-1][0] <= lo <= got[-1][1]:
                    got[-1][1] = max(got[-1][1], hi)
                else:
                    got.append([lo, hi])
    return [tuple(x) for x in got]


def _shard(size: int):
    def reply(k, chunks, blobs):
        rows, texts = [], []
        for blob in blobs:
            kind, own, text, start, ids, codes, said = X.split_blobs(blob)
            rows.append([X.unpack_ints(x) for x in (kind, own, text, start, ids, codes)])
            texts.append(X.unpack_words(X.unpress(said))[0])
        data, offs = B.flat(pa.concat_arrays(texts))
        starts, ends, by = B.words(data, offs, B.SPACE)
        codes, _ = B.encode(B.binary(data, starts, ends))
        base = np.cumsum([0, *map(len, texts)])
        passages, owners, regions = [], [], []
        for i, (kind, own, _, _, _, c) in enumerate(rows):
            for r in np.flatnonzero(kind == 0).tolist():
                j = base[i] + c[r]
                passages.append(codes[by[j] : by[j + 1]])
                owners.append(own[r])
            for r in np.flatnonzero(kind == 1).tolist():
                j = base[i] + c[r]
                regions.append((codes[by[j] : by[j + 1]], int(own[r])))
        got = iter(confirm(passages, np.array(owners, np.int64), regions, size))
        for i, (b, (kind, _, text, start, ids, c)) in enumerate(zip(chunks, rows, strict=True)):
            out, lost = [], []
            for r in np.flatnonzero(kind == 1).tolist():
                j, sure = base[i] + c[r], next(got)
                out.extend((text[r], start[r] + lo, start[r] + hi) for lo, hi in sure)
                for a in unconfirmed(int(by[j + 1] - by[j]), sure, size):
                    w = by[j] + a
                    lost.append((int(ids[r]), int(text[r]), int(start[r]) + a, data[starts[w] : ends[w + size - 1]].tobytes()))
            if out:
                yield b, X.join_blobs(*map(X.pack_ints, np.array(out, np.int64).T))
            if lost:
                yield b, _LOST + X.press(pickle.dumps(lost))

    return reply


#: Marks an answer that holds windows nothing was confirmed for.
_LOST = b"\xff" * 8


def unconfirmed(words: int, sure: list[tuple[int, int]], size: int) -> list[int]:
    """Where windows of a region of so many words start that lie in none of the confirmed stretches."""
    left = np.ones(max(words - size + 1, 0), bool)
    for lo, hi in sure:
        left[lo : max(hi - size + 1, lo)] = False
    return np.flatnonzero(left).tolist()


def _settle_collisions(found: DataFrame, size: int) -> DataFrame:
    """Answers of what is confirmed, and of windows that share a hash with other words but whose own words a smaller id has.

    Such windows are as rare as collisions of 64-bit hashes, so usually this reads no rows.
    """
    lost = F.substring("blob", 1, 8) == F.lit(_LOST)

    def rows(batches):
        for x in batches:
            for b, blob in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                ids, texts, at, said = zip(*pickle.loads(X.unpress(blob.as_py()[8:])), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(ids)), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(at, pa.int64()), pa.array(said, pa.binary())], ["b", "id", "t", "at", "said"])

    def back(batches):
        for x in batches:
            for b, t, at in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([-1], pa.int32()), pa.array([X.join_blobs(*(X.pack_ints(np.array([v], np.int64)) for v in (t, at, at + size)))], pa.binary())], ["b", "k", "blob"])

    w = found.where(lost).select("b", "blob").mapInArrow(rows, "b long, id long, t long, at long, said binary")
    low = w.groupBy("said").agg(F.min("id").alias("low"))
    more = w.join(low, "said").where("low < id").select("b", "t", "at").mapInArrow(back, X.ANSWER_SCHEMA)
    return found.where(~lost).union(more)


def _chunked(docs: DataFrame, doc_id: str, text: str, size: int, carry: list[str], hot: int = HOT, bits: int = HASH_BITS):
    """The chunks, and what of them is confirmed."""
    n = X.parts(docs.sparkSession)
    chunks = X.pack(X.settled(docs), doc_id, text, carry=carry)
    answers = X.answer(X.each_chunk(chunks, _ask(n, size, bits), X.SENT_SCHEMA), _candidates(hot))
    texts = X.finish(chunks, answers, _send_texts(n, size, bits), X.SENT_SCHEMA)
    return chunks, _settle_collisions(X.durable(X.answer(texts, _shard(size))), size)


def _gone(c: X.Chunk, answers: dict[int, list[bytes]]):
    starts, ends, by = B.words(c.data, c.offsets, B.SPACE)
    edge = np.zeros(len(starts) + 1, np.int64)
    for blobs in answers.values():
        for blob in blobs:
            text, lo, hi = map(X.unpack_ints, X.split_blobs(blob))
            np.add.at(edge, by[text] + lo, 1)
            np.add.at(edge, by[text] + hi, -1)
    return starts, ends, by, np.cumsum(edge)[:-1] > 0


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, hot: int = HOT, bits: int = HASH_BITS) -> DataFrame:
    """Per document: words, removed words, and a digest of the kept ones."""
    chunks, found = _chunked(docs, doc_id, text, size, [], hot, bits)

    def done(b, c, answers):
        starts, ends, by, gone = _gone(c, answers)
        keep = ~gone
        lens = (ends - starts)[keep]
        words, offs = B.gather(c.data, starts[keep], lens)
        joined = np.full(len(words) + len(lens), 32, np.uint8)
        joined[np.arange(len(words)) + np.repeat(np.arange(len(lens)), lens)] = words
        kept = np.concatenate([[0], np.cumsum(keep)])[by]
        edge = (offs + np.arange(len(offs)))[kept]
        raw = memoryview(joined)
        shas = [hashlib.sha256(raw[i : max(i, j - 1)]).hexdigest() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.table([c.id_array(), pa.array(np.diff(by)), pa.array(np.diff(by) - np.diff(kept)), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return X.finish(chunks, found, done, DIGESTS)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` without the repeated words: each run of them goes with the white space after it. Null texts stay null."""
    others = [c for c in docs.columns if c != text]
    chunks, found = _chunked(docs, doc_id, text, size, others)
    schema = StructType([docs.schema[c] for c in docs.columns])

    def done(b, c, answers):
        starts, _, by, gone = _gone(c, answers)
        drop = np.zeros(len(c.data) + 1, np.int64)
        first = np.flatnonzero(gone)
        owner = np.searchsorted(by, first, side="right") - 1
        after = np.append(starts, len(c.data))[first + 1]
        stop = np.minimum(after, c.offsets[owner + 1])
        np.add.at(drop, starts[first], 1)
        np.add.at(drop, stop, -1)
        keep = np.cumsum(drop)[:-1] == 0
        offs = np.concatenate([[0], np.cumsum(keep)])[c.offsets]
        texts = B.from_parts(c.data[keep], offs).cast(pa.string())
        texts = pc.if_else(c.null_texts(), None, texts)
        rest = c.carried
        cols = {name: rest.column(i) for i, name in enumerate(others)} | {text: texts}
        return pa.table([cols[x] for x in docs_columns], docs_columns)

    docs_columns = docs.columns
    return X.finish(chunks, found, done, schema)

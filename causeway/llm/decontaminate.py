"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Of every ``window - gram + 1`` k-grams in a row the least hash is kept, on both sides, so any
span of ``window`` shared words shares a kept fingerprint. A fingerprint found in a document is extended to the item windows
around it, which are compared word by word. Items of fewer words than a window are one window, looked up whole.

Few items (their size is checked) go to all executors; more than that are looked up by a shuffle: chunks of documents ask which of
their fingerprints the benchmark has, and then for the items of the windows around these, word by word.

Null texts have no words: nothing is hit, and a null item is in no document. Repeated document rows are answered each. Repeated items count each by its id; items of
one id are one item with several texts. Items of null id hit like others; together they count as one item in ``n_items`` and have no
place in ``items_sha256``, as in the query's SQL. Texts of any length are cut whole; other columns are carried as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X

WINDOW, GRAM = 10, 5
BROADCAST_BYTES = 16 << 20
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def least(grams: np.ndarray, at: np.ndarray, word_offsets: np.ndarray, width: int) -> np.ndarray:
    """Which of the k-grams (hashes, places) winnowing keeps: each that is the least of some ``width`` in a row in its text."""
    n = len(grams)
    if n == 0 or width == 1:
        return np.ones(n, bool)
    text = np.searchsorted(word_offsets, at, side="right")
    keep = np.zeros(n, bool)
    if n >= width:
        low = grams[: n - width + 1].copy()
        for j in range(1, width):
            np.minimum(low, grams[j : n - width + 1 + j], out=low)
        whole = text[: n - width + 1] == text[width - 1 :]
        for j in range(width):
            keep[j : n - width + 1 + j] |= whole & (grams[j : n - width + 1 + j] == low)
    counts = np.bincount(text, minlength=len(word_offsets) + 1)
    keep[counts[text] < width] = True  # too short for a window: all of them
    return keep


class Items:
    """Fingerprints, windows and short items of a set of benchmark texts; a window's words are looked up in the texts when needed."""

    def __init__(self, ids: list, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        data, offsets = B.flat(pa.array(texts, pa.large_binary()))
        self.data = B.LOWER[data]
        self.starts, self.ends, by = B.words(self.data, offsets, B.NOT_ALNUM)
        h = B.hashes(self.data, self.starts, self.ends)
        counts = np.diff(by)
        grams, at = B.windows(h, by, gram)
        self.prints = np.unique(grams[least(grams, at, by, window - gram + 1)])
        self.by_size: dict[int, tuple] = {}
        long = counts >= window
        sizes = [window, *np.unique(counts[(counts > 0) & ~long]).tolist()]
        for size in sizes:
            w, at = B.windows(h, by, size)
            item = np.searchsorted(by, at, side="right") - 1
            own = long[item] if size == window else counts[item] == size
            w, at, item = w[own], at[own], item[own]
            order = np.lexsort((item, w))
            w, at, item = w[order], at[order], item[order]
            hashes, first = np.unique(w, return_index=True)
            self.by_size[int(size)] = (hashes, np.append(first, len(w)), item, at)
        self.ids = [None if i is None else str(i) for i in ids]

    def said(self, at: int, size: int) -> bytes:
        return spoken(self.data, self.starts, self.ends, at, size)


def spoken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    """So many words in a row, joined by one space."""
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts[at : at + size].tolist(), ends[at : at + size].tolist(), strict=True))


_MADE: dict[tuple, Items] = {}


def _items(key: tuple, held) -> Items:
    """The items of a broadcast, made once a worker."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Items([i for i, _ in held.value], [t for _, t in held.value], *key[1:])
    return _MADE[key]


def _around(h: np.ndarray, by: np.ndarray, prints: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of texts around fingerprints that are among ``prints``."""
    grams, at = B.windows(h, by, gram)
    keep = least(grams, at, by, window - gram + 1)
    at = at[keep][isin(grams[keep], prints)]
    text = np.searchsorted(by, at, side="right") - 1
    spots = (at[:, None] - np.arange(window - gram + 1)).ravel()
    text = np.repeat(text, window - gram + 1)
    spots = np.unique(spots[(spots >= by[text]) & (spots + window <= by[text + 1])])
    w = np.zeros(len(spots), np.uint64)
    for j in range(window):
        w *= B._ODD
        w += h[spots + j]
    return B.mix(w), spots


def scan(c: X.Chunk, items: Items | None) -> pa.Table:
    """The digest rows of a chunk's documents."""
    data = B.LOWER[c.data]
    starts, ends, by = B.words(data, c.offsets, B.NOT_ALNUM)
    n_hit = np.zeros(len(c), np.int64)
    found: dict[int, set[str | None]] = {}
    if items is not None and len(starts):
        h = B.hashes(data, starts, ends)
        hit = np.zeros(len(starts), bool)
        for size, (hashes, first, item, at) in items.by_size.items():
            if len(hashes) == 0:
                continue
            w, spots = _around(h, by, items.prints, size, items.gram) if size == items.window else B.windows(h, by, size)
            place = np.minimum(np.searchsorted(hashes, w), len(hashes) - 1)
            ok = hashes[place] == w
            text = np.searchsorted(by, spots, side="right") - 1
            for p, s, t in zip(place[ok].tolist(), spots[ok].tolist(), text[ok].tolist(), strict=True):
                words = spoken(data, starts, ends, s, size)
                own = {items.ids[item[i]] for i in range(first[p], first[p + 1]) if items.said(int(at[i]), size) == words}
                if own:
                    hit[s : s + size] = True
                    found.setdefault(t, set()).update(own)
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_hit = sums[by[1:]] - sums[by[:-1]]
    return _digests(c, by, n_hit, found)


def _digests(c: X.Chunk, by: np.ndarray, n_hit: np.ndarray, found: dict[int, set]) -> pa.Table:
    sets = [found.get(t, ()) for t in range(len(c))]
    lists = [sorted(i for i in x if i is not None) for x in sets]
    return pa.table(
        [c.id_array(), pa.array(np.diff(by)), pa.array(n_hit), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()), pa.array(n_hit > 0)],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which x are in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: words, words inside item windows, and the items whose windows occur."""
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return _scanned(rows, "doc_id", "text", benchmark, item_id, item_text, window, gram, broadcast_bytes, False)


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without those in which a window of an item occurs; all columns unchanged."""
    return _scanned(docs, doc_id, text, benchmark, item_id, item_text, window, gram, broadcast_bytes, True)


def _scanned(docs, doc_id, text, benchmark, item_id, item_text, window, gram, broadcast_bytes, keep) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.selectExpr(f"cast(`{item_id}` as string) as item_id", f"cast(`{item_text}` as string) as text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _by_shuffle(docs, items, doc_id, text, window, gram, keep)
    held = spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in items.collect()])
    i_id, i_text = docs.columns.index(doc_id), docs.columns.index(text)

    key = (uuid.uuid4().hex, window, gram)

    def run(batches: Iterable[pa.RecordBatch]):
        made = _items(key, held)
        for x in batches:
            sizes = np.asarray(pc.binary_length(x.column(i_text)).fill_null(0)).astype(np.int64)
            at = X.cuts(sizes, X.CHUNK_BYTES)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                part = x.slice(lo, hi - lo)
                ids = part.column(i_id).cast(pa.int64())
                c = X.Chunk(ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), None, None, *B.flat(part.column(i_text)))
                found = scan(c, made)
                if keep:
                    yield part.filter(pc.invert(found.column("contaminated").combine_chunks()))
                else:
                    yield from found.to_batches()
                B.trim()

    return docs.mapInArrow(run, docs.schema if keep else HITS)


def _cut(texts: pa.Array) -> tuple[np.ndarray, ...]:
    data, offs = B.flat(texts)
    data = B.LOWER[data]
    starts, ends, by = B.words(data, offs, B.NOT_ALNUM)
    return data, starts, ends, by, B.hashes(data, starts, ends)


def _dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys by bucket, and each bucket's first place (n + 1)."""
    keys = np.unique(keys)
    k = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(k, kind="stable")
    return keys[order], np.searchsorted(k[order], np.arange(n + 1))


def _by_shuffle(docs: DataFrame, items: DataFrame, doc_id: str, text: str, window: int, gram: int, keep: bool) -> DataFrame:
    """Two questions a chunk, both about distinct keys: which of its fingerprints the benchmark has, and which items have the windows around these.

    A bucket of the first question holds each of the benchmark's fingerprints once, however many items have it, and answers with
    places. A bucket of the second holds windows word for word with their items, so a chunk gets ids only for words it has.
    """
    spark = docs.sparkSession
    n = X.parts(spark)
    others = [c for c in docs.columns if c != text] if keep else []
    chunks = X.pack(X.settled(docs), doc_id, text, carry=others)
    items = X.durable(items.select("item_id", "text"))

    def item_rows(batches):
        """(key, kind, size, said, item): fingerprints (kind 0), and windows or short items with their words (kind 1)."""
        for x in batches:
            for i, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                data, starts, ends, by, h = _cut(pa.array([t.encode()], pa.large_binary()))
                if not len(h):
                    continue
                size = min(window, len(h))
                w, at = B.windows(h, by, size)
                prints = np.zeros(0, np.uint64)
                if size == window:
                    grams, spots = B.windows(h, by, gram)
                    prints = np.unique(grams[least(grams, spots, by, window - gram + 1)])
                w, first = np.unique(w, return_index=True)
                keys = np.concatenate([prints, w])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64)), pa.array([0] * len(prints) + [1] * len(w), pa.int32()), pa.array([size] * len(keys), pa.int32()), pa.array([b""] * len(prints) + [spoken(data, starts, ends, s, size) for s in at[first].tolist()], pa.binary()), pa.array([i] * len(keys), pa.string())],
                    ["key", "kind", "size", "said", "item"],
                )

    rows = X.durable(items.mapInArrow(item_rows, "key long, kind int, size int, said binary, item string"))
    sizes = [r[0] for r in rows.where("kind = 1").select("size").distinct().orderBy("size").collect()]  # at most ``window``
    short = [s for s in sizes if s < window]
    bucket = F.expr(f"cast(pmod(cast(key as decimal(20,0)) + if(key < 0, 18446744073709551616BD, 0BD), {n}) as int)")
    # short items are asked for by fingerprint too: the hash of all their words
    known = rows.where(f"kind = 0 or size < {window}").select("key").distinct().groupBy(bucket.alias("k"), F.expr("cast(pmod(xxhash64(key), 64) as int)").alias("part")).agg(F.collect_list("key").alias("keys"))

    def grams_of(h, by):
        grams, at = B.windows(h, by, gram)
        return np.concatenate([grams[least(grams, at, by, window - gram + 1)], *(B.windows(h, by, s)[0] for s in short)])

    def words_of(c):
        return _cut(B.from_parts(c.data, c.offsets))

    def ask(b, c):
        _, _, _, by, h = words_of(c)
        keys, bounds = _dealt(grams_of(h, by), n)
        ks = np.flatnonzero(np.diff(bounds))
        if len(ks):
            yield X.sent(b, ks, [X.press(keys[bounds[k] : bounds[k + 1]].tobytes()) for k in ks])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(x.values) for x in right.column("keys"))]).astype(np.int64).view(np.uint64))
        out = []
        for b, k, blob in zip(left.column("b").to_pylist(), left.column("k").to_pylist(), left.column("blob"), strict=True):
            got = np.flatnonzero(isin(np.frombuffer(X.unpress(blob.as_py()), np.uint64), mine))
            if len(got):
                out.append((b, k, X.pack_ints(got)))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["b", "k", "blob"])

    def candidates(c, answers):
        """(size, hash, place) of the windows and short runs around what the benchmark has."""
        data, starts, ends, by, h = words_of(c)
        keys, bounds = _dealt(grams_of(h, by), n)
        hit = np.sort(np.concatenate([np.zeros(0, np.uint64), *(keys[bounds[k] : bounds[k + 1]][X.unpack_ints(x)] for k, (x,) in answers.items() if k < n)]))
        out = [(window, *_around(h, by, hit, window, gram))]
        for s in short:
            w, at = B.windows(h, by, s)
            ok = isin(w, hit)
            out.append((s, w[ok], at[ok]))
        return data, starts, ends, by, out

    blank = X.empty(ASKED)

    def ask_windows(b, c, answers):
        data, starts, ends, _, found = candidates(c, answers)
        seen: dict[tuple[int, bytes], int] = {}
        for size, w, at in found:
            for x, s in zip(w.tolist(), at.tolist(), strict=True):
                seen.setdefault((size, spoken(data, starts, ends, s, size)), x)
        return pa.table([pa.array([b] * len(seen), pa.int64()), pa.array([x - (1 << 64) if x >> 63 else x for x in seen.values()], pa.int64()), pa.array([s for s, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.binary())], ["b", "key", "size", "said"]) if seen else blank

    answers = X.durable(X.each_chunk(chunks, ask, X.SENT_SCHEMA).groupBy("k").cogroup(known.groupBy("k")).applyInArrow(meet, "b long, k int, blob binary").select("b", "k", "blob"))
    asked = X.finish(chunks, answers, ask_windows, ASKED)
    # words decide, so hashes only bring them together; items of one window come as lists, each id once
    own = rows.where("kind = 1").select("key", "size", "said", "item").distinct()
    matched = X.durable(asked.join(own, ["key", "size", "said"]).select("b", "size", "said", "item"))
    given = matched.groupBy("b", F.expr(f"cast({n} + pmod(xxhash64(said), 64) as int)").alias("k")).agg(F.collect_list(F.struct("size", "said", "item")).alias("rows")).select("b", "k", F.expr("to_binary(to_json(transform(rows, r -> struct(r.size as s, hex(r.said) as w, r.item as i))), 'utf-8')").alias("blob"))
    columns = docs.columns

    def done(b, c, answers):
        import json

        _, _, _, by, found = (parts := candidates(c, {k: v for k, v in answers.items() if k < n}))
        data, starts, ends = parts[:3]
        of: dict[tuple[int, bytes], set] = {}
        for k, blobs in answers.items():
            if k >= n:
                for r in (r for x in blobs for r in json.loads(x)):
                    of.setdefault((r["s"], bytes.fromhex(r["w"])), set()).add(r.get("i"))
        hit, items_of = np.zeros(len(starts), bool), {}
        for size, _, at in found:
            text = np.searchsorted(by, at, side="right") - 1
            for s, t in zip(at.tolist(), text.tolist(), strict=True):
                if own_ids := of.get((size, spoken(data, starts, ends, s, size))):
                    hit[s : s + size] = True
                    items_of.setdefault(t, set()).update(own_ids)
        sums = np.concatenate([[0], np.cumsum(hit)])
        got = _digests(c, by, sums[by[1:]] - sums[by[:-1]], items_of)
        return X.rows_of(c, text_name, others, columns, pc.invert(got.column("contaminated")).combine_chunks()) if keep else got

    text_name = text
    return X.finish(chunks, answers.union(given), done, docs.schema if keep else HITS)


ASKED = "b long, key long, size int, said binary"

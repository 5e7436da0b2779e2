"""Language-model scores of whole texts, with the unigram score beside them.

Tokens are lower-cased (A-Z) words and one end a text. Every chunk asks about its distinct words; a bucket adds up a word's
count over all learning texts and cuts it into subword ids once. Each chunk's texts are then stored as subword ids, and all that
the attention model learns comes from them: its classes, shares and what follows what are counts over all learning texts in full,
and its weights come from all their windows, in which each subword and each end is learned from once. A
bounded sample of windows gives the first weights only; then shards of ``CHUNKS`` chunks, dealt by their numbers, are gone over each from these, and
their weights are averaged by the windows they saw. So scores hang on the chunks, that is on how the table is cut into partitions when it is read, and
not on the number of shuffle partitions or on where a shard is worked on.

Null texts are empty: their end is their only token. Sums of
single precision differ in their last digit by where a window stands in a matrix, so scores are rounded to DIGITS decimals: repeated
rows score alike but for a difference in the last of these. Without learning rows N and V are 0. Subwords of
equal counts are ordered by id. Texts of any length are scored whole; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import bpe, lm
from . import exchange as X

FIRST_WINDOWS, FIRST_STEPS, GROUPS = 16384, 1200, 64
BLOCK, STEP, DIGITS = 8192, 64, 6
#: Chunks that weights are learned from one after another.
CHUNKS = 8
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TEXTS = "b long, windows long, blob binary"


def _words(c: X.Chunk):
    data = B.LOWER[c.data]
    starts, ends, by = B.words(data, c.offsets, B.SPACE)
    codes, values = B.encode(B.binary(data, starts, ends))
    return codes, values, by


def _ask(n: int):
    def ask(b, c):
        codes, values, by = _words(c)
        learn = np.repeat(c.extra % 2 == 1, np.diff(by))
        counts = np.bincount(codes[learn], minlength=len(values))
        order, bounds = X.deal(values, n)
        taken, counts = values.take(pa.array(order)), counts[order]
        ks = np.flatnonzero(np.diff(bounds))
        if len(ks):
            yield X.sent(b, ks, [X.join_blobs(X.press(X.pack_words(taken.slice(i, j - i)), level=3), X.pack_ints(counts[i:j])) for i, j in zip(bounds[ks].tolist(), bounds[ks + 1].tolist(), strict=True)])

    return ask


def subwords(words: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, each with a space before it, and how many each has."""
    enc = bpe._encoder(path, pattern)._core_bpe.encode_ordinary
    got = [enc(" " + w) for w in words.cast(pa.large_string()).to_pylist()]
    return np.fromiter((i for g in got for i in g), np.int64), np.fromiter(map(len, got), np.int64, len(got))


def _begins(path: str) -> np.ndarray:
    """Which ids begin a word, with the end of a text as the last."""
    ranks = bpe.read_ranks(path)
    out = np.zeros(max(ranks.values()) + 2, bool)
    out[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    return out


def _reply(path: str, pattern: str):
    def reply(k, chunks, blobs):
        parts = [X.split_blobs(x) for x in blobs]
        lists = [X.unpack_words(X.unpress(a))[0] for a, _ in parts]
        codes, values = B.encode(pa.concat_arrays(lists))
        counts = np.bincount(codes, weights=np.concatenate([X.unpack_ints(b) for _, b in parts]), minlength=len(values)).astype(np.int64)
        ids, lens = subwords(values, path, pattern)
        starts = np.cumsum(lens) - lens
        at = 0
        for b, own in zip(chunks, lists, strict=True):
            c = codes[at : at + len(own)]
            at += len(own)
            yield b, X.join_blobs(X.pack_ints(counts[c]), X.pack_ragged(B.gather(ids, starts[c], lens[c])[0].astype(np.uint32), lens[c]))
        total = np.bincount(ids, weights=np.repeat(counts, lens)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield -1, X.join_blobs(X.pack_ints(np.array([int((counts > 0).sum()), int(counts.sum())])), X.pack_ints(seen), X.pack_ints(total[seen]))

    return reply


def _totals(replies: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Distinct words, words, and counts by subword id (as many rows as the vocabulary has) over all learning texts."""

    def run(batches):
        for x in batches:
            for blob in x.column(0):
                a, ids, n = map(X.unpack_ints, X.split_blobs(blob.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], ids])), pa.array(np.concatenate([a, n]))], ["id", "n"])

    got = {r["id"]: r["n"] for r in replies.where("b = -1").select("blob").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator()}
    return got.pop(-2, 0), got.pop(-1, 0), got


class Texts:
    """A chunk's texts as subword ids: places of texts in them, which to learn from, and the digest rows without scores."""

    def __init__(self, blob: bytes):
        ids, rows = X.split_blobs(blob)
        self.ids, lens = X.unpack_ragged(ids, np.uint32)
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        self.rows = pa.ipc.open_stream(X.unpress(rows)).read_all()

    @staticmethod
    def pack(ids: np.ndarray, lens: np.ndarray, rows: pa.Table) -> bytes:
        return X.join_blobs(X.pack_ragged(ids.astype(np.uint32), lens), X.press(X._ipc(rows, 0), level=3))

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of the texts to learn from."""
        at = np.flatnonzero(self.rows.column("learn").to_numpy())
        return B.gather(self.ids, self.offsets[at], np.diff(self.offsets)[at])


def arrange(texts: DataFrame, vocabulary: lm.Vocabulary, end: int) -> None:
    """Counts what class follows what over all learning texts in full. At most CLASSES ** 2 sums come back."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        sums = np.zeros(lm.CLASSES * lm.CLASSES, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                _, y, x, _ = lm.stream(held.value, *Texts(blob.as_py()).learned(), end)
                sums += np.bincount(x.astype(np.int64) * lm.CLASSES + y, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])

    follow = np.zeros(lm.CLASSES * lm.CLASSES)
    got = texts.select("blob").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    follow[got["pair"].to_numpy()] = got["n"].to_numpy()
    vocabulary.arrange(follow.reshape(lm.CLASSES, lm.CLASSES))


def windows(texts: Texts, vocabulary: lm.Vocabulary, end: int, b: int, every: int = 1):
    """Stretches of a chunk's learning texts (one in ``every``) in a fixed shuffled order, some thousands at a time: classes before and targets."""
    _, y, x, at = lm.stream(vocabulary, *texts.learned(), end)
    start, hi = lm.stretches(at)
    order = np.random.default_rng(b).permutation(len(start))
    order = order[int(B.mix(np.array([b], np.uint64))[0] % np.uint64(every)) :: every]
    for i in range(0, len(order), BLOCK):
        own = order[i : i + BLOCK]
        yield lm.cut(x, y, start[own], hi[own])


def train(texts: DataFrame, vocabulary: lm.Vocabulary, end: int) -> dict[str, np.ndarray]:
    """First weights from a bounded sample of windows, then one pass of executors over all windows of ``texts``, in shards of ``CHUNKS`` chunks."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)
    # about FIRST_WINDOWS of all: on few texts all of them
    every = max(1, texts.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0] // FIRST_WINDOWS)

    def some(batches):
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for x, y in windows(Texts(blob.as_py()), held.value, end, b, every):
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["b", "x", "y"])

    first = sorted(texts.select("b", "blob").mapInArrow(some, "b long, x binary, y binary").collect())
    x, y = (np.frombuffer(b"".join(bytes(r[c]) for r in first), np.int16).reshape(-1, n) for c, n in (("x", 2 * lm.HALF), ("y", 2 * lm.HALF)))
    order = np.random.default_rng(11).permutation(len(x))
    m = lm.fit(lm.initial(), vocabulary, x[order], y[order], min(FIRST_STEPS, 4 * len(x) // STEP), 0.01, size=STEP)
    start = texts.sparkSession.sparkContext.broadcast(m)
    names = sorted(m)

    def run(batches):
        now, own, seen, xs, ys = None, None, 0, [], []

        def learn():
            nonlocal own, seen
            if xs:
                x, y = np.concatenate(xs), np.concatenate(ys)
                xs.clear(), ys.clear()
                own, seen = lm.fit(own, held.value, x, y, -(-len(x) // STEP), 0.002, size=STEP), seen + len(x)

        def weights():
            learn()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([seen]), pa.array([np.concatenate([own[k].ravel() for k in names]).astype(np.float32).tobytes()], pa.binary())], ["g", "n", "w"])

        for batch in batches:
            for shard, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != now:
                    yield from weights()
                    now, own, seen = shard, start.value, 0
                for x, y in windows(Texts(blob.as_py()), held.value, end, b):
                    xs.append(x)
                    ys.append(y)
                    if sum(map(len, xs)) >= BLOCK:  # bounds memory
                        learn()
                B.trim()
        yield from weights()

    def average(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        total, n = 0.0, t.column("n").to_pylist()
        for k, blob in zip(n, t.column("w"), strict=True):
            total = total + np.frombuffer(blob.as_py(), np.float32) * (k / sum(n))
        return pa.table([pa.array([t.column("g")[0].as_py() // GROUPS]), pa.array([sum(n)]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["g", "n", "w"])

    # fixed shards of chunks, each in order, whatever the partitions are; their weights are averaged by GROUPS, level by level
    shards = max(1, -(-texts.count() // CHUNKS))
    dealt = texts.select(F.pmod(F.xxhash64("b"), F.lit(shards)).alias("shard"), "b", "blob").repartition(X.parts(texts.sparkSession), "shard").sortWithinPartitions("shard", "b")
    sets = "g long, n long, w binary"
    at = X.durable(dealt.mapInArrow(run, sets))
    while shards > GROUPS:
        at = at.groupBy(F.expr(f"g div {GROUPS}").alias("of")).applyInArrow(lambda key, t: average(t), sets)
        shards = -(-shards // GROUPS)
    got = at.orderBy("g").collect()
    if not got:
        return m
    flat = np.average([np.frombuffer(r["w"], np.float32) for r in got], axis=0, weights=[r["n"] for r in got]).astype(np.float32)
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + m[k].size].reshape(m[k].shape)
        at += m[k].size
    return out


def score(docs: DataFrame, path: str, pattern: str, learn: str, held_out: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document. ``learn``, ``held_out``: SQL conditions; ``path``, ``pattern``: ranks and pre-token pattern of the subwords."""
    n = X.parts(docs.sparkSession)
    docs = X.settled(docs)
    end = int(max(bpe.read_ranks(path).values())) + 1
    flag = f"case when {learn} then 1 else 0 end + case when {held_out} then 2 else 0 end"
    asked = X.each_chunk(X.pack(docs, doc_id, text, extra=flag, deal=False), _ask(n), X.SENT_SCHEMA)
    replies = X.durable(X.answer(asked, _reply(path, pattern)))
    distinct, total, by_id = _totals(replies)
    ends = docs.where(learn).count()
    counts = np.zeros(end + 1, np.int64)
    counts[list(by_id)] = list(by_id.values())
    counts[end] = ends
    vocabulary = lm.Vocabulary(counts, _begins(path))
    big_n, v = total + ends, distinct + (ends > 0)

    def cut(b, c, answers):
        codes, values, by = _words(c)
        order, bounds = X.deal(values, n)
        known, lens, flat = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), []
        for k in np.flatnonzero(np.diff(bounds)):
            seen, ragged = X.split_blobs(answers[int(k)][0])
            own = order[bounds[k] : bounds[k + 1]]
            known[own] = X.unpack_ints(seen)
            ids, lens[own] = X.unpack_ragged(ragged, np.uint32)
            flat.append(ids)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        starts = np.zeros(len(values), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        logs = np.concatenate([[0], np.cumsum(np.log10(known + 0.5)[codes])])
        found = np.concatenate([[0], np.cumsum((known > 0)[codes])])
        n_tokens = np.diff(by) + 1
        base = logs[by[1:]] - logs[by[:-1]] + np.log10(ends + 0.5) - n_tokens * np.log10(big_n + 0.5 * (v + 1))
        out, spots = B.gather(ids, starts[codes], lens[codes])
        size = np.diff(spots[by])
        learns = c.extra % 2 == 1
        rows = pa.table(
            [c.id_array(), pa.array(c.extra >= 2), pa.array(n_tokens), pa.array(found[by[1:]] - found[by[:-1]] + (ends > 0)), pa.array(np.full(len(c), big_n)), pa.array(base), pa.array(learns)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "learn"],
        )
        return pa.table([pa.array([b]), pa.array([int((size[learns] // (2 * lm.HALF) + 1).sum())]), pa.array([Texts.pack(out, size, rows)], pa.binary())], ["b", "windows", "blob"])

    texts = X.durable(X.finish(X.pack(docs, doc_id, text, extra=flag), replies.where("b >= 0"), cut, TEXTS))
    arrange(texts, vocabulary, end)
    model = docs.sparkSession.sparkContext.broadcast((train(texts, vocabulary, end), vocabulary))

    def scored(batches):
        m, voc = model.value
        for batch in batches:
            for blob in batch.column(0):
                t = Texts(blob.as_py())
                s = lm.score(m, voc, t.ids.astype(np.int64), t.offsets, end) / np.log(10)
                yield from t.rows.drop_columns("learn").append_column("score", pa.array(np.round(s, DIGITS))).combine_chunks().to_batches()
                B.trim()

    return texts.select("blob").mapInArrow(scored, SCORED)

"""Phrase collocations by Apriori passes over levels of n-grams.

Texts are lower-cased (A-Z), split into pieces and words; everything is counted per language. A phrase of k words is a
candidate when it occurs at least ``least`` times, and only if both its phrases of k - 1 words are.

1. Tasks count their distinct words; sums give the frequent words and each language's number of words.
2. Texts become runs of numbers: frequent words by their number, and a break wherever a piece ends or a word is rare. These
   are stored, and later passes read them instead of the texts.
3. For k = 2, 3, 4: a task numbers its phrases of k - 1 words by the level before, and counts a phrase of k words, named by the numbers
   of its two overlapping parts, only where both are frequent. Sums above ``least`` are the next level's table.
4. Cuts are scored from the tables: all parts of a candidate are in them.

A level's table is broadcast while it holds at most ``broadcast_bytes``. It grows with the data, so beyond that each task asks
for its own distinct phrases only, by a join: a phrase in a third of all rows is one row a task, not one an occurrence. Sums
are pre-aggregated in tasks; the best phrases of a language are picked in shares before they meet.

Null texts are empty; a null language is ``und``. Equal scores go by count, then phrase, in the order of UTF-8 bytes. Repeated
rows count each. Texts of any length are read whole, and no piece is cut. Empty tables give no rows. Columns beside the text
and the language are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
BROADCAST_BYTES = 64 << 20
#: Bytes of text whose phrases are counted at once.
SLICE = 8 << 20
#: Separators of words, and those of them that end a piece: fixed by the word rule.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(10, 14)]] = True
_APART = _BREAKS.copy()
_APART[[9, 32]] = True
#: Shares in which the best phrases of a language are picked, one after another.
_SHARES = (4096, 64, 1)
_PAIR_BYTES = 24
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


class _Slice:
    """Texts read together: the distinct (language, word) pairs, and of each word its pair and whether a piece begins with it."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = B.flat(texts)
        data = B.LOWER[data]
        starts, ends, by = B.words(data, offsets, _APART)
        codes, words = B.encode(B.binary(data, starts, ends))
        of, langs = B.encode(langs)
        self.totals = np.bincount(of, np.diff(by), len(langs)).astype(np.int64)
        self.own, pairs = B.encode(pa.array(np.repeat(of.astype(np.int64) * len(words), np.diff(by)) + codes))
        lang, word = np.divmod(pairs.to_numpy(zero_copy_only=False), max(len(words), 1))
        self.langs, self.lang, self.word = langs, langs.take(pa.array(lang)), words.take(pa.array(word))
        ended = np.searchsorted(np.flatnonzero(_BREAKS[data]), starts)
        self.begins = np.ones(len(starts), bool)
        self.begins[1:] = ended[1:] > ended[:-1]
        self.begins[by[by < len(starts)]] = True

    def counts(self) -> np.ndarray:
        return np.bincount(self.own, minlength=len(self.word)).astype(np.int64)

    def coded(self, ids: np.ndarray) -> bytes:
        """The words as numbers (``ids`` of the pairs; -1: rare), with -1 wherever no phrase goes on. Words that stand alone are left out."""
        ids = ids[self.own]
        known = ids >= 0
        begins = self.begins | ~known
        begins[1:] |= ~known[:-1]
        keep = np.flatnonzero(known & ~(begins & np.append(begins[1:], True)))
        return _stored(ids[keep], begins[keep])


def _stored(ids: np.ndarray, begins: np.ndarray) -> bytes:
    out = np.full(len(ids) + int(begins.sum()), -1, np.int64)
    out[np.arange(len(ids)) + np.cumsum(begins)] = ids
    return X.pack_ints(out)


class _Runs:
    """A stored sequence of phrases of k words, and the distinct pairs of neighbours in it: phrases of k + 1 words."""

    def __init__(self, blob: bytes):
        ids = X.unpack_ints(blob)
        codes, values = B.encode(pa.array(ids))
        codes = codes.astype(np.int64)
        self.at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        self.own, pairs = B.encode(pa.array(codes[self.at] * len(values) + codes[self.at + 1]))
        left, right = np.divmod(pairs.to_numpy(zero_copy_only=False), max(len(values), 1))
        values = values.to_numpy(zero_copy_only=False)
        self.left, self.right = values[left], values[right]

    def counts(self) -> np.ndarray:
        return np.bincount(self.own, minlength=len(self.left)).astype(np.int64)

    def coded(self, ids: np.ndarray) -> bytes:
        """The sequence of phrases of k + 1 words."""
        ids = ids[self.own]
        keep = ids >= 0
        at = self.at[keep]
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        alone = begins & np.append(begins[1:], True)
        return _stored(ids[keep][~alone], begins[~alone])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) joined and cut to about SLICE bytes; a longer text is a slice of its own."""
    held, size = [], 0
    for x in batches:
        sizes = np.asarray(pc.binary_length(x.column(1)).fill_null(0)).astype(np.int64)
        at = X.cuts(sizes, SLICE, rows=1 << 30)
        for a, z in zip(at[:-1], at[1:], strict=True):
            if held and size + sizes[a:z].sum() > SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(x.slice(a, z - a))
            size += int(sizes[a:z].sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def _count_words(batches):
    """Rows (lang, word, n) of each slice; a null word stands for all words of the language."""
    for x in _slices(batches):
        s = _Slice(x.column(0), x.column(1))
        yield _batch("lang word n", s.lang, s.word.cast(pa.binary()), s.counts())
        yield _batch("lang word n", s.langs, pa.nulls(len(s.langs), pa.binary()), s.totals)
        B.trim()


def _count_pairs(batches):
    for x in batches:
        for blob in x.column("blob"):
            r = _Runs(blob.as_py())
            yield _batch("left right n", r.left, r.right, r.counts())
            B.trim()


def _numbered(rows: DataFrame, size) -> tuple[DataFrame, int, int]:
    """Stored ``rows`` with a dense number ``id``, how many they are, and the sum of ``size``. Counts a partition come to the driver, no rows."""
    rows = X.durable(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.sum(size).alias("s")).collect())
    base = np.cumsum([0, *(r["c"] for r in counts)]).tolist()
    starts = rows.sparkSession.createDataFrame([(r["p"], b) for r, b in zip(counts, base, strict=False)], "_p long, _base long")
    placed = rows.join(F.broadcast(starts), part == F.col("_p")).withColumn("id", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.drop("_id", "_p", "_base"), base[-1], sum(r["s"] for r in counts)


class _Lookup:
    """Numbers of pairs (left, right) in a table of them; -1 for the others."""

    def __init__(self, left: pa.Array, right: pa.Array, ids: np.ndarray):
        a, self.lefts = B.encode(left)
        b, self.rights = B.encode(right)
        key = a.astype(np.int64) * len(self.rights) + b
        order = np.argsort(key)
        self.key, self.ids = key[order], ids[order]

    def __call__(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        if not len(self.key):
            return np.full(len(left), -1, np.int64)
        a = pc.index_in(left, self.lefts).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        b = pc.index_in(right, self.rights).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        want = a * len(self.rights) + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((self.key[at] == want) & (a >= 0) & (b >= 0), self.ids[at], -1)


def _flat(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _lookup(table: pa.Table) -> _Lookup:
    """Of columns (left or lang, right or word, id)."""
    right = _flat(table.column(1))
    return _Lookup(_flat(table.column(0)), right.cast(pa.large_binary()) if pa.types.is_binary(right.type) else right, _flat(table.column(2)).to_numpy(zero_copy_only=False))


def _code_by_broadcast(rows: DataFrame, table: DataFrame, of_texts: bool) -> DataFrame:
    """Blobs of the next level, by a table of a checked size that every task has."""
    known = rows.sparkSession.sparkContext.broadcast(table.toArrow())

    def run(batches):
        find = _lookup(known.value)
        if of_texts:
            for x in _slices(batches):
                s = _Slice(x.column(0), x.column(1))
                yield _batch("blob", pa.array([s.coded(find(s.lang, s.word))], pa.binary()))
                B.trim()
        else:
            for x in batches:
                for blob in x.column("blob"):
                    r = _Runs(blob.as_py())
                    yield _batch("blob", pa.array([r.coded(find(pa.array(r.left), pa.array(r.right)))], pa.binary()))
                    B.trim()

    return rows.mapInArrow(run, "blob binary")


def _code_by_join(rows: DataFrame, table: DataFrame, of_texts: bool) -> DataFrame:
    """The same for tables of any size: each slice asks for its distinct phrases by a join."""
    keys = ["lang", "word"] if of_texts else ["left", "right"]

    def number(batches):
        part = TaskContext.get().partitionId()
        if of_texts:
            blobs = (X.press(X._ipc(x, 0)) for x in _slices(batches))
        else:
            blobs = (blob.as_py() for x in batches for blob in x.column("blob"))
        for i, blob in enumerate(blobs):
            yield _batch("b blob", pa.array([(part << 24) + i]), pa.array([blob], pa.binary()))

    def read(blob: bytes):
        if not of_texts:
            r = _Runs(blob)
            return r, pa.array(r.left), pa.array(r.right)
        x = pa.ipc.open_stream(X.unpress(blob)).read_all()
        s = _Slice(_flat(x.column(0)), _flat(x.column(1)))
        return s, s.lang, s.word.cast(pa.binary())

    def ask(batches):
        for x in batches:
            for b, blob in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                _, left, right = read(blob.as_py())
                yield _batch(f"b i {keys[0]} {keys[1]}", pa.array([b] * len(left), pa.int64()), np.arange(len(left)), left, right)
                B.trim()

    def code(one: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for blob in one.column("blob"):
            s, left, _ = read(blob.as_py())
            ids = np.full(len(left), -1, np.int64)
            ids[_flat(known.column("i")).to_numpy(zero_copy_only=False)] = _flat(known.column("id")).to_numpy(zero_copy_only=False)
            out.append(s.coded(ids))
        B.trim()
        return pa.table([pa.array(out, pa.binary())], ["blob"])

    slices = X.durable(rows.mapInArrow(number, "b long, blob binary"))
    asked = slices.mapInArrow(ask, f"b long, i long, {keys[0]} {'string' if of_texts else 'long'}, {keys[1]} {'binary' if of_texts else 'long'}")
    known = asked.join(table, keys).select("b", "i", "id")
    return slices.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(code, "blob binary")


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and a table of frequent phrases for each length from one word on.

    Level 1: id, lang, word (UTF-8), n. Level k: id, left and right (ids of its first and last k - 1 words in level k - 1), n.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = X.durable(counts.where(F.col("word").isNull() | (F.col("n") >= least)))
    size = F.octet_length("lang") + F.octet_length("word") + _PAIR_BYTES
    table, rows, held = _numbered(counts.where("word is not null"), size)
    out, at, keys = [table], texts, ["lang", "word"]
    for k in range(2, longest + 1):
        if not rows:
            table = docs.sparkSession.createDataFrame([], "left long, right long, n long, id long")
        else:
            code = _code_by_broadcast if (held or 0) <= broadcast_bytes else _code_by_join
            at = X.durable(code(at, table.select(*keys, "id"), k == 2))
            keys = ["left", "right"]
            found = at.mapInArrow(_count_pairs, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            table, rows, held = _numbered(found, F.lit(_PAIR_BYTES))
        out.append(table)
    return counts.where("word is null").select("lang", "n"), out


def scored(tables: list[DataFrame], cover: int = COVER) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) of the level tables, cut where the score is least, without those that a longer one covers."""
    grams = tables[0].select("id", "lang", F.decode("word", "UTF-8").alias("phrase"), F.decode("word", "UTF-8").alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    out = None
    for k, table in enumerate(tables[1:], 2):
        left = grams.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        right = grams.select(F.col("id").alias("right"), "last", "tails")
        # the counts of its first 1, 2, ... words and of its last ones
        grams = table.join(left, "left").join(right, "right").select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"), F.col("n").alias("a"),
        )
        wide = "decimal(20,0)"  # products may pass 64 bits
        cuts = [F.struct(F.expr(f"(cast(a as {wide}) * 2000000) div (cast(heads[{j - 1}] as {wide}) + cast(tails[{k - j - 1}] as {wide}))").alias("score"), F.lit(j).alias("k"), F.expr(f"heads[{j - 1}]").alias("l"), F.expr(f"tails[{k - j - 1}]").alias("r")) for j in range(1, k)]
        here = grams.withColumn("cut", F.array_min(F.array(*cuts)))
        if k < len(tables):
            above = tables[k]
            longer = above.select(F.col("left").alias("id"), "n").union(above.select(F.col("right").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("longer"))
            here = here.join(longer, "id", "left").where(f"longer is null or cast(longer as {wide}) * 100 < cast(a as {wide}) * {cover}")
        here = here.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = here if out is None else out.union(here)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each language's ``top`` phrases by score."""
    totals, tables = levels(docs, text, lang, least, longest, broadcast_bytes)
    best = scored(tables, cover)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for n in _SHARES:
        share = F.pmod(F.xxhash64("phrase"), F.lit(n))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Language identification by interpolated Kneser-Ney character models, one for each language.

Words are runs of letters, lower-cased; a model gives each letter and each word's end after the three before it. Counts cover all
learning rows: tasks count the n-grams of their distinct words and buckets of n-grams add them up. Models are sorted arrays of
n-gram keys. The driver gets the summed tables if they are small; beyond ``model_bytes`` the same arrays are made by Spark, written to the
shared folder and mapped into memory, so a model of any size has all its orders and counts. The language of the lowest cross-entropy per letter is chosen; a
logistic fit on a bounded sample of learning rows turns its lead over the next into a probability, and leads under the calibrated
bound are rejected.

A null text, or one without a letter, is ``und`` with score 0. Texts of letters that no model has seen get the language with the
lowest cross-entropy all the same. Ties go to the first language by name. Without learning rows all is ``und``. Repeated rows get
the same prediction, and count once in the sample; texts of any length are used whole. The result has its own columns only, so others may have any names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X
from . import files

ORDER = 4
MODEL_BYTES = 96 << 20
SAMPLE = 1000
PRECISION = 0.995
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double"

_PAD, _END, _BREAK = 1, 2, 10
#: Bytes that part words: ASCII but letters. Other characters that are no letters part words once they are decoded.
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def events(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys (16 bits a letter, the last in the low bits) of all letters and ends, and the word each is in."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = b"\n".join(words.to_pylist()).decode("utf-8", "replace").lower() + "\n"
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = cp == _BREAK
    word = np.cumsum(line) - line
    letter = _letters()[cp]
    code = np.where(cp > 0xFFFF, 0xE000 + cp % 0x1000, cp).astype(np.uint64)
    prev = np.concatenate([[False], letter[:-1]])
    event = letter | prev  # a letter, or the end of a run of letters
    code[~letter] = _END
    n = len(cp)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(letter & ~prev, at, 0))
    key = code.copy()
    for j in range(1, ORDER):
        before = np.concatenate([np.full(min(j, n), _PAD, np.uint64), code[: max(n - j, 0)]])
        key |= np.where(at - j >= start, before, np.uint64(_PAD)) << np.uint64(16 * j)
    return key[event], word[event].astype(np.int64)


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    starts, ends, by = B.words(data, offsets, _NOT_LETTER)
    codes, values = B.encode(B.binary(data, starts, ends))
    return codes, values, by


def count(rows: DataFrame) -> DataFrame:
    """n-grams and counts of each language, by buckets (lang, k, blob, n). rows: lang, text."""
    n = X.parts(rows.sparkSession)

    def run(batches):
        held: dict[str, list] = {}

        def fold(lang: str) -> None:
            k, c = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            held[lang] = [merge(k, c)]

        for x in batches:
            langs, at = B.encode(x.column(0))
            for i, lang in enumerate(at.to_pylist()):
                own = x.column(1).filter(pa.array(langs == i))
                sizes = np.asarray(pc.binary_length(own).fill_null(0)).astype(np.int64)
                cut = X.cuts(sizes, X.CHUNK_BYTES)
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    codes, values, _ = distinct_words(*B.flat(own.slice(lo, hi - lo)))
                    keys, word = events(values)
                    held.setdefault(lang, []).append(merge(keys, np.bincount(codes, minlength=len(values))[word]))
                    if len(held[lang]) > 8:
                        fold(lang)
        for lang in held:
            fold(lang)
            (keys, counts), = held[lang]
            k = (B.mix(keys) % np.uint64(n)).astype(np.int64)
            for b in np.unique(k).tolist():
                own = k == b
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b], pa.int32()), pa.array([X.join_blobs(X.pack_sorted(keys[own]), X.pack_ints(counts[own]))], pa.binary())], ["lang", "k", "blob"])

    def add(t: pa.Table) -> pa.Table:
        parts = [X.split_blobs(x.as_py()) for x in t.column("blob")]
        keys, counts = merge(np.concatenate([X.unpack_sorted(a) for a, _ in parts]), np.concatenate([X.unpack_ints(b) for _, b in parts]))
        return pa.table([t.column("lang")[:1].combine_chunks(), t.column("k")[:1].combine_chunks(), pa.array([X.join_blobs(X.pack_sorted(keys), X.pack_ints(counts))], pa.binary()), pa.array([len(keys)])], ["lang", "k", "blob", "n"])

    return X.durable(rows.mapInArrow(run, "lang string, k int, blob binary").groupBy("lang", "k").applyInArrow(add, "lang string, k int, blob binary, n long"))


def models(summed: DataFrame, model_bytes: int = MODEL_BYTES) -> dict[str, Model]:
    """A model of each language."""
    if 16 * (summed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) > model_bytes:
        return stored(summed)
    out: dict[str, list] = {}
    for r in summed.select("lang", "blob").toLocalIterator():
        a, b = X.split_blobs(r["blob"])
        out.setdefault(r["lang"], []).append((X.unpack_sorted(a), X.unpack_ints(b)))
    return {lang: Model(*merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))) for lang, parts in sorted(out.items())}


def stored(summed: DataFrame) -> dict[str, Model]:
    """The same models from tables in the shared folder: no task or driver holds a language's n-grams."""
    spark = summed.sparkSession
    folder = files.fresh(X.shared_dir(spark), "letters")

    def flat(batches):
        for x in batches:
            for lang, blob in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                a, b = X.split_blobs(blob.as_py())
                keys = X.unpack_sorted(a)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(X.unpack_ints(b))], ["lang", "key", "n"])

    def shards(name: str, kinds: tuple):
        def run(batches):
            part = TaskContext.get().partitionId()
            for i, x in enumerate(batches):  # in order by language and key
                langs, at = B.encode(x.column(0))
                for j, lang in enumerate(at.to_pylist()):
                    own = x.filter(pa.array(langs == j))
                    uri = f"{folder}/{name}-{part:06}-{i:06}-{j:06}"
                    for c, kind in enumerate(kinds, 1):
                        files.put(f"{uri}-{c}", [own.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([uri]), pa.array([len(own)])], ["lang", "uri", "n"])

        return run

    def join(t: pa.Table) -> pa.Table:
        """One file of each column from a table's shards, read one at a time."""
        lang, name, kinds = t.column("lang")[0].as_py(), t.column("name")[0].as_py(), t.column("kinds")[0].as_py()
        uris = sorted(t.column("uri").to_pylist())
        whole = f"{folder}/{name}-{lang.encode().hex()}"
        for c in range(1, kinds + 1):
            files.put(f"{whole}-{c}", (files.read(f"{u}-{c}") for u in uris))
        return pa.table([t.column("lang")[:1].combine_chunks(), t.column("name")[:1].combine_chunks(), pa.array([whole]), pa.array([sum(t.column("n").to_pylist())])], ["lang", "name", "uri", "n"])

    def write(df: DataFrame, name: str, kinds: tuple) -> dict[str, tuple[str, int]]:
        order = F.col(df.columns[1]).bitwiseXOR(F.lit(-(1 << 63)))  # as numbers without sign
        rows = df.withColumn("_o", order).repartitionByRange(X.parts(spark), "lang", "_o").sortWithinPartitions("lang", "_o").drop("_o")
        made = X.durable(rows.mapInArrow(shards(name, kinds), "lang string, uri string, n long"))
        got = made.withColumn("name", F.lit(name)).withColumn("kinds", F.lit(len(kinds))).groupBy("lang").applyInArrow(join, "lang string, name string, uri string, n long").collect()
        return {r["lang"]: (r["uri"], r["n"]) for r in got}

    grams = X.durable(summed.select("lang", "blob").mapInArrow(flat, "lang string, key long, n long"))
    parts: dict[str, list] = {}
    for o in range(ORDER, 0, -1):
        if o < ORDER:  # in how many contexts each shorter n-gram was seen
            grams = X.durable(grams.groupBy("lang", F.col("key").bitwiseAND((1 << 16 * o) - 1).alias("key")).agg(F.count("*").alias("n")))
        few = {r["lang"]: (r["a"], r["b"]) for r in grams.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect()}  # as many rows as languages
        d = {lang: discount(a, b) for lang, (a, b) in few.items()}
        rate = spark.createDataFrame(sorted(d.items()), "lang string, d double")
        rows = grams.withColumn("history", F.shiftrightunsigned("key", 16))
        sums = rows.groupBy("lang", "history").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        p = rows.join(sums, ["lang", "history"]).join(F.broadcast(rate), "lang").selectExpr("lang", "key", "greatest(n - d, 0D) / total as p")
        left = sums.join(F.broadcast(rate), "lang").selectExpr("lang", "history", "d * kinds / total as share")
        keys, heads = write(p, f"p{o}", (np.uint64, np.float64)), write(left, f"h{o}", (np.uint64, np.float64))
        for lang in d:
            parts.setdefault(lang, []).append((o, *keys[lang], *heads[lang]))
    return {lang: Stored(parts[lang]) for lang in sorted(parts)}


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Model:
    """Interpolated Kneser-Ney over sorted arrays: for each order the n-grams' discounted probabilities and their histories' shares for the next order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []
        for o in range(ORDER, 0, -1):
            if o < ORDER:  # in how many contexts each shorter n-gram was seen
                keys, counts = merge(keys & np.uint64((1 << 16 * o) - 1), np.ones(len(keys), np.int64))
            history = keys >> np.uint64(16)
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            d = discount(n1, n2)
            first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
            total, kinds = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))
            p = np.maximum(counts - d, 0) / np.repeat(total, kinds)
            self.orders.append((o, keys, p, history[first], d * kinds / total))
        self.letters = len(keys) + 1

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the last letters of these n-grams."""
        p, share = np.zeros(len(grams)), np.ones(len(grams))
        for o, keys, prob, history, left in self.orders:
            g = grams & np.uint64((1 << 16 * o) - 1) if o < 4 else grams
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            p += np.where(keys[at] == g, share * prob[at], 0)
            h = g >> np.uint64(16)
            at = np.minimum(np.searchsorted(history, h), len(history) - 1)
            share = np.where(history[at] == h, share * left[at], share)
        return np.log(p + share / max(self.letters, 256))


class Stored(Model):
    """A model whose arrays lie in the shared folder: only their names go to executors, which map them into memory."""

    def __init__(self, parts: list[tuple]):
        self.parts, self.letters = parts, parts[-1][2] + 1

    @property
    def orders(self):
        for o, p, n, h, m in self.parts:
            yield o, files.mapped(f"{p}-1", np.uint64, n), files.mapped(f"{p}-2", np.float64, n), files.mapped(f"{h}-1", np.uint64, m), files.mapped(f"{h}-2", np.float64, m)


class Identifier:
    """Models by language with the calibration."""

    def __init__(self, models: dict[str, Model]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.fit, self.bound = np.array([0.0, 1.0, 0.0]), 0.0

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per event by text and language, and the number of events."""
        codes, values, by = distinct_words(data, offsets)
        keys, word = events(values)
        grams, which = np.unique(keys, return_inverse=True)
        n = np.bincount(word, minlength=len(values)).astype(np.float64)
        sums = [np.concatenate([[0], np.cumsum(n[codes])])]
        for m in self.models:
            s = np.bincount(word, weights=m.log_p(grams)[which], minlength=len(values))
            sums.append(np.concatenate([[0], np.cumsum(s[codes])]))
        count, *scores = [s[by[1:]] - s[by[:-1]] for s in sums]
        return -np.stack(scores, axis=1) / np.maximum(count, 1)[:, None] if scores else np.zeros((len(count), 0)), count

    def lead(self, e: np.ndarray, count: np.ndarray):
        best = e.argmin(axis=1)
        low = np.sort(e, axis=1)
        gap = low[:, 1] - low[:, 0] if e.shape[1] > 1 else np.full(len(e), 1.0)
        return best, low[:, 0], np.stack([np.ones(len(e)), gap * np.sqrt(count), -low[:, 0]], axis=1)

    def calibrate(self, langs: list[str], data: np.ndarray, offsets: np.ndarray, precision: float) -> None:
        """Fits the probability that the best language is right, and the least score that keeps this precision on the sample."""
        e, count = self.entropies(data, offsets)
        ok = count > 0
        if not ok.any() or len(self.langs) < 2:
            return
        best, _, x = self.lead(e[ok], count[ok])
        y = (np.array(langs)[ok] == np.array(self.langs)[best]).astype(float)
        x[:, 1] = np.log1p(x[:, 1])
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.5
            w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.5 * w), -5, 5)
        self.fit = w
        score = self.scores(x)
        order = np.argsort(-score)
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        self.bound = float(score[order][good[-1]]) if len(good) else 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))

    def table(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        lang, score, reject, ce = np.full(n, "und", object), np.zeros(n), np.ones(n, bool), np.full(n, np.nan)
        if self.langs:
            e, count = self.entropies(*B.flat(texts))
            ok = np.flatnonzero(count > 0)
            if len(ok):
                best, low, x = self.lead(e[ok], count[ok])
                x[:, 1] = np.log1p(x[:, 1])
                lang[ok], score[ok], ce[ok] = np.array(self.langs, object)[best], self.scores(x), low
                reject[ok] = score[ok] < self.bound
        return pa.RecordBatch.from_arrays([ids, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(reject), pa.array(ce, mask=np.isnan(ce))], ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])


def train(docs: DataFrame, learn: str, lang: str = "lang", text: str = "text", order_by: str = "doc_id", model_bytes: int = MODEL_BYTES, sample: int = SAMPLE, precision: float = PRECISION) -> Identifier:
    """Learns from the rows for which the SQL condition ``learn`` holds and that have a language and a text."""
    rows = docs.where(learn).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    made = Identifier(models(count(rows.selectExpr(f"cast(`{lang}` as string) as lang", f"cast(`{text}` as string) as text")), model_bytes))
    ids = _sample(rows.selectExpr(f"xxhash64(`{order_by}`, `{lang}`, `{text}`) as h", f"cast(`{lang}` as string) as lang", f"cast(`{text}` as string) as text"), sample).toArrow()
    if ids.num_rows:
        made.calibrate(ids["lang"].to_pylist(), *B.flat(ids["text"]), precision)
    return made


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """(lang, text) of the ``n`` different rows of least hash (h, lang, text): texts travel only for some times as many as are asked for."""
    kinds = rows.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    share = min(1.0, 8 * (n + 100) / max(kinds, 1))
    low = rows.where(F.col("h") <= F.lit(min(int(share * 2.0**64) - (1 << 63), (1 << 63) - 1))).dropDuplicates(["h"])
    return low.orderBy("h").limit(n).select("lang", "text")


def identify(docs: DataFrame, model: Identifier, doc_id: str = "doc_id", text: str = "text", reject: bool = True) -> DataFrame:
    """One row per document. ``reject``: rejected ones are ``und``; else they keep the best language and are only marked."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for x in batches:
            sizes = np.asarray(pc.binary_length(x.column(1)).fill_null(0)).astype(np.int64)
            at = X.cuts(sizes, X.CHUNK_BYTES)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                part = x.slice(lo, hi - lo)
                yield m.table(part.column(0), part.column(1))
                B.trim()

    out = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, PREDICTED)
    return out.withColumn("lang_pred", F.when(F.col("rejected"), "und").otherwise(F.col("lang_pred"))) if reject else out

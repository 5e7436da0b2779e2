"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words in a row (lower-cased runs of letters and digits; a shorter text is one shingle). A shingle's weight
is ``(1 + ln tf) * (1 + ln((1 + N) / (1 + df)) / ln(1 + N))``: tf in the text, df over all N documents. The idf lies between 1
and 2, so that what thousands of copies share still weighs at least half of what one has alone. Two texts are linked if their
weighted Jaccard similarity is 0.8 or more; classes are what links connect.

1. Chunks ask for the df of their distinct shingles and sample each text (``bands * rows`` samples).
2. Equal texts count once. Texts that share a band, and whose weights allow it, are candidates; candidates that connect are a group.
3. The vectors of a group's texts meet in one task if they are few, where every pair is compared that isn't connected already. A group of
   more texts is mostly a chain of unlike ones, as any two that share a band join it, and grows faster than the input. Of it only texts that
   share a band meet: first each band's with the one that shares most bands, then those that still are in another class than most of a
   band's with all of that band's, in tasks of bounded size; a pair is compared in the first band that it shares.

Null texts and texts without words have no shingles: equal non-empty ones are copies, all others are classes of their own.
A class is named by its least id (null if it has none). Rows of equal id are rows like any other. Texts of any length have all their
shingles; other columns are carried as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 2
KEY_BITS = 48
TASK_TEXTS, TASK_WEIGHT = 1024, 1 << 20
CLASSES = "doc_id long, class_id long"
_TEXT = np.uint64(X.CHUNK_ROWS - 1)


class Shingles:
    """Distinct shingles by text (text, hash, tf), and a chunk's distinct keys for df with their numbers of documents."""

    def __init__(self, c: X.Chunk, size: int):
        data = B.LOWER[c.data]
        starts, ends, by = B.words(data, c.offsets, B.NOT_ALNUM)
        h = B.hashes(data, starts, ends)
        w, _ = B.windows(h, by, size)
        n = np.diff(by)
        text = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
        few = np.flatnonzero((n > 0) & (n < size))
        if len(few):  # whole texts of fewer words
            own = np.zeros(len(few), np.uint64)
            for j in range(size):
                live = n[few] > j
                own[live] = own[live] * B._ODD + h[by[few[live]] + j]
            w, text = np.concatenate([w, B.mix(own + np.uint64(1))]), np.concatenate([text, few])
        # a shingle is the upper bits of its hash; the lower ones hold the text, of which a chunk has at most 4,096
        z = np.sort(w & ~_TEXT | text.astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]])) if len(z) else np.zeros(0, np.int64)
        h, text, tf = z[first] & ~_TEXT, (z[first] & _TEXT).astype(np.int64), np.diff(np.append(first, len(z)))
        key = h >> np.uint64(64 - KEY_BITS)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.docs = key[first], np.diff(np.append(first, len(key)))
        code = np.repeat(np.arange(len(first)), self.docs)
        order = np.argsort(text.astype(np.uint16), kind="stable")
        self.hash, self.text, self.tf, self.code = h[order], text[order], tf[order], code[order]

    def weigh(self, answers: dict[int, list[bytes]], n: int, total: int) -> np.ndarray:
        df = self.docs.copy()
        at = _bounds(self.keys, n)
        for k, blobs in answers.items():
            if k >= 0:
                own, counts = X.split_blobs(blobs[0])
                df[X.unpack_sorted(own).astype(np.int64) + at[k]] = X.unpack_ints(counts)
        idf = 1 + np.log((1 + total) / (1 + np.minimum(df, total))) / np.log(1 + max(total, 1))
        return ((1 + np.log(self.tf)) * idf[self.code]).astype(np.float32)


def _bounds(keys: np.ndarray, n: int) -> np.ndarray:
    step = (1 << KEY_BITS) // n + 1
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) * np.uint64(step))


def _ask(n: int, size: int):
    def ask(b, c):
        s = Shingles(c, size)
        at = _bounds(s.keys, n)
        ks = np.flatnonzero(np.diff(at))
        if len(ks):
            yield X.sent(b, ks, [X.join_blobs(X.pack_sorted(s.keys[at[k] : at[k + 1]]), X.pack_ints(s.docs[at[k] : at[k + 1]])) for k in ks])

    return ask


def _frequencies(k, chunks, blobs):
    """For each chunk: places of its keys that more documents have than its own, and how many do."""
    parts = [X.split_blobs(x) for x in blobs]
    keys = [X.unpack_sorted(x) for x, _ in parts]
    counts = [X.unpack_ints(y) for _, y in parts]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    sums = np.add.reduceat(np.concatenate(counts)[order], first)
    total = np.empty(len(s), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(s))))
    at = 0
    for b, own in zip(chunks, counts, strict=True):
        df = total[at : at + len(own)]
        at += len(own)
        more = np.flatnonzero(df > own)
        if len(more):
            yield b, X.join_blobs(X.pack_sorted(more.astype(np.uint64)), X.pack_ints(df[more]))


_DRAW = 12


@lru_cache(2)
def _draws(n: int) -> tuple[np.ndarray, ...]:
    """Tables by _DRAW bits of 1 / r, r and ln c (Gamma(2, 1)) and beta - 1 (uniform), and n odd multipliers. Fixed by a seed, so the same on every executor."""
    rng = np.random.default_rng(20240229)
    r, c, beta = rng.gamma(2, 1, 1 << _DRAW), np.log(rng.gamma(2, 1, 1 << _DRAW)), rng.random(1 << _DRAW)
    return *(x.astype(np.float32) for x in (1 / r, r, c, beta)), rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def samples(hashes: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have shingles (in order), and n consistent weighted samples of each (rows): equal with the probability of the weighted Jaccard similarity."""
    inverse, r_of, c_of, b_of, odd = _draws(n)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(text)))
    out = np.zeros((len(first), n), np.uint64)
    log_w = np.log(weights)
    low, shift = np.uint64((1 << _DRAW) - 1), [np.uint64(64 - _DRAW * k) for k in (1, 2, 3)]
    step = 1 << 15
    at = 0
    while at < len(first):  # in blocks that stay in the cache
        end = max(at + 1, int(np.searchsorted(first, first[at] + step, side="right")) - 1) if first[-1] - first[at] > step else len(first)
        i, j = first[at], first[end] if end < len(first) else len(text)
        h, lw, own, heads = hashes[i:j], log_w[i:j], counts[at:end], first[at:end] - i
        for k in range(n):
            z = h * odd[k]  # the high bits of a product with a random odd number
            x = (z >> shift[0]).view(np.int64)
            r = r_of[x]
            beta = b_of[(z >> shift[1] & low).view(np.int64)]
            t = lw * inverse[x]
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            beta += c_of[(z >> shift[2] & low).view(np.int64)]  # ln c - r (t - beta + 1)
            best = np.flatnonzero(beta == np.repeat(np.minimum.reduceat(beta, heads), own))
            pick = best[np.searchsorted(best, heads)]
            out[at:end, k] = B.mix(h[pick] ^ B.mix(t[pick].astype(np.int64).astype(np.uint64) + np.uint64(k)))
        at = end
    return text[first], out


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sampled), bands), np.uint64)
    for r in range(rows):
        key = key * B._ODD + sampled[:, r::rows][:, :bands]
    return B.mix(key + np.arange(bands, dtype=np.uint64))


def sized(keys: np.ndarray, weight: np.ndarray, similarity: float) -> np.ndarray:
    """Each key twice, with the text's class of weight and with the next: similar texts are at most one class apart, so they share one of the two."""
    z = np.floor(np.log(np.maximum(weight, 1e-9)) / -np.log(similarity - 1e-4)).astype(np.int64).astype(np.uint64)
    return np.concatenate([B.mix(keys ^ B.mix(z + np.uint64(k))[:, None]) for k in (0, 1)], axis=1)


SIGNED = "uid long, doc_id long, t1 long, t2 long, keys array<long>, size int"


def _sign(n: int, size: int, bands: int, rows: int, total: int, similarity: float):
    def done(b, c, answers):
        s = Shingles(c, size)
        w = s.weigh(answers, n, total)
        own, sampled = samples(s.hash, w, s.text, bands * rows)
        keys = sized(band_keys(sampled, bands, rows), np.bincount(s.text, weights=w, minlength=len(c))[own], similarity).astype(np.int64)
        lens = np.zeros(len(c), np.int64)
        lens[own] = 2 * bands
        offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        raw = memoryview(c.data)
        uid = X.row_id(b, np.arange(len(c)))
        th = [xxhash.xxh3_128_intdigest(raw[i:j]) for i, j in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)]
        # texts that are empty are nobody's copies
        th = [t if j > i else 1 << 127 | u for t, i, j, u in zip(th, c.offsets[:-1].tolist(), c.offsets[1:].tolist(), uid.tolist(), strict=True)]
        halves = [np.array([t >> s & (1 << 64) - 1 for t in th], np.uint64).astype(np.int64) for s in (64, 0)]
        return pa.table([pa.array(uid), c.id_array(), pa.array(halves[0]), pa.array(halves[1]), pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.ravel())), pa.array(np.bincount(s.text, minlength=len(c)), pa.int32())], ["uid", "doc_id", "t1", "t2", "keys", "size"])

    return done


VECTORS = "uid long, blob binary"


def _vectors(n: int, size: int, total: int):
    blank = X.empty(VECTORS)

    def done(b, c, answers):
        wanted = np.sort(np.concatenate([X.unpack_ints(x) for x in answers[-1]])) if -1 in answers else np.zeros(0, np.int64)
        if not len(wanted):
            return blank
        s = Shingles(c, size)
        w = s.weigh(answers, n, total)
        lo, hi = np.searchsorted(s.text, wanted), np.searchsorted(s.text, wanted, side="right")
        blobs = [X.join_blobs(X.pack_sorted(s.hash[i:j]), X.press(w[i:j].tobytes())) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        return pa.table([pa.array(X.row_id(b, wanted)), pa.array(blobs, pa.binary())], ["uid", "blob"])

    return done


def connect(hashes: list[np.ndarray], weights: list[np.ndarray], label: np.ndarray, similarity: float, only: list[int] | None = None, meets: Callable | None = None) -> np.ndarray:
    """Labels after linking all pairs of texts of at least this weighted Jaccard similarity; pairs of one label need no comparison.

    ``only``: texts of which a pair has one at least. ``meets``: of a text and an array of others, those to compare. A text is compared with all of other labels at once.
    """
    n = len(hashes)
    sizes = np.array([len(h) for h in hashes])
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)
    w = np.concatenate(weights).astype(np.float64)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    total = np.add.reduceat(w, offs[:-1])
    parent = label.copy()
    dense = np.zeros(int(code.max()) + 1)
    done = np.zeros(n, bool)
    for i in range(n) if only is None else only:
        others = np.flatnonzero((parent != parent[i]) & ~done)
        done[i] = True
        if not len(others):
            if (parent == parent[0]).all():
                break
            continue
        # the lesser weight can't be under the similarity's share of the greater
        others = others[np.minimum(total[others], total[i]) >= similarity * np.maximum(total[others], total[i]) * (1 - 1e-9)]
        if meets is not None and len(others):
            others = meets(i, others)
        if not len(others):
            continue
        own = slice(offs[i], offs[i + 1])
        dense[code[own]] = w[own]
        at, edge = B.gather(np.arange(len(w)), offs[:-1][others], sizes[others])
        both = np.add.reduceat(np.minimum(w[at], dense[code[at]]), edge[:-1])
        dense[code[own]] = 0
        for j in others[both >= similarity * (total[others] + total[i] - both) * (1 - 1e-12)].tolist():
            a, z = sorted((parent[i], parent[j]))
            if a != z:
                parent[parent == z] = a
    return parent


def first_shared(keys: np.ndarray, place: np.ndarray) -> Callable:
    """For ``connect``, of texts that share a key, which stands at this place among each one's keys (see ``sized``): whether it is the first one that two of them share."""
    bands = keys.shape[1] // 2
    before = place[0] % bands
    own, up = keys[:, :before], keys[:, bands : bands + before]

    def meets(i: int, others: np.ndarray) -> np.ndarray:
        if place[i] >= bands:  # two that have it by the class next to their own share one by their own
            others = others[place[others] < bands]
        o, u = own[others], up[others]
        return others[~((o == own[i]) | (o == up[i]) | (u == own[i])).any(axis=1)]

    return meets


def _verify(similarity: float):
    """Of texts (uid, label, lead, blob), pairs with a leader if there is one; of those that share a key (keys, place), pairs that share none before."""

    def run(t: pa.Table) -> pa.Table:
        label, lead = (t.column(c).to_numpy() for c in ("label", "lead"))
        parts = [X.split_blobs(x.as_py()) for x in t.column("blob")]
        meets = None
        if "keys" in t.column_names:
            meets = first_shared(t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(t), -1), t.column("place").to_numpy())
        only = np.flatnonzero(lead).tolist() or None
        got = connect([X.unpack_sorted(a) for a, _ in parts], [np.frombuffer(X.unpress(z), np.float32) for _, z in parts], label, similarity, only, meets)
        new = got != label
        B.trim()
        return pa.table([pa.array(label[new]), pa.array(got[new])], ["u", "v"])

    return run


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, carry: list[str] | None = None):
    """(uid, doc_id, rep, class): each row, the row that stands for its text, and the row that stands for its class; with the chunks."""
    spark = docs.sparkSession
    n = X.parts(spark)
    docs = X.settled(docs)
    total = docs.count()
    chunks = X.pack(docs, doc_id, text, carry=carry)
    asked = X.each_chunk(X.pack(docs, doc_id, text, deal=False), _ask(n, size), X.SENT_SCHEMA)
    df = X.durable(X.answer(asked, _frequencies))
    signed = X.durable(X.finish(chunks, df, _sign(n, size, bands, rows, total, similarity), SIGNED))
    reps = signed.groupBy("t1", "t2").agg(F.min("uid").alias("rep"))
    signed = X.durable(signed.join(reps, ["t1", "t2"]).select("uid", "doc_id", "rep", F.when(F.col("uid") == F.col("rep"), F.col("keys")).alias("keys"), "size"))
    # a key holds its band's number; one text may have it by its own class of weight and another by the next
    banded = signed.where("uid = rep").select("uid", F.explode("keys").alias("key"))
    low = banded.groupBy("key").agg(F.min("uid").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = banded.join(low, "key").where("uid <> low").select("uid", "low")
    groups = components(edges)
    groups = X.durable(groups.select(F.col("u").alias("uid"), F.col("v").alias("grp")).union(groups.select(F.col("v").alias("uid"), F.col("v").alias("grp")).distinct()))
    wanted = groups.select((F.shiftright("uid", 12)).alias("b"), F.col("uid").bitwiseAND(4095).alias("i")).groupBy("b").applyInArrow(_places, X.ANSWER_SCHEMA)
    vectors = X.durable(X.finish(X.pack(docs, doc_id, text), df.union(wanted), _vectors(n, size, total), VECTORS))
    links = _links(signed, groups, vectors, similarity)
    named = signed.join(links.withColumnsRenamed({"u": "rep", "v": "cls"}), "rep", "left").select("uid", "doc_id", "rep", F.coalesce("cls", "rep").alias("cls"))
    return named, chunks


def _places(t: pa.Table) -> pa.Table:
    """Rows wanted of a chunk, as its answer -1."""
    return pa.table([pa.array(t.column("b").to_numpy()[:1]), pa.array([-1], pa.int32()), pa.array([X.pack_ints(t.column("i").to_numpy())], pa.binary())], ["b", "k", "blob"])


def _tasks(texts: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): how many tasks of bounded size each key's texts (size) take."""
    return texts.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / TASK_TEXTS), F.ceil(F.sum("size") / TASK_WEIGHT)).cast("int").alias(name))


def _links(signed: DataFrame, groups: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """(u, v): text u belongs to the class that v stands for."""
    member = groups.join(signed.where("uid = rep").select("uid", "size", "keys"), "uid")
    large = X.durable(_tasks(member, "grp", "tasks").where("tasks > 1"))
    some = large.limit(1).count() > 0
    small = groups.join(large, "grp", "left_anti") if some else groups
    found = _compared(small.select("grp", "uid", F.col("uid").alias("label"), F.lit(False).alias("lead")), vectors, ["grp"], similarity)
    return _links_of_large(member.join(large, "grp", "left_semi"), found, vectors, similarity) if some else found


def _compared(seats: DataFrame, vectors: DataFrame, task: list[str], similarity: float) -> DataFrame:
    return seats.join(vectors, "uid").groupBy(*task).applyInArrow(_verify(similarity), "u long, v long")


def _links_of_large(member: DataFrame, found: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """``found``, with the links of the members of large groups."""
    member = X.durable(member.select("uid", "size", "keys"))
    key = member.select("uid", "size", F.posexplode("keys").alias("place", "key"))
    key = X.durable(key.join(key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    # a key's texts and the one of them that shares most keys with others
    most = key.groupBy("uid").agg(F.sum("n").alias("met"))
    star = key.join(most, "uid").groupBy("key").agg(F.max_by("uid", F.struct("met", -F.col("uid"))).alias("star"))
    star = X.durable(key.join(star, "key").where("uid <> star").select("star", "uid", "size").distinct())
    tasks = X.durable(_tasks(star, "star", "tasks"))
    seats = star.join(tasks, "star").select("star", F.pmod(F.xxhash64("uid"), F.col("tasks")).alias("block"), "uid", F.lit(False).alias("lead"))
    seats = seats.union(tasks.select("star", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)), "star", F.lit(True)))
    links = components(found.union(_compared(seats.withColumn("label", F.col("uid")), vectors, ["star", "block"], similarity)))
    # every text outside a key's largest class meets all texts of the key: its row of tasks, their column
    own = key.drop("n").join(links.withColumnsRenamed({"u": "uid", "v": "label"}), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    top = own.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    own = X.durable(own.join(top, "key").withColumn("lead", F.col("label") != F.col("top")).drop("top"))
    if not own.limit(1).count():
        return links
    sizes = X.durable(_tasks(own.where("lead"), "key", "rows").join(_tasks(own, "key", "columns"), "key"))
    at = lambda of, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(of)).cast("int")
    up_to = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    placed = own.join(sizes, "key").withColumns({"row": at("rows", 1), "column": at("columns", 0)})
    column = F.transform(up_to("rows"), lambda r: r * F.col("columns") + F.col("column"))
    row = F.when(F.col("lead"), F.transform(up_to("columns"), lambda c: F.col("row") * F.col("columns") + c)).otherwise(F.array().cast("array<int>"))
    seats = placed.withColumn("cell", F.explode(F.array_union(column, row)))
    seats = seats.select("key", "cell", "uid", "label", "place", (F.col("lead") & (F.floor(F.col("cell") / F.col("columns")) == F.col("row"))).alias("lead"))
    seats = seats.join(member.select("uid", "keys"), "uid")
    return components(links.union(_compared(seats, vectors, ["key", "cell"], similarity)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: its id and its class, named by the least id in it."""
    named, _ = classes(docs, doc_id, text, **options)
    least = named.groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "cls").select("doc_id", "class_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: the one of least id (null ids last), all columns unchanged."""
    others = [c for c in docs.columns if c != text]
    named, chunks = classes(docs, doc_id, text, carry=others, **options)
    kept = named.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid"))["uid"].alias("uid"))
    wanted = kept.select(F.shiftright("uid", 12).alias("b"), F.col("uid").bitwiseAND(4095).alias("i")).groupBy("b").applyInArrow(_places, X.ANSWER_SCHEMA)
    columns = docs.columns

    def done(b, c, answers):
        keep = np.zeros(len(c), bool)
        for blob in answers.get(-1, []):
            keep[X.unpack_ints(blob)] = True
        return X.rows_of(c, text, others, columns, pa.array(keep))

    return X.finish(chunks, wanted, done, docs.schema)

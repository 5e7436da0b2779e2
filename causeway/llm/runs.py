"""Periodic runs of words, found with a suffix automaton.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, of at least ``least`` words and ``times`` periods.

1. Windows of a few words that do not recur near by cannot lie in a run: in a run of that many periods each window of
   ``window(least, times)`` words occurs twice. What is left are stretches, and each run lies whole in one of them. Hashes only
   choose stretches, so a collision costs time and no run.
2. A stretch's words are read into a suffix automaton. From its longest state down, each state's ordered set of end positions
   is merged into its suffix link's, the smaller into the larger. Two positions that become neighbours in a state have exactly
   that state's length of words in common to their left; where their distance does not exceed it, they end a square.
3. A square whose next words differ ends its run, and the state's length tells where the run begins. One whose next words
   agree goes on to the right, and the pair one further seeds the same run. Neighbours that later words part may seed a
   multiple of a period; of equal stretches the smallest period counts.

A document is one task's work; tasks take batches of documents, and nothing is shuffled. Null texts have no words and stay
null where texts are returned; a null id is kept. Empty texts, and a table without rows, give no runs. Repeated rows are
worked on each by itself. Texts of any length are read whole: memory is a few hundred bytes a word of the longest stretch.
Runs of one document are ordered by start, then period. Other columns are carried by ``collapse`` as they are, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X

LEAST, TIMES = 6, 4
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_ROUNDS = 8
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def window(least: int, times: int) -> int:
    """The most words of which every window in a run occurs twice in that run."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def stretches(hashes: np.ndarray, by: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches that may hold runs. ``by``: words before each text (n + 1)."""
    k = window(least, times)
    w, at = B.windows(hashes, by, k)
    part = np.searchsorted(by, at, side="right") - 1
    for _ in range(_ROUNDS):
        key = B.mix(w ^ B.mix(part.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        w, at, part = w[again], at[again], part[again]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])])[: len(at)]
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] + k - 1 >= least if len(part) else np.zeros(0, bool)
        if again.all() and long.all():
            break
        w, at, part = w[long], at[long], part[long]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    last = np.append(first[1:], len(part)) - 1 if len(part) else first
    return at[first], at[last] + k


def automaton(t: list[int]) -> tuple[list[int], list[int], list[list[int]]]:
    """Length, suffix link and own end positions (negated; none for a copied state) of the states of the words' suffix automaton; state 0 is the root."""
    follow: list[dict[int, int]] = [{}]
    length, link, ends = [0], [-1], [[]]
    last = 0
    for i, c in enumerate(t):
        now = len(length)
        follow.append({})
        length.append(i + 1)
        link.append(0)
        ends.append([-i])
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] != length[p] + 1:
                whole, q = q, len(length)
                follow.append(follow[whole].copy())
                length.append(length[p] + 1)
                link.append(link[whole])
                ends.append([])
                link[whole] = q
                while p >= 0 and follow[p].get(c) == whole:
                    follow[p][c] = q
                    p = link[p]
            link[now] = q
        last = now
    return length, link, ends


def merge(small: list[int], large: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """The union of two ordered sets, and the pairs of one element of each that are neighbours at some time."""
    pairs = []
    if len(small) < 32 or 64 * len(small) < len(large):
        before = 1  # no element: they are negated positions
        for x in small:
            at = bisect_left(large, x)
            if at and large[at - 1] != before:
                pairs.append((large[at - 1], x))
            if at < len(large):
                pairs.append((x, large[at]))
            large.insert(at, x)
            before = x
        return large, pairs
    both = np.array(large + small, np.int64)
    order = np.argsort(both, kind="stable")
    both, own = both[order], order >= len(large)
    edge = np.flatnonzero(own[1:] != own[:-1])
    return both.tolist(), list(zip(both[edge].tolist(), both[edge + 1].tolist(), strict=True))


def repetitions(t: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, in order."""
    length, link, ends = automaton(t)
    floor = min(max(least, times * d) - d for d in range(1, least + 1))  # states of fewer words end no square that is asked for
    n, found = len(t), {}
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        p = link[v]
        common = length[p]
        if common < floor:
            continue
        small, large = ends[v], ends[p]
        ends[v] = None
        if len(small) > len(large):
            small, large = large, small
        if small:
            large, pairs = merge(small, large)
            for right, left in pairs:
                d = left - right  # positions are negated
                size = common + d
                if size >= least and size >= times * d and (right == 1 - n or t[1 - right] != t[1 - left]):
                    at = (1 - left - common, size)
                    if d < found.get(at, d + 1):
                        found[at] = d
        ends[p] = large
    return sorted((start, size, d) for (start, size), d in found.items())


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (text, start in it, length, period) of all runs, in order."""
    lo, hi = stretches(B.hashes(data, starts, ends), by, least, times)
    if not len(lo):
        return np.zeros((0, 4), np.int64)
    at, offs = B.gather(np.arange(len(starts)), lo, hi - lo)
    codes, _ = B.encode(B.binary(data, starts[at], ends[at]))
    text = np.searchsorted(by, lo, side="right") - 1
    out = []
    for i, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        shift = int(lo[i] - by[text[i]])
        out += [(int(text[i]), shift + s, size, d) for s, size, d in repetitions(codes[a:z].tolist(), least, times)]
    return np.array(sorted((t, s, d, n) for t, s, n, d in out), np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: np.ndarray, found: np.ndarray) -> pa.Array:
    """The texts' words but those after a run's first period, joined by one space."""
    edge = np.zeros(len(starts) + 1, np.int64)
    first = by[found[:, 0]] + found[:, 1]
    np.add.at(edge, first + found[:, 3], 1)
    np.add.at(edge, first + found[:, 2], -1)
    keep = np.cumsum(edge)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[by]
    lens = (ends - starts)[keep]
    lens[kept[1:][kept[1:] > kept[:-1]] - 1] -= 1  # no space after the last word
    said, offs = B.gather(data, starts[keep], lens + 1)
    spaces = offs[1:] - 1
    last = np.zeros(len(lens), bool)
    last[kept[1:][kept[1:] > kept[:-1]] - 1] = True
    said[spaces[~last]] = 32
    return B.from_parts(said, offs[kept])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    at = X.cuts(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64), X.CHUNK_BYTES)
    return zip(at[:-1], at[1:], strict=True)


def _work(texts: pa.Array, least: int, times: int):
    data, offsets = B.flat(texts)
    data = np.append(data, np.uint8(32))  # a byte to read after the last word
    starts, ends, by = B.words(data[:-1], offsets, B.SPACE)
    found = _runs(data, starts, ends, by, least, times)
    return by, found, _collapsed(data, starts, ends, by, found).cast(pa.string())


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document: number of words, its runs, and its words without those after each run's first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, z in _slices(x.column(1)):
                part = x.slice(a, z - a)
                by, found, said = _work(part.column(1), least, times)
                at = np.searchsorted(found[:, 0], np.arange(len(part) + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(by)), runs, said], ["doc_id", "n_words", "runs", "collapsed"])
                B.trim()

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, FOUND)


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with each run cut to its first period; words are then one space apart. Texts without runs, and null ones, stay as they are."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, z in _slices(x.column(place)):
                part = x.slice(a, z - a)
                own = part.column(place)
                _, found, said = _work(own, least, times)
                hit = np.zeros(len(part), bool)
                hit[found[:, 0]] = True
                cols = part.columns
                cols[place] = pc.if_else(pa.array(hit), said, own.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)
                B.trim()

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Of ``find``'s rows: how many runs, the one of most periods (ties: first), and digests of all runs and of the kept words."""
    most = F.aggregate(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda b, r: F.when(b.isNull() | (r["length"].cast("decimal(19,0)") * b["period"].cast("decimal(19,0)") > b["length"].cast("decimal(19,0)") * r["period"].cast("decimal(19,0)")), r).otherwise(b),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    said = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )

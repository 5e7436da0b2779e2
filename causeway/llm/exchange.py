"""Chunked exchanges: global questions about words or hashes, answered per chunk of documents.

Rows of documents become *chunks* of a few MB (compressed, keyed ``b``), dealt out once by ``b``; each later pass
reads that same shuffle. A chunk asks about its distinct keys only, so a word or passage in a third of all rows costs one
entry per chunk, not one per row, and no task gathers the rows of a key.

Chunks are numbered by partition and place in it, so the documents must come in the same order when an executor is lost and
its work is done again. A plain read of stored rows does; operators store anything else first (``settled``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import batch as B

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096
CHUNK_SCHEMA = "b long, blob binary"
SENT_SCHEMA = "k int, b long, blob binary"
ANSWER_SCHEMA = "b long, k int, blob binary"


def press(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpress(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def parts(spark: SparkSession) -> int:
    """Partitions of an exchange: the session's own setting, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A folder of our own only where it is unset on one machine, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file:///tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """The rows, stored in the shared folder: later passes neither recompute them nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Plan nodes whose rows come in the same order whenever they are computed: stored rows, and what keeps or drops rows one by one.
_ORDERED = {"Project", "Filter", "LocalRelation", "Range"}


def settled(docs: DataFrame) -> DataFrame:
    """``docs``, stored first unless it is a plain read of stored rows: chunks are numbered by place, so rows must keep their order when they are computed again."""
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "LogicalRDD":  # rows of an RDD; only those of a checkpoint are stored
            kept = node.rdd().getCheckpointFile().isDefined()
        else:
            kept = name in _ORDERED or name.startswith(("Relation", "LogicalRelation"))
        if not kept:
            return durable(docs)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return docs


class Chunk:
    """Documents of one chunk: ids (0 where null), which ids and texts are null, one int64 extra each, bytes and offsets, and the carried columns."""

    def __init__(self, ids, id_null, text_null, extra, data, offsets, rest=b""):
        self.ids, self.id_null, self.text_null, self.extra, self.data, self.offsets, self._rest = ids, id_null, text_null, extra, data, offsets, rest

    @property
    def carried(self) -> pa.Table:
        return pa.ipc.open_stream(self._rest).read_all()

    def null_texts(self) -> pa.Array:
        return pa.array(self.text_null)

    def __len__(self):
        return len(self.ids)

    @staticmethod
    def of(blob: bytes) -> Chunk:
        raw = unpress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids = np.frombuffer(raw, np.int64, n, 8)
        extra = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        lens = np.frombuffer(raw, np.int64, n, 8 + 16 * n)
        flags = np.frombuffer(raw, np.uint8, n, 8 + 24 * n)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(lens, out=offsets[1:])
        end = 8 + 25 * n + int(offsets[-1])
        return Chunk(ids, (flags & 1) > 0, (flags & 2) > 0, extra, np.frombuffer(raw, np.uint8, int(offsets[-1]), 8 + 25 * n), offsets, memoryview(raw)[end:])

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.id_null)


def _pack(batch: pa.RecordBatch, lo: int, hi: int) -> bytes:
    part = batch.slice(lo, hi - lo)
    ids, texts, extra = part.column(0), part.column(1), part.column(2)
    data, offsets = B.flat(texts)
    n = len(part)
    flags = np.asarray(ids.is_null()).astype(np.uint8) | np.asarray(texts.is_null()).astype(np.uint8) << 1
    return press(b"".join((np.int64(n).tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), extra.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.diff(offsets).tobytes(), flags.tobytes(), data.tobytes(), _ipc(part, 3))), level=3)


def _ipc(part: pa.RecordBatch, first: int) -> bytes:
    if part.num_columns <= first:
        return b""
    rest = pa.Table.from_arrays(part.columns[first:], part.schema.names[first:])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as w:
        w.write_table(rest)
    return sink.getvalue().to_pybytes()


def cuts(sizes: np.ndarray, most: int, rows: int = CHUNK_ROWS) -> list[int]:
    """Where to cut rows so that each part holds at most so many bytes (or one row) and rows."""
    out, total, since = [0], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if since and (total + s > most or since >= rows):
            out.append(i)
            total = since = 0
        total += s
        since += 1
    return [*out, len(sizes)] if len(sizes) else [0]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", extra: str | None = None, carry: list[str] | None = None, most: int = CHUNK_BYTES, deal: bool = True) -> DataFrame:
    """Chunks of the documents, dealt out by ``b`` (or left where they are cut, for a pass that needs no answers).

    ``extra``: an SQL expression whose long value goes with each document. ``carry``: columns that go with them unchanged.
    Neither moves a chunk's borders: passes over the same rows number them alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal k, held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            sizes = np.asarray(pc.binary_length(rows.column(1)).fill_null(0)).astype(np.int64)
            at = cuts(sizes, most)
            # the last chunk stays open, so that borders follow from the texts alone and not from batches or other columns
            for lo, hi in zip(at[:-1] if last else at[:-2], at[1:] if last else at[1:-1], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + k], pa.int64()), pa.array([_pack(rows, lo, hi)], pa.binary())], ["b", "blob"])
                k += 1
            held, size = [rows.slice(at[-2])], 0
            B.trim()

        for x in batches:
            if len(x):
                held.append(x)
                size += x.nbytes
                if size >= 4 * most:
                    yield from out(False)
        if held:
            yield from out(True)

    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text", f"cast({extra or 'null'} as long) as extra", *(f"`{c}` as `_c{i}`" for i, c in enumerate(carry or ())))
    chunks = rows.mapInArrow(run, CHUNK_SCHEMA)
    return chunks.repartition(parts(docs.sparkSession), "b") if deal else chunks


def carried_schema(docs: DataFrame, columns: list[str]) -> StructType:
    return StructType([docs.schema[c] for c in columns])


def rows_of(c: Chunk, text: str, others: list[str], columns: list[str], keep: pa.Array) -> pa.Table:
    """A chunk's rows for which ``keep`` holds, as they were: its texts and carried columns."""
    texts = pc.if_else(c.null_texts(), None, B.from_parts(c.data, c.offsets).cast(pa.string()))
    rest = c.carried if others else None
    cols = {name: rest.column(i) for i, name in enumerate(others)} | {text: texts}
    return pa.table([cols[x] for x in columns], columns).filter(keep)


def row_id(b: int, i: np.ndarray) -> np.ndarray:
    """A number for each row: its chunk's and its place in it."""
    return (np.int64(b) << 12) + i


def each_chunk(chunks: DataFrame, fn: Callable[[int, Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over every chunk."""

    def run(batches):
        for x in batches:
            for b, blob in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                yield from fn(b, Chunk.of(blob.as_py()))
                B.trim()

    return chunks.mapInArrow(run, schema)


def sent(b: int, keys: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["k", "b", "blob"])


def answer(rows: DataFrame, fn: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """For each bucket k: fn(k, chunk numbers, blobs) gives (chunk number, answer) pairs."""

    def run(t: pa.Table) -> pa.Table:
        k = t.column("k")[0].as_py()
        got = list(fn(k, t.column("b").to_pylist(), [x.as_py() for x in t.column("blob")]))
        B.trim()
        return pa.table([pa.array([x for x, _ in got], pa.int64()), pa.array([k] * len(got), pa.int32()), pa.array([y for _, y in got], pa.binary())], ["b", "k", "blob"])

    return rows.groupBy("k").applyInArrow(run, ANSWER_SCHEMA)


def finish(chunks: DataFrame, answers: DataFrame, fn: Callable[[int, Chunk, dict[int, list[bytes]]], pa.Table], schema: StructType | str) -> DataFrame:
    """Each chunk with its answers by k. Chunks without answers are run too."""

    blank = empty(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[int, list[bytes]] = {}
        for k, blob in zip(right.column("k").to_pylist(), right.column("blob"), strict=True):
            by.setdefault(k, []).append(blob.as_py())
        made = [fn(b, Chunk.of(blob.as_py()), by) for b, blob in zip(left.column("b").to_pylist(), left.column("blob"), strict=True)]
        B.trim()
        return pa.concat_tables(made) if made else blank

    return chunks.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(run, schema)


def empty(schema: StructType | str) -> pa.Table:
    """An Arrow table without rows; for the driver, which has a session to parse with."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()


# --- sorted keys ---


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as steps, byte plane by byte plane."""
    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8")
    return press(np.int64(len(keys)).tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = unpress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Integers as offsets from the least, in as few bytes as hold them."""
    base = int(x.min()) if len(x) else 0
    d = (x - base).astype(np.uint64)
    d = d.astype(np.min_scalar_type(int(d.max()) if len(d) else 0))
    return press(np.array([base, len(x), d.itemsize], np.int64).tobytes() + np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T if len(d) else d).tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    raw = unpress(blob)
    base, n, w = np.frombuffer(raw, np.int64, 3).tolist()
    if not n:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, 24).reshape(w, n).T).view(f"<u{w}").ravel().astype(np.int64) + base


def join_blobs(*blobs: bytes) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], np.int64).tobytes() + b"".join(blobs)


def split_blobs(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(blob, np.int64, n, 8))])
    return [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


# --- distinct words ---------------------------------------------------------------------------------------------------


def pack_words(values: pa.Array) -> bytes:
    data, offs = B.flat(values)
    return np.int64(len(values)).tobytes() + np.diff(offs).astype(np.uint32).tobytes() + data.tobytes()


def unpack_words(raw: bytes, at: int = 0) -> tuple[pa.Array, int]:
    """The words and where they end in raw."""
    n = int(np.frombuffer(raw, np.int64, 1, at)[0])
    lens = np.frombuffer(raw, np.uint32, n, at + 8).astype(np.int64)
    offs = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    end = at + 8 + 4 * n + int(offs[-1])
    return B.from_parts(np.frombuffer(raw, np.uint8, int(offs[-1]), at + 8 + 4 * n), offs), end


def deal(values: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the distinct words by bucket, and each bucket's first place in it (n + 1). The same for equal words lists."""
    data, offs = B.flat(values)
    k = (B.hashes(data, offs[:-1], offs[1:]) % np.uint64(n)).astype(np.int64)
    order = np.argsort(k, kind="stable")
    return order, np.searchsorted(k[order], np.arange(n + 1))


def pack_ragged(values: np.ndarray, lengths: np.ndarray) -> bytes:
    return press(np.int64(len(lengths)).tobytes() + lengths.astype(np.uint32).tobytes() + values.tobytes(), level=3)


def unpack_ragged(blob: bytes, dtype) -> tuple[np.ndarray, np.ndarray]:
    raw = unpress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, dtype, -1, 8 + 4 * n), np.frombuffer(raw, np.uint32, n, 8).astype(np.int64)

"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Each chunk of documents cuts its texts into pieces with positions and asks about its distinct pieces; the pieces are dealt
out by their hash, each distinct one is encoded once, and the ids go back to the chunks, which reassemble them by position.
Decoding joins ids with the table of token bytes (one row per id, fixed by the vocabulary) and joins the bytes by position.

A piece is a white-space character with the run of other characters after it. Every cut lies between two matches of the
pre-token pattern, whatever stands on either side, so that encoding the pieces one by one gives what the whole text would. Under a
pattern for which that isn't known (``CUTTABLE``) a piece is a whole text.

Null texts are empty: no ids. Repeated rows give repeated results, an empty table none; texts of any length are encoded whole. Columns other
than id and text are not used.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame

from . import batch as B
from . import exchange as X

ENCODED = "doc_id long, ids array<int>"
#: Larger chunks than elsewhere: the more words a chunk has, the fewer of them are new to it.
CHUNK_BYTES = 8 << 20
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: The pre-token patterns whose matches never go on over a white-space character before another one: fixed values. Texts are cut there for these alone.
CUTTABLE = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)

_AFTER = ~B.SPACE
_AFTER[0x1C:0x20] = False
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # first bytes of other white-space characters


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in order of id, and their offsets."""
    ranks = read_ranks(path)
    by = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        by[i] = t
    offs = np.zeros(len(by) + 1, np.int64)
    np.cumsum([len(t) for t in by], out=offs[1:])
    return np.frombuffer(b"".join(by), np.uint8), offs


def pieces(data: np.ndarray, offsets: np.ndarray, pattern: str) -> np.ndarray:
    """Offsets of the pieces, from 0 to len(data): whole texts, if it isn't known where the pattern can be cut."""
    if pattern not in CUTTABLE:
        return np.unique(offsets)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[:-2] = B.SPACE[data[:-1]] & _AFTER[data[1:]]
    cut[offsets] = True
    # white space at the end of a text has the next text after it, not more of its own
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    cut[last] = np.isin(last, offsets)
    return np.flatnonzero(cut)


def _distinct(c: X.Chunk, n: int, pattern: str):
    at = pieces(c.data, c.offsets, pattern)
    codes, values = B.encode(B.from_parts(c.data, at))
    order, bounds = X.deal(values, n)
    return at, codes, values, order, bounds


def _ask(n: int, pattern: str):
    def ask(b, c):
        _, _, values, order, bounds = _distinct(c, n, pattern)
        taken = values.take(pa.array(order))
        ks = np.flatnonzero(np.diff(bounds))
        if len(ks):
            yield X.sent(b, ks, [X.press(X.pack_words(taken.slice(bounds[k], bounds[k + 1] - bounds[k])), level=3) for k in ks])

    return ask


def encode_words(words: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and how many each has."""
    enc = _encoder(path, pattern)._core_bpe.encode_ordinary
    got = [enc(w) for w in words.cast(pa.large_string()).to_pylist()]
    return np.fromiter((i for g in got for i in g), np.uint32), np.fromiter(map(len, got), np.int64, len(got))


def _reply(path: str, pattern: str):
    def reply(k, chunks, blobs):
        lists = [X.unpack_words(X.unpress(x))[0] for x in blobs]
        codes, values = B.encode(pa.concat_arrays(lists))
        ids, lens = encode_words(values, path, pattern)
        starts = np.cumsum(lens) - lens
        at = 0
        for b, own in zip(chunks, lists, strict=True):
            c = codes[at : at + len(own)]
            at += len(own)
            yield b, X.pack_ragged(B.gather(ids, starts[c], lens[c])[0].astype(np.uint16 if len(ids) == 0 or ids.max() < 1 << 16 else np.uint32), lens[c])

    return reply


def assemble(order: np.ndarray, bounds: np.ndarray, codes: np.ndarray, answers: dict[int, list[bytes]], dtype=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces by position, and offsets by piece."""
    lens = np.zeros(len(order), np.int64)
    flat = []
    for k in np.flatnonzero(np.diff(bounds)):
        (blob,) = answers[int(k)]
        raw = X.unpress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        own = np.frombuffer(raw, np.uint32, n, 8).astype(np.int64)
        width = (len(raw) - 8 - 4 * n) // max(int(own.sum()), 1)
        lens[order[bounds[k] : bounds[k + 1]]] = own
        flat.append(np.frombuffer(raw, np.uint32 if width == 4 else np.uint16, -1, 8 + 4 * n))
    ids = np.concatenate([x.astype(np.uint32) for x in flat]) if flat else np.zeros(0, np.uint32)
    starts = np.zeros(len(order), np.int64)
    by_order = lens[order]
    starts[order] = np.cumsum(by_order) - by_order
    return B.gather(ids, starts[codes], lens[codes])


def decode(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids one after another, and offsets by id."""
    data, offs = token_bytes(path)
    return B.gather(data, offs[:-1][ids], np.diff(offs)[ids])


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: its id and token ids; with ``digests`` digests of the ids and of the bytes they decode to.

    ``path``: a file of ranks (base64 token, rank). ``pattern``: the pre-token pattern.
    """
    chunks = X.pack(X.settled(docs), doc_id, text, most=CHUNK_BYTES)
    n = X.parts(docs.sparkSession)
    replies = X.answer(X.each_chunk(chunks, _ask(n, pattern), X.SENT_SCHEMA), _reply(path, pattern))

    def done(b, c, answers):
        at, codes, _, order, bounds = _distinct(c, n, pattern)
        ids, offs = assemble(order, bounds, codes, answers)
        by_doc = offs[np.searchsorted(at, c.offsets)]
        if not digests:
            return pa.table([c.id_array(), pa.ListArray.from_arrays(pa.array(by_doc, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
        data, spots = decode(ids, path)
        to = spots[by_doc]
        raw, said = memoryview(ids.astype("<u4").tobytes()), memoryview(data)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.table(
            [
                c.id_array(),
                pa.array(np.diff(by_doc)),
                pa.array([sha(raw[4 * i : 4 * j]) for i, j in zip(by_doc[:-1].tolist(), by_doc[1:].tolist(), strict=True)], pa.string()),
                pa.array([sha(said[i:j]) for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return X.finish(chunks, replies, done, DIGESTS if digests else ENCODED)


def tokenize(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` in place of the text, and ``exact``: whether they decode to it (always, but for a fault). Columns of these names give way."""
    others = [c for c in docs.columns if c not in (text, "ids", "exact") or c == doc_id]
    n = X.parts(docs.sparkSession)
    chunks = X.pack(X.settled(docs), doc_id, text, carry=others, most=CHUNK_BYTES)
    replies = X.answer(X.each_chunk(chunks, _ask(n, pattern), X.SENT_SCHEMA), _reply(path, pattern))

    def done(b, c, answers):
        at, codes, _, order, bounds = _distinct(c, n, pattern)
        ids, offs = assemble(order, bounds, codes, answers)
        by_doc = offs[np.searchsorted(at, c.offsets)]
        data, spots = decode(ids, path)
        to, raw, said = spots[by_doc], memoryview(c.data), memoryview(data)
        exact = [raw[i:j] == said[k:m] for i, j, k, m in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), to[:-1].tolist(), to[1:].tolist(), strict=True)]
        rest = c.carried
        return pa.table([*rest.columns, pa.ListArray.from_arrays(pa.array(by_doc, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(exact)], [*others, "ids", "exact"])

    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return X.finish(chunks, replies, done, schema)


def decode_rows(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``bytes``: what the ids decode to (null ids: empty)."""

    def run(batches):
        for x in batches:
            col = x.column(x.schema.get_field_index(ids)).cast(pa.list_(pa.int32()))
            own = np.asarray(pc.list_value_length(col).fill_null(0)).astype(np.int64)
            flat = np.asarray(col.flatten())
            data, spots = decode(flat, path)
            edge = spots[np.concatenate([[0], np.cumsum(own)])]
            yield pa.RecordBatch.from_arrays([*(x.column(x.schema.get_field_index(c)) for c in others), B.from_parts(data, edge).cast(pa.binary())], [*others, "bytes"])

    others = [c for c in encoded.columns if c != "bytes"]  # a column of this name gives way
    return encoded.mapInArrow(run, T.StructType([*(encoded.schema[c] for c in others), T.StructField("bytes", T.BinaryType())]))

"""Token ids in files of independent zstandard frames, with a seek table and checksums by frame.

File: data frames, one skippable frame with the documents' index, one skippable frame with the seek table as its last bytes
(the public seekable format of zstandard: compressed size, decompressed size, low 32 bits of xxh64 of the content). A data
frame holds whole documents' ids as little-endian unsigned 32-bit integers, so a reader decompresses the frames of the
documents it asks for and no others.

Documents are dealt out by ranges of their id and sorted in them: file by file, ids ascend. Null ids come first, null texts
are empty (the end id alone); of rows of one id those without a text come first, and the rest as they come in the table, so that
very many rows of one id, or without one, may fill several files. Other columns are not used. Texts of any length are whole frames.
An empty table makes no rows. Strings of the tokenizer's special tokens in a text become these tokens, as the library has it by default.

A tokenizer whose words are known to be independent (``KNOWN``) encodes distinct words; any other encodes whole texts.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import batch as B
from . import exchange as X
from . import files

#: Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FRAME_TOKENS = 1 << 15
#: Tokens that a task of a reader takes on at once, in whole frames.
SPAN_TOKENS = 1 << 21
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_KEPT = 500_000
ENCODED_BYTES = 8 << 20


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a tokenizer must be for words to be encoded apart: its kind of normaliser, pre-tokenizer and model. Fixed values of a public tokenizer.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


def by_words(path: str) -> bool:
    """Whether the tokenizer of this file is of the known kind."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and model.get("unk_token") is None and not model.get("dropout") and not model.get("ignore_merges")
    return plain and all(said.get(k) == v for k, v in KNOWN.items()) and all(len(t["content"].encode()) > 1 and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said.get("added_tokens", ()))


@lru_cache(2)
def _heads(path: str) -> list[bytes]:
    """First two bytes of the strings that stand for tokens of their own wherever they are in a text."""
    with open(path, encoding="utf-8") as f:
        return sorted({t["content"].encode()[:2] for t in json.load(f).get("added_tokens", ())})


def _marked(data: np.ndarray, offsets: np.ndarray, heads: list[bytes]) -> np.ndarray:
    """Which texts may hold such a string."""
    out = np.zeros(len(offsets) - 1, bool)
    for a, b in heads:
        at = np.flatnonzero((data[:-1] == a) & (data[1:] == b))
        text = np.searchsorted(offsets, at, side="right") - 1
        out[text[at + 1 < offsets[text + 1]]] = True
    return out


#: Byte classes of words whose number of pre-tokens is plain: 1 letters (ASCII, Latin-1), 2 digits, 3 other printable ASCII but the apostrophe.
_CLASS = np.zeros(256, np.int8)
_CLASS[33:127], _CLASS[48:58] = 3, 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_CLASS[[0x27, 0x97, 0xB7]] = 0
_GROUP = 200


@lru_cache(2)
def _word_ends(path: str) -> np.ndarray:
    vocab = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with plain capitals made small, and starts and ends of pieces: pre-tokens of words of plain characters, and other words whole."""
    data = B.LOWER[data]
    if len(data):
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1
        data[wide[(data[wide] < 0x9F) & (data[wide] != 0x97)]] |= 0x20
    starts, ends, _ = B.words(data, offsets, B.SPACE)
    kind = _CLASS[data]
    odd = np.concatenate([[0], np.cumsum(kind == 0)])
    other = odd[ends] - odd[starts] > 0
    whole = np.zeros(len(data) + 1, np.int8)
    whole[starts[other]] += 1
    whole[ends[other]] -= 1
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[starts] = last[ends - 1] = True
    part = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & (kind[:-1] > 0) & (np.cumsum(whole, dtype=np.int8)[1:-1] == 0) if len(data) else first
    first[1:] |= part
    last[:-1] |= part
    return data, np.flatnonzero(first), np.flatnonzero(last) + 1


class WordEncoder:
    """Ids of texts by their words. White space separates tokens of a tokenizer that drops it, so words can be encoded apart.

    Words of plain characters are encoded some hundreds at a time, as a call costs more than a word, and told apart by the
    tokens that end pre-tokens; words with any other character are encoded one by one. A text that may hold a special token's
    string is encoded whole, as the string is cut out before there are words.
    """

    def __init__(self, path: str):
        self.path, self.kept = path, {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and offsets by text."""
        whole = _marked(data, offsets, _heads(self.path))
        if not whole.any():
            return self._by_words(data, offsets)
        lens = np.diff(offsets)
        ids, at = self._by_words(*B.gather(data, offsets[:-1], np.where(whole, 0, lens)))
        own, own_at = TextEncoder(self.path)(*B.gather(data, offsets[:-1][whole], lens[whole]))
        starts, sizes = at[:-1].copy(), np.diff(at)
        starts[whole], sizes[whole] = len(ids) + own_at[:-1], np.diff(own_at)
        return B.gather(np.concatenate([ids, own]), starts, sizes)

    def _by_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends = _pieces(data, offsets)
        by = np.searchsorted(starts, offsets)
        codes, values = B.encode(B.binary(data, starts, ends))
        words = values.to_pylist()
        if len(self.kept) > _KEPT:  # bounds memory; a word that is missing is encoded again
            self.kept.clear()
        kept = self.kept
        new = np.fromiter((w not in kept for w in words), bool, len(words))
        if new.any():
            self._learn(values.filter(pa.array(new)))
        got = [kept[w] for w in words]
        lens = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        flat = np.frombuffer(b"".join(got), "<u4")
        ids, offs = B.gather(flat, (np.cumsum(lens) - lens)[codes], lens[codes])
        return ids, offs[by]

    def _learn(self, values: pa.Array) -> None:
        data, offs = B.flat(values)
        kind = _CLASS[data]
        head = np.ones(len(data), bool)
        head[1:] = kind[1:] != kind[:-1]
        head[offs[:-1]] = True
        bad, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (kind == 0, head | (kind == 2)))
        plain = bad[offs[1:]] == bad[offs[:-1]]
        n = (heads[offs[1:]] - heads[offs[:-1]])[plain]
        words = values.to_pylist()
        tokenizer, kept = _tokenizer(self.path), self.kept
        some = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        for i in range(0, len(some), 64 * _GROUP):
            part = some[i : i + 64 * _GROUP]
            lines = [b" ".join(part[j : j + _GROUP]).decode() for j in range(0, len(part), _GROUP)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(_word_ends(self.path)[ids]) + 1
            last = np.cumsum(n[i : i + len(part)])
            if len(ends) != last[-1]:
                raise ValueError("this tokenizer doesn't mark the ends of its pre-tokens")
            cut, raw = (4 * ends[last - 1]).tolist(), ids.tobytes()
            kept.update(zip(part, (raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)), strict=True))
        for w, p in zip(words, plain.tolist(), strict=True):
            if not p:
                kept[w] = np.array(tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()


class TextEncoder:
    """Ids of texts by whole texts, for any tokenizer; equal texts of a batch once."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, values = B.encode(B.from_parts(data, offsets))
        got = [np.array(e.ids, "<u4") for e in _tokenizer(self.path).encode_batch_fast([w.decode() for w in values.to_pylist()], add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return B.gather(np.concatenate(got) if got else np.zeros(0, "<u4"), (np.cumsum(lens) - lens)[codes], lens[codes])


@lru_cache(2)
def _encoder(path: str) -> WordEncoder | TextEncoder:
    """One for each Python worker, so its tasks share the words they have met."""
    return (WordEncoder if by_words(path) else TextEncoder)(path)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def file_blocks(docs):
    """The bytes of a file, block by block. docs: (doc_id or None, ids) pairs in order."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    table, ids, counts, held, size = [], [], [], [], 0

    def frame():
        raw = np.concatenate(held).astype("<u4").tobytes() if held else b""
        blob = press.compress(raw)
        table.append(struct.pack("<III", len(blob), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return blob

    firsts = []
    for i, x in docs:
        if held and size + len(x) > FRAME_TOKENS:
            yield frame()
            held, size = [], 0
        ids.append(i)
        counts.append(len(x))
        firsts.append(len(table))
        held.append(x)
        size += len(x)
    if held:
        yield frame()
    index = pa.table([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], ["doc_id", "n", "frame"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(index)
    body = sink.getvalue().to_pybytes()
    yield _skippable(SKIPPABLE, body)
    table.append(struct.pack("<III", 8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    yield _skippable(SEEK_TABLE, b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE_END))


def unpack_frame(blob: bytes, size: int, check: int) -> np.ndarray:
    """A frame's ids. Raises ValueError if they don't match the seek table."""
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame doesn't match its checksum")
    return np.frombuffer(raw, "<u4")


class TokenFile:
    """A file's documents; ``read(offset, size)`` gives its bytes."""

    def __init__(self, read, size: int):
        self.read = read
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE_END or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        head = size - 9 - 12 * n - 8
        if struct.unpack("<II", read(head, 8)) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError("the seek table is broken")
        self.table = np.frombuffer(read(head + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        body = read(int(self.at[-2]) + 8, int(self.table[-1, 0]) - 8)
        index = pa.ipc.open_stream(body).read_all()
        self.doc_ids, self.counts, self.frames = index["doc_id"].combine_chunks(), index["n"].to_numpy(), index["frame"].to_numpy()

    def frame(self, k: int) -> np.ndarray:
        return unpack_frame(self.read(int(self.at[k]), int(self.table[k, 0])), int(self.table[k, 1]), int(self.table[k, 2]))

    def documents(self):
        """(doc_id, ids) of all documents in order; one frame is held at a time."""
        ids, now, data, at = self.doc_ids.to_pylist(), -1, None, 0
        for i, n, k in zip(ids, self.counts.tolist(), self.frames.tolist(), strict=True):
            if k != now:
                now, data, at = k, self.frame(k), 0
            yield i, data[at : at + n]
            at += n

    def get(self, wanted) -> dict[int, np.ndarray]:
        """The ids of some documents: only their frames are decompressed."""
        out, known = {}, {}
        for row, i in enumerate(self.doc_ids.to_pylist()):
            if i in wanted:
                k = int(self.frames[row])
                if k not in known:
                    known[k] = self.frame(k)
                at = int(self.counts[:row][self.frames[:row] == k].sum())
                out[i] = known[k][at : at + int(self.counts[row])]
        return out


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Writes the files; gives (name, documents, tokens) of each in order: one entry a partition."""
    n = X.parts(docs.sparkSession)
    order = ["doc_id", "some", "place"]
    rows = X.settled(docs).selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text", f"`{text}` is not null as some", "monotonically_increasing_id() as place")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        name, made = f"part-{TaskContext.get().partitionId():06d}.tok", [0, 0]
        encoder = _encoder(tokenizer)

        def documents():
            for x in batches:
                sizes = np.asarray(pc.binary_length(x.column(1)).fill_null(0)).astype(np.int64)
                at = X.cuts(sizes, ENCODED_BYTES)
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    part = x.slice(lo, hi - lo)
                    ids, offs = encoder(*B.flat(part.column(1)))
                    for i, a, b in zip(part.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                        made[0] += 1
                        made[1] += b - a + 1
                        yield i, np.append(ids[a:b], np.uint32(end_id))
                    B.trim()

        files.put(f"{folder}/{name}", file_blocks(documents()))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([made[0]]), pa.array([made[1]])], ["name", "docs", "tokens"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "name string, docs long, tokens long").collect())
    files.put(f"{folder}/manifest.json", [json.dumps(got).encode()])
    return got


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: id, place of its first token among all, number of tokens, crc32 of its ids."""
    to, path = files.resolve(folder)
    with to.open_input_stream(f"{path}/manifest.json") as f:
        made = json.loads(f.read())
    first, total = [], 0
    for name, _, tokens in made:
        first.append((name, total))
        total += tokens

    def opened(name: str):
        to, path = files.resolve(f"{folder}/{name}")
        f = to.open_input_file(path)
        return f, lambda a, n: (f.seek(a), f.read(n))[1]

    def spans(batches):
        """Runs of frames of about SPAN_TOKENS, with what the index says of their documents."""
        for x in batches:
            for name, start in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                f, get = opened(name)
                with f:
                    t = TokenFile(get, f.size())
                ends = np.cumsum(t.counts)
                k = np.arange(len(t.table) - 1)
                tokens = np.bincount(t.frames, weights=t.counts, minlength=len(k)).astype(np.int64)
                of = (np.cumsum(tokens) - tokens) // SPAN_TOKENS  # which span each frame begins in
                for own in np.split(k, np.flatnonzero(np.diff(of)) + 1) if len(k) else []:
                    i, j = np.searchsorted(t.frames, [own[0], own[-1] + 1])
                    before = int(ends[i - 1]) if i else 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([start + before]), pa.array([int(t.at[own[0]])]), pa.array([t.table[own].ravel().tolist()], pa.list_(pa.int64())), pa.array([t.doc_ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([t.counts[i:j].tolist()], pa.list_(pa.int64()))],
                        ["name", "start", "at", "frames", "ids", "n"],
                    )

    def run(batches):
        for x in batches:
            for r in x.to_pylist():
                table = np.array(r["frames"], np.int64).reshape(-1, 3)
                f, get = opened(r["name"])
                with f:
                    raw = get(r["at"], int(table[:, 0].sum()))
                cut = np.concatenate([[0], np.cumsum(table[:, 0])])
                ids = np.concatenate([unpack_frame(raw[a:b], size, check) for a, b, (_, size, check) in zip(cut[:-1].tolist(), cut[1:].tolist(), table.tolist(), strict=True)])
                spot = np.concatenate([[0], np.cumsum(r["n"])]).astype(np.int64)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(spot[:-1].tolist(), spot[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["start"] + spot[:-1]), pa.array(r["n"], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    named = spark.createDataFrame(first, "name string, start long").repartition(max(len(first), 1))
    found = named.mapInArrow(spans, "name string, start long, at long, frames array<long>, ids array<long>, n array<long>")
    return found.repartition(X.parts(spark)).mapInArrow(run, ROWS)


def read_documents(folder: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents, by seeking in the files."""
    to, path = files.resolve(folder)
    out = {}
    for info in to.get_file_info(fs.FileSelector(path)):
        if info.path.endswith(".tok"):
            with to.open_input_file(info.path) as f:
                out |= TokenFile(lambda a, n, f=f: (f.seek(a), f.read(n))[1], info.size).get(wanted)
    return out

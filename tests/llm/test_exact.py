"""The operators with exact contracts against brute force and round trips."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer
import pyarrow as pa
import pytest

from causeway.llm import bpe, chat, decontaminate, files, flac, token_files

TEXTS = [
    "The cat  sat\n\n on the\tmat. It's 12 o'clock now 　x", None, "", " ", "\n", "a" * 70000 + " b", "é à ü    z\x1c\x1d q", "don't 'tis we'll 🙂 👍🏽x",
    "trailing space ", "trailing lines\n\n", " \n lead", "same text here", "same text here", "x\r\ny", "Ça va? ÉCOLE 123abc !!!", "tab\t\tx\x0b\x0cy", "\u0085a  b  c", "word " * 3000,
]


def docs(spark, texts=TEXTS, ids=None):
    rows = [(i, t, "n", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, b long").repartition(3)


def stored(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_bpe_is_as_tiktoken(spark, tmp_path):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe._encoder(path, P.PATTERN)
    df = stored(spark, docs(spark, [*TEXTS, None], [*range(len(TEXTS)), None]), tmp_path)
    got = {r[0]: r for r in bpe.encode(df, path, P.PATTERN, digests=True).collect()}
    ids = {r[0]: r[1] for r in bpe.encode(df, path, P.PATTERN).collect()}
    assert len(got) == len(TEXTS) + 1 and None in got
    for i, t in enumerate(TEXTS):
        want = enc.encode_ordinary(t or "")
        assert ids[i] == want
        assert got[i][1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode_rows(bpe.encode(df, path, P.PATTERN), path)
    assert {r["doc_id"]: r["bytes"].decode() for r in back.collect() if r[0] is not None} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0


def test_token_files(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [*TEXTS, "hello <|endoftext|> world", "<|EndOfText|> <| a|>", "x<|startoftext|>y<|endoftext|><|endoftext|>", "ends in <", "| begins", "<|endoftext|>"]
    assert 49407 in t.encode(texts[len(TEXTS)], add_special_tokens=False).ids
    ids = [5 * i - 7 for i in range(len(texts))]
    df = docs(spark, texts, ids)
    folder = files.fresh("file://" + str(tmp_path), "out")
    token_files.write(df, folder, path)
    got = sorted(token_files.read(spark, folder).collect())
    start, plain = 0, {}
    for (i, at, n, c), doc, text in zip(got, ids, texts, strict=True):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        plain[doc] = want
        assert (i, at, n, c) == (doc, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    some = token_files.read_documents(folder, {ids[0], ids[5], ids[-1]})
    assert {k: v.tolist() for k, v in some.items()} == {k: plain[k] for k in (ids[0], ids[5], ids[-1])}


def test_token_file_seeks_and_checks():
    docs = [(i, np.arange(i * 900, dtype="<u4")) for i in range(60)]
    raw = b"".join(token_files.file_blocks(docs))
    reads = []
    f = token_files.TokenFile(lambda a, n: (reads.append(n), raw[a : a + n])[1], len(raw))
    reads.clear()
    assert f.get({3})[3].tolist() == list(range(2700)) and len(reads) == 1  # one frame
    assert [(i, x.tolist()) for i, x in f.documents()] == [(i, x.tolist()) for i, x in docs]
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(x.tobytes() for _, x in docs)
    entry = len(raw) - 9 - 12 * len(f.table) + 8  # the first frame's checksum
    broken = raw[:entry] + struct.pack("<I", 1) + raw[entry + 4 :]
    with pytest.raises(ValueError, match="checksum"):
        token_files.TokenFile(lambda a, n: broken[a : a + n], len(broken)).get({3})
    assert b"".join(token_files.file_blocks([]))


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    flat = np.full(192 * 6, 77)
    tone = (128 + 60 * np.sin(np.arange(192 * 6) / 5)).astype(np.uint8)
    x = np.concatenate([rng.integers(0, 256, 192 * 3), np.full(192, 9), np.repeat([0, 255], 192), 100 + np.cumsum(rng.integers(-1, 2, 192 * 3)), np.where(rng.random(192 * 3) < 0.02, 255, 128), tone, flat]).astype(np.uint8)
    offs = np.array([0, 192, 192 * 7, 192 * 12, 192 * 18, len(x)])
    blobs = flac.encode_streams(x, offs)
    pcm, at = flac.decode_streams(blobs)
    assert at.tolist() == offs.tolist() and ((pcm.astype(int) + 128) == x).all()
    kinds = {raw[b + (6 if n in flac.SIZES else 8)] >> 1 & 63 for raw in blobs for b, n in zip(flac.Stream(memoryview(raw)).begins.tolist(), flac.Stream(memoryview(raw)).counts.tolist())}
    assert {0, 1} <= kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)
    assert len(blobs[3]) - flac.Stream(memoryview(blobs[3])).start < 192 * 6 * 0.6  # fitted predictors follow a tone
    (part,) = flac.read_samples([blobs[2]], [300], [777])
    assert ((part.astype(int) + 128) == x[192 * 7 + 300 : 192 * 7 + 777]).all()
    for at in (len(blobs[1]) - 40, flac.Stream(memoryview(blobs[1])).start + 4):
        bad = bytearray(blobs[1])
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(bad)])


def test_flac_predictors_leave_what_the_definition_says():
    rng = np.random.default_rng(4)
    x = rng.integers(-128, 128, (5, 192)).astype(np.int16)
    c = rng.integers(-512, 512, (5, 4))
    for o in flac.LPC:
        want = [[int(r[t]) - (sum(int(c[i, j]) * int(r[t - 1 - j]) for j in range(o)) >> flac.SHIFT) for t in range(o, 192)] for i, r in enumerate(x)]
        assert flac._predicted(x, o, c).tolist() == want


def feature(raw):
    x = [b - 128 for b in raw]
    return f"peak={max(map(abs, x))};energy={sum(v * v for v in x)};flips={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};step={sum(abs(b - a) for a, b in zip(x, x[1:])) * 1000 // len(x)}"


def test_flac_query(spark, tmp_path):
    stored_ = flac.store(docs(spark))
    got = {r["doc_id"]: r for r in flac.digest(flac.pcm_blocks(stored_)).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in stored_.collect()}
    flac.write_pcm(stored_, str(tmp_path / "pcm"))
    some = {}
    for r in sorted(flac.read_pcm(spark, str(tmp_path / "pcm"), 100, 5000).collect(), key=lambda r: r["sample"]):
        some[r["doc_id"]] = some.get(r["doc_id"], b"") + bytes((b + 128) % 256 for b in r["pcm"])
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature(padded))
        assert some[i] == padded[100:5000]
    assert got[11][1:] == got[12][1:]


def test_chat_fold(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [
        (1, 10, 1, "message", "user", "hi <|im_end|> \\"), (1, 11, 2, "delta", "assistant", "he"), (1, 11, 3, "delta", "assistant", "llo"), (1, 11, 4, "regenerate", "assistant", None),
        (1, 11, 5, "delta", "assistant", "good "), (1, 11, 6, "delta", "assistant", "day"), (1, 12, 7, "message", "user", "x"), (1, 12, 9, "edit", "user", "edited"), (1, 13, 8, "message", "assistant", "a\nb"), (2, 1, 1, "message", None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = sorted(tuple(r) for r in chat.fold(events).collect())
    assert got == [(1, 1, "user", "hi <|im_end|> \\"), (1, 2, "assistant", "good day"), (1, 7, "user", "edited"), (1, 8, "assistant", "a\nb"), (2, 1, "", "")]
    out = {r["conv_id"]: r for r in chat.parse(spark, chat.write(events)).collect()}
    turns = [x[2:] for x in got[:4]]
    assert out[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert out[1]["loss_sha256"] == hashlib.sha256(b"good daya\nb").hexdigest() and out[1]["loss_chars"] == 11
    assert out[2]["n_turns"] == 1 and chat.parse(spark, chat.write(events.limit(0))).count() == 0


def test_chat_turns_repeat_and_escape(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(3, 0, "us\ner\\", said), (3, 1, "assistant", said), (3, 1, "assistant", said), (None, None, None, None), (4, 0, "assistant", "\\<|"), (4, 1, "assistant", "")]
    out = {r["conv_id"]: r for r in chat.parse(spark, chat.write(chat.turns_as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert out[3]["n_turns"] == 3 and out[None]["n_turns"] == 1
    assert out[3]["turns_sha256"] == hashlib.sha256((f"us\ner\\\n{said}\n" + f"assistant\n{said}\n" * 2).encode()).hexdigest()
    assert out[3]["loss_sha256"] == hashlib.sha256((said * 2).encode()).hexdigest() and out[4]["loss_chars"] == 3


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items):
    out = {}
    low = lambda t: WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    split = {i: low(t) for i, t in items}
    for d, t in texts:
        w, hit, own = low(t), set(), set()
        for i, x in split.items():
            n = min(10, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == x[a : a + n]:
                        hit.update(range(s, s + n))
                        own.add(str(i))
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_is_as_brute_force(spark, tmp_path, limit):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([40, 25, 10, 9, 5, 3, 1, 0, 12, 12])] + [(20, None), (21, "only Here")]
    texts = []
    for d in range(60):
        x = word(int(rng.integers(0, 80)))
        if d % 3 == 0:
            src = items[d % 10][1].split()
            a = int(rng.integers(0, max(1, len(src))))
            x[5:5] = src[a : a + int(rng.integers(1, 20))]
        texts.append((d, (", " if d % 2 else " ").join(x).replace("w1", "W1")))
    texts += [(100, None), (101, ""), (102, "ONLY... here")]
    df = stored(spark, docs(spark, [t for _, t in texts], [d for d, _ in texts]), tmp_path)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contaminated(df, bench, broadcast_bytes=limit).collect()}
    assert got == brute_hits(texts, items)
    assert not any(r["contaminated"] for r in decontaminate.contaminated(df, bench.limit(0)).collect())


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_items_of_null_id_hit_as_in_sql(spark, tmp_path, limit):
    import duckdb

    from causeway.llm import queries

    a, b, c = (" ".join(f"{x}{i}" for i in range(14)) for x in "abc")
    docs = [(1, f"x {a} y"), (2, f"x {a} {b}"), (3, f"{c} z"), (4, "nothing here"), (5, f"{c} {a} {b}"), (6, "short one")]
    items = [(None, a), (7, b), (None, c), (9, c), (None, "short one"), (8, None), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark"))
    df, bench = (spark.read.parquet(str(tmp_path / t)) for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}/*.parquet'")
    want = sorted(con.sql(queries.ORACLES["op10_decontamination"]).fetchall())
    assert sorted(map(tuple, decontaminate.contaminated(df, bench, broadcast_bytes=limit).collect())) == want
    assert [r["doc_id"] for r in decontaminate.clean(df, bench, broadcast_bytes=limit).collect()] == [4]


def test_chat_log_folds_back_to_the_turns(spark, tmp_path):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "ab"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", "é🙂x" * 40000), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "y")]
    t = spark.createDataFrame([(*r, 9, "n") for r in rows], "conv_id long, turn long, role string, text string, seq long, kind string")
    log = chat.turns_as_events(t)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds == {"open": 4, "regenerate": 4, "delta": 4 * 4 + 4, "message": 4, "edit": 4}
    got = sorted(((r["conv_id"], r["place"]["turn"], r["role"], r["text"]) for r in chat.fold(log).collect()), key=str)
    assert got == sorted(((c, n, a or "", b or "") for c, n, a, b in rows), key=str)
    assert chat.parse(spark, chat.write(chat.turns_as_events(t.limit(0)))).count() == 0


def test_bpe_of_other_patterns_encodes_whole_texts(spark, tmp_path):
    path = P.path("byte_bpe_50k.tiktoken")
    pattern = r"[^\n]+|\n[a-z ]*|\s+"  # joins line ends with what follows
    df = stored(spark, docs(spark), tmp_path)
    enc = bpe._encoder(path, pattern)
    assert {r[0]: r[1] for r in bpe.encode(df, path, pattern).collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_bpe_columns_of_the_same_names_give_way(spark, tmp_path):
    path = P.path("byte_bpe_50k.tiktoken")
    df = stored(spark, spark.createDataFrame([(1, "a b", "old", 5, "t")], "doc_id long, text string, ids string, exact int, b string"), tmp_path)
    out = bpe.tokenize(df, path, P.PATTERN)
    r = out.first()
    assert out.columns == ["doc_id", "b", "ids", "exact"] and r["exact"] is True and r["b"] == "t"
    assert bytes(bpe.decode_rows(out.withColumnRenamed("b", "bytes"), path).first()["bytes"]) == b"a b"


def test_tokenizers_of_other_kinds_encode_whole_texts(spark, tmp_path):
    import json

    known = P.path("word_bpe_49k.json")
    cased = json.load(open(known))
    cased["normalizer"]["normalizers"].pop()  # keeps capitals
    other = str(tmp_path / "cased.json")
    json.dump(cased, open(other, "w"))
    assert token_files.by_words(known) and not token_files.by_words(other) and not token_files.by_words(P.path("byte_bpe_50k.json"))
    for path in (other, P.path("byte_bpe_50k.json")):
        t = Tokenizer.from_file(path)
        folder = files.fresh("file://" + str(tmp_path), "out")
        token_files.write(docs(spark), folder, path)
        got = {r["doc_id"]: r["ids_crc32"] for r in token_files.read(spark, folder).collect()}
        assert got == {i: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in enumerate(TEXTS)}


def test_one_id_may_fill_many_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text", "id as start").union(spark.createDataFrame([(5, "five", 1)], "doc_id long, text string, start long"))
    df = stored(spark, df, tmp_path)
    folder = files.fresh("file://" + str(tmp_path), "out")
    made = token_files.write(df, folder, P.path("word_bpe_49k.json"))
    assert sum(d > 500 for _, d, _ in made) >= 3 and sum(d for _, d, _ in made) == 4001
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 4000 + [5]
    ends = [r["start"] + r["n_tokens"] for r in rows]
    assert [r["start"] for r in rows] == [0, *ends[:-1]]


def test_readers_take_spans_of_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_TOKENS", 50)
    raw = b"".join(token_files.file_blocks([(i, np.arange(i, dtype="<u4")) for i in range(100)]))
    (tmp_path / "part-000000.tok").write_bytes(raw)
    (tmp_path / "manifest.json").write_text('[["part-000000.tok", 100, 4950]]')
    rows = sorted(token_files.read(spark, "file://" + str(tmp_path)).collect())
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(i, i * (i - 1) // 2, i, zlib.crc32(np.arange(i, dtype="<u4").tobytes())) for i in range(100)]

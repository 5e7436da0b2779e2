"""The pipeline's stages on planted documents, and end to end."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from causeway.llm import decontaminate  # noqa: E402


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_clean_keeps_rows_as_they_are(spark, tmp_path, limit):
    item = " ".join(f"bench{i}" for i in range(15))
    rows = [(1, "a b c", "en", None), (2, "x " + item + " y", "en", 1), (3, None, None, 2), (None, "clean text", "de", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, b int").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = decontaminate.clean(df, spark.createDataFrame([(7, item)], "item_id long, text string"), broadcast_bytes=limit)
    assert out.columns == df.columns and sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, (r for r in rows if r[0] != 2)))


def test_planted(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    bad = ["scumword", "vileword", "nastyword"]
    docs, labels, shared, item = [], [], word(60), word(40)
    for i in range(240):
        w = word(int(rng.integers(30, 120)))
        if i % 6 == 0:
            for b in bad:
                w.insert(int(rng.integers(0, len(w))), b)
        labels.append((i, int(i % 6 == 0)))
        docs.append([i, w, "en", f"s{i % 3}"])
    near = list(docs[1][1])
    near[3] = "changed"
    docs += [[300, list(docs[2][1]), "en", "s"], [301, near, "en", "s"], [302, word(30) + shared, "en", "s"], [303, word(30) + shared + word(9), "en", "s"], [304, word(20) + item[5:25], "en", "s"], [305, word(20) + ["5cumw0rd"], "en", "s"], [306, [], "en", "s"]]
    rows = [(i, " ".join(w) if i != 306 else None, lang, src, 1) for i, w, lang, src in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        assert k == 4 or out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in d.select("doc_id").collect()}
    clean = {i for i in range(240) if i % 6}
    assert kept["toxicity"] == clean | {300, 301, 302, 303, 304, 306}
    assert kept["near_duplicates"] == kept["toxicity"] - {300, 301}
    assert kept["substring_dedup"] == kept["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "substring_dedup")).collect()}
    assert texts[302] == rows[-5][1] and len(texts[303].split()) == 39 and texts[306] is None
    assert kept["decontamination"] == kept["substring_dedup"] - {304}
    assert kept["byte_bpe"] == kept["decontamination"] and d.where("not exact").count() == 0


def test_run_on_nothing(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_as_brute_force(spark, tmp_path):
    """Each stage's rows from what it was given: scores text by text, all pairs, all windows, all benchmark windows, whole texts."""
    import public_tokenizers
    from test_exact import brute_hits
    from test_near_dup import brute as brute_classes
    from test_passages import WORD
    from test_passages import brute as brute_passages

    from causeway.llm import batch as B
    from causeway.llm import bpe, toxicity

    sf = "/root/testdata/sf0.001"
    d, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    scorer = toxicity.train(d, spark.read.parquet(f"{sf}/labels.parquet"), "true")
    for name, stage in corpus_pipeline.STAGES:
        given = [(r["doc_id"], r["text"]) for r in d.collect()]
        stage(spark, d, sf).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        got = {r["doc_id"]: r for r in d.collect()}
        texts = dict(given)
        if name == "toxicity":
            want = {i for i, t in given if scorer.scores(*B.flat(pa.array([t], pa.string())))[0] < 0.5}
        elif name == "near_duplicates":
            want = {c for _, c in brute_classes(given)}
        elif name == "substring_dedup":
            want = set(texts)
            digest = {i: (hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest()) for i, r in got.items()}
            assert digest == {i: sha for i, _, _, sha in brute_passages(given, 13)}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = {i for i, x in brute_hits(given, items).items() if not x[-1]}
        else:
            want = set(texts)
            enc = bpe._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            assert {i: r["ids"] for i, r in got.items()} == {i: enc.encode_ordinary(t or "") for i, t in given}
        assert set(got) == want, name
        out[name] = len(got)
    assert out["toxicity"] > out["near_duplicates"] > 0

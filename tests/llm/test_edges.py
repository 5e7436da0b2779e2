"""Ties, repeated rows, very long texts, empty tables and columns of clashing names."""

import numpy as np
import public_tokenizers as P

from causeway.llm import bpe, chat, decontaminate, langid, lm_scoring, near_dup, passages, queries, toxicity

CLASH = "doc_id long, text string, b long, k int, blob binary, uid long, ids string, exact string, extra long, score string, restored int, lang_pred string, lang string, class_id string, contaminated int"


def clashing(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, 1, 2, b"x", 3, "i", "e", 4, "s", 5, "p", "en", "c", 6) for i, t in rows], CLASH)
    df.write.parquet(str(tmp_path / "clash"))
    return spark.read.parquet(str(tmp_path / "clash"))


def long_text(seed, n):
    return " ".join(f"v{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def test_stages_with_clashing_columns_and_long_texts(spark, tmp_path):
    long, other = long_text(1, 60_000), long_text(2, 50_000)
    near = long.replace("v", "v", 1).split(" ")
    near[30_000] = "changed"
    rows = [(1, long), (2, " ".join(near)), (3, other), (4, "toxicword " + long_text(3, 30)), (5, None), (6, ""), (None, "x y z"), (7, long_text(4, 20) + " " + other[:400])]
    df = clashing(spark, rows, tmp_path)
    scorer = toxicity.Scorer(toxicity.language_model(np.ones(toxicity.SIZE**3)), [b"toxicword"], np.array([3.0]), 0.05)
    kept = toxicity.reject(df, scorer)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6, 7, None}
    said = toxicity.deobfuscate(df.where("doc_id = 4"), scorer.model).first()
    assert said["restored"].startswith("toxicword")
    one = near_dup.keep_one(df)
    assert one.columns == df.columns and {r["doc_id"] for r in one.collect()} == {1, 3, 4, 5, 6, 7, None}
    cut = passages.remove(df)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == df.columns and texts[1] == long and texts[2].split() == ["changed"] and len(texts[7].split()) < 40 and texts[5] is None
    items = spark.createDataFrame([(9, " ".join(other.split()[-12:]))], "item_id long, text string")
    for limit in (1 << 20, 0):
        clean = decontaminate.clean(df, items, broadcast_bytes=limit)
        assert clean.columns == df.columns and 3 not in {r["doc_id"] for r in clean.collect()} and clean.count() == 7
    coded = bpe.tokenize(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(r["exact"] is True for r in coded.collect()) and len(coded.where("doc_id = 1").first()["ids"]) > 60_000


def test_repeated_rows_score_alike(spark, tmp_path):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, "le chat dort"), (3, "le chat dort"), (4, None), (4, None)]
    df = clashing(spark, rows, tmp_path)
    lm = lm_scoring.score(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "true", "false").collect()
    assert len(lm) == 7 and len({round(r["score"], 5) for r in lm if r["doc_id"] in (1, 2)}) == 1 == len({round(r["score"], 5) for r in lm if r["doc_id"] == 4})
    assert len({round(r["base_score"], 9) for r in lm if r["doc_id"] in (1, 2)}) == 1
    scorer = toxicity.Scorer(toxicity.language_model(np.ones(toxicity.SIZE**3)), [b"cat", b"cat*"], np.array([1.0, 1.0]), 0.1)  # a tie of features: the first counts
    got = toxicity.score(df, scorer).collect()
    assert len(got) == 7 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert abs(next(r["score"] for r in got if r["doc_id"] == 1) - (1 - np.exp(-1.1))) < 1e-9


def test_languages_tie_by_name(spark, tmp_path):
    same = ["alpha beta gamma", "delta epsilon zeta"] * 20
    docs = spark.createDataFrame([(i, t, lang) for lang in ("b", "a") for i, t in enumerate(same)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "train"))
    model = langid.train(spark.read.parquet(str(tmp_path / "train")), "true")
    df = clashing(spark, [(1, "alpha zeta"), (1, "alpha zeta"), (2, None), (3, "12 !"), (4, "alpha " * 40_000)], tmp_path)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model, reject=False).collect()]
    assert sorted(got) == [(1, "a"), (1, "a"), (2, "und"), (3, "und"), (4, "a")]


def test_no_conversations_through_the_query(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string, seq long, kind string").write.parquet(str(tmp_path / "conversations.parquet"))
    (r,) = queries.op4_chat_formatting(spark, str(tmp_path)).collect()
    assert (r["conv_id"], r["n_turns"]) == (-1, 2)


def test_long_turns_and_clashing_columns_of_a_log(spark):
    long = "<|im_end|>\\ é" * 100_000
    t = spark.createDataFrame([(1, 0, "assistant", long, 5, "delta", 7)], "conv_id long, turn int, role string, text string, msg int, kind string, place int")
    (r,) = chat.parse(spark, chat.write(chat.turns_as_events(t))).collect()
    assert r["loss_chars"] == len(long) and r["n_turns"] == 1


def test_only_stored_rows_count_as_ordered(spark, tmp_path):
    """Rows of an RDD may come in another order when an executor is lost, so they are stored first."""
    from causeway.llm import exchange as X

    def same(df):
        return X.settled(df) is df

    rdd = spark.sparkContext.parallelize([(i, f"text {i}") for i in range(20)], 4).repartition(3)
    made = spark.createDataFrame(rdd, "doc_id long, text string")
    assert not same(made) and not same(made.where("doc_id > 3"))
    stored = X.settled(made)
    assert same(stored) and same(stored.select("doc_id")) and sorted(map(tuple, stored.collect())) == sorted(map(tuple, made.collect()))
    made.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert same(read) and same(read.where("doc_id > 3").select("text")) and not same(read.repartition(2)) and not same(read.orderBy("text")) and not same(read.distinct())

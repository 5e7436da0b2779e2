"""Tables without rows, repeated rows and clashing columns, for operators whose own tests don't have them."""

import public_tokenizers as P

from causeway.llm import decontaminate, files, flac, token_files

SCHEMA = "doc_id long, text string, start long, media binary, blob binary, k int"


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert flac.digest(flac.pcm_blocks(flac.media(df))).count() == 0
    folder = files.fresh("file://" + str(tmp_path), "t")
    assert token_files.write(df, folder, P.path("word_bpe_49k.json")) is not None and token_files.read(spark, folder).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.contaminated(df, items).count() == 0 == decontaminate.clean(df, items, broadcast_bytes=0).count()


def test_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(7, "same words", 1, None, None, 1)] * 3 + [(7, None, None, None, None, None), (None, "x", None, None, None, None)], SCHEMA)
    assert len({tuple(r)[1:] for r in flac.digest(flac.pcm_blocks(flac.media(df))).where("doc_id = 7").collect()}) == 2
    folder = files.fresh("file://" + str(tmp_path), "t")
    token_files.write(df, folder, P.path("word_bpe_49k.json"))
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 7, 7, 7, 7] and [r["n_tokens"] for r in rows] == [2, 1, 3, 3, 3] and rows[-1]["start"] == 9

import pytest

from tidegrid.llm import language as lg


def test_long_words_give_all_ngrams():
    """The middle of a long word counts, not its ends alone."""
    ids = lg.feature_ids("x" * 40 + "qzk" + "x" * 40, {})
    assert len(ids) == 6 + 84 + 83 + 1
    assert {lg.zlib.crc32(g.encode()) % lg.BUCKETS for g in ("qz", "zk", "xqz", "qzk", "zkx")} <= set(ids)


def test_too_many_languages_raise(spark):
    rows = [(i, f"word{'abc'[i % 3]} other", "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="max_langs"):
        lg.train(docs, max_langs=2)
    assert lg.train(docs, max_langs=3).langs == ["a", "b", "c"]

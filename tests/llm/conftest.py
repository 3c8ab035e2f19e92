import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty, long and repeated texts, ties, and columns whose names clash with the operators'."""
    words = "the quick brown fox jumps over the lazy dog while seven wizards boil juicy apples near quiet rivers today".split()
    long_ = " ".join(words[i * 7 % len(words)] + str(i % 97) for i in range(20_000))
    base = " ".join(f"{w}{i}" for i, w in enumerate(words * 3))
    texts = [None, "", " \t\n", "one", base, base, base.replace("fox3", "cat"), long_, "1234 5678 !!", "Ünï ▁ 漢字 🎉\x00x", "word " * 400, "a" * 5000]
    sources = [None, None, "s0", "s0", "s1", "s1", "s1", "s0", "s2", "", "s2", "s2"]
    langs = ["en", None, "en", None, "en", "en", "en", "en", None, "de", "en", "de"]
    rows = [(i, t, lang, s, -1, "x", 0.5, 7) for i, (t, lang, s) in enumerate(zip(texts, langs, sources))]
    rows += [rows[4], (None, "no id here at all", "en", None, -1, "x", 0.5, 7), (None, None, None, None, None, None, None, None)]
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("component_id", T.StringType()),
            T.StructField("score", T.DoubleType()), T.StructField("key", T.IntegerType()),
        ]
    )
    return spark.createDataFrame(rows, schema)

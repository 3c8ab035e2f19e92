"""Rows that are alone in their group, and hot keys."""

from collections import Counter

from pyspark.sql import functions as F

from tracklight.llm import simhash
from tracklight.llm.common import join_counted


def test_lone_rows_are_not_dealt(spark):
    """Most groups of blocks hold one fingerprint, which has nothing to be compared with."""
    keyed = spark.createDataFrame([(k, k * 100 + i) for k in range(50) for i in range(1 if k else 7)], "key long, fp long")
    assert {r.fp for r in simhash.tiles(keyed, 2048, "fp").collect()} == set(range(7))
    assert Counter(r.fp for r in simhash.tiles(keyed, 3, "fp").collect()) == dict.fromkeys(range(7), 3)


def test_hot_keys_need_no_anti_join(spark):
    """A hot key is told apart by a list in the plan; the rows are those of a plain join, with null keys and unknown ones."""
    keys = [7] * 3000 + [-(2**63)] * 2000 + list(range(100, 2100)) + [None, 5000]
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    lookup = rows.where("key < 5000").groupBy("key").agg(F.count("*").alias("_n"), F.max("key").alias("top"))
    for how in ("inner", "left"):
        joined = join_counted(rows, lookup, ["key"], "_n", how)
        assert "LeftAnti" not in joined._jdf.queryExecution().toString()
        assert Counter(joined.collect()) == Counter(rows.join(lookup.drop("_n"), ["key"], how).collect())
    assert "Union" not in join_counted(rows, lookup.where("key > 99"), ["key"], "_n", total=10_000)._jdf.queryExecution().toString()

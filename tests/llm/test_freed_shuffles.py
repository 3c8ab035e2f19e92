"""Shuffles of the near-dedup stage are deleted step by step, not whenever the driver collects its garbage."""

import time

from pyspark.sql import functions as F

import corpus_pipeline
from tracklight.llm import jaccard
from tracklight.llm.common import FREED, checkpoint, freeing_shuffles

SF = "/root/testdata/sf0.001"


def shuffled(spark):
    """Numbers of the shuffles that have files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {x.split("_")[1] for x in names if x.startswith("shuffle_")}


def left(spark, before):
    """How many shuffles still have files that hadn't before; they are deleted beside what runs."""
    until = time.time() + 10
    while (rest := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return len(rest)


def test_near_dedup_leaves_no_shuffles(spark, monkeypatch):
    texts = [" ".join("w%d" % (i // 4 * 97 + k * k % 89) for k in range(120)) + " e%d" % i for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").checkpoint()
    left_over, frames, groups = [], [], jaccard.similar_groups

    def seen(*args):
        before = shuffled(spark)
        frames.append(groups(*args))
        left_over.append(left(spark, before))
        return frames[-1]

    monkeypatch.setattr(jaccard, "similar_groups", seen)
    setting = spark.conf.get(FREED)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert left_over == [0] and spark.conf.get(FREED) == setting
    for _ in range(2):
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 4))
        assert frames[0].select("group").distinct().count() == 10


def test_freed_frames_can_run_again(spark):
    """Also one made within, whose shuffles are gone by then; frames made outside keep theirs."""
    rows = spark.range(1000).withColumn("key", F.col("id") % 7)
    with freeing_shuffles(spark):
        counts = rows.groupBy("key").count()
        copy = checkpoint(counts)
    assert sorted(copy.collect()) == sorted(counts.collect()) == sorted(counts.collect())
    assert {r["count"] for r in counts.collect()} == {142, 143}

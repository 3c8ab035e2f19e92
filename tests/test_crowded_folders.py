"""Folders of many cases when cases are archived."""

from pyspark.sql import functions as F

from tracklight.operators import capture

ROWS = [(f"n{i}", f"Cases/P/n{i}.md") for i in range(3000)] + [("a", "Cases/P/a.md"), ("b", "Cases/P/a/b.md"), ("c", "Cases/P/a/b/c.md"), ("P", "Cases/P.md")]


def most_read(spark, run):
    """What run() gives, and the rows that the largest task reads of shuffles meanwhile."""
    scala = spark.sparkContext._jsc.sc()
    bus, tasks = scala.listenerBus(), scala.statusStore().taskList
    spark.sparkContext.setJobGroup("first", "")
    spark.range(1).count()
    (job, *_) = spark.sparkContext.statusTracker().getJobIdsForGroup("first")
    begin = max(spark.sparkContext.statusTracker().getJobInfo(job).stageIds)
    out = run()
    bus.waitUntilEmpty(30_000)
    read = [0]
    for stage in range(begin + 1, begin + 200):
        found = tasks(stage, 0, 1000)
        read += [found.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(found.size())]
    return out, max(read)


def archived(spark, *ids):
    rows = spark.createDataFrame(ROWS, "id string, file_path string").withColumn("archived", F.lit(False)).repartition(4)
    out = capture.archive(rows, spark.createDataFrame([(i,) for i in ids], "id string"))
    return {r.id: (r.file_path, r.archived) for r in out.collect()}


def test_a_crowded_folder_is_not_one_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(capture, "CROWDED", 100, raising=False)
    confs = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        out, most = most_read(spark, lambda: archived(spark, "a"))
        assert most < 1500
        changed = {i: x for i, x in out.items() if x != (dict(ROWS)[i], False)}
        assert changed == {"a": ("Cases/P/Archive/a.md", True), "b": ("Cases/P/Archive/a/b.md", False), "c": ("Cases/P/Archive/a/b/c.md", False)} and len(out) == len(ROWS)
        out, most = most_read(spark, lambda: archived(spark, "P", "b"))  # the crowded folder itself moves
        assert most < 1500
        assert out["P"] == ("Cases/Archive/P.md", True) and out["n7"] == ("Cases/Archive/P/n7.md", False) and out["a"] == ("Cases/Archive/P/a.md", False)
        assert out["b"] == ("Cases/P/a/Archive/b.md", True) and out["c"] == ("Cases/P/a/Archive/b/c.md", False)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

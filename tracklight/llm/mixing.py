"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source's weight is a schedule over training time 0 to 1. Its integral is the source's share of
the budget. The source's documents are strung in a fixed pseudo-random order, and the tokens before a
document are its place in the source's demand; the inverse of the demand that has accumulated by a
time gives the time at which the document is due, its training position. Documents are range-sorted by
position.

Running sums are taken at two levels, over BINS bins of a hash for each source and then within a bin,
so a source with a third of all rows is dealt to many tasks. Sources are ranked in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklight.llm.common import WORD, checkpoint

#: Share of all sizes that the mix takes, and the most that it takes of a source and of a document, in sizes.
BUDGET, MOST = 1.5, 2
#: For each class of sources, the weight at the times 0 and 1, linear between them. The integrals are 3, 1 and 2.
SCHEDULES: tuple[Sequence[tuple[float, float]], ...] = (
    ((0.0, 4.0), (1.0, 2.0)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.0), (1.0, 3.0)),
)
#: Hex digits of a document's hash that name its bin.
BIN_DIGITS = 3


def n_words(text: str = "text") -> F.Column:
    """Runs of characters other than space and the controls 09-0D; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(schedule: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with rank (long, from 0): by code point of column source, null last. No task holds them all."""
    by = [F.col("source").isNull(), F.col("source")]
    parted = sources.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    parted = checkpoint(parted)
    counts = parted.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return parted.withColumn("own", own).join(offsets, "part").select(
        "source", "source_size", (F.col("own") + F.col("offset")).cast("long").alias("rank")
    )


def targets(sources: DataFrame, schedules=SCHEDULES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, rank, class, target (double) for a row for each source with its size.

    Weights repeat over the ranks. A target stops at `most` times its source's size and the excess is
    reshared by weight, until none is above.
    """
    weights = F.array(*(F.lit(float(integral(s))) for s in schedules))
    rows = ranked(sources).withColumn("class", (F.col("rank") % len(schedules)).cast("int"))
    rows = checkpoint(rows.withColumn("weight", F.element_at(weights, F.col("class") + 1)))
    cap = F.col("source_size") * F.lit(float(most))
    share = None  # of the budget, for a weight of 1
    while True:
        above = F.lit(False) if share is None else F.col("weight") * F.lit(share[0]) / F.lit(share[1]) > cap
        total, capped, weight, n = rows.agg(
            F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if not total or not weight or (share and share[2] == n):
            break
        share = (budget * total - (capped or 0.0), weight, n)
    wanted = cap if share is None else F.least(cap, F.col("weight") * F.lit(share[0]) / F.lit(share[1]))
    return rows.select("source", "source_size", "rank", "class", wanted.cast("double").alias("target"))


def due(share: F.Column, kind: F.Column, schedules=SCHEDULES) -> F.Column:
    """The time at which a source of a class has been asked for this share (0 to 1) of its target."""
    out = F.lit(None).cast("double")
    for k, schedule in reversed(list(enumerate(schedules))):
        whole, done = integral(schedule), 0.0
        time = F.lit(1.0)
        pieces = []
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            pieces.append((done, t0, w0, t1, w1))
            done += (t1 - t0) * (w0 + w1) / 2
        for before, t0, w0, t1, w1 in reversed(pieces):
            area = F.greatest(share * whole - before, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            # area = w0 x + slope x^2 / 2, solved for x in the form that stays exact where the slope is small
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * area, F.lit(0.0)))
            x = F.when(root + w0 > 0, 2 * area / (root + w0)).otherwise(0.0)
            time = F.when(share * whole < before + (t1 - t0) * (w0 + w1) / 2, t0 + x).otherwise(time)
        out = F.when(kind == k, F.least(time, F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, schedules=SCHEDULES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """A row for each row of doc_id, source and size (long), with what the mix takes of it.

    Adds source_size (long), target (double, the source's), taken (long: words taken, whole passes over
    the source and at its end a part of one document at most), copies (int: passes that take at least
    half the document), position and position2 (double: training time at which the first and second pass
    reach it; null if they don't). Order within a source is by MD5 of doc_id, then size, so reruns
    agree; rows of equal doc_id and size are interchangeable. A null source is a source, the last;
    documents of null doc_id count as id ''. Documents of size 0 take 0. Without rows the result is empty.
    `most` is 2: two passes at most.
    """
    if most != 2:
        raise ValueError("two passes are made")
    docs = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.withColumn("key", key).withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = docs.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    bins = checkpoint(bins)
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), schedules, budget, most)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_before", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).drop("bin_size")
    sources = sources.withColumnRenamed("source", "_s")
    bins = bins.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    bins = bins.withColumnsRenamed({"source": "_source", "bin": "_bin"})
    own = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("own_before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = placed.join(bins, (F.col("bin") == F.col("_bin")) & F.col("source").eqNullSafe(F.col("_source")))
    start = F.col("own_before") + F.col("bin_before")
    words = F.floor("target").cast("long")
    zero = F.lit(0).cast("long")
    takes = [F.least(F.greatest(words - start - p * F.col("source_size"), zero), F.col("size")) for p in range(most)]
    at = [
        F.when(takes[p] > 0, due((start + p * F.col("source_size")) / F.col("target"), F.col("class"), schedules))
        for p in range(most)
    ]
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (takes[0] + takes[1]).alias("taken"),
        sum((F.when((t > 0) & (2 * t >= F.col("size")), 1).otherwise(0) for t in takes), F.lit(0)).alias("copies"),
        at[0].alias("position"),
        at[1].alias("position2"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; what isn't taken comes last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: The same in SQL, for sources whose doc_id are distinct.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
r(n, num, den, capped) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size), sum(w), 0 FROM s
  UNION ALL
  SELECT n + 1, num2, den2, capped2 FROM (
    SELECT n, capped,
      (SELECT 1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (w * num / den > 2.0::DOUBLE * source_size), 0) FROM s) AS num2,
      (SELECT sum(w) FILTER (NOT w * num / den > 2.0::DOUBLE * source_size) FROM s) AS den2,
      (SELECT CAST(count(*) FILTER (w * num / den > 2.0::DOUBLE * source_size) AS INT) FROM s) AS capped2
    FROM r) WHERE capped2 <> capped),
l AS (SELECT num, den FROM r ORDER BY n DESC LIMIT 1),
t AS (SELECT s.*, least(2.0::DOUBLE * source_size, w * num / den) AS target FROM s, l),
p AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
  FROM d),
q AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.c, t.w,
    least(greatest(CAST(floor(t.target) AS BIGINT) - p.c, 0), p.size) AS t0,
    least(greatest(CAST(floor(t.target) AS BIGINT) - p.c - t.source_size, 0), p.size) AS t1
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 AS BIGINT) AS taken,
  CASE WHEN t0 > 0 THEN (CASE w
    WHEN 3 THEN CASE WHEN c / target * 3.0::DOUBLE < 3.0::DOUBLE THEN 2 * (c / target * 3.0::DOUBLE) / (sqrt(16.0::DOUBLE + 2 * -2.0::DOUBLE * (c / target * 3.0::DOUBLE)) + 4.0::DOUBLE) ELSE 1.0::DOUBLE END
    WHEN 1 THEN c / target
    ELSE 2 * (c / target * 2.0::DOUBLE) / (sqrt(1.0::DOUBLE + 2 * 2.0::DOUBLE * (c / target * 2.0::DOUBLE)) + 1.0::DOUBLE) END) END AS position
FROM q
"""

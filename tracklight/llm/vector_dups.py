"""Near-duplicate vectors of equal label by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated onto the principal axes of the whole table, those of most
variance first. Tiles of pairs accumulate the leading dimensions' products; by Cauchy-Schwarz the rest
of the product is at most that of the two suffix norms, so a pair stops once its cosine cannot
reach the threshold. What survives is compared on the vectors as given.

Equal vectors are made one first, with their number, so copies cost nothing. A label with many
vectors is cut into parts along the first principal axis and dealt as pairs of parts to as many tasks as it
needs. The first coordinates of two unit vectors differ by no more than the vectors do, so parts that lie farther apart
than the threshold's distance are never paired, and no link is lost. Within the paired parts all pairs are looked at: where a
label's vectors all lie close together along that axis, work still grows with the square of its distinct vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import checkpoint, join_counted, letting_go, long
from tracklight.llm.components import connected_components, stars
from tracklight.operators.common import numbered

THRESHOLD = 0.93
#: Vectors of a part; a task compares two parts.
TILE = 4096
#: Dimensions that are accumulated before pairs are given up, and rows of a tile at a time.
LEAD, ROWS = 16, 512
#: Slack of the bound, over what rounding can do.
SLACK = 1e-9


def usable(label: str = "label", vector: str = "embedding") -> F.Column:
    """Whether a vector can have links: label and vector not null, all components finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & fine, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the principal axes of all of them, of most variance first, as columns.

    Each partition sums its outer products; those sums, a matrix for a partition, are summed again by
    length before they reach the driver.
    """
    schema = T.StructType([long("dim"), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def give(sums: dict[int, np.ndarray]):
        columns = [pa.array(list(sums), pa.int64()), pa.array([x.ravel().tolist() for x in sums.values()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "sums"])

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                x = unit(matrix(batch.column(1).filter(pa.array(dims == dim)), dim))
                sums[int(dim)] = sums.get(int(dim), 0) + x.T @ x
        yield give(sums)

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[dim] = sums.get(dim, 0) + np.array(x)
        yield give(sums)

    rows = classes.select("dim", "embedding").mapInArrow(products, schema).repartition("dim").mapInArrow(added, schema).collect()
    return {r.dim: np.linalg.eigh(np.array(r.sums).reshape(r.dim, r.dim))[1][:, ::-1].copy() for r in rows}


def near(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float) -> np.ndarray:
    """The matrix of links between two sets of vectors."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ rotation, ub @ rotation
    dim = a.shape[1]
    edges = range(0, dim, LEAD)
    rests = [np.stack([np.sqrt((x[:, lead + LEAD :] ** 2).sum(axis=1)) for lead in edges]) for x in (ra, rb)]  # norms of what is left
    out = np.zeros((len(a), len(b)), bool)
    for start in range(0, len(a), ROWS):
        rows = slice(start, start + ROWS)
        total, alive = 0.0, None
        for step, lead in enumerate(edges):
            total = total + ra[rows, lead : lead + LEAD] @ rb[:, lead : lead + LEAD].T
            alive = total + rests[0][step, rows][:, None] * rests[1][step][None, :] >= threshold - SLACK
            if alive.mean() < 0.02:
                break
        i, j = np.nonzero(alive)
        for part in range(0, len(i), 50_000):
            pi, pj = i[part : part + 50_000] + start, j[part : part + 50_000]
            good = np.einsum("ij,ij->i", ua[pi], ub[pj]) >= threshold
            out[pi[good], pj[good]] = True
    return out


def leading(classes: DataFrame, rotations) -> DataFrame:
    """label, dim, cid, lead: each class's coordinate on the first principal axis; rotations is a broadcast of axes()."""

    def coordinates(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            lead = np.zeros(len(dims))
            for dim in np.unique(dims):
                mine = dims == dim
                lead[mine] = unit(matrix(batch.column("embedding").filter(pa.array(mine)), dim)) @ rotations.value[int(dim)][:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "cid")), pa.array(lead)], names=["label", "dim", "cid", "lead"])

    schema = T.StructType([long("label"), long("dim"), long("cid"), T.StructField("lead", T.DoubleType())])
    return classes.select("label", "dim", "cid", "embedding").mapInArrow(letting_go(coordinates), schema)


def paired_parts(leads: DataFrame, threshold: float, tile: int) -> DataFrame:
    """cid, part, first, last: a class's part, of `tile` classes along the first axis, and the first and last part that it must meet.

    Parts follow each other along the axis, so the parts near enough to one are a run of them. The runs come from running counts
    over the parts' ends, of which there are two for each part.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - SLACK))) + SLACK)
    group = ["label", "dim"]
    placed = numbered(leads, group, ["lead", "cid"], "place").withColumn("part", F.floor((F.col("place") - 1) / tile).cast("int")).drop("place")
    placed = checkpoint(placed)
    ends = placed.groupBy(*group, "part").agg(F.min("lead").alias("low"), (F.max("lead") + reach).alias("high"))
    ends = checkpoint(ends)
    low = ends.select(*group, "part", F.col("low").alias("edge"), F.lit(0).alias("kind"))
    high = ends.select(*group, "part", F.col("high").alias("edge"), F.lit(1).alias("kind"))
    before = Window.partitionBy(*group).orderBy("edge", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = low.union(high).withColumns({"lows": F.sum(1 - F.col("kind")).over(before), "highs": F.sum("kind").over(before)})
    last = F.max(F.when(F.col("kind") == 1, F.col("lows") - 1))  # parts that begin no later than this one's reach
    first = F.max(F.when(F.col("kind") == 0, F.col("highs")))  # parts whose reach ends before this one begins
    runs = both.groupBy(*group, "part").agg(first.cast("int").alias("first"), last.cast("int").alias("last"))
    return placed.join(runs, [*group, "part"]).select("cid", "part", "first", "last")


RESULT = T.StructType([long("a"), long("b"), long("weight")])


def compare_tiles(batches, rotations: dict[int, np.ndarray], threshold: float):
    """For each tile, the copies that each class is linked to (b null), and links that join its components.

    The rows come sorted by tile: (label, dim, lo, hi).
    """

    def result(rows: list[pa.RecordBatch]):
        all_rows = pa.Table.from_batches(rows).combine_chunks()
        dim = all_rows["dim"][0].as_py()
        x = matrix(all_rows["embedding"].combine_chunks(), dim)
        side, cid, n = (all_rows[c].to_numpy() for c in ("side", "cid", "n"))
        same = all_rows["lo"][0].as_py() == all_rows["hi"][0].as_py()
        one, two = (slice(None),) * 2 if same else (side == 0, side == 1)
        linked = near(x[one], x[two], rotations[dim], threshold)
        if same:
            np.fill_diagonal(linked, False)
            sums = [(cid, linked @ n)]
        else:
            sums = [(cid[one], linked @ n[two]), (cid[two], linked.T @ n[one])]
        nodes, weights = (np.concatenate(c) for c in zip(*sums))
        a, b = stars(linked, cid[one], cid[two])
        none = pa.nulls(len(nodes), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([nodes, a])),
                pa.chunked_array([none, pa.array(b)]).combine_chunks(),
                pa.array(np.concatenate([weights, np.zeros(len(a), np.int64)])),
            ],
            names=["a", "b", "weight"],
        )

    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tiles = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "lo", "hi")], axis=1)
        starts = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]).any(axis=1)) + 1), len(tiles)]
        for s, e in zip(starts, starts[1:]):
            if key is not None and key != tuple(tiles[s]):
                yield result(held)
                held = []
            key = tuple(tiles[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield result(held)


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """A row for each row of vec_id, label and embedding: vec_id, n_links, component_id, kept.

    n_links (long) counts the other rows of equal label whose cosine is at least `threshold`, copies
    included; component_id is the smallest vec_id that can be reached over links, a row's own included; kept is
    vec_id = component_id. A row with a null label, or whose vector is null, empty, all zero or has a
    component that is null or not finite, has no links and is its own component. Vectors of unequal length
    aren't linked. A null vec_id is passed over by component_id unless all of a component are null, and
    isn't kept. Repeated rows each count. Other columns are not returned. Labels are integers.
    """
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", usable().alias("usable"))
    good = rows.where("usable").select("vec_id", "label", "embedding")
    classes = good.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes = classes.withColumn("dim", F.size("embedding").cast("long")).withColumn("cid", F.monotonically_increasing_id())
    classes = checkpoint(classes)  # from here on the numbers hold
    rotations = classes.sparkSession.sparkContext.broadcast(axes(classes))
    dealt = classes.join(paired_parts(leading(classes, rotations), threshold, tile), "cid")
    dealt = dealt.withColumn("other", F.explode(F.sequence("first", "last"))).select(
        "label",
        "dim",
        F.least("part", "other").alias("lo"),
        F.greatest("part", "other").alias("hi"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        "cid",
        "n",
        "embedding",
    )
    dealt = dealt.repartition("label", "dim", "lo", "hi").sortWithinPartitions("label", "dim", "lo", "hi")
    found = checkpoint(dealt.mapInArrow(letting_go(lambda batches: compare_tiles(batches, rotations.value, threshold)), RESULT))
    weights = found.where("b is null").groupBy(F.col("a").alias("_w")).agg(F.sum("weight").alias("weight"))
    roots = connected_components(found.where("b is not null"))
    classes = classes.join(roots, F.col("cid") == F.col("node"), "left").join(weights, F.col("cid") == F.col("_w"), "left")
    classes = checkpoint(
        classes.select(
            "label", "embedding", "n", "least_id", F.coalesce("root", "cid").alias("root"),
            (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
        )
    )
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("_n"))
    lookup = join_counted(classes, least, ["root"], "_n").select("label", "embedding", "n", "n_links", "component_id")
    linked = join_counted(good, checkpoint(lookup), ["label", "embedding"], "n")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH v AS (
  SELECT vec_id, label, embedding,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
x AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM v WHERE fine),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c.m AS component_id,
  v.vec_id = c.m AS kept
FROM v JOIN c ON c.a = v.vec_id
"""

"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import checkpoint, join_counted, letting_go, long


#: Up to so many links are joined by one task, which holds them in some 50 bytes each.
ALONE = 500_000
#: Links that a task reads at least; few links over many partitions would leave a file for each pair of tasks.
TASK_LINKS = 500_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (long) for every node of the links: root is the smallest node that can be reached.

    Up to ALONE distinct links, or what is left of more after some rounds, are joined by one task: a round's ten stages of as many tasks
    as a shuffle has partitions cost more time and disk than so few links do. Of more, large-star and small-star steps alternate until
    nothing changes, a number of rounds logarithmic in the longest chain. The smallest neighbour is an aggregate that is joined back; nodes with very many links get it by
    a broadcast of at most HOT rows, so their links are never gathered in one task. Each round is checkpointed. Links with
    a null end and links of a node with itself count for nothing; without links the result is empty.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen = None
    while True:
        edges = checkpoint(edges)
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] <= ALONE:
            return checkpoint(edges.coalesce(1).mapInArrow(letting_go(join_alone), T.StructType([long("node"), long("root")])))
        if mark[0] == 0 or mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        seen = mark
        edges = edges.coalesce(mark[0] // TASK_LINKS + 1)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both, F.least("u", F.min("v")), 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large).coalesce(2 * mark[0] // TASK_LINKS + 1)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = smallest(large, F.min("v"), 2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()


def join_alone(batches):
    """node, root of all links (u, v) of the batches."""
    ends = [np.stack([batch.column(i).to_numpy() for i in range(2)]) for batch in batches]
    if ends:
        found = least_reached(*np.concatenate(ends, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the smallest node that each reaches.

    In a round each root that a smaller one is linked with goes below it. One that is the smallest of its neighbours has others gone below
    or past it, and so isn't in the next round: the trees that are linked with others halve in two rounds.
    """
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        lo, hi = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = lo != hi
        if not apart.any():
            return names, names[root]
        i, j = i[apart], j[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]


def smallest(edges: DataFrame, least: F.Column, total: int) -> DataFrame:
    """u, v and m: the aggregate `least` over the links of u, of at most `total`."""
    return join_counted(edges, edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("_n")), ["u"], "_n", total=total)


def stars(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a matrix of links joins, at most one for each row and each column.

    rows and columns are node numbers (int64). Labels sink to the smallest number of each component.
    """
    some_r, some_c = linked.any(axis=1), linked.any(axis=0)
    linked, rows, columns = linked[some_r][:, some_c], rows[some_r], columns[some_c]
    if not len(rows):
        return rows, rows
    top = np.iinfo(np.int64).max
    label_r, label_c = rows.copy(), columns.copy()
    while True:
        new_r = np.minimum(label_r, np.where(linked, label_c[None, :], top).min(axis=1))
        new_c = np.minimum(label_c, np.where(linked, new_r[:, None], top).min(axis=0))
        if (new_r == label_r).all() and (new_c == label_c).all():
            nodes, roots = np.concatenate([rows, columns]), np.concatenate([label_r, label_c])
            return nodes[nodes != roots], roots[nodes != roots]
        label_r, label_c = new_r, new_c

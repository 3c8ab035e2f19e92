"""Parts of vectors along the first principal axis: far parts aren't paired, and no link is lost."""

import numpy as np

from tracklight.llm import vector_dups
from tracklight.llm.common import checkpoint


def test_far_parts_are_not_paired(spark):
    rng = np.random.default_rng(3)
    turn = np.concatenate([rng.uniform(0, 3, 240), np.full(20, 1.5)])  # an arc, with a lump of near copies
    rows = np.stack([np.cos(turn), np.sin(turn), 0.05 * rng.standard_normal(260)], axis=1)
    label = np.where(np.arange(260) % 9 == 0, 1, 0)  # most are of one label
    data = [(i, int(x), r.tolist()) for i, (x, r) in enumerate(zip(label, rows))]
    df = spark.createDataFrame(data, "vec_id long, label long, embedding array<double>")
    unit = vector_dups.unit(rows)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(260, dtype=bool)
    root = np.arange(260)
    for _ in range(260):
        root = np.minimum(root, np.where(linked, root[None, :], 260).min(axis=1))
    for tile in (8, 50, 4096):
        out = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dups.link_vectors(df, tile=tile).collect())
        assert out == [(i, int(linked[i].sum()), int(root[i])) for i in range(260)]

    class Axes:
        value = {3: np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()}

    classes = checkpoint(df.selectExpr("vec_id AS cid", "label", "embedding", "3L AS dim"))
    parts = vector_dups.paired_parts(vector_dups.leading(classes, Axes), 0.93, 8).join(classes, "cid").toPandas()
    mine = parts[parts.label == 0]
    count = mine.part.nunique()
    pairs = {(r.part, q) for r in mine.itertuples() for q in range(r.first, r.last + 1)}
    assert {(b, a) for a, b in pairs} == pairs and {(p, p) for p in range(count)} <= pairs
    assert len(pairs) < 0.7 * count**2  # what is farther apart than the threshold's distance is left out
    part = dict(zip(parts.cid, parts.part))
    assert all((part[i], part[j]) in pairs for i, j in zip(*np.nonzero(linked & (label == 0)[:, None])))

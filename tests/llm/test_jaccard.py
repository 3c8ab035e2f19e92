"""Near copies against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tracklight.llm import jaccard
from tracklight.llm.common import shared_folder
from tracklight.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute_kept(rows):
    """Smallest doc_id of each group that links of similarity 0.8 join, by all pairs."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))
    near = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                near.append((i, j))
    moved = True
    while moved:
        moved = False
        for i, j in near:
            least = min(root[i], root[j])
            moved |= root[i] != least or root[j] != least
            root[i] = root[j] = least
    groups = {}
    for (doc_id, _), r in zip(rows, root):
        groups[r] = min(doc_id, groups.get(r, doc_id))
    return sorted(groups.values())


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    shared_folder(spark)


def near_rows():
    """Pairs of similarity 0.75 to 0.85 in several sizes, chains, exact copies, a shared passage and short texts."""
    rng = random.Random(23)
    word = lambda: "w%d" % rng.randrange(3000)
    common = [word() for _ in range(40)]
    texts = []
    for n in (30, 60, 150, 400, 1200):
        for similarity in (0.75, 0.78, 0.79, 0.795, 0.8, 0.805, 0.81, 0.82, 0.85):
            words = [word() for _ in range(n + 4)]
            swapped = round(n * (1 - similarity) / (1 + similarity))  # shingles of each that the other lacks
            texts += [words, words[: n + 4 - swapped] + [word() for _ in range(swapped)]]
    for _ in range(3):
        words = [word() for _ in range(120)]
        for _ in range(6):
            texts.append(list(words))
            words[rng.randrange(len(words))] = word()
    texts += [common + [word() for _ in range(rng.choice([8, 9, 10, 60]))] for _ in range(40)]
    texts += [texts[3], ["one"], ["One"], ["one", "two", "three"], [], []]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)] + [(len(order), None)]


@pytest.mark.parametrize("tiles", [(2048, 512), (5, 3)])
def test_stage_is_exact(spark, tiles, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    monkeypatch.setattr(jaccard.similar_groups, "__defaults__", ("text", *tiles))
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)


def test_common_shingles_change_nothing(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    many = jaccard.common_shingles(docs)
    assert len(many[0]) > 100
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == brute_kept(rows)


def test_distances_are_at_most_what_isnt_shared(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard, "AT_ONCE", 64)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.choice([0, 3, 900, 1024, 1025, 2040, 2050, 5000], 40)]
    prints = jaccard.Fingerprints([jaccard.parities(x) for x in sets])
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    for i, j, d in zip(a, b, prints.distances(a, b)):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (i != j or d == 0)
        cells = min(max(1024, 1 << (len(sets[k]) - 1).bit_length() if len(sets[k]) else 0) for k in (i, j))
        odd = np.bincount(np.concatenate([sets[i], sets[j]]).astype(np.uint64) % np.uint64(cells), minlength=cells) & 1
        assert d == odd.sum()


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64)]))
        common = a[rng.random(len(a)) < 0.5]
        rank = rng.permutation(len(common)) + 1
        if len(b) and jaccard.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            assert len(np.intersect1d(jaccard.prefix(a, common, rank), jaccard.prefix(b, common, rank)))


def test_run_drops_by_exact_similarity(spark, tmp_path, monkeypatch):
    """run() with the stages that need whole tables left out drops what brute force drops."""
    rows = near_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    last = ("last", lambda spark, docs, sf: docs)
    stages = [x for x in corpus_pipeline.STAGES if x[0] == "simhash_near_dedup"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages, last])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == brute_kept(rows)


@pytest.mark.parametrize("tile", [3, 6, 200])
def test_clusters_in_parts(spark, tile, monkeypatch):
    """Clusters of one group, of several and of strangers, cut into parts of every size, are joined as all pairs join them."""
    rng = random.Random(29)
    clusters = []
    for groups in ([30], [20, 5, 1, 1], [1] * 12, [2] * 6, [9, 9]):
        rows = []
        for size in groups:
            words = ["w%d" % rng.randrange(5000) for _ in range(90)]
            for _ in range(size):
                rows.append(" ".join(words))
                words[rng.randrange(len(words))] = "x%d" % rng.randrange(5000)
        rng.shuffle(rows)
        clusters.append(rows)
    texts = [(i, t) for i, t in enumerate(t for rows in clusters for t in rows)]
    members = [(key, i, 86) for i, key in enumerate(k for k, rows in enumerate(clusters) for _ in rows)]
    df = spark.createDataFrame(texts, "node long, text string").checkpoint()
    monkeypatch.setattr(jaccard, "CLUSTER_SHINGLES", 86 * (2 * tile - 1))
    links = jaccard.verified(spark.createDataFrame(members, "key long, node long, n long").checkpoint(), df, tile)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    ours = {}
    for i, _ in texts:
        ours.setdefault(roots.get(i, i), []).append(i)
    assert sorted(map(min, ours.values())) == brute_kept(texts)

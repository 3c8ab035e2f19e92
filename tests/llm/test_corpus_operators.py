"""SimHash, mixing, vectors, chat and the pipeline against brute force and DuckDB."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tracklight.llm import chat, jaccard, mixing, simhash, vector_dups
from tracklight.llm.components import connected_components, stars
from tracklight.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def reachable(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# Components.


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    roots = reachable(300, pairs)
    links = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")
    out = {r.node: r.root for r in connected_components(links).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert out == {i: roots[i] for i in touched}
    assert connected_components(links.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.data())
def test_stars(n, m, data):
    linked = np.array(data.draw(st.lists(st.lists(st.booleans(), min_size=m, max_size=m), min_size=n, max_size=n)))
    a, b = stars(linked, np.arange(n), np.arange(n, n + m))
    assert reachable(n + m, zip(a.tolist(), b.tolist())) == reachable(n + m, ((i, n + j) for i, j in zip(*np.nonzero(linked))))
    assert len(a) <= n + m


# 2. SimHash.


def brute_fingerprint(text, k=4):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\n\tÀ \x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def check_components(rows, radius=4):
    prints = [r.fp & (2**64 - 1) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    roots = reachable(len(rows), near)
    least = {}
    for r, g in zip(rows, roots):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert [r.component_id for r in rows] == [least.get(g) for g in roots]


@pytest.mark.parametrize("tile", [2048, 5])
def test_near_links_lose_nothing(spark, tile, monkeypatch):
    """Clusters of near fingerprints, some in one block pair's bucket, with tiles of every size."""
    rng = random.Random(11)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 12])):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    hot = rng.getrandbits(64)
    prints += [hot ^ rng.getrandbits(6) ^ (rng.getrandbits(3) << 40) for _ in range(60)]
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.RADIUS, tile))
    check_components(simhash.near_duplicates(df).orderBy("doc_id").collect())


def test_simhash_of_odd_rows(spark, odd_docs):
    prints = simhash.fingerprints(odd_docs)
    rows = simhash.near_duplicates(prints).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.fp & (2**64 - 1) == brute_fingerprint(r.text)
    check_components(rows)
    assert simhash.near_duplicates(prints.limit(0)).count() == 0


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op2_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{brute_fingerprint(t):016x}" for i, t in docs.items()}
    rows = [r for r in QUERIES["op2_simhash"](spark, SF).withColumn("fp", F.conv("fingerprint", 16, -10).cast("long")).collect()]
    check_components(rows)


# 4, 8 and 10 against SQL.


def duck(sf=SF):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck().execute(ORACLE_SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    text = lambda df: sorted(tuple("" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df[names].itertuples(index=False))
    assert text(ours) == text(theirs)


# 4. Mixing.


def plain_targets(sizes, weights):
    """The excess reshared by weight, step by step."""
    budget = 1.5 * sum(sizes)
    target, capped = [0.0] * len(sizes), set()
    left = budget
    while left > 1e-9 and len(capped) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in open_)
        for i in open_:
            target[i] += left * weights[i] / total
        left = 0.0
        for i in open_:
            if target[i] > 2 * sizes[i]:
                left += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                capped.add(i)
    return target


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 30):
        names = sorted(rng.sample([f"s{i}" for i in range(100)], n))
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in names]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        out = {r.source: r.target for r in mixing.targets(df).collect()}
        expected = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(n)])
        assert np.allclose([out[s] for s in names], expected, rtol=1e-9, atol=1e-6)


def test_mix_of_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("size", mixing.n_words())
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode().split())) for r in odd_docs.collect())
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.position))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", 1) for i in range(3000)], "doc_id long, source string, size long")
    rows = mixing.mix(docs).where("position is not null").collect()
    for k, schedule in enumerate(mixing.SCHEDULES):
        place = np.sort([p for r in rows if r.source == f"s{k}" for p in (r.position, r.position2) if p is not None])
        (t0, w0), (t1, w1) = schedule
        share = (w0 * place + (w1 - w0) * place**2 / 2) / mixing.integral(schedule)
        assert np.allclose(np.diff(share), np.diff(share).mean(), atol=1e-6)


# 8. Vectors.


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        base = rng.normal(size=20)
        for _ in range(rng.integers(1, 6)):
            rows.append((base + rng.normal(size=20) * rng.choice([0.0, 0.1, 0.3])) * rng.choice([1.0, 7.0]))
    vectors = [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    n = len(vectors)
    vectors += [(n, None, 0), (n + 1, [0.0] * 20, 0), (n + 2, [float("nan")] * 20, 0), (n + 3, vectors[0][1], None), (n + 4, [1.0, None], 0), (n + 5, [], 0)]
    vectors += [vectors[0], (None, vectors[0][1], vectors[0][2]), (n + 6, vectors[0][1][:5], vectors[0][2])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    good = lambda v: v[1] and v[2] is not None and None not in v[1] and all(np.isfinite(v[1])) and any(v[1])
    unit = [np.float32(v[1]).astype(float) / np.linalg.norm(np.float32(v[1]).astype(float)) if good(v) else None for v in vectors]
    pairs = [
        (i, j) for i in range(len(vectors)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and vectors[i][2] == vectors[j][2] and unit[i] @ unit[j] >= 0.93
    ]
    links, roots = Counter(x for p in pairs for x in p), reachable(len(vectors), pairs)
    least = {}
    for v, g in zip(vectors, roots):
        if v[0] is not None:
            least[g] = min(v[0], least.get(g, v[0]))
    expected = sorted((str(v[0]), links[i], str(least.get(roots[i])), v[0] is not None and v[0] == least[roots[i]]) for i, v in enumerate(vectors))
    for tile in (4096, 7):
        out = vector_dups.link_vectors(df, tile=tile).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == expected
    assert vector_dups.link_vectors(df.limit(0)).count() == 0


def test_bound_stops_no_link():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(300, 64))
    b = a + rng.normal(size=a.shape) * 0.25
    rotation = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    cosine = vector_dups.unit(a) @ vector_dups.unit(b).T
    assert (vector_dups.near(a, b, rotation, 0.93) == (cosine >= 0.93)).all()


# 10. Chat.


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_end|>", "a\nb", "", "<~|nl|>"]), st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<~|im_end|>", "<~~|im_start|>", "<|nl|>", "~", "<", "|>", "\n", "é", "<|im_end|"]), max_size=8).map("".join)), max_size=4))
def test_grammar_round_trip(turns):
    whole = "".join(chat.render(*t)[0] for t in turns)
    assert [t[:2] for t in chat.parse(whole)] == turns


@pytest.mark.parametrize("broken", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_start|>", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u<|im_end|>\n"])
def test_broken_text(broken):
    with pytest.raises(chat.Broken):
        chat.parse(broken)


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 0, "assistant", "é" * 3000), (3, 0, "system", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    formatted = chat.format_turns(df)
    whole = {}
    for r in formatted.collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    out = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert out.keys() == by.keys()
    for conv, turns in by.items():
        r, said = out[conv], "".join(t for role, t in turns if role == "assistant")
        assert [t[:2] for t in chat.parse(whole[conv])] == turns
        assert r.n_turns == len(turns) and r.formatted_chars == len(whole[conv]) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# The pipeline.


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == columns and kept.count() >= 0.99 * docs.count()
    good = corpus_pipeline.quality_rules(spark, kept, sf)
    assert good.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert np.mean([i in ids for i, q in labels.items() if q == 1]) > 0.9


def test_dedup_and_mixing_stages(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = kept.collect()
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    groups = jaccard.similar_groups(numbered, "_row")
    assert len(rows) == groups.select("group").distinct().count()
    assert len([r for r in rows if r.doc_id == 4]) == 1 and not [r for r in rows if r.doc_id == 5]
    kept.write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 2 and not {i for i in times if i in (1, 2)}
    out = corpus_pipeline.encode_pieces(spark, mixed, SF).collect()
    assert len(out) == sum(times.values())


def test_stages_of_an_empty_table(spark, odd_docs):
    docs = odd_docs.limit(0).select("doc_id", "text", "lang", "source", "n_words")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

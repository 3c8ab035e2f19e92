"""The near-dedup stage starts with operator 2's fingerprints and pivot tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tracklight.llm import jaccard, simhash

SF = "/root/testdata/sf0.001"


def edited(rng, count):
    """Groups of texts with a word changed here and there."""
    texts = []
    for _ in range(count):
        words = ["w%d" % rng.randrange(4000) for _ in range(300)]
        for _ in range(5):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(4000)
    return texts


def test_clusters_are_those_of_the_operator(spark):
    rows = list(enumerate(edited(random.Random(3), 12) + ["one", "", None, "two words"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    theirs = {r.doc_id: r.component_id for r in simhash.near_duplicates(simhash.fingerprints(docs)).collect()}
    prints = jaccard.signatures(docs, jaccard.common_shingles(docs)).select(F.col("doc_id").alias("node"), "n", "fp")
    ours = {r.node: r.comp for r in jaccard.simhash_clusters(prints).collect()}
    assert ours == theirs and len(set(ours.values())) < 40


def test_stage_runs_the_operator(spark, monkeypatch):
    """Its links are candidates that the sets decide on: of what SimHash alone joins, only the similar are joined."""
    texts = edited(random.Random(4), 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").checkpoint()
    seen = []
    near_links = jaccard.near_links
    monkeypatch.setattr(jaccard, "near_links", lambda prints: seen.append(prints.count()) or near_links(prints))
    assert len(corpus_pipeline.near_dedup(spark, docs, SF).collect()) == 3 and seen and seen[0] > 3
    monkeypatch.setattr(jaccard, "near_links", lambda prints: prints.crossJoin(prints.withColumnRenamed("fp", "b")).withColumnRenamed("fp", "a"))
    assert len(corpus_pipeline.near_dedup(spark, docs, SF).collect()) == 3

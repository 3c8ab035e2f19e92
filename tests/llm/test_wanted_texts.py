"""Texts that no cluster asks for aren't sent."""

import random

from tracklight.llm import jaccard


def test_wanted_texts(spark):
    """All texts asked for and next to no others, whatever the ids are."""
    rng = random.Random(6)
    ids = [*range(3000), *(i << 33 for i in range(-50, 50) if i), *(rng.randrange(-(2**63), 2**63) for _ in range(500))]
    texts = spark.createDataFrame([(i, f"text {i}") for i in ids], "node long, text string")
    some = set(rng.sample(ids, 400)) | {0, 8, 2999}
    found = [r.node for r in jaccard.wanted(texts, spark.createDataFrame([(i,) for i in some] * 2, "node long")).collect()]
    assert len(found) == len(set(found)) and some <= set(found) and len(found) < len(some) + 20
    assert jaccard.wanted(texts, texts.limit(0)).count() == 0
    assert jaccard.wanted(texts, texts.limit(0)).columns == texts.columns

"""Few links are joined by one task, many by rounds; both give the same."""

import random

import pytest

from tracklight.llm import components


def plain(links):
    """By flooding."""
    beside = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    out = {}
    for node in sorted(beside):
        todo = [] if node in out else [node]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = node
                todo.extend(beside[x])
    return out


def cases():
    rng = random.Random(5)
    chain = list(range(-300, 300))
    rng.shuffle(chain)
    yield list(zip(chain, chain[1:]))
    yield [(7, x) for x in range(400)] + [(1000 + x, 1000 + x * 7 % 90) for x in range(90)]
    yield [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(None, 1), (2, None), (5, 5), (-(2**63), 2**63 - 1)]
    yield [(3, 3), (None, 4)]


@pytest.mark.parametrize("alone", [0, 20, components.ALONE])
def test_roots(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    for links in cases():
        out = components.connected_components(spark.createDataFrame(links, "a long, b long"))
        rows = out.collect()
        assert out.dtypes == [("node", "bigint"), ("root", "bigint")]
        assert {r.node: r.root for r in rows} == plain(links) and len(rows) == len(plain(links))


def test_few_links_take_few_tasks(spark):
    """Rounds would take a task for each of a shuffle's partitions some ten times each: on 211 partitions, thousands of tasks for 600 links."""
    links = spark.createDataFrame([(i * 37 % 601, (i + 1) * 37 % 601) for i in range(600)], "a long, b long").checkpoint()
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("components", "components")
    try:
        components.connected_components(links)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(tracker.getJobIdsForGroup("components")) <= 8

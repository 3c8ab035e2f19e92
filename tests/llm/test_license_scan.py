"""Licence scans against brute force over all windows, and odd rows."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tracklight.llm import licenses
from tracklight.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text, templates, threshold=0.8):
    """Every window of bigrams against every template; of overlapping finds the best stays."""
    words = licenses.normalize(text.encode())
    grams = list(zip(words, words[1:]))
    found = []
    for first in range(len(grams)):
        for size in range(1, len(grams) - first + 1):
            bag = Counter(grams[first : first + size])
            for (n, spdx, other), must in zip(templates.templates, templates.must):
                if 2 * min(n, size) < threshold * (n + size) or not must <= bag.keys():
                    continue
                dice = 2 * sum((bag & other).values()) / (n + size)
                if dice >= threshold:
                    found.append((first, first + size + 1, spdx, dice))
    out = []
    for f in sorted(found, key=lambda f: (-f[3], f[0] - f[1], f[0], f[2])):
        if all(f[1] <= o[0] or f[0] >= o[1] for o in out):
            out.append(f)
    return sorted(out)


def test_scan_is_the_best_of_all_windows():
    t = licenses.Templates()
    rng = random.Random(4)
    some = [
        "licensed under the MIT license", "Licensed under the MIT License or the Apache License, Version 2.0", "released under the unlicense",
        "this work is licensed under a creative commons attribution 4.0 international license", "SPDX-License-Identifier: ISC", "distributed under the terms",
    ]
    for _ in range(12):
        words = " and so on it is the license of a thing under".split()
        text = " ".join(rng.choice([*some, *words]) for _ in range(4))
        assert licenses.scan(text.encode(), t) == brute(text, t), text


def test_the_name_must_be_there():
    t = licenses.Templates()
    for text in ("distributed under the terms and conditions", "software released under the", "is licensed under the following license", "available under the same"):
        assert licenses.scan(text.encode(), t) == []
    assert [f[2] for f in licenses.scan(b"available under the Unlicense", t)] == ["Unlicense"]


def test_more_texts_and_many_notices():
    t = licenses.Templates({"X-1": "the quick licence of brown foxes lets lazy dogs jump over it at any time they like and no fox pays"})
    assert [f[2] for f in licenses.scan(b"so: The quick license of brown foxes lets lazy dogs jump over it, at any time they like, and no fox pays.", t)] == ["X-1"]
    began = time.perf_counter()
    found = licenses.scan(b"Licensed under the MIT License.\n" * 16_000, t)
    assert len(found) == 16_000 and time.perf_counter() - began < 8


def test_query_against_brute_force(spark):
    t = licenses.Templates()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["op6_licenses"](spark, SF).collect()}
    assert out.keys() == docs.keys()
    for i, text in docs.items():
        if len(text.split()) < 90:
            finds = brute(text, t)
            best = max((f[3] for f in finds), default=0.0)
            assert (out[i].n_finds, out[i].licenses, out[i].best_dice) == (len(finds), ",".join(sorted({f[2] for f in finds})), best)


def test_licenses_of_odd_rows(spark, odd_docs):
    out = licenses.scan_licenses(odd_docs.withColumn("finds", F.lit("x"))).collect()
    assert len(out) == odd_docs.count() and all(r.finds == [] for r in out)
    assert licenses.scan_licenses(odd_docs.limit(0)).count() == 0
    same = spark.createDataFrame([("released under the mit license " + "word " * 50_000,)] * 2, "text string")
    assert [[f.license for f in r.finds] for r in licenses.scan_licenses(same).collect()] == [["MIT"], ["MIT"]]

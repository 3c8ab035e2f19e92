"""Token counts, sentence pieces, licences, pages, quality and language against brute force and exact round trips."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklight.llm import html_text, language, licenses, quality, sentence_pieces, token_counts
from tracklight.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# 1. Token counts.


def greedy(word, start, inner):
    n, at, pieces = 0, 0, start
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at, pieces = n + 1, end, inner
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abc", min_size=1, max_size=14))
def test_longest_match(start, inner, word):
    start, inner = {x.encode() for x in start}, {x.encode() for x in inner}
    word = word.encode()
    assert token_counts.LongestMatch(start, inner).count(word) == greedy(word, start, inner)
    assert token_counts.LongestMatch(start).count(word) == greedy(word, start, start)


def test_counts_of_texts(spark, odd_docs):
    with open(token_counts.VOCABULARY, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f}
    out = token_counts.count_tokens(odd_docs).collect()
    assert len(out) == odd_docs.count() and "key" in out[0]
    for r in out:
        words = (r.text or "").encode().split()
        expected = sum(greedy(b" " + w, pieces, pieces) if len(w) < 200 else token_counts.load(token_counts.VOCABULARY)[0].count(w) for w in words)
        assert (r.n_words, r.n_tokens) == (len(words), expected)
    assert token_counts.count_tokens(odd_docs.limit(0)).count() == 0


# 3. Sentence pieces.


def test_parity_and_round_trip(spark, odd_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    coded = sentence_pieces.decode(sentence_pieces.encode(odd_docs)).collect()
    assert len(coded) == odd_docs.count()
    for r in coded:
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.n_mismatches == 0
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r.round_trip == (r.decoded == (r.text or "")) == ("▁" not in (r.text or ""))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e  \n\t▁é漢🎉.0t"), max_size=40))
def test_parity_of_any_text(text):
    encoder = sentence_pieces.load(sentence_pieces.MODEL)
    packed, _, same = encoder.encode([text])
    ids = np.frombuffer(packed[0], "<i4").tolist()
    import sentencepiece

    if not hasattr(test_parity_of_any_text, "library"):
        test_parity_of_any_text.library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert ids == test_parity_of_any_text.library.encode(text)
    assert same[0] == (encoder.model.decode(ids) == text)


def test_whole_table_has_no_mismatch(spark):
    out = QUERIES["op3_sentence_pieces"](spark, SF).collect()
    assert all(r.n_mismatches == 0 and r.round_trip for r in out)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field_(number, value):
    """A protocol buffer's field: an int as a varint, a float in four bytes, else bytes."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(path, trim=True, prefix=True, fallback=True):
    """A model file of a unigram model, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    words = {"▁": -3.0, "▁the": -4.0, "▁cat": -6.0, "▁c": -5.5, "at": -5.0, "t": -7.0, "h": -7.1, "e": -7.2, "a": -7.3, "c": -7.4, "s": -6.0, "▁sat": -8.0, "▁th": -6.5, "he": -6.6, "é": -9.0}
    pieces += [(p, v, 1) for p, v in words.items()]
    out = b"".join(field_(1, field_(1, p.encode()) + field_(2, v) + field_(3, k)) for p, v, k in pieces)
    out += field_(2, field_(3, 1) + field_(35, int(fallback)))
    out += field_(3, field_(1, b"identity") + field_(3, int(prefix)) + field_(4, int(trim)) + field_(5, 1))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize(("trim", "prefix", "fallback"), [(True, True, True), (False, True, True), (True, False, True), (True, True, False)])
def test_unigram_model(spark, tmp_path, trim, prefix, fallback):
    """A unigram model in all its settings agrees with the sentencepiece library, encoding and decoding."""
    import sentencepiece

    path = unigram_model(tmp_path / "unigram.model", trim, prefix, fallback)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat", "thecat", "  the  cat ", "hat é cats", "", None, "the cat\nsat the", "aaaa tttt", "sat"] + (["zebra 漢 x", "q"] if fallback else [])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in sentence_pieces.decode(sentence_pieces.encode(df, path=path), path=path).collect():
        ids = library.encode(r.text or "")
        assert (r.ids, r.n_mismatches) == (ids, 0), r.text
        assert r.decoded == library.decode(ids)
        assert r.round_trip == (r.decoded == (r.text or ""))


def test_pieces_of_clashing_columns(spark, odd_docs):
    clash = odd_docs.withColumns({"ids": F.lit("x"), "n_tokens": F.lit("y"), "round_trip": F.lit(3), "decoded": F.lit(1)})
    out = sentence_pieces.decode(sentence_pieces.encode(clash))
    assert [c for c in out.columns if c == "ids"] == ["ids"] and out.count() == odd_docs.count()
    assert all(isinstance(r.n_tokens, int) and isinstance(r.ids, list) for r in out.collect())
    assert sentence_pieces.encode(clash.limit(0)).count() == 0


# 5. Pages.

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header><a href=/>Home</a> site name, slogan, and more</header>
<div id="cookie-banner">We use cookies, and you, dear reader, must agree, of course.</div>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="wrap"><div class="sidebar"><p>Popular, things, here, and there, and everywhere, all day long, folks.</p></div>
<div class="post-content"><h1>Head &amp; line</h1><p>First   paragraph, with
 <b>bold</b>, commas, and text that goes on for a while, as they do.<p>Second &lt;one&gt;, also with some length, and a few, commas.
<ul><li>item one</li><li>item two</ul><table><tr><td>cell<td>next</table><form>Subscribe, now, please<input></form>
<div class="ad">Buy, buy, buy</div><p>Third&nbsp;paragraph<br>after a break.</div></div>
<div id="comments"><p>Reader one says, well, many, many, many, many, many, many, many, things, as readers do.</p></div>
<aside>Related, stuff</aside><footer>&copy; 2020, all rights</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE).split("\n\n") == [
        "Head & line",
        "First paragraph, with bold , commas, and text that goes on for a while, as they do.".replace(" ,", ","),
        "Second <one>, also with some length, and a few, commas.",
        "item one", "item two", "cell", "next", "Third paragraph after a break.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text, no markup", "just text, no markup"), ("<p>a<p>b", "a\n\nb"), ("<article></article>", ""),
        ("<script>x</script>", ""), ("<nav>menu</nav>", ""), ("<p>open <b>tag", "open tag"), ("a < b & c &eacute;", "a < b & c é"), ("<!-- never closed", ""),
        ("<article><p>Short.</article><div>Long, long, long, long, long text, beside it, with, many, commas, indeed.</div><footer>f</footer>", None),
    ],
)
def test_odd_pages(page, text):
    out = html_text.extract(page)
    assert out == text if text is not None else out.startswith("Short.")


def test_deep_page():
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    assert html_text.extract(deep) == "deep text"


def test_pages_of_the_table(spark):
    import re
    from html import unescape

    out = QUERIES["op5_html_text"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in out:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 6. Licences.


def test_licenses():
    t = licenses.Templates()
    hit = lambda x: [(f[2], round(f[3], 3)) for f in licenses.scan(x.encode(), t)]
    assert hit("Some words.\nReleased under the MIT License.\nOf the others and the rest.") == [("MIT", 1.0)]
    inline = hit("It is Licensed under CC BY-NC 4.0. And the file is licenced under the Apache License, Version 2.0.")
    assert [x for x, _ in inline] == ["CC-BY-NC-4.0", "Apache-2.0"] and min(d for _, d in inline) >= 0.9
    assert hit("The license of the driver was under the seat of the car.") == []
    changed = licenses.TEXTS["MIT"].replace("without restriction", "with no restriction at all").replace("KIND", "SORT")
    assert hit("Intro here.\n\n" + changed + "\n\nMore prose follows it.")[0][0] == "MIT"
    assert licenses.scan(None, t) == [] == licenses.scan(b"", t)


def test_size_bounds_lose_nothing():
    t = licenses.Templates()
    rng = random.Random(3)
    from collections import Counter

    for n, spdx, bag in rng.sample(t.templates, 60):
        some = Counter({b: k for b, k in bag.items() if rng.random() < 0.9})
        size = sum(some.values())
        dice = lambda other, m: 2 * sum((some & other).values()) / (size + m) if size + m else 0
        all_ = [(-dice(other, m), s) for m, s, other in t.templates if dice(other, m) >= 0.8]
        best = t.best(some, size, 0.8)
        assert (best is None) == (not all_)
        if all_:
            assert (-best[0], best[1]) == min(all_)


# 7. Quality.


def brute_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 3000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if inside is None else len(inside)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", "c|d", " ", "\x0b", "\x1c", " "]), max_size=60).map(" ".join))
def test_statistics(text):
    expected = brute_statistics(text)
    assert quality.statistics(text.encode())[0] == expected


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 12))
    y = ((x[:, 2] + 0.1 * rng.random(1500) < 0.6) & (x[:, 3] < 0.8)).astype(float)
    forest = quality.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for f, direction in enumerate(quality.FEATURES.values()):
        if direction:
            grid = np.repeat(x[:50], 30, axis=0)
            grid[:, f] = np.tile(np.linspace(0, 1, 30), 50)
            steps = np.diff(forest.score(grid).reshape(50, 30), axis=1)
            assert (steps * direction >= -1e-12).all()
    walked = []
    for row in x[:40]:
        total = forest.start
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.child[node] + (row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, forest.score(x[:40]))


def test_quality_query(spark):
    out = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out.keys() == docs.keys()
    for i, r in out.items():
        expected = brute_statistics(docs[i])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines] == expected[:4]
        assert expected[4] is None or r.n_repeat_words == expected[4]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_held_out_quality(spark):
    """Half of the labels teach; on the other half, good documents that pass the base rule stay and bad ones go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated = quality.rate(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), labels.where("doc_id % 2 = 0"), drop_text=True)
    rows = rated.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_quality_of_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.rate(odd_docs, none).collect()
    assert len(out) == odd_docs.count()
    assert all(r.base_failed for r in out if not r.text or len(r.text.split()) < 20)
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 0), (None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.rate(odd_docs, labels).count() == odd_docs.count()
    assert quality.rate(odd_docs.limit(0), labels).count() == 0


# 9. Language.


def brute_chances(scores, transitions):
    n, k = scores.shape
    from itertools import product

    total = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        w = np.exp(sum(scores[i, p] for i, p in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        for i, p in enumerate(path):
            total[i, p] += w
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(5)
    lengths = np.array([5, 3, 3, 1])
    scores, transitions = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    out = language.forward_backward(scores, lengths, transitions)
    ends = np.cumsum(lengths)
    for s, e in zip(ends - lengths, ends):
        assert np.allclose(out[s:e], brute_chances(scores[s:e], transitions))


def test_words_score_alike_alone_and_together():
    field = language.fit(["hello there world of words " * 9, "bonjour le monde des mots " * 9], ["en", "fr"])
    words = ["hello", "monde", "a", "xyzzyxyzzy", "ü"]
    together = field.emissions(words)
    assert np.allclose(together, np.concatenate([field.emissions([w]) for w in words]), atol=1e-5)


def test_every_language_is_learned(spark):
    """A table of 80 languages: each has words of its own, and gets its own documents back."""
    rng = random.Random(31)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(80)}
    docs = [(i, " ".join(rng.choice(words[i % 80]) for _ in range(40)), f"l{i % 80:02d}") for i in range(320)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    field = language.train(df)
    assert len(field.languages) == 80
    out = language.identify(df, field).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.99


def test_lexicon():
    counts = {("le", "fr"): 9, ("le", "it"): 1, ("casa", "it"): 3, ("casa", "es"): 3, ("rare", "en"): 1, ("of", "en"): 4}
    known = language.lexicon(counts, ["en", "es", "fr", "it"])
    codes = known.look_up(language.spelled(["le", "casa", "rare", "of", "other"])[3]).tolist()
    assert codes == [1 + 2 * 2 + 1, 1 + 2 * 1, 0, 1 + 1, 0]
    field = language.fit(["alpha beta " * 30, "alpha beta " * 5, "gamma delta " * 30, "gamma delta"], ["en", "en", "es", "es"])
    assert len(field.lexicon.hashes) == 4
    codes = field.lexicon.look_up(language.spelled(["alpha", "delta"])[3])
    rows = [next(r for i, (r, _, _) in enumerate(language.features([w], field.lexicon)) if i == 1)[0] for w in ("alpha", "delta")]
    assert codes.tolist() == [2, 4] and field.weights[rows[0]].argmax() == 0 and field.weights[rows[1]].argmax() == 1


def test_code_switching():
    field = language.fit(["hello there world of many words " * 30, "bonjour le monde des jolis mots " * 30], ["en", "fr"])
    labeller = language.Labeller(field)
    words = "hello there world of bonjour le monde des".split()
    rows = labeller.rows([words])[0]
    chances = language.forward_backward(labeller.scores[rows], np.array([len(rows)]), field.transitions)
    assert chances.argmax(axis=1).tolist() == [0, 0, 0, 0, 1, 1, 1, 1]


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op9_language"](spark, sf).where("held_out").collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) > 0.97
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out)


def test_language_of_odd_rows(spark, odd_docs):
    field = language.train(odd_docs)
    out = language.identify(odd_docs, field).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == has_letter and 0 <= r.score <= 1
    empty = language.train(odd_docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd_docs, empty).collect()} == {"und"}
    assert language.identify(odd_docs.limit(0), field).count() == 0


def test_letters():
    assert [language.letters(x) for x in ("Ab!", "²", "Ⅷ", "x_1y", "É", "漢字。", "--")] == ["ab", "", "", "xy", "é", "漢字", ""]


def test_small_caches_change_nothing(monkeypatch):
    texts = ["alpha beta gamma delta " * 3, "uno dos tres cuatro cinco", "alpha dos", ""] * 3
    field = language.fit(texts[:2], ["en", "es"])
    whole = language.Labeller(field).chances(texts)
    monkeypatch.setattr(language, "CACHE", 700)
    monkeypatch.setattr(language, "CHUNK", 4)
    few = language.Labeller(field).chances(texts)
    assert all((a is None) == (b is None) and (a is None or np.allclose(a, b)) for a, b in zip(whole, few))
    encoder = sentence_pieces.Encoder(sentence_pieces.MODEL)
    first = encoder.encode(texts)
    monkeypatch.setattr(sentence_pieces, "CACHE", 2)
    assert sentence_pieces.Encoder(sentence_pieces.MODEL).encode(texts) == first

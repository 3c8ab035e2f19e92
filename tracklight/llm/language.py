"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and its place in a lexicon: a table of the words that several of
the training documents have, with the language that has them most. Learned transitions join neighbours, and forward-backward gives each
word's chance of each language. A document's language is the one with the highest mean chance over its words.

The training texts are in one language each. So that transitions can be learned, they are cut into
segments, and segments of different documents are strung together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import checkpoint, held, join_counted, letting_go, map_columns, string

#: Bounds of the training sample: documents of each language, words in all (but for every language LEAST_WORDS at least, however
#: many languages there are), words of a document, and words of the lexicon for each language.
DOCUMENTS, TRAIN_WORDS, LEAST_WORDS, DOCUMENT_WORDS, LEXICON = 300, 120_000, 2_000, 400, 20_000
#: Documents that a word of the lexicon is in, and the share of them from which it is a language's own.
LEAST_DOCUMENTS, OWN = 2, 0.9
#: Rows of the weights, as a power of two; features that share a row share its weight.
ROW_BITS = 17
#: Segments of a training sequence, and words in one.
SEGMENTS, SEGMENT_WORDS = 3, 20
#: Steps of the fit, their size, and the weight of the penalty.
STEPS, STEP, PENALTY = 30, 0.3, 1e-5
#: Chances that are computed at once (words times languages), and bytes of words and scores that a worker keeps.
CHUNK, CACHE, WORD_BYTES = 1_000_000, 32 << 20, 200
UNDETERMINED = "und"


def letters(word: str) -> str:
    """The letters of a word in lower case; a word without any says nothing."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


@dataclass
class Lexicon:
    """Hashes of words, sorted, and a code of each: the number of the language that has it most, and whether it is that one's own."""

    hashes: np.ndarray
    codes: np.ndarray

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words; 0 for one that isn't listed."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.codes[at], 0)


def lexicon(counts: dict[tuple[str, str], int], languages: list[str]) -> Lexicon:
    """From the number of training documents of a language that have a word: the LEXICON most frequent of each language.

    Words in fewer than LEAST_DOCUMENTS documents are left out, so that a word of a training document is listed for what others say.
    """
    number = {x: i for i, x in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    most: dict[str, list[tuple[int, str]]] = {}
    for (word, lang), n in counts.items():
        table.setdefault(word, np.zeros(len(languages), np.int64))[number[lang]] += n
        most.setdefault(lang, []).append((-n, word))
    listed = {w for rows in most.values() for _, w in sorted(rows)[:LEXICON]}
    words = sorted(w for w in listed if table[w].sum() >= LEAST_DOCUMENTS)
    if not words:
        return Lexicon(np.empty(0, np.uint64), np.empty(0, np.int64))
    best = [(int(table[w].argmax()), table[w].max() >= OWN * table[w].sum()) for w in words]
    hashes, codes = spelled(words)[3], np.array([1 + 2 * k + own for k, own in best], np.int64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], codes[order])


def spelled(words: list[str]):
    """Code points of words with their borders, one word after another, their sizes, their starts and a hash of each word."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(codes)) - np.repeat(starts, sizes)  # place in the word
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64))
        return codes, sizes, starts, np.add.reduceat(codes * powers[at], starts)


BASE = np.uint64(1_000_003)


def features(words: list[str], known: Lexicon):
    """For each kind of feature, rows of the weights, with the first of each word if it has many, else the words that have one.

    Kinds: the word itself, its n-grams of one to three characters with its borders, its affixes of one to three, and its
    place in the lexicon. A feature's row is a hash of its kind and characters. Words have a letter at least.
    """
    codes, sizes, starts, hashes = spelled(words)
    left = np.repeat(sizes + starts, sizes) - np.arange(len(codes))  # characters from here to the word's end

    def row(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind * 0x51ED270B)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - ROW_BITS)).astype(np.int64)

    with np.errstate(over="ignore"):
        yield row(hashes, 0), np.arange(len(words)), False
        yield row(known.look_up(hashes).astype(np.uint64), 10), np.arange(len(words)), False
        gram = np.zeros(len(codes), np.uint64)
        for n in (1, 2, 3):
            gram = gram * BASE
            gram[: len(codes) - n + 1] += codes[n - 1 :]
            whole = left >= n
            counts = sizes - n + 1
            yield row(gram[whole], n), np.cumsum(counts) - counts, True
            long_ = np.flatnonzero(sizes >= n + 2)
            yield row(gram[starts[long_] + 1], 3 + n), long_, False
            yield row(gram[starts[long_] + sizes[long_] - 1 - n], 6 + n), long_, False


@dataclass
class Field:
    """The fitted field: languages, the lexicon, the weights by a feature's row, and the transitions' logarithms."""

    languages: list[str]
    lexicon: Lexicon
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """The sums of the features' weights, for words of letters only."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        if words and len(self.languages):
            for rows, where, many in features(words, self.lexicon):
                if many:
                    out += np.add.reduceat(self.weights[rows], where, axis=0)
                else:
                    out[where] += self.weights[rows]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Each word's chances, for sequences that lie one after another in `scores`; longest first.

    With `pairs`, also the expected number of each transition.
    """
    chance = np.exp(transitions - transitions.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    starts = np.cumsum(lengths) - lengths
    alpha, beta = np.empty_like(local), np.ones_like(local)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences with a word at each step
    for t in range(lengths[0]):
        rows = starts[: active[t]] + t
        a = local[rows] if t == 0 else (alpha[rows - 1] @ chance) * local[rows]
        alpha[rows] = a / a.sum(axis=1, keepdims=True)
    for t in range(lengths[0] - 2, -1, -1):
        rows = starts[: active[t + 1]] + t
        b = (local[rows + 1] * beta[rows + 1]) @ chance.T
        beta[rows] = b / b.sum(axis=1, keepdims=True)
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    if not pairs:
        return out
    last = np.zeros(len(scores), bool)
    last[starts + lengths - 1] = True
    left = np.flatnonzero(~last)
    joint = alpha[left][:, :, None] * chance[None] * (local * beta)[left + 1][:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return out, joint.sum(axis=0)


def fit(texts: list[str], langs: list[str], counts: dict[tuple[str, str], int] | None = None) -> Field:
    """A field fitted to documents of one language each; `counts`, for the lexicon, are those of the texts if not given."""
    languages = sorted(set(langs))
    n_langs = len(languages)
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(42)
    segments: list[tuple[int, list[str]]] = []
    own: dict[tuple[str, str], int] = {}
    for text, lang in zip(texts, langs):
        words = [w for w in map(letters, text.split()) if w]
        for w in set(words):
            own[w, lang] = own.get((w, lang), 0) + 1
        segments += [(number[lang], words[i : i + SEGMENT_WORDS]) for i in range(0, len(words), SEGMENT_WORDS)]
    known = lexicon(own if counts is None else {k: n for k, n in counts.items() if k[1] in number}, languages)
    kept, room = [], np.full(n_langs, max(LEAST_WORDS, TRAIN_WORDS // max(1, n_langs)))
    for k in rng.permutation(len(segments)):
        lang, words = segments[k]
        if room[lang] > 0:
            kept.append(segments[k])
            room[lang] -= len(words)
    if not kept:
        return Field(languages, known, np.zeros((1 << ROW_BITS, n_langs), np.float32), np.zeros((n_langs, n_langs)))
    sequences = [kept[i : i + SEGMENTS] for i in range(0, len(kept), SEGMENTS)]
    sequences.sort(key=lambda s: -sum(len(x) for _, x in s))
    lengths = np.array([sum(len(x) for _, x in s) for s in sequences])
    words = [w for s in sequences for _, x in s for w in x]
    labels = np.array([lang for s in sequences for lang, x in s for _ in x])
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([kinds[w] for w in words])
    flat, owner = [], []
    for rows, where, many in features(list(kinds), known):
        flat.append(rows)
        owner.append(np.repeat(np.arange(len(kinds)), np.diff([*where, len(rows)])) if many else where)
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    n_rows = 1 << ROW_BITS
    weights, transitions = np.zeros((n_rows, n_langs)), np.zeros((n_langs, n_langs))
    gold = np.zeros((len(words), n_langs))
    gold[np.arange(len(words)), labels] = 1
    follows = np.ones(len(words), bool)
    follows[np.cumsum(lengths) - lengths] = False
    moves = np.zeros((n_langs, n_langs))
    at = np.flatnonzero(follows)
    np.add.at(moves, (labels[at - 1], labels[at]), 1)
    sums = [np.full(x.shape, 1e-6) for x in (weights, transitions)]
    for _ in range(STEPS):
        scores = np.stack([np.bincount(owner, weights[flat, k], len(kinds)) for k in range(n_langs)], axis=1)
        chances, expected = forward_backward(scores[ids], lengths, transitions, pairs=True)
        off = gold - chances
        by_kind = np.stack([np.bincount(ids, off[:, k], len(kinds)) for k in range(n_langs)], axis=1)
        slope = np.stack([np.bincount(flat, by_kind[owner, k], n_rows) for k in range(n_langs)], axis=1) / len(words)
        for x, g, s in ((weights, slope - PENALTY * weights, sums[0]), (transitions, (moves - expected) / len(words), sums[1])):
            s += g * g
            x += STEP * g / np.sqrt(s)
    return Field(languages, known, weights.astype(np.float32), transitions)


def taught(batches):
    """For each row of text and lang: lang, up to DOCUMENT_WORDS words in segments spread evenly over the whole text, and the distinct words."""
    for batch in batches:
        said, distinct = [], []
        for text in batch.column(0).to_pylist():
            words = [w for w in map(letters, text.split()) if w]
            starts = range(0, len(words), SEGMENT_WORDS)
            few = DOCUMENT_WORDS // SEGMENT_WORDS
            if len(starts) > few:
                starts = [starts[i * len(starts) // few] for i in range(few)]
            said.append(" ".join(w for i in starts for w in words[i : i + SEGMENT_WORDS]))
            distinct.append(list(dict.fromkeys(words)))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(said, pa.string()), pa.array(distinct, pa.list_(pa.string()))], names=["lang", "said", "words"])


def train(docs: DataFrame, documents: int = DOCUMENTS) -> Field:
    """A field fitted to about `documents` of each value of lang; every value that has a document is learned.

    docs has doc_id, text and lang; rows whose text or lang is null teach nothing. The sample is those
    whose hash of doc_id is below the share that their language needs. The driver gets at most DOCUMENT_WORDS words of a document
    and the LEXICON most frequent words of a language.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = checkpoint(docs.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")))
    place = F.xxhash64("doc_id", F.lit(9)) / F.lit(2.0**64) + 0.5
    shared = join_counted(docs.select("doc_id", "text", "lang", F.col("lang").alias("_lang"), place.alias("_place")), counts.withColumn("_rows", F.col("_n")), ["_lang"], "_rows")
    some = shared.where(F.col("_place") * F.col("_n") < documents).select("text", "lang")
    schema = T.StructType([string("lang"), string("said"), T.StructField("words", T.ArrayType(T.StringType()))])
    some = checkpoint(some.mapInArrow(letting_go(taught), schema))
    rows = sorted((r.lang, r.said) for r in some.select("lang", "said").collect())
    words = some.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # of a bounded sample of documents
    words = words.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEXICON).select("lang", "word", "n")
    return fit([said for _, said in rows], [lang for lang, _ in rows], {(r.word, r.lang): r.n for r in words.collect()})


class Labeller:
    """Applies a field, with the scores of words seen by this process."""

    def __init__(self, field: Field):
        self.field = field
        self.at: dict[str, int] = {}  # -1: no letter
        self.scores = np.zeros((0, len(field.languages)), np.float32)
        self.held = 0
        self.most = CACHE // (WORD_BYTES + 4 * len(field.languages))

    def learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > self.most:
            self.at.clear()
            self.held = 0
        plain = [letters(w) for w in words]
        some = [i for i, p in enumerate(plain) if p]
        if self.held + len(some) > len(self.scores):
            grown = np.zeros((max(self.held + len(some), 2 * len(self.scores)), len(self.field.languages)), np.float32)
            grown[: self.held] = self.scores[: self.held]
            self.scores = grown
        for start in range(0, len(some), 20_000):
            part = some[start : start + 20_000]
            self.scores[self.held : self.held + len(part)] = self.field.emissions([plain[i] for i in part])
            self.at.update(zip([words[i] for i in part], range(self.held, self.held + len(part))))
            self.held += len(part)
        self.at.update((w, -1) for w, p in zip(words, plain) if not p)

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        kinds = set().union(*docs)
        new = [w for w in kinds if w not in self.at]
        if new:
            if len(self.at) + len(new) > self.most:  # all is forgotten: what these documents need is learned together
                new = list(kinds)
            self.learn(new)
        out = [np.fromiter(map(self.at.__getitem__, d), np.int64, len(d)) for d in docs]
        return [r[r >= 0] for r in out]

    def chances(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the mean chance of each language over its words; None if it has no letter."""
        out: list[np.ndarray | None] = [None] * len(texts)
        todo: list[int] = []
        words: list[list[str]] = []
        held = 0
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        for i in [*order, None]:
            if i is None or held * len(self.field.languages) >= CHUNK:
                self._label(todo, words, out)
                todo, words, held = [], [], 0
            if i is not None:
                todo.append(i)
                words.append(texts[i].split())
                held += len(words[-1])
        return out

    def _label(self, todo: list[int], words: list[list[str]], out: list) -> None:
        rows = self.rows(words)
        found = sorted((k for k, r in enumerate(rows) if len(r)), key=lambda k: -len(rows[k]))
        if not found or not self.field.languages:
            return
        lengths = np.array([len(rows[k]) for k in found])
        chances = forward_backward(self.scores[np.concatenate([rows[k] for k in found])], lengths, self.field.transitions)
        means = np.add.reduceat(chances, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        for k, mean in zip(found, means):
            out[todo[k]] = mean


def identify(df: DataFrame, field: Field, text: str = "text", drop_text: bool = False) -> DataFrame:
    """`df` with lang_pred (string) and score (double, 0 to 1), from the whole text alone.

    score is the mean over the words of the chance of lang_pred, the first in order of equals. A text
    that is null or has no letter is `und` with score 0, as is every text if nothing was learned. Words end at white
    space. Repeated rows keep theirs; columns of `df` named lang_pred or score are replaced, others stay.
    """
    import uuid

    shared = df.sparkSession.sparkContext.broadcast(field)
    name = uuid.uuid4().hex

    def make():
        labeller = held(("language", name), lambda: Labeller(shared.value))

        def run(column):
            means = labeller.chances(column.to_pylist())
            best = [None if m is None else int(m.argmax()) for m in means]
            langs = [UNDETERMINED if b is None else labeller.field.languages[b] for b in best]
            scores = [0.0 if b is None else min(1.0, float(m[b])) for m, b in zip(means, best)]
            return [pa.array(langs, pa.string()), scores]

        return run

    fields = [string("lang_pred"), T.StructField("score", T.DoubleType())]
    return map_columns(df, make, [text], fields, drop=[text] if drop_text else [])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that nothing is learned from; one of null doc_id isn't held out, but isn't learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))

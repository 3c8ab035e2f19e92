"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown here, on histograms of a bounded sample of labelled rows, and flattened into node
arrays; a batch of documents is scored by walking all its rows down a tree at once. A chosen feature
can be held monotonic: the score never rises, or never falls, with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import as_bytes, long, map_columns

#: Labelled rows that the trees are fitted on, at most: those with the least hashes of doc_id.
SAMPLE = 20_000
#: A document is kept if its chance of being good is at least this.
KEEP = 0.2
SYMBOLS = b"#*$%&|<>"
#: The base rule: fewest words, and most hundredths of words in repeated windows.
FEWEST, REPEATS, WINDOW = 20, 30, 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the trees see, each with its direction: -1 where more of it never makes a text better.
FEATURES = {
    "log_words": 0,
    "chars_a_word": 0,
    "symbols_a_word": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "same_neighbours": -1,
    "distinct_words": 0,
    "upper_words": -1,
    "marks_a_word": 0,
    "digit_words": 0,
    "words_a_line": 0,
    "stops_a_word": 0,
}
#: Growth of the trees.
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 60, 3, 32, 0.2, 10, 1.0


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more; ids number the words. Windows are compared exactly."""
    n = len(ids)
    if n <= window:
        return 0
    width, rank = 1, ids.astype(np.int64)
    while width < window:
        step = min(width, window - width)
        pair = rank[: n - width - step + 1] * np.int64(n + 1) + rank[step : step + n - width - step + 1]
        width += step
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.empty(len(pair), bool)
        fresh[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        if fresh.all():
            return 0
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.cumsum(fresh) - 1
    often = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text's UTF-8."""
    text = text or b""
    words = text.split()
    n = len(words)
    plain = text.isascii()
    code_points = (lambda x: len(x)) if plain else (lambda x: len(x.decode("utf-8", "replace")))
    chars = code_points(b"".join(words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    with_words = [x for x in lines if x and not x.isspace()] if len(lines) > 1 else lines
    dup_lines = len(with_words) - len(set(with_words)) if len(lines) > 1 else 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeat_words(ids)
    some = max(n, 1)
    kinds = list(number)
    times = np.bincount(ids, minlength=len(kinds)) if n else np.zeros(0, np.int64)
    upper = sum(int(times[i]) for i, w in enumerate(kinds) if len(w) > 1 and w.isupper())
    digits = sum(int(times[i]) for i, w in enumerate(kinds) if w[0] < 58 and any(48 <= c < 58 for c in w))
    stops = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    marks = text.count(b",") + text.count(b".") + text.count(b"!") + text.count(b"?")
    return [n, chars, symbols, dup_lines, repeats], [
        np.log1p(n),
        chars / some,
        symbols / some,
        dup_lines / max(len(with_words), 1),
        repeats / some,
        float((ids[1:] == ids[:-1]).sum()) / some,
        len(kinds) / some,
        upper / some,
        marks / some,
        digits / some,
        n / max(len(with_words), 1),
        stops / some,
    ]


def describe(df: DataFrame, text: str = "text", drop_text: bool = False, forest: Forest | None = None) -> DataFrame:
    """`df` with the BASE counts (long) and features (array of double) of the whole text; null counts as empty.

    With `forest`, its score (double) stands in place of features. Repeated rows keep theirs; columns of `df` of these names are
    replaced, others stay.
    """
    last = T.StructField("score", T.DoubleType()) if forest else T.StructField("features", T.ArrayType(T.DoubleType()))

    def make():
        def run(column):
            found = [statistics(x) for x in as_bytes(column)]
            rows = [x[1] for x in found]
            made = forest.score(np.array(rows, float).reshape(len(rows), len(FEATURES))) if forest else rows
            return [*([x[0][i] for x in found] for i in range(len(BASE))), made]

        return run

    return map_columns(df, make, [text], [*map(long, BASE), last], drop=[text] if drop_text else [])


@dataclass
class Forest:
    """Trees in node arrays: feature (-1 for a leaf), threshold, first child (the second follows it), value."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of the label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                # a row at a leaf stays there: its first child is the leaf itself
                beyond = x[rows, np.maximum(self.feature[node], 0)] > self.threshold[node]
                node = self.child[node] + (beyond & inner)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, directions=tuple(FEATURES.values())) -> Forest:
    """Trees by Newton boosting of the logistic loss, weighted so that both labels count alike.

    directions: 1 or -1 holds the score monotonic in a feature: a split whose two values run against it
    isn't taken, and the values below a split keep to their side of the middle of the two.
    """
    feature, threshold, child, value, roots = [], [], [], [], []
    share = y.mean() if len(y) else 1.0
    if not len(y) or share in (0.0, 1.0):  # nothing to tell apart
        leaf = np.array([-1]), np.array([0.0]), np.array([0]), np.array([0.0]), np.array([0])
        return Forest(*leaf, start=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    total = np.zeros(len(y))

    def grow(at: int, rows: np.ndarray, depth: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        value[at] = RATE * float(np.clip(-g.sum() / (h.sum() + RIDGE), low, high))
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            total[rows] += value[at]
            return
        best = (1e-6, None)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            sums = [np.bincount(binned[rows, f], w, len(cut) + 1) for w in (None, g, h)]
            n, gl, hl = (np.cumsum(s)[:-1] for s in sums)
            gr, hr = g.sum() - gl, h.sum() - hl
            left, right = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
            gain = -(gl * left + (hl + RIDGE) * left**2 / 2 + gr * right + (hr + RIDGE) * right**2 / 2)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS) | ((right - left) * directions[f] < 0)] = -np.inf
            k = int(gain.argmax())
            none = np.clip(-g.sum() / (h.sum() + RIDGE), low, high)
            more = gain[k] + g.sum() * none + (h.sum() + RIDGE) * none**2 / 2
            if more > best[0]:
                best = (more, (f, k, left[k], right[k]))
        if best[1] is None:
            total[rows] += value[at]
            return
        f, k, left, right = best[1]
        first = len(feature)
        for _ in range(2):
            feature.append(-1)
            threshold.append(0.0)
            child.append(len(child))
            value.append(0.0)
        feature[at], threshold[at], child[at] = f, float(cuts[f][k]), first
        middle = (left + right) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        below = binned[rows, f] <= k
        for i, part in enumerate((rows[below], rows[~below])):
            grow(first + i, part, depth + 1, *bounds[directions[f]][i])

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        roots.append(len(feature))
        feature.append(-1)
        threshold.append(0.0)
        child.append(len(child))
        value.append(0.0)
        grow(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)
    return Forest(*map(np.array, (feature, threshold, child, value, roots)), start=0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees fitted on documents with a label: quality 1 is good. At most `sample` of them reach the driver.

    docs has doc_id and text. Rows of null doc_id or quality teach nothing; a document with several
    labels counts with each.
    """
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    chosen = docs.select("doc_id").distinct().join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    chosen = F.broadcast(chosen)  # `sample` rows at most
    rows = describe(docs.select("doc_id", "text").join(chosen, "doc_id"), drop_text=True)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *BASE).limit(sample).select("features", "quality").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float))


def rate(docs: DataFrame, labels: DataFrame, drop_text: bool = False, keep: float = KEEP) -> DataFrame:
    """`docs`, which have doc_id and text, with the BASE counts, score (double), base_failed and kept (boolean).

    The trees are fitted on their own labelled rows. Described and scored in one pass.
    base_failed: fewer than FEWEST words, or over REPEATS hundredths of the words in repeated windows.
    kept: not base_failed, and the trees give a chance of at least `keep`. Columns of these names are replaced.
    An empty table gives no rows; without labels the base rule alone decides.
    """
    scored = describe(docs, drop_text=drop_text, forest=train(docs, labels))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep))

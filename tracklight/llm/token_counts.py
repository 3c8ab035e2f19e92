"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link, to the node that stands for what is left
of the text read so far once the pieces that are certain by then are popped, and the count of those
pieces. Reading a word is then one pass over its bytes: greedy longest-match word-piece lengths, in
time linear in the word, and no piece is built.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from tracklight.llm.common import as_bytes, held, long, map_columns

#: Vocabulary of the query: one base64 piece and its rank a line; a piece that starts a word begins with a space.
VOCABULARY = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Words kept with their counts in a worker; when so many are held, all are forgotten.
CACHE_WORDS = 500_000
#: Longer words are read each time.
CACHE_BYTES = 64


class LongestMatch:
    """Counts the pieces of greedy longest match from the left.

    `start` are the pieces that may begin a word, `inner` those that may follow (without their mark).
    A word that the pieces don't cover counts as one token, the unknown one. With `marker`, each word
    is read with the marker before it and both sets are the same.
    """

    def __init__(self, start: Iterable[bytes], inner: Iterable[bytes] | None = None, marker: bytes = b""):
        self.marker = marker
        children: list[dict[int, int]] = [{}]
        ends = [False]

        def add(root: int, piece: bytes) -> None:
            node = root
            for byte in piece:
                below = children[node].get(byte)
                if below is None:
                    below = children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = below
            ends[node] = node != root or ends[node]

        if inner is None:
            rest = 0
        else:
            rest = 1
            children.append({})
            ends.append(False)
            for piece in inner:
                add(rest, piece)
        for piece in start:
            add(0, piece)
        fail = [-1] * len(children)
        pops = [0] * len(children)
        queue = deque({0, rest})
        while queue:
            node = queue.popleft()
            for byte, below in children[node].items():
                if ends[below]:
                    fail[below], pops[below] = rest, 1
                else:
                    link, popped = fail[node], pops[node]
                    while link >= 0 and byte not in children[link]:
                        popped += pops[link]
                        link = fail[link]
                    if link >= 0:
                        fail[below], pops[below] = children[link][byte], popped
                queue.append(below)
        left = [0] * len(children)  # pieces still to pop when a word ends at the node; -1 if its end can't be covered
        for node in range(len(children)):
            at, n = node, 0
            while at >= 0 and at != rest:
                n += pops[at]
                at = fail[at]
            left[node] = n if at == rest else -1
        self.children, self.fail, self.pops, self.left = children, fail, pops, left

    def count(self, word: bytes) -> int:
        children, fail, pops = self.children, self.fail, self.pops
        node = n = 0
        for byte in self.marker + word if self.marker else word:
            below = children[node].get(byte)
            while below is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                below = children[node].get(byte)
            node = below
        tail = self.left[node]
        return n + tail if tail >= 0 else 1


def load(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton of a rank file, with the counts of words seen by this process."""

    def make():
        with open(path, "rb") as file:
            pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
        return LongestMatch(pieces, marker=b" "), {}

    return held(("token counts", path), make)


def count_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY, drop_text: bool = False) -> DataFrame:
    """`df` with n_words and n_tokens (long) of the whole text.

    Words are runs of characters other than space and the controls 09-0D; each is read with a space
    before it, so the first word of a text counts as any other. Null and empty texts have 0 and 0,
    repeated rows each their own counts. Columns of `df` named n_words or n_tokens are replaced, other
    columns stay. The vocabulary file must lie at `path` on every executor.
    """

    def make():
        automaton, known = load(path)
        count = automaton.count

        def run(column):
            n_words, n_tokens = [], []
            for content in as_bytes(column):
                words = content.split() if content else ()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = count(word)
                        if len(word) <= CACHE_BYTES:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[word] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            return n_words, n_tokens

        return run

    return map_columns(df, make, [text], [long("n_words"), long("n_tokens")], drop=[text] if drop_text else [])

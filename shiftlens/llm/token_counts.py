"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters that are not white space, with the word mark in front. Its best
segmentation into vocabulary pieces has the highest sum of log probabilities, the fewest pieces
among equals. That best score depends on nothing but the characters read so far, so all pre-tokens
that begin alike share it: each trie node is scored once, when it is made. A vocabulary file gives
pieces in the order of their frequency; the probability of a piece follows from its place (Zipf).

Null and empty texts have no tokens. Repeated rows are counted alike.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

MARK = "▁"
#: A character that no piece holds costs one token per UTF-8 byte, each at this log probability.
BYTE_SCORE = -25.0
#: A task's trie starts anew beyond so many nodes, which changes no result.
TRIE_NODES = 700_000
#: Longer pre-tokens are scored without entering the trie.
TRIE_DEPTH = 128

RESULT = "struct<n_tokens:bigint,n_pretokens:bigint>"


def piece_scores(path: str) -> dict[str, float]:
    """Log probabilities of the ordinary pieces of a sentencepiece file, by rank."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        own.id_to_piece(i)
        for i in range(own.get_piece_size())
        if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))
    ]
    norm = math.log(sum(1 / (i + 1) for i in range(len(plain))))
    return {p: -math.log(i + 1) - norm for i, p in enumerate(plain)}


class Trie:
    """Forward scores and token counts per node; one per task."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [(0.0, 0)]
        self.counts: dict[str, int] = {}

    def step(self, text: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Score and minus the count of ``text[:end]``; ``path`` has those of all before it."""
        width = len(text[end - 1].encode())
        score, count = path[end - 1]
        best = (score + width * BYTE_SCORE, count - width)
        for start in range(max(0, end - self.longest), end):
            of_piece = self.scores.get(text[start:end])
            if of_piece is not None:
                score, count = path[start]
                best = max(best, (score + of_piece, count - 1))
        return best

    def count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is not None:
            return found
        text, path = MARK + word, [(0.0, 0)]
        if len(text) > TRIE_DEPTH:
            for end in range(1, len(text) + 1):
                path.append(self.step(text, end, path))
            return -path[-1][1]
        if len(self.best) > TRIE_NODES:
            self.clear()
        node = 0
        for end, c in enumerate(text, 1):
            below = self.child.get((node, c))
            if below is None:
                below = self.child[node, c] = len(self.best)
                self.best.append(self.step(text, end, path))
            path.append(self.best[below])
            node = below
        found = self.counts[word] = -self.best[node][1]
        return found


@lru_cache(maxsize=1)
def _trie(scores) -> Trie:
    return Trie(scores.value)


def token_counts(text: Column, scores) -> Column:
    """``n_tokens`` and ``n_pretokens`` of each text; ``scores`` is broadcast."""

    @F.arrow_udf(RESULT)
    def count(texts: pa.Array) -> pa.Array:
        own, tokens, words = _trie(scores), [], []
        for text in texts:
            split = (text.as_py() or "").split()
            words.append(len(split))
            tokens.append(sum(map(own.count, split)))
        return pa.StructArray.from_arrays(
            [pa.array(tokens, pa.int64()), pa.array(words, pa.int64())],
            ["n_tokens", "n_pretokens"],
        )

    return count(text)

"""Byte-pair encoding with merge ranks, and decoding.

A vocabulary file in the JSON format of the public ``tokenizers`` library gives the merges, the
vocabulary and the added tokens; the word pattern, the end-of-word mark and the lower-casing are
those of such word-level files. A task finds the words of a whole text at once and keeps their ids,
packed, in a bounded cache; what occurs again and again outlives a full one. For a word that is
not there, a priority queue of merge ranks runs over a doubly linked list of numbered symbols, and
entries whose pair has changed since they were queued are skipped. Decoding joins vocabulary strings.
Results leave a task in pieces of some ``HELD_IDS`` ids, however many rows and ids a batch has.

Null and empty texts give no ids and an empty decoded text. Repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: Words kept by a task since its cache was last full, and from before that; changes no result.
CACHE_WORDS = 300_000
#: Longer ones are encoded each time they occur.
CACHE_CHARS = 64
#: A task hands its results on once it holds so many ids; one text's stay together.
HELD_IDS = 1 << 18
#: Bits of a symbol's place in an entry of the queue, below its rank.
SHIFT = 32
PLACE = (1 << SHIFT) - 1

RESULT = "struct<ids:array<int>,decoded:string>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def merge(symbols: list[int], ranks: list[dict[int, int]], wholes: list[int]) -> list[int]:
    """The symbols after all merges, lowest rank first and leftmost among equals.

    ``ranks[left][right]`` is the rank of a pair and ``wholes[rank]`` the symbol that it becomes.
    """
    n = len(symbols)
    before = list(range(-1, n - 1))
    after = [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        rank = ranks[symbols[i]].get(symbols[i + 1])
        if rank is not None:
            queue.append(rank << SHIFT | i)
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        entry = pop(queue)
        rank, left = entry >> SHIFT, entry & PLACE
        right = after[left]
        # the pair may have changed since it was queued; a symbol that was merged away is -1
        if right < 0 or symbols[left] < 0 or ranks[symbols[left]].get(symbols[right]) != rank:
            continue
        symbols[left] = whole = wholes[rank]
        symbols[right] = -1
        after[left] = right = after[right]
        if right >= 0:
            before[right] = left
            rank = ranks[whole].get(symbols[right])
            if rank is not None:
                push(queue, rank << SHIFT | left)
        left = before[left]
        if left >= 0:
            rank = ranks[symbols[left]].get(whole)
            if rank is not None:
                push(queue, rank << SHIFT | left)
    return [s for s in symbols if s >= 0]


class Recent(dict):
    """What was made of a key, for at most ``CACHE_WORDS`` keys and as many from before it was last full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key) or self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found

    def forget(self) -> None:
        self.older = {}
        self.clear()


def _byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it has a form, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def _late(pattern: str) -> str:
    """Letters and numbers that ``regex`` knows and the ``tokenizers`` library does not yet.

    The two may follow different versions of Unicode.
    """
    doubtful = [
        c
        for c in map(chr, range(0x370, 0x110000))
        if unicodedata.category(c) == "Cn" and regex.match(pattern, c)
    ]
    known = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(doubtful))
    return "".join(sorted(set(doubtful) - {c for c, _ in known}))


def packed(ids: Iterable[int]) -> bytes:
    """Ids as 32-bit integers, one after the other."""
    return array("i", ids).tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


class Words:
    """Finds words as the pattern of a vocabulary file has them."""

    def __init__(self, pattern: str) -> None:
        self.plain = regex.compile(pattern)
        self.late = frozenset(late := _late(r"[\p{L}\p{N}]"))
        for name in (r"\p{L}", r"\p{N}") if late else ():
            pattern = pattern.replace(name, f"[{name}--[{late}]]")
        self.dated = regex.compile(pattern, regex.VERSION1)  # slow, for texts with late characters

    def find(self, text: str) -> list[str]:
        if text.isascii() or self.late.isdisjoint(text):
            return self.plain.findall(text)
        # no word crosses a space, and few parts hold late characters
        fit = lambda part: self.plain if self.late.isdisjoint(part) else self.dated
        return [w for part in text.split(" ") for w in fit(part).findall(part)]


class Tokenizer:
    """Encodes words with one vocabulary file; one per task. Of a word it keeps the packed ids."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        # by id: its vocabulary string, and its digits
        places = range(max(self.names, default=-1) + 1)
        self.strings = pa.array([self.names.get(i) for i in places], pa.string())
        self.digits = pa.array(map(str, places), pa.string())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = Words(split["pattern"]["Regex"])
        marks = sorted(self.added, key=len, reverse=True)
        self.mark = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        # every string that merging meets has a number, the vocabulary's first
        numbers = {s: n for n, s in enumerate(self.vocab)}
        number = lambda s: numbers.setdefault(s, len(numbers))
        shown = _byte_symbols()
        self.inner = [number(c) for c in shown]
        self.last = [number(c + self.end) for c in shown]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(number(left), number(right)) for left, right in merges]
        self.wholes = [number(left + right) for left, right in merges]
        self.ranks: list[dict[int, int]] = [{} for _ in numbers]
        for rank, (left, right) in enumerate(pairs):
            self.ranks[left][right] = rank
        self.ids = list(self.vocab.values())
        self.known = Recent(lambda word: packed(self.encode_word(word)))

    def normal(self, text: str) -> str:
        # one character at a time: the lower case of a sigma does not depend on its place
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        inner, ids = self.inner, self.ids
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(ids)
        return [ids[s] for s in merge(symbols, self.ranks, self.wholes) if s < n]

    def forget(self) -> None:
        """Give the cache back at a task's end: the process may go on with other work."""
        self.known.forget()

    def packed(self, text: str) -> bytes:
        """Packed ids of the text's words and added tokens."""
        if self.mark is None or not self.mark.search(text):
            return b"".join(map(self.known.__getitem__, self.word.find(self.normal(text))))
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += [self.packed(text[at : m.start()]), packed([self.added[m.group()]])]
            at = m.end()
        return b"".join([*out, self.packed(text[at:])])

    def encode(self, text: str) -> list[int]:
        return unpacked(self.packed(text)).tolist()

    def lists(self, batches: Iterable[pa.Array]) -> Iterator[pa.ListArray]:
        """The ids of each text, text after text, in arrays of some ``HELD_IDS`` ids."""

        def held() -> pa.ListArray:
            ids = unpacked(b"".join(found))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

        for texts in batches:
            ends, found = [0], []
            for text in texts:
                found.append(self.packed(text.as_py() or ""))
                ends.append(ends[-1] + len(unpacked(found[-1])))
                if ends[-1] >= HELD_IDS:
                    yield held()
                    ends, found = [0], []
            if found:
                yield held()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, joined by a space as the file names no decoder of its own."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])

    @staticmethod
    def joined(told: pa.Array, lists: pa.ListArray) -> pa.Array:
        """For each list of ids what ``told`` has for them, joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, told.take(lists.values)), " ")


@lru_cache(maxsize=2)
def _tokenizer(content: str) -> Tokenizer:
    return Tokenizer(content)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, which goes with the plan: a file of fixed size, no table."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(text: Column, content) -> Column:
    """``ids`` and ``decoded`` of each text; ``content`` is a broadcast vocabulary text."""

    @F.arrow_udf(RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _tokenizer(content.value)
        for ids in own.lists(batches):
            both = [ids, own.joined(own.strings, ids)]
            yield pa.StructArray.from_arrays(both, ["ids", "decoded"])
        own.forget()

    return encode(text)


def digested(text: Column, content) -> Column:
    """Number of ids and the SHA-256 of the ids' text and of the decoded text.

    The cache, of at most twice ``CACHE_WORDS`` short words, stays with the worker for its next task.
    """

    @F.arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _tokenizer(content.value)
        for ids in own.lists(batches):
            columns = [ids.value_lengths().cast(pa.int64())]
            for told in (own.digits, own.strings):
                sums = [hashlib.sha256(j.as_py().encode()).hexdigest() for j in own.joined(told, ids)]
                columns.append(pa.array(sums, pa.string()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.StructArray.from_arrays(columns, names)

    return digest(text)

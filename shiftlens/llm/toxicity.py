"""Toxic texts by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic text has beyond
it. A window of words is compressed twice: with the ordinary dictionary, and with the toxic
dictionary laid before the ordinary one. The bytes saved by the toxic part are the window's
distance. A document's score comes from how many of its windows save at least 1, 2 or 3 bytes, by a
logistic curve calibrated on the labelled documents.

Toxic training text: of each toxic document the words, or parts of words, made of five-byte grams
that several toxic training documents share and that are at least ``TIMES`` as frequent among toxic
documents as among ordinary ones. Ordinary training text leaves out words with such grams, so an
ordinary document that quotes one or is labelled wrongly does not hide it. Training uses labelled
documents only, never more than ``MAX_TOXIC`` and ``MAX_ORDINARY``, drawn by a hash of their id,
none longer than ``MAX_CHARS`` characters. Labels of one document that disagree count as toxic.

Scoring reads whole texts. Null and empty texts have no windows; they get the score of a text whose
windows save nothing. Without labels of both kinds no text is toxic: every score is 0.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Bounds of the labelled sample that the dictionaries and the curve are fitted on.
MAX_TOXIC = 3000
MAX_ORDINARY = 6000
MAX_CHARS = 200_000

GRAM = 5
#: Toxic documents that must share a gram: a hundredth of them, between these.
MIN_SUPPORT, MAX_SUPPORT = 3, 8
#: How many times as frequent among toxic documents a gram must be that ordinary ones have, too; one
#: more ordinary document is counted than have it. Below that are words of a topic or a language.
TIMES = 25
TOXIC_BYTES = 4096
ORDINARY_BYTES = 16384
#: Words of one window, and how far windows are apart.
WINDOW_WORDS = 8
#: A missed toxic document counts as much as so many wrongly rejected ones.
TOXIC_WEIGHT = 2.0
#: Savings whose windows are counted.
SAVED = (1, 2, 3)

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
# A block's last bytes are never matched, so each window ends in some that need not be.
TAIL = b" " * 8
# The offsets that close the header of a trained dictionary: 1, 4 and 8 as 32-bit integers.
HEADER_END = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def words(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode())


MODEL = (
    "toxic binary, ordinary binary, mean array<double>, spread array<double>, weights array<double>"
)


@dataclass(frozen=True)
class Model:
    """What the tasks need; a few kilobytes."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: tuple[float, ...] = field(default=())
    spread: tuple[float, ...] = field(default=())
    weights: tuple[float, ...] = field(default=())


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        compression_level=5,
        window_log=17,
        hash_log=17,
        chain_log=17,
        search_log=6,
        min_match=4,
        strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=params)


@lru_cache(maxsize=4)
def _compressors(toxic: bytes, ordinary: bytes) -> tuple:
    return _compressor(ordinary).compress, _compressor(toxic + ordinary).compress


def savings(model: Model, text: str) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    plain, both = _compressors(model.toxic, model.ordinary)
    own = words(text)
    windows = (
        b" " + b" ".join(own[i : i + WINDOW_WORDS]) + TAIL
        for i in range(0, len(own), WINDOW_WORDS)
    )
    return np.array([len(plain(w)) - len(both(w)) for w in windows], int)


def features(saved: np.ndarray) -> list[float]:
    n = max(1, len(saved))
    counts = [int((saved >= s).sum()) for s in SAVED]
    return [
        max(0, int(saved.max(initial=0))),
        np.log1p(n),
        *np.log1p(counts),
        *(min(1.0, 5 * c / n) for c in counts),
    ]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary without its header; all samples where they are too few."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
        return whole[whole.index(HEADER_END) + len(HEADER_END) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def _parts(word: bytes, strong: set[bytes]) -> list[bytes]:
    """The stretches of a word that strong grams cover."""
    word = b" " + word + b" "
    covered = bytearray(len(word))
    for i in range(len(word) - GRAM + 1):
        if word[i : i + GRAM] in strong:
            covered[i : i + GRAM] = b"\x01" * GRAM
    return [word[m.start() : m.end()] for m in re.finditer(rb"\x01+", bytes(covered))]


def _support(documents: list[set[bytes]]) -> Counter[bytes]:
    """In how many documents each gram is."""
    found: Counter[bytes] = Counter()
    for own in documents:
        found.update(set().union(*(_grams(w) for w in own)))
    return found


def strong_grams(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> set[bytes]:
    """Grams that enough toxic documents share, and far more of them than of ordinary ones."""
    least = _least(toxic)
    shared = {g: n for g, n in _support(toxic).items() if n >= least}
    known = _support(ordinary)
    times = TIMES * len(toxic)
    return {g for g, n in shared.items() if not known[g] or n * len(ordinary) >= times * (known[g] + 1)}


def _least(toxic: list[set[bytes]]) -> int:
    return min(MAX_SUPPORT, max(MIN_SUPPORT, len(toxic) // 100))


def toxic_samples(toxic: list[set[bytes]], strong: set[bytes]) -> list[bytes]:
    """One sample for each toxic document that has strong grams."""
    in_documents = Counter(w for own in toxic for w in own)
    least = _least(toxic)
    samples = []
    for own in toxic:
        found = []
        for word in sorted(own):
            parts = _parts(word, strong)
            if parts and in_documents[word] >= least:
                parts = [b" " + word + b" "]
            found += parts
        if found:
            samples.append(b"  " + b" ".join(p.strip() for p in found) + b"  ")
    return samples


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(toxic: list[str], ordinary: list[str], ordinary_weight: float = 1.0) -> Model:
    """``ordinary_weight``: how many documents each ordinary one of the sample stands for."""
    if not toxic or not ordinary:
        return Model()
    # each word is held once, however many documents have it
    held: dict[bytes, bytes] = {}
    bad, good = ([{held.setdefault(w, w) for w in words(t)} for t in side] for side in (toxic, ordinary))
    strong = strong_grams(bad, good)
    prepared = toxic_samples(bad, strong)
    mixed = random.Random(0)
    of_toxic = prepared * 8
    mixed.shuffle(of_toxic)
    marked = {w for w in held if not _grams(w).isdisjoint(strong)}
    of_good = [b" " + b" ".join(sorted(own - marked)) + b" " for own in good]
    mixed.shuffle(of_good)
    model = Model(_trained(of_toxic, TOXIC_BYTES), _trained(of_good, ORDINARY_BYTES))
    x = np.array([features(savings(model, t)) for t in [*toxic, *ordinary]])
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    weight = np.where(y == 1, TOXIC_WEIGHT, ordinary_weight)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    scaled = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    beta = _logistic(scaled, y, weight)
    return Model(model.toxic, model.ordinary, tuple(mean), tuple(spread), tuple(beta))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the CRC-32 of its id as text; never used for fitting."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out."""
    known = (
        labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sides = {1: MAX_TOXIC, 0: MAX_ORDINARY}
    there = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for side, most in sides.items():
        part = known.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = (
        docs.where(F.length("text") <= MAX_CHARS)
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most MAX_TOXIC + MAX_ORDINARY ids
    )
    whole = there.get(0, 0)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        toxic, ordinary = (list(rows["text"][rows["toxic"] == side]) for side in sides)
        model = fit(toxic, ordinary, whole / max(1, len(ordinary)))
        return pd.DataFrame([vars(model)])

    # one task for the bounded sample, so that the driver holds no texts
    rows = texts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fitted, MODEL).collect()
    if not rows:
        return Model()
    parts = rows[0].asDict()
    return Model(*(tuple(v) if isinstance(v, list) else bytes(v) for v in parts.values()))


def score(model: Model, text: str) -> float:
    if not model.weights:
        return 0.0
    x = (np.array(features(savings(model, text))) - model.mean) / model.spread
    z = x @ np.array(model.weights[:-1]) + model.weights[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scored(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1."""

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        return pa.array([score(model, t.as_py() or "") for t in texts], pa.float64())

    return of_text(text)

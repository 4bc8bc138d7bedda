"""Documents whose shingle sets overlap, by MinHash with Bayesian pruning.

Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. A document's
set holds its runs of ``SHINGLE`` consecutive words, or all its words where it has fewer. Documents
of one set are a class; the member with the smallest id stands for it and is the only one that is
compared. Signatures have ``HASHES`` MinHash values in bands; two sets meet where a band agrees,
which misses a pair at the threshold less than once in ten million. Pairs are compared a stretch of
values at a time, and dropped as soon as the posterior probability of reaching the threshold
(uniform prior) is below ``TOLERANCE``. What is left connects candidates to clusters. All pairs of a
cluster that pass the same comparison are verified exactly on their texts.

Pairs never become rows: large buckets and clusters are dealt into chunks, every two chunks meet in
a group of their own of bounded size, and a group hands over its members' link counts and a forest
of the links, no more rows than it has members.

Null texts and texts without words have no shingles, link to nothing and are classes of their own.
Rows of one id and text are one class. A null id comes before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.llm.common import kept_aside
from shiftlens.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared between two looks at the posterior.
STRETCH = 16
TOLERANCE = 1e-6
#: Members of one chunk of a bucket, on average, and of a cluster of candidates.
CHUNK = 256
CLUSTER_CHUNK = 64
#: Buckets of the filter on documents to verify: its size whatever the input.
SIEVE = 1 << 20
#: Words whose hashes a task keeps.
CACHE_WORDS = 100_000

SIGNED = (
    "doc bigint, text_hash bigint, n bigint, set_low bigint, set_high bigint, signature binary"
)
PAIR = "a_doc bigint, a_text bigint, b_doc bigint, b_text bigint"
VERIFIED = f"{PAIR}, n_links bigint"


#: Bytes to what they count as: A-Z in lower case, blanks for all of ASCII that is in no word.
WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Hashes:
    return _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    split = (text or "").encode().translate(WORDS).split()
    h = np.fromiter(map(_words().__getitem__, split), np.uint64, len(split))
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    own = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        own = _mix(own ^ h[i : i + len(own)])
    return np.unique(own)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return (
        draw.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1),
        draw.integers(0, 2**63, HASHES, np.uint64),
    )


def signature(own: np.ndarray) -> np.ndarray:
    """Sixteen bits of every MinHash value."""
    if not len(own):
        return np.zeros(HASHES, np.uint16)
    factor, shift = _family()
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):  # the working set stays small for long texts
        part = own[at : at + 4096]
        np.minimum(least, (part[:, None] * factor + shift).min(axis=0), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, low, high, signed = [], [], [], []
        for text in batch.column("text"):
            own = shingles(text.as_py())
            sizes.append(len(own))
            low.append(own.sum(dtype=np.uint64))
            high.append(_mix(own + np.uint64(1)).sum(dtype=np.uint64))
            signed.append(signature(own).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                batch.column("text_hash"),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(low, np.uint64).view(np.int64)),
                pa.array(np.array(high, np.uint64).view(np.int64)),
                pa.array(signed, pa.binary()),
            ],
            ["doc", "text_hash", "n", "set_low", "set_high", "signature"],
        )


@lru_cache(maxsize=1)
def least_matches() -> np.ndarray:
    """For 0 to ``HASHES`` compared values, how many must agree for the pair to stay.

    With a uniform prior the similarity has a beta posterior, whose mass above the threshold is
    summed from binomial terms.
    """
    need = np.zeros(HASHES + 1, int)
    for n in range(1, HASHES + 1):
        k = np.arange(n + 2)
        choose = np.array([lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) for i in k])
        terms = np.exp(choose + k * np.log(THRESHOLD) + (n + 1 - k) * np.log1p(-THRESHOLD))
        posterior = np.cumsum(terms)[: n + 1]  # of m matches: at most m of n + 1
        need[n] = int(np.searchsorted(posterior, TOLERANCE))
    return need


def surviving(signed: np.ndarray, sizes: np.ndarray, pairs: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs, those that may reach the threshold."""
    a, b = pairs
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    fits = small >= THRESHOLD * large - 1e-9
    a, b = a[fits], b[fits]
    need, matches = least_matches(), np.zeros(len(a), int)
    for at in range(0, HASHES, STRETCH):
        part = slice(at, at + STRETCH)
        matches += (signed[a, part] == signed[b, part]).sum(axis=1)
        stay = matches >= need[at + STRETCH]
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def _joined(root: dict, x, y) -> bool:
    """Whether the pair connects what was apart; from then on it is connected."""

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    x, y = find(x), find(y)
    root[y] = x
    return x != y


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that connect what the pairs before them have not."""
    root: dict[int, int] = {}
    pairs = zip(a.tolist(), b.tolist(), strict=True)
    kept = [k for k, (x, y) in enumerate(pairs) if _joined(root, x, y)]
    return a[kept], b[kept]


def exact(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the two shingle sets of each pair reach the threshold."""
    sets = [shingles(t) for t in texts]
    whole, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bit = np.cumsum(times > 1) - 1  # shingles of one text alone are in no intersection
    masks, at = [], 0
    for own in sets:
        mine = place[at : at + len(own)]
        at += len(own)
        bits = np.zeros(int(bit[-1]) + 1 if len(bit) else 0, bool)
        bits[bit[mine[times[mine] > 1]]] = True
        masks.append(int.from_bytes(np.packbits(bits).tobytes(), "big"))
    return np.array(
        [
            (common := (masks[x] & masks[y]).bit_count())
            >= THRESHOLD * (len(sets[x]) + len(sets[y]) - common) - 1e-9
            for x, y in zip(a.tolist(), b.tolist(), strict=True)
        ],
        bool,
    )


def _by_group(keys: list[str], of_group: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A function over batches that come sorted by ``keys``, which hands on whole groups."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            starts = _starts(rest, keys)
            yield from _each(rest, starts[:-1], of_group)
            rest = rest.slice(starts[-2]) if len(starts) > 1 else rest
        if rest is not None:
            yield from _each(rest, _starts(rest, keys), of_group)

    return over


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups start, and the number of rows."""
    if not rows.num_rows:
        return np.zeros(1, int)
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def _each(rows: pa.Table, starts: np.ndarray, of_group) -> Iterator[pa.RecordBatch]:
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        yield from of_group(rows.slice(start, end - start))


def _met(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of a group: within a chunk, or between its two chunks."""
    signed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16)
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    if i == j:
        pairs = np.triu_indices(group.num_rows, 1)
    else:
        first = group.column("chunk").to_numpy() == i
        pairs = tuple(x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first)))
    return surviving(signed.reshape(-1, HASHES), group.column("n").to_numpy(), pairs)


def _ends(group: pa.Table, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    sides = [group.select(["doc", "text_hash"]).take(pa.array(x, pa.int64())) for x in (a, b)]
    return [side.column(c).combine_chunks() for side in sides for c in ("doc", "text_hash")]


ENDS = ["a_doc", "a_text", "b_doc", "b_text"]


def _candidate_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the candidate pairs of a task, over all of its groups."""
    root: dict = {}

    def of_group(group: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = _met(group)
        if len(a):
            a, b = forest(a, b)
            names = list(zip(*(group.column(c).to_pylist() for c in ("doc", "text_hash")), strict=True))
            new = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if _joined(root, names[x], names[y])]
            yield pa.RecordBatch.from_arrays(_ends(group, a[new], b[new]), ENDS)

    return _by_group(["band", "bucket", "i", "j"], of_group)(batches)


def _verified(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """A forest of the links, without a count, and each member's count under itself twice."""
    a, b = _met(group)
    if not len(a):
        return
    true = exact(group.column("text").to_pylist(), a, b)
    a, b = a[true], b[true]
    count = np.bincount(np.concatenate([a, b]), minlength=group.num_rows)
    linked = np.flatnonzero(count)
    for x, y, links in ((*forest(a, b), None), (linked, linked, count[linked])):
        links = pa.nulls(len(x), pa.int64()) if links is None else pa.array(links, pa.int64())
        yield pa.RecordBatch.from_arrays([*_ends(group, x, y), links], [*ENDS, "n_links"])


def signed_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    own = docs.select(
        F.col(doc).cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    return own.mapInArrow(_sign, SIGNED)


def classes(signed: DataFrame) -> DataFrame:
    """One row per set of shingles: its first document ``rep``, and the signature.

    Texts without shingles are a class per id and text.
    """
    alone = F.when(F.col("n") == 0, F.struct("doc", "text_hash"))
    first = F.min(F.struct("doc", "text_hash")).alias("rep")
    return (
        signed.groupBy("n", "set_low", "set_high", alone.alias("alone"))
        .agg(first, F.min("signature").alias("signature"))
        .drop("alone")
    )


def _candidates(reps: DataFrame) -> DataFrame:
    """Pairs of representatives that pass the Bayesian comparison."""
    per_band = 2 * ROWS
    keys = F.array(
        *(
            F.struct(
                F.lit(k).alias("band"),
                F.xxhash64(F.substring("signature", 1 + k * per_band, per_band)).alias("bucket"),
            )
            for k in range(BANDS)
        )
    )
    members = reps.where(F.col("n") > 0).select(
        F.col("rep.doc").alias("doc"), F.col("rep.text_hash").alias("text_hash"), F.explode(keys).alias("k")
    ).select("doc", "text_hash", "k.*")
    counts = members.groupBy("band", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = kept_aside(members.join(kept_aside(counts), ["band", "bucket"]))
    placed = _dealt(shared, CHUNK).select("band", "bucket", "i", "j", "chunk", "doc", "text_hash")
    signatures = reps.select(
        F.col("rep.doc").alias("s_doc"), F.col("rep.text_hash").alias("s_text"), "n", "signature"
    )
    same = placed["doc"].eqNullSafe(signatures["s_doc"]) & (
        placed["text_hash"] == signatures["s_text"]
    )
    full = placed.join(signatures, same).select(*placed.columns, "n", "signature")
    groups = ["band", "bucket", "i", "j"]
    sorted_rows = full.repartition(*groups).sortWithinPartitions(*groups)
    return sorted_rows.mapInArrow(_candidate_forest, PAIR)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Members of groups, dealt into chunks and to every two of them: adds ``chunk, i, j``."""
    chunks = F.ceil(F.col("members") / size).cast("int")
    chunk = F.pmod(F.xxhash64("doc", "text_hash"), chunks).cast("int")
    met = rows.withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1))
    )
    return met.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})


def _sieved(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that may be in a pair, once each; the filter has at most ``SIEVE`` rows."""
    spot = lambda doc, text: F.pmod(F.xxhash64(doc, text), F.lit(SIEVE)).alias("spot")
    spots = pairs.select(spot("a_doc", "a_text")).union(pairs.select(spot("b_doc", "b_text")))
    return (
        docs.withColumn("spot", spot("doc", "text_hash"))
        .join(F.broadcast(kept_aside(spots.distinct())), "spot", "left_semi")
        .drop("spot")
    )


def links(docs: DataFrame, reps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``a_doc, a_text, b_doc, b_text, n_links`` over representatives.

    Rows without ``n_links`` are links that connect all that is linked; the others count the links
    of one representative, several rows of one add up.
    """
    pairs = kept_aside(_candidates(reps))
    clusters = kept_aside(components(pairs.select(_vertex("a").alias("a"), _vertex("b").alias("b"))))
    sizes = kept_aside(clusters.groupBy("label").agg(F.count("*").alias("members")))
    placed = _dealt(
        clusters.join(sizes, "label").select(
            "label", "members", _known("vertex").alias("doc"), F.col("vertex.text").alias("text_hash")
        ),
        CLUSTER_CHUNK,
    ).select(F.xxhash64("label").alias("cluster"), "i", "j", "chunk", "doc", "text_hash")
    own = docs.select(
        F.col(doc).cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    texts = _sieved(own, pairs).dropDuplicates(["doc", "text_hash"])
    texts = texts.select(F.col("doc").alias("t_doc"), F.col("text_hash").alias("t_text"), "text")
    signatures = reps.select(
        F.col("rep.doc").alias("s_doc"), F.col("rep.text_hash").alias("s_text"), "n", "signature"
    )
    full = placed
    for side, d, h in ((signatures, "s_doc", "s_text"), (texts, "t_doc", "t_text")):
        full = full.join(side, full["doc"].eqNullSafe(side[d]) & (full["text_hash"] == side[h])).drop(d, h)
    groups = ["cluster", "i", "j"]
    sorted_rows = full.repartition(*groups).sortWithinPartitions(*groups)
    return sorted_rows.mapInArrow(_by_group(groups, _verified), VERIFIED)


def _vertex(side: str) -> Column:
    """A key without nulls, so that plain equality joins it and ids keep their order."""
    doc = F.col(f"{side}_doc")
    return F.struct(
        doc.isNotNull().alias("known"), F.coalesce(doc, F.lit(0)).alias("doc"), F.col(f"{side}_text").alias("text")
    )


def _known(vertex: str) -> Column:
    """The id of a vertex, which may be null."""
    return F.when(F.col(f"{vertex}.known"), F.col(f"{vertex}.doc"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its class, the class's links, and the group that links connect.

    ``doc, text_hash, class_doc, class_text, n_links, group_doc, group_text``; a class is named by
    its first document, a group by its first class.
    """
    signed = kept_aside(signed_documents(docs, doc, text))
    reps = kept_aside(classes(signed))
    found = kept_aside(links(docs, reps, doc, text))
    edges = found.where("n_links IS NULL").select(_vertex("a").alias("a"), _vertex("b").alias("b"))
    counted = (
        found.where("n_links IS NOT NULL")
        .groupBy(_vertex("a").alias("vertex"))
        .agg(F.sum("n_links").alias("n_links"))
    )
    linked = counted.join(components(edges), "vertex").select(
        _known("vertex").alias("l_doc"),
        F.col("vertex.text").alias("l_text"),
        "n_links",
        _known("label").alias("group_doc"),
        F.col("label.text").alias("group_text"),
    )
    keys = ["n", "set_low", "set_high"]
    of_class = reps.where(F.col("n") > 0).select(
        *keys, F.col("rep.doc").alias("class_doc"), F.col("rep.text_hash").alias("class_text")
    )
    same = of_class["class_doc"].eqNullSafe(linked["l_doc"]) & (of_class["class_text"] == linked["l_text"])
    known = kept_aside(
        of_class.join(linked, same, "left").select(
            *keys,
            "class_doc",
            "class_text",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(F.col("l_text").isNull(), F.col("class_doc")).otherwise(F.col("group_doc")).alias("group_doc"),
            F.coalesce("group_text", "class_text").alias("group_text"),
        )
    )
    with_words = signed.where(F.col("n") > 0).drop("signature").join(known, keys)
    without = signed.where(F.col("n") == 0)
    names = ["doc", "text_hash", "class_doc", "class_text", "n_links", "group_doc", "group_text"]
    own = [F.col(c) for c in ("doc", "text_hash")]
    return with_words.select(names).union(without.select(*own, *own, F.lit(0).cast("bigint"), *own))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The documents that stand first in their group, all their columns; of repeated rows one."""
    stays = F.col("doc").eqNullSafe(F.col("group_doc")) & (F.col("text_hash") == F.col("group_text"))
    kept = kept_aside(
        near_duplicates(docs)
        .where(stays)
        .groupBy(F.col("doc").alias("kept_doc"), F.col("text_hash").alias("kept_text"))
        .agg(F.count("*").alias("kept_rows"))
    )
    same = docs["doc_id"].eqNullSafe(kept["kept_doc"]) & (F.xxhash64(docs["text"]) == kept["kept_text"])
    met = docs.join(kept, same)
    once = met.where(F.col("kept_rows") == 1).select(docs.columns)
    again = met.where(F.col("kept_rows") > 1).dropDuplicates(["kept_doc", "kept_text"])
    return once.unionByName(again.select(docs.columns))

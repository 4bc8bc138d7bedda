"""Personal data in texts: candidates, boosted trees, calibrated thresholds; built-in functions only.

Generators with high recall propose spans, which may overlap: the four base kinds, and loose forms
of an address, a long number and an IPv6 address. Spans of a base kind that pass its check (octets,
digit counts, the Luhn sum) stay as they are. The loose ones are judged by gradient-boosted trees on
their format and on the words around them; those above a threshold calibrated on data that the trees
have not seen are added, unless they overlap a base span.

The trees are fitted on the candidates of all documents, of which three in four by a hash of their ids grow the
trees and the others set the threshold: candidates that pass a base check are positive, the others that touch none
are negative. Candidates with the same features are counted once with their number as weight, so what is
fitted is small and the texts are read once.
The fitted trees become one column expression, so scoring is a projection without any shuffle.

Offsets count code points, ends are exclusive. Null and empty texts have no spans, repeated rows
have the same. Without candidates of both classes nothing is added. All repetitions that could run
over a long text are possessive, so matching takes linear time and no deep stack.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.sources.tables import stored

TREES, DEPTH = 10, 4
#: Share of true spans among those above the threshold, on the calibration part.
PRECISION = 0.98
#: Characters of context on either side.
CONTEXT = 24

# The base kinds. ``\\G`` lets a match begin where the one before has ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(PATTERNS)

LOOSE = {
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9.-]++",
    "number": r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "address6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
KINDS = (*BASE_KINDS, *LOOSE)

#: What a text must hold for a kind to be looked for at all.
GATES = {"email": "@", "phone": "+", "contact": "at|@", "address6": ":"}

N_FEATURES = 13
CONTEXT_WORDS = r"(?i)mail|phone|tel|call|fax|mobile|contact|card|account|iban|addr|ip\b|ssn|born|id\b"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    backwards = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.try_to_number(backwards.substr(place, F.lit(1)), F.lit("9")).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, text: Column) -> Column:
    """The base kind's check of a matched string."""
    n = F.length(_digits(text))
    if kind == "ip":
        return F.forall(
            F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
        )
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _located(kind: str, hits: Column, gaps: Column) -> Column:
    """Spans of the hits; the text is gap, hit, gap, ..., gap."""
    n = F.size(hits)
    pieces = F.arrays_zip(
        hits.alias("hit"), F.slice(gaps, 1, n).alias("gap"), F.slice(gaps, 2, n).alias("next")
    )

    def place(held: Column, piece: Column) -> Column:
        start = held["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            piece["hit"].alias("text"),
            F.concat_ws(" ", F.right(piece["gap"], F.lit(CONTEXT)), F.left(piece["next"], F.lit(CONTEXT))).alias(
                "near"
            ),
        )
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(span)).alias("out"))

    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(n > 0, F.aggregate(pieces, start, place, lambda held: held["out"])).otherwise(none)


SPANS = "array<struct<kind:string,start:int,end:int,text:string,near:string>>"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with an array of spans for each kind, under the kind's name in ``found``."""
    own = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    hits, gaps = {}, {}
    for kind, pattern in {**PATTERNS, **LOOSE}.items():
        gate = F.col("_text").rlike(re.sub(r"([+])", r"\\\1", GATES.get(kind, "[0-9]")))
        found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        hits[f"_h_{kind}"] = F.when(gate, found).otherwise(F.array().cast("array<string>"))
        split = F.split("_text", pattern, -1)
        gaps[f"_g_{kind}"] = F.when(F.size(f"_h_{kind}") > 0, split)
    placed = {k: _located(k, F.col(f"_h_{k}"), F.col(f"_g_{k}")).alias(k) for k in KINDS}
    return (
        own.withColumns(hits)
        .withColumns(gaps)
        .select(*docs.columns, F.struct(*placed.values()).alias("_found"))
    )


def _base(found: Column) -> Column:
    """Spans of the base kinds that pass their checks, by kind and start."""

    def passing(kind: str) -> Column:
        return F.filter(found[kind], lambda s: passes(kind, s["text"]))

    return F.concat(*map(passing, BASE_KINDS))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(
        spans,
        lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])),
    )


def features(span: Column) -> list[Column]:
    """Format and context of a span, as numbers."""
    text, near = span["text"], span["near"]
    count = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")
    return [
        F.length(text).cast("double"),
        count("0-9"),
        count("A-Za-z"),
        count("@"),
        count("."),
        count(r"\x20-"),
        count(":"),
        text.startswith("+").cast("double"),
        text.contains("(").cast("double"),
        F.length(F.regexp_extract(text, r"^\W*([0-9]+)", 1)).cast("double"),
        F.length(F.regexp_extract(text, r"([0-9]+)\W*$", 1)).cast("double"),
        near.rlike(CONTEXT_WORDS).cast("double"),
        near.rlike(r"[=:]\s*[\"']?\s").cast("double"),
    ]


def _tree(lines: list[str], inputs: list[Column]) -> Column:
    """A tree's printed form as nested conditions; takes its lines from the list."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split()[1]))
    feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    below = _tree(lines, inputs)
    lines.pop(0)  # the matching Else
    above = _tree(lines, inputs)
    return F.when(inputs[int(feature)] <= float(limit), below).otherwise(above)


class Model:
    """Fitted trees as text, and the threshold above which a span is added."""

    def __init__(self, trees: list[tuple[float, list[str]]], threshold: float) -> None:
        self.trees, self.threshold = trees, threshold

    def score(self, span: Column) -> Column:
        # an array of one array, so that the features are computed once and not at every split
        return F.transform(
            F.array(F.array(*features(span))),
            lambda inputs: self.score_of([inputs[i] for i in range(N_FEATURES)]),
        )[0]

    def score_of(self, inputs: list[Column]) -> Column:
        """The score of features that are there as columns."""
        margin = reduce(Column.__add__, (w * _tree(list(t), inputs) for w, t in self.trees))
        return 1 / (1 + F.exp(-2 * margin))


def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Model | None:
    """Trees from the candidates of all documents, the threshold from those of documents kept apart."""
    own = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = F.col("_found")
    every = F.concat(*(found[k] for k in KINDS))
    spans = candidates(own).select("doc", _base(found).alias("base"), every.alias("all"))

    def labelled(spans: Column, value: float) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(value).alias("label"), s.alias("s")))

    right, wrong = F.col("base"), _apart(F.col("all"), F.col("base"))
    both = F.concat(labelled(right, 1.0), labelled(wrong, 0.0))
    # a document without an id grows trees
    apart = F.coalesce(F.pmod(F.xxhash64("doc", F.lit("calibration")), F.lit(4)) == 0, F.lit(False))
    rows = spans.select(apart.alias("apart"), F.explode(both).alias("r")).select("apart", "r.label", "r.s")
    names = [f"f{i}" for i in range(N_FEATURES)]
    inputs = [c.alias(n) for n, c in zip(names, features(F.col("s")), strict=True)]
    table = stored(
        rows.select("apart", "label", *inputs)
        .groupBy("apart", "label", *names)
        .agg(F.count("*").cast("double").alias("weight"))
    )
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(table.where("NOT apart"))
    train = packed.select("label", "weight", "features")
    if train.select("label").distinct().count() < 2:
        return None
    trainer = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=0, checkpointInterval=-1, weightCol="weight")
    fitted = trainer.fit(train)
    trees = [
        (float(w), [x for x in t.toDebugString.splitlines()[1:] if x.strip()])
        for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)
    ]
    model = Model(trees, 1.0)
    bins = (
        table.where("apart")
        .groupBy(F.floor(model.score_of([F.col(n) for n in names]) * 50).alias("bin"))
        .agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("rows"))
        .orderBy(F.desc("bin"))
        .collect()  # at most 51 rows
    )
    right = rows_above = 0
    for b in bins:
        right, rows_above = right + b["right"], rows_above + b["rows"]
        if right < PRECISION * rows_above:
            break
        model.threshold = max(0.5, b["bin"] / 50)
    return model


def spans(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The frame with ``base`` and ``added`` spans of every text."""
    found = F.col("_found")
    base = candidates(docs, text).withColumn("base", _base(found))
    if model is None:
        added = F.array().cast(SPANS)
    else:
        loose = _apart(F.concat(*(found[k] for k in LOOSE)), F.col("base"))
        added = F.filter(loose, lambda s: model.score(s) >= model.threshold)
    return base.withColumn("added", added).drop("_found")


def listed(found: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order given."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )

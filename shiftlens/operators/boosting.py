"""Second-order boosted trees over binned features, their scores and their attributions.

Features are cut into bins once, at quantiles of the training rows. A level of a tree is one pass: every task
adds up the gradients and hessians of its rows per (node, feature, bin), the sums are combined before the
exchange, and the driver gets a table whose size depends on the tree and not on the rows. A split takes
the largest gain under L2, with the missing values on the better side and a least hessian on both.

Margins are written with the rows every ``CHECK`` trees, and the AUC of the validation rows is taken for all
trees since; the model ends at the best one once ``patience`` trees bring no gain. Gradients are summed as whole
numbers, so the order of tasks does not matter and a second run gives the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.catalog import FEATURES
from shiftlens.operators.monitor import auc_ks, risk_level
from shiftlens.sources.tables import stored

CHECK = 16
#: Gradients and hessians are at most 1; sums of 2^32 rows fit 64 bits.
STEPS = float(1 << 30)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Rows are kept in blocks: every value is the packed column of some thousand rows, the bins column by column, so that
#: a pass moves few large values. At most so many blocks are in a file, which bounds what a task reads at once.
STATE = "is_valid boolean, hash binary, label binary, bins binary, margin binary"
BLOCKS = 16
SUMS = "node int, feature int, bin int, g bigint, h bigint"


@dataclass(frozen=True)
class Settings:
    """What the published model was trained with."""

    max_trees: int = 400
    rate: float = 0.03
    depth: int = 4
    least_weight: float = 5.0
    row_share: float = 0.8
    feature_share: float = 0.8
    l2: float = 1.0
    patience: int = 50
    bins: int = 256
    seed: int = 42


class Tree:
    """Nodes as in a heap: node i has children 2i + 1 and 2i + 2; a leaf's feature is -1."""

    def __init__(self, depth: int) -> None:
        n = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(n, -1)
        self.cut = np.zeros(n, np.int64)  # bins up to it go left
        self.threshold = np.zeros(n)  # values up to it go left
        self.missing_left = np.zeros(n, bool)
        self.value = np.zeros(n)
        self.cover = np.zeros(n)
        self.gain = np.zeros(n)

    def nodes(self, columns: np.ndarray, missing: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where rows end up; ``columns`` are bins or values, ``cuts`` the tree's in the same terms.

        Each split is one comparison of a whole column, which is much quicker than to look up every row's own split.
        """
        kind = np.uint8 if len(self.feature) < 256 else np.int64
        at = np.zeros(len(columns), kind)
        for node in np.flatnonzero(self.feature >= 0).tolist():
            f = self.feature[node]
            left = columns[:, f] <= columns.dtype.type(cuts[node])
            if self.missing_left[node]:
                left |= missing[:, f]
            else:
                left &= ~missing[:, f]
            at += (at == node) * (kind(node + 2) - left.astype(kind))
        return at


@dataclass
class Model:
    names: list[str]
    base: float
    trees: list[Tree]
    settings: Settings
    #: Validation AUC after each tree that was grown, those after the best one included.
    history: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        return self.base + sum(
            (t.value[t.nodes(x, missing, t.threshold)] for t in self.trees), np.zeros(len(x))
        )


def bin_cuts(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Per feature the upper bounds of its bins, at quantiles of ``rows``."""
    shares = [i / bins for i in range(1, bins)]
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names}
    found = rows.agg(
        *[F.percentile_approx(v, shares, 20 * bins).alias(f"c{i}") for i, v in enumerate(known.values())]
    ).first()
    return [np.unique(np.array(c or [], np.float64)) for c in found]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Values as a matrix; missing ones are NaN."""
    columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
    return np.stack(columns, axis=1) if len(batch) else np.zeros((0, len(names)))


def _binned(rows: DataFrame, names: list[str], cuts: list[np.ndarray], base: float) -> DataFrame:
    """``STATE``: bin 0 is for missing values."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names)
            out = np.zeros(x.shape, np.uint16)
            for i, bounds in enumerate(shared.value):
                out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(bounds, x[:, i]))
            hashes, labels, valid = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "label", "is_valid")
            )
            for side in (False, True):
                own = np.flatnonzero(valid == side)
                if len(own):
                    parts = (hashes[own], labels[own], out[own].T, np.full(len(own), base))
                    columns = [pa.array([p.tobytes()], pa.binary()) for p in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([side]), *columns], [f.split()[0] for f in STATE.split(", ")])

    return stored(rows.mapInArrow(binned, STATE), maxRecordsPerFile=BLOCKS)


class _Rows:
    """A block of ``STATE`` with the margins that recent trees add."""

    def __init__(self, batch: pa.RecordBatch, at: int, recent: list[Tree]) -> None:
        of = lambda c, kind: np.frombuffer(batch.column(c)[at].as_buffer(), kind)
        self.hash, self.label = of("hash", np.uint64), of("label", np.float64)
        self.bins = of("bins", np.uint16).reshape(-1, len(self.hash)).T
        self.missing = self.bins == 0
        self.margins = [of("margin", np.float64)]
        for tree in recent:
            self.margins.append(self.margins[-1] + tree.value[self.nodes(tree)])

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch], recent: list[Tree]) -> Iterator[_Rows]:
        for batch in batches:
            for at in range(len(batch)):
                yield cls(batch, at, recent)

    def nodes(self, tree: Tree) -> np.ndarray:
        return tree.nodes(self.bins, self.missing, tree.cut)

    def drawn(self, number: int, share: float) -> np.ndarray:
        """The rows that a tree sees; the same for the same row and number."""
        with np.errstate(over="ignore"):
            x = self.hash + GOLDEN * np.uint64(number + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) <= np.uint64(min(int(share * 2**64), 2**64 - 1))


def _level(
    state: DataFrame,
    recent: list[Tree],
    tree: Tree,
    number: int,
    asked: list[int],
    columns: np.ndarray,
    n_bins: int,
    share: float,
) -> dict[int, np.ndarray]:
    """Sums of gradients and hessians by node, in whole steps: (2, feature, bin)."""
    context = (recent, tree, number, asked, columns, n_bins, share)
    shared = state.sparkSession.sparkContext.broadcast(context)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, tree, number, asked, columns, n_bins, share = shared.value
        place = np.full(len(tree.feature), -1)
        place[asked] = np.arange(len(asked))
        shape = (len(columns), len(asked), n_bins)
        sums = np.zeros((2, len(columns), len(asked) * n_bins), np.int64)
        for rows in _Rows.each(batches, recent):
            own = place[rows.nodes(tree)]
            kept = np.flatnonzero(rows.drawn(number, share) & (own >= 0))
            p = 1 / (1 + np.exp(-rows.margins[-1][kept]))
            whole = [np.rint(value * STEPS) for value in (p - rows.label[kept], p * (1 - p))]
            place_of = own[kept] * n_bins
            for j, f in enumerate(columns):
                cells = place_of + rows.bins[:, f][kept]
                for i in range(2):
                    # sums of a batch are exact in a float64
                    found = np.bincount(cells, whole[i], len(asked) * n_bins).astype(np.int64)
                    sums[i, j] += found
        sums = sums.reshape(2, -1)
        held = np.flatnonzero(sums.any(axis=0))
        feature, node, cell = np.unravel_index(held, shape)
        found = [np.asarray(asked)[node], columns[feature], cell]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in found), *(pa.array(s[held]) for s in sums)],
            [f.split()[0] for f in SUMS.split(", ")],
        )

    train = state.where("NOT is_valid").select("hash", "label", "bins", "margin")
    sums = train.mapInArrow(summed, SUMS).groupBy("node", "feature", "bin")
    found = sums.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = {}
    position = {f: i for i, f in enumerate(columns.tolist())}
    for node, part in found.groupby("node"):
        table = np.zeros((2, len(columns), n_bins), np.int64)
        at = part["feature"].map(position).to_numpy()
        table[0, at, part["bin"]] = part["g"]
        table[1, at, part["bin"]] = part["h"]
        out[int(node)] = table
    return out


def best_split(table: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool] | None:
    """Gain, place of the feature, last bin that goes left, and whether missing values do."""
    g, h = table
    total_g, total_h = g[0].sum(), h[0].sum()
    part_g, part_h = np.cumsum(g[:, 1:], axis=1), np.cumsum(h[:, 1:], axis=1)
    best = None
    for missing_left in (True, False):
        left_g, left_h = part_g + missing_left * g[:, :1], part_h + missing_left * h[:, :1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
        gain = np.where((left_h >= least) & (right_h >= least), gain / 2, -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best[0] + 1e-12):
            best = (float(gain[f, b]), int(f), int(b) + 1, missing_left)
    return best


def _grown(state: DataFrame, recent: list[Tree], number: int, cuts: list[np.ndarray], s: Settings) -> Tree:
    tree, n_bins = Tree(s.depth), 2 + max(map(len, cuts), default=0)
    draw = np.random.default_rng([s.seed, number])
    n_features = max(1, int(s.feature_share * len(cuts)))
    columns = np.sort(draw.permutation(len(cuts))[:n_features])
    asked, above = [0], {}
    for _ in range(s.depth):
        # of two children the lighter one is summed up, the other is what its parent has besides; sums are whole
        light = [0] if asked == [0] else [min(asked[i : i + 2], key=tree.cover.__getitem__) for i in range(0, len(asked), 2)]
        sums_of = _level(state, recent, tree, number, light, columns, n_bins, s.row_share)
        for node in light:
            if node and (node - 1) // 2 in above:
                other = node + 1 if node % 2 else node - 1
                sums_of[other] = above[(node - 1) // 2] - sums_of.get(node, 0)
        above, following = sums_of, []
        for node in asked:
            if node not in sums_of:
                continue
            table = sums_of[node] / STEPS
            g, h = table
            if node == 0:
                tree.cover[0], tree.value[0] = h[0].sum(), -s.rate * g[0].sum() / (h[0].sum() + s.l2)
            found = best_split(table, s.l2, s.least_weight)
            # bins beyond a feature's last bound hold nothing that could go right
            if found is None or found[2] > len(cuts[columns[found[1]]]):
                continue
            tree.gain[node], f, last, missing_left = found
            tree.feature[node], tree.cut[node] = columns[f], last
            tree.threshold[node], tree.missing_left[node] = cuts[columns[f]][last - 1], missing_left
            for child, sums in (
                (2 * node + 1, [x[f, 1 : last + 1].sum() + missing_left * x[f, 0] for x in (g, h)]),
                (2 * node + 2, [x[f, last + 1 :].sum() + (not missing_left) * x[f, 0] for x in (g, h)]),
            ):
                tree.value[child], tree.cover[child] = -s.rate * sums[0] / (sums[1] + s.l2), sums[1]
                following.append(child)
        asked = following
        if not asked:
            break
    return tree


def _margins(state: DataFrame, recent: list[Tree]) -> DataFrame:
    """``STATE`` with the margins that the recent trees lead to."""
    shared = state.sparkSession.sparkContext.broadcast(recent)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                margin = pa.array([_Rows(batch, at, shared.value).margins[-1].tobytes()], pa.binary())
                yield batch.slice(at, 1).set_column(batch.schema.names.index("margin"), "margin", margin)

    return stored(state.mapInArrow(moved, STATE), maxRecordsPerFile=BLOCKS)


def _aucs(state: DataFrame, recent: list[Tree]) -> list[float]:
    """Of the validation rows, after each of the recent trees; empty where it is not defined."""
    shared = state.sparkSession.sparkContext.broadcast(recent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _Rows.each(batches, shared.value):
            for i, margin in enumerate(rows.margins[1:]):
                columns = [pa.array(np.full(len(margin), i, np.int32)), pa.array(margin), pa.array(rows.label)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "margin", "label"])

    valid = state.where("is_valid").select("hash", "label", "bins", "margin")
    long = valid.mapInArrow(each, "tree int, margin double, label double")
    found = auc_ks(long, ["tree"], label="label", score="margin").orderBy("tree").collect()
    return [r["auc"] for r in found if r["auc"] is not None]


def train(
    features: DataFrame,
    names: list[str] = FEATURES,
    label: str = "is_bad",
    key: str = "user_id",
    settings: Settings = Settings(),  # noqa: B008
) -> Model:
    """A model of the rows with ``dataset`` 'train', as long as it is best for those with 'valid'."""
    known = features.where(F.col("dataset").isin("train", "valid") & F.col(label).isNotNull())
    rows = known.select(
        F.xxhash64(key).alias("hash"),
        F.col(label).cast("double").alias("label"),
        (F.col("dataset") == "valid").alias("is_valid"),
        *[F.col(c).cast("double").alias(c) for c in names],
    )
    training = rows.where("NOT is_valid")
    rate = training.agg(F.avg("label")).first()[0]
    if rate is None:
        raise ValueError("there are no training rows")
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    model = Model(list(names), float(np.log(rate / (1 - rate))), [], settings)
    cuts = bin_cuts(training, names, settings.bins)
    state = _binned(rows, names, cuts, model.base)
    recent: list[Tree] = []
    for number in range(settings.max_trees):
        recent.append(_grown(state, recent, number, cuts, settings))
        if len(recent) < CHECK and number + 1 < settings.max_trees:
            continue
        model.trees += recent
        model.history += _aucs(state, recent)
        if len(model.history) == len(model.trees) and stops(model.history, settings.patience):
            break
        state, recent = _margins(state, recent), []
    if len(model.history) == len(model.trees):
        model.history = model.history[: stops(model.history, settings.patience) or None]
        model.trees = model.trees[: int(np.argmax(model.history)) + 1]
    return model


def stops(history: list[float], patience: int) -> int:
    """How many trees were grown when ``patience`` trees had brought no gain; 0 if that has not come."""
    best = 0
    for i, value in enumerate(history):
        if value > history[best]:
            best = i
        elif i - best >= patience:
            return i + 1
    return 0


def score(model: Model, features: DataFrame) -> DataFrame:
    """``score, risk_score, risk_level`` after the kept columns; the band is set on the unrounded score."""
    kept = [c for c in ("user_id", "dataset", "is_bad") if c in features.columns]
    shared = features.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(columns: pd.DataFrame) -> pd.Series:
        x = columns.to_numpy(dtype="float64")
        return pd.Series(1 / (1 + np.exp(-shared.value.margin(x))))

    values = F.struct(*[F.col(c).cast("double").alias(c) for c in model.names])
    return features.select(*kept, probability(values).alias("score")).select(
        *kept,
        "score",
        F.round("score", 4).alias("risk_score"),
        risk_level(F.col("score")).alias("risk_level"),
    )


Box = tuple[float, float, bool, float]


def leaf_boxes(model: Model) -> list[tuple[float, dict[int, Box]]]:
    """Every leaf as (value, {feature: (above, up to, missing too, share of weight that stays on its path)})."""
    boxes = []

    def walk(tree: Tree, node: int, box: dict[int, Box]) -> None:
        f = int(tree.feature[node])
        if f < 0:
            boxes.append((float(tree.value[node]), box))
            return
        low, high, missing, share = box.get(f, (-np.inf, np.inf, True, 1.0))
        at, left = tree.threshold[node], bool(tree.missing_left[node])
        parts = [tree.cover[c] / (tree.cover[2 * node + 1] + tree.cover[2 * node + 2]) for c in (2 * node + 1, 2 * node + 2)]
        walk(tree, 2 * node + 1, {**box, f: (low, min(high, at), missing and left, share * parts[0])})
        walk(tree, 2 * node + 2, {**box, f: (max(low, at), high, missing and not left, share * parts[1])})

    for tree in model.trees:
        walk(tree, 0, {})
    return boxes


def leaf_payouts(value: float, box: dict[int, Box]) -> list[np.ndarray]:
    """For each feature of a leaf its Shapley values by what fits: bit i is set where feature i does."""
    d, shares = len(box), [share for _, _, _, share in box.values()]
    fits = [((np.arange(1 << d) >> i) & 1).astype(float) for i in range(d)]
    out = []
    for j in range(d):
        poly = [np.ones(1 << d)]
        for i in range(d):
            if i != j:
                grown = [shares[i] * c for c in poly] + [np.zeros(1 << d)]
                for n, c in enumerate(poly):
                    grown[n + 1] = grown[n + 1] + c * fits[i]
                poly = grown
        mass = sum(c * (factorial(n) * factorial(d - n - 1) / factorial(d)) for n, c in enumerate(poly))
        out.append(value * mass * (fits[j] - shares[j]))
    return out


def tree_attributions(model: Model, features: DataFrame, key: str = "user_id") -> DataFrame:
    """Wide ``key, <feature>...``: Shapley values of every row's log-odds under the trees' cover.

    For one leaf the payout is a product over the features on its path: 1 or 0 where the feature
    is known, the share of training weight where it is not. Its Shapley value follows from the
    coefficients of a short polynomial. It depends only on which of the path's few features fit, so each leaf has a
    table of its payouts, and a row looks up its own. Rows are independent, so batches are enough; the leaves
    (trees x 16 at most) travel with the task.
    """
    leaves = [(box, leaf_payouts(value, box)) for value, box in leaf_boxes(model)]
    names = model.names

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # columns lie together, as each is compared on its own
            x = np.asfortranarray(batch[names].to_numpy(dtype="float64"))
            missing = np.isnan(x)
            out = np.zeros(x.shape, order="F")
            for box, payouts in leaves:
                known = np.zeros(len(x), np.intp)
                for i, (f, (low, high, blank, _)) in enumerate(box.items()):
                    v = x[:, f]
                    fits = (v > low) & (v <= high)
                    known |= (fits | missing[:, f] if blank else fits).astype(np.intp) << i
                for f, payout in zip(box, payouts, strict=True):
                    out[:, f] += payout[known]
            yield pd.concat([batch[[key]], pd.DataFrame(out, columns=names)], axis=1)

    schema = f"{key} bigint, " + ", ".join(f"`{c}` double" for c in names)
    plain = features.select(
        F.col(key).cast("bigint").alias(key), *[F.col(c).cast("double").alias(c) for c in names]
    )
    return plain.mapInPandas(attribute, schema)

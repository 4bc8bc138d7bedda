"""Second-order boosted trees against their definition."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.operators import boosting as B

NAMES = ["a", "b", "c"]
SCHEMA = "user_id bigint, a double, b double, c double, is_bad int, dataset string"


def make(n=600, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(draw.integers(8)), float(draw.normal()), float(draw.integers(3))
        a = None if draw.random() < 0.2 else a
        p = 0.2 + 0.4 * (a is None) + 0.3 * (b > 0.5)
        rows.append((i, a, math.nan if i % 50 == 0 else b, c, int(draw.random() < p), ["train", "train", "valid", "test"][i % 4]))
    return rows


def matrix(rows):
    return np.array([[math.nan if v is None else v for v in r[1:4]] for r in rows], float)


def brute_split(x, g, h, l2, least):
    """The largest gain over every feature, every value and both sides for the missing."""
    best = (0.0, None)
    for f in range(x.shape[1]):
        missing = np.isnan(x[:, f])
        for cut in np.unique(x[~missing, f]):
            for side in (True, False):
                left = np.where(missing, side, x[:, f] <= cut)
                if h[left].sum() < least or h[~left].sum() < least:
                    continue
                gain = 0.5 * sum(g[m].sum() ** 2 / (h[m].sum() + l2) for m in (left, ~left))
                gain -= 0.5 * g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    return best


@pytest.fixture(scope="module")
def grown(spark):
    rows = make()
    # one bin for each value, all rows and columns
    settings = B.Settings(max_trees=3, depth=3, rate=0.3, row_share=1.0, feature_share=1.0, bins=1000, least_weight=1.0)
    return rows, settings, B.train(spark.createDataFrame(rows, SCHEMA).repartition(5), NAMES, settings=settings)


def test_gains_equal_brute_force(grown):
    rows, settings, model = grown
    train = [r for r in rows if r[5] == "train"]
    x, y = matrix(train), np.array([r[4] for r in train], float)
    margin = np.full(len(x), math.log(y.mean() / (1 - y.mean())))
    missing = np.isnan(x)
    checked = 0
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(x), int)
        for level in range(settings.depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = at == node
                if not own.any():
                    continue
                gain, left = brute_split(x[own], g[own], h[own], settings.l2, settings.least_weight)
                assert tree.gain[node] == pytest.approx(gain, abs=1e-6)
                if gain == 0:
                    assert tree.feature[node] < 0
                    continue
                checked += 1
                f = tree.feature[node]
                went = np.where(missing[own, f], tree.missing_left[node], x[own, f] <= tree.threshold[node])
                for child, part in ((2 * node + 1, went), (2 * node + 2, ~went)):
                    value = -settings.rate * g[own][part].sum() / (h[own][part].sum() + settings.l2)
                    assert tree.value[child] == pytest.approx(value, abs=1e-6)
                at[np.flatnonzero(own)] = np.where(went, 2 * node + 1, 2 * node + 2)
        margin = margin + tree.value[tree.nodes(x, missing, tree.threshold)]
    assert checked > 6


def test_scores_and_attributions(spark, grown):
    rows, _, model = grown
    frame = spark.createDataFrame(rows, SCHEMA)
    scores = {r["user_id"]: r["score"] for r in B.score(model, frame).collect()}
    margins = model.margin(matrix(rows))
    assert max(abs(scores[r[0]] - 1 / (1 + math.exp(-m))) for r, m in zip(rows, margins)) < 1e-12

    boxes = B.leaf_boxes(model)

    def value(x, known):
        out = 0.0
        for leaf, box in boxes:
            for f, (low, high, missing, share) in box.items():
                inside = missing if math.isnan(x[f]) else low < x[f] <= high
                leaf *= inside if f in known else share
            out += leaf
        return out

    wide = {r["user_id"]: r for r in B.tree_attributions(model, frame).collect()}
    expected = value([0.0] * 3, set())
    for row, x, margin in list(zip(rows, matrix(rows), margins))[:60]:
        got = [wide[row[0]][c] for c in NAMES]
        assert model.base + expected + sum(got) == pytest.approx(margin, abs=1e-9)
        for f in range(3):
            rest = [u for u in range(3) if u != f]
            want = sum(
                math.factorial(k) * math.factorial(2 - k) / 6 * (value(x, {*s, f}) - value(x, set(s)))
                for k in range(3)
                for s in itertools.combinations(rest, k)
            )
            assert got[f] == pytest.approx(want, abs=1e-9)


def test_best_iteration_and_repeats(spark):
    rows = make(800, 2)
    settings = B.Settings(max_trees=40, rate=0.5, depth=2, patience=5)
    models = [
        B.train(spark.createDataFrame(rows, SCHEMA).repartition(parts), NAMES, settings=settings) for parts in (2, 6)
    ]
    first, second = models
    assert [t.value.tolist() for t in first.trees] == [t.value.tolist() for t in second.trees]
    best = len(first.trees) - 1
    assert first.history[best] == max(first.history) and first.history.index(max(first.history)) == best
    assert len(first.history) in (best + 1 + 5, 40)
    # the history is what the validation rows say
    valid = [r for r in rows if r[5] == "valid"]
    margin = first.margin(matrix(valid))
    bad = np.array([r[4] for r in valid]) == 1
    pairs = margin[bad][:, None] - margin[~bad][None, :]
    assert first.history[best] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean(), abs=1e-9)


def test_stops():
    assert B.stops([0.5, 0.6, 0.6, 0.59, 0.58], 3) == 5
    assert B.stops([0.5, 0.6, 0.6, 0.61, 0.58], 3) == 0
    assert B.stops([], 3) == 0


def test_validation_of_one_label_and_no_rows(spark):
    rows = [r for r in make(200, 3) if r[5] != "valid" or r[4] == 0]
    model = B.train(spark.createDataFrame(rows, SCHEMA), NAMES, settings=B.Settings(max_trees=2))
    assert len(model.trees) == 2 and model.history == []
    with pytest.raises(ValueError):
        B.train(spark.createDataFrame(rows, SCHEMA).where(F.lit(False)), NAMES)


def test_payout_tables_equal_subsets():
    """A leaf's payouts against the sum over all orders of its features."""
    box = {0: (0, 1, True, 0.25), 3: (0, 1, False, 0.5), 5: (0, 1, False, 0.9)}
    shares = [0.25, 0.5, 0.9]
    worth = lambda known, fits: math.prod(fits[i] if i in known else shares[i] for i in range(3))
    tables = B.leaf_payouts(2.0, box)
    for bits in range(8):
        fits = [(bits >> i) & 1 for i in range(3)]
        for j in range(3):
            gains = [
                worth(set(order[: order.index(j) + 1]), fits) - worth(set(order[: order.index(j)]), fits)
                for order in itertools.permutations(range(3))
            ]
            assert abs(tables[j][bits] - 2.0 * sum(gains) / len(gains)) < 1e-12


def test_a_level_sums_up_one_child_of_two(spark, monkeypatch):
    asked, level = [], B._level

    def seen(*args):
        asked.append(len(args[4]))
        return level(*args)

    monkeypatch.setattr(B, "_level", seen)
    settings = B.Settings(max_trees=1, depth=3, rate=0.3, least_weight=1.0)
    B.train(spark.createDataFrame(make(), SCHEMA).repartition(5), NAMES, settings=settings)
    assert asked[0] == 1 and len(asked) == 3 and asked[1] == 1 and asked[2] <= 2

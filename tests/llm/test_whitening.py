"""Whitening against a plain covariance."""

import math

import numpy as np

from shiftlens.llm import queries, whitening
from shiftlens.llm.secular import Spectrum, secular_roots

VECTORS = "vec_id bigint, embedding array<float>, id string, x string, n string, component string, label int"


def row(i, vector):
    return (i, vector, "i", "x", "n", "c", 1)


def whole(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])


def plain(vectors):
    """Deviations, whitened vectors and shares of the trace."""
    x = whole(vectors)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    covariance = (apart / n).T @ (apart / n) / n
    values, found = np.linalg.eigh(covariance)
    first = np.argsort(-values)[:32]
    first = first[values[first] > 1e-11 * np.trace(covariance)]
    deviations = [sum(int(v) ** 2 for v in r) for r in apart]
    return deviations, apart / n @ found[:, first] / np.sqrt(values[first]), values[first] / np.trace(covariance)


def held(got, ids, vectors):
    deviations, expected, shares = plain(vectors)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == sorted(set(ids)) and len(got) == len(ids) * len(shares)
    signs = None
    for i, deviation, want in zip(ids, deviations, expected):
        rows = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in rows] == list(range(1, len(shares) + 1))
        assert {(r["n"], r["deviation"]) for r in rows} == {(len(vectors), deviation)}
        assert np.allclose([r["explained"] for r in rows], shares, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in rows)
        found = np.array([r["whitened"] for r in rows])
        if signs is None and (np.abs(want) > 1e-3).all():
            signs = np.sign(found * want)
        if signs is not None:
            assert np.allclose(found, want * signs, atol=1e-8)


def test_whitening(llm, tables):
    draw = np.random.default_rng(9)
    vectors = (draw.normal(size=(700, 40)) @ draw.normal(size=(40, 40)) + 5).tolist()
    for v in vectors:
        v[3], v[7] = v[4], 0.25  # two equal dimensions and one without variance
    vectors += [vectors[5]] * 350  # a third are copies, each with an id of its own
    bad = [row(9000, None), row(9001, [None] * 40), row(9002, [math.nan] * 40), row(9003, [-math.inf] * 40), row(9004, []),
           row(9005, [3e38] * 40)]
    rows = [row(i, v) for i, v in enumerate(vectors)] + bad
    got = queries.op13_whitening(llm, tables(embeddings=(rows, VECTORS))).collect()
    held(got, list(range(len(vectors))), vectors)


def test_lengths_ids_and_empty_tables(llm, tables):
    draw = np.random.default_rng(10)
    short, other = draw.normal(size=(50, 3)).tolist(), draw.normal(size=(60, 5)).tolist()
    rows = [row(i, v) for i, v in enumerate(short)] + [row(100 + i, v) for i, v in enumerate(other)]
    rows += [row(500, [1.0] * 7)]  # alone: no variance, no rows
    got = queries.op13_whitening(llm, tables(embeddings=(rows, VECTORS))).collect()
    held([r for r in got if r["vec_id"] < 100], list(range(50)), short)
    held([r for r in got if r["vec_id"] >= 100], list(range(100, 160)), other)
    # rows without an id and of one id
    rows = [row(None, short[0]), row(None, short[1])] + [row(1, v) for v in short[2:]] + [row(1, short[2])]
    got = queries.op13_whitening(llm, tables(embeddings=(rows, VECTORS))).collect()
    assert len(got) == 3 * 51 and sum(r["vec_id"] is None for r in got) == 6
    assert queries.op13_whitening(llm, tables(embeddings=([], VECTORS))).count() == 0


def test_many_partitions(llm, tables):
    """Spectra meet in several rounds."""
    draw = np.random.default_rng(11)
    vectors = draw.normal(size=(400, 6)).tolist()
    frame = llm.createDataFrame([row(i, v) for i, v in enumerate(vectors)], VECTORS).repartition(100)
    rows = whitening.whole(frame)
    got = whitening.whitened(rows, whitening.refined(rows)).withColumnRenamed("id", "vec_id").collect()
    held(got, list(range(400)), vectors)


def test_large_deviations():
    x = np.array([[2**61, 5, 1], [-(2**61), 7, 1], [0, 9, 2]])
    sums = [int(s) for s in x.astype(object).sum(axis=0)]
    total = whitening.Totals(3, sums)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert total.deviations(x) == [w if w < 2**63 else None for w in want]
    small = whitening.Totals(3, [int(s) for s in x[:, 1:].sum(axis=0)])
    assert small.deviations(x[:, 1:]) == [((3 * x[:, 1:] - x[:, 1:].sum(axis=0)) ** 2).sum(axis=1)[i] for i in range(3)]


def test_rank_one_updates():
    draw = np.random.default_rng(12)
    for width, n in ((1, 5), (2, 9), (6, 4), (30, 200)):
        x = np.floor(10 * draw.normal(size=(n, width)) @ draw.normal(size=(width, width)))
        x[:, -1] = x[:, 0]
        x = np.concatenate([x, x[:2], np.zeros((1, width)), 1e-9 * x[:1], 1e9 * x[:1]])
        found = Spectrum.nothing(width)
        for v in x:
            found.add(v)
        want = x.T @ x
        back = found.vectors * found.values @ found.vectors.T
        assert np.abs(back - want).max() <= 1e-12 * np.abs(want).max()
        assert np.abs(found.vectors.T @ found.vectors - np.eye(width)).max() < 1e-11
        assert (np.diff(found.values) >= 0).all()


def test_secular_roots_interlace():
    d = np.array([0.0, 1e-12, 1.0, 1.0 + 1e-9, 5.0, 1e8])
    z = np.array([1e-3, 1.0, 1e-5, 3.0, 1e-7, 2.0])
    values, weights = secular_roots(d, z)
    assert (values >= d).all() and (values[:-1] <= d[1:]).all()
    assert np.abs(weights.T @ weights - np.eye(6)).max() < 1e-13

"""Hard negatives against all pairs."""

import math

import numpy as np

from shiftlens.llm import hard_negatives, queries

VECTORS = "vec_id bigint, embedding array<float>, label int, row string, copies string, summary string"
END = 2**63 - 1


def row(i, vector, label):
    return (i, vector, label, "r", "c", "s")


def plain(rows):
    usable = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label, *_ in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, label, v) in enumerate(usable):
        if i % 100:
            continue
        scored = [
            (-max(-END - 1, min(END, sum(x * y for x, y in zip(v, w)))), j, other == label)
            for b, (j, other, w) in enumerate(usable)
            if b != a and len(w) == len(v)
        ]
        for p, j, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted(x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(llm, tables, rows):
    got = queries.op12_hard_negatives(llm, tables(embeddings=(rows, VECTORS)))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.select(*names).collect()))


def near(draw, n, width=24, clusters=6):
    """Vectors around a few centres, as embeddings are."""
    centres = draw.normal(size=(clusters, width))
    own = draw.integers(clusters, size=n)
    found = centres[own] + 0.4 * draw.normal(size=(n, width))
    return [[float(x) for x in v] for v in found / 5], (own + draw.integers(2, size=n)).tolist()


def test_hard_negatives(llm, tables):
    draw = np.random.default_rng(5)
    vectors, labels = near(draw, 1500)
    rows = [row(i, v, l) for i, (v, l) in enumerate(zip(vectors, labels))]
    # ties, other lengths, and rows that take no part
    rows += [row(2000 + i, [0.5] * 24, i % 3) for i in range(120)]
    rows += [row(3000 + i, [float(i % 4), 1.0, 0.5], i % 2) for i in range(60)] + [row(3100 + i, [], i % 2) for i in range(3)]
    rows += [row(3300, None, 1), row(3400, [None] * 24, 1), row(3500, [math.nan] * 24, 1), row(3600, [math.inf] * 24, 1),
             row(3700, [0.1] * 24, None), row(None, [0.1] * 24, 1)]
    # equal rows, and an id with several vectors
    rows += [rows[100]] * 30 + [rows[200]] * 2 + [rows[201]] * 40 + [row(100, vectors[5], 1), row(100, vectors[6], 2)]
    got = mined(llm, tables, rows)
    assert got == plain(rows)
    assert len(got) > 1000
    assert mined(llm, tables, []) == []


def test_very_large_components(llm, tables):
    draw = np.random.default_rng(6)
    sizes = [3e38, -3e38, 1e17, 5e15, 1e9, 0.25]
    rows = [row(i * 50, [float(draw.choice(sizes)) for _ in range(4)], int(draw.integers(2))) for i in range(120)]
    rows += [row(10_000 + i, [1e7, 1e7 + i, 3.0, 0.1], i % 2) for i in range(100)]
    assert mined(llm, tables, rows) == plain(rows)


def test_blocks_change_nothing(llm, tables, monkeypatch):
    vectors, labels = near(np.random.default_rng(7), 800)
    rows = [row(i, v, l) for i, (v, l) in enumerate(zip(vectors, labels))]
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 30_000)
    assert mined(llm, tables, rows) == plain(rows)


def test_summaries_spare_exact_scores(monkeypatch):
    """Bounds hold, and of vectors around a few centres most are given up before their score is formed."""
    import pyarrow as pa

    draw = np.random.default_rng(8)
    # segments with means of their own, as where neighbouring components go together
    smooth = np.repeat(draw.normal(size=(4000, 4)), 8, axis=1) + 0.1 * draw.normal(size=(4000, 32))
    matrix = np.floor(64 * smooth)
    table = pa.table({
        "row": np.arange(4000), "id": np.arange(4000), "label": np.zeros(4000, np.int64),
        "ints": pa.array(matrix.tolist()), "copies": np.ones(4000, np.int64),
        "summary": pa.array(hard_negatives._summary(matrix).tolist()),
    })
    block = hard_negatives.Block(table, np.arange(4000), 32)
    formed = []
    scores = hard_negatives.Block.scores
    monkeypatch.setattr(hard_negatives.Block, "scores", lambda s, q, a, rows: formed.append(len(rows)) or scores(s, q, a, rows))
    for a in range(20):
        exact = matrix @ matrix[a]
        for level in range(len(block.parts)):
            low, high = block.bounds(level, block, a, np.arange(4000))
            assert (low <= exact).all() and (exact <= high).all()
        found = [i for i, _ in hard_negatives.nearest(block, block, a, 5)]
        order = np.lexsort((np.arange(4000), -exact))
        assert found == [i for i in order.tolist() if i != a][:5]
    assert sum(formed) < 20 * 4000 / 10

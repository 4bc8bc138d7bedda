import random
import re
from itertools import combinations

import numpy as np

from shiftlens.llm import ngram_join, queries
from shiftlens.llm.components import components

from llm.helpers import DOCS, doc, numbered


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain(rows):
    classes, out = {}, {}
    for i, t in rows:
        classes.setdefault(shingle_set(t), []).append(i)
    reps = {min(v): s for s, v in classes.items() if s}
    links, root = dict.fromkeys(reps, 0), {i: i for i in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(reps), 2):
        common = len(reps[a] & reps[b])
        if common >= 0.8 * (len(reps[a]) + len(reps[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for s, ids in classes.items():
        for i in ids:
            out[i] = (min(ids), links[min(ids)], find(min(ids))) if s else (i, 0, i)
    return out


def corpus():
    draw = random.Random(2)
    text = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    base, chain, texts = text(120), text(200), []
    for _ in range(80):  # near copies of one text, most of them linked with each other
        t = list(base)
        for _ in range(draw.randrange(4)):
            t[draw.randrange(len(t))] = "edit"
        texts.append(" ".join(t))
    for i in range(8):  # a chain whose ends are far apart
        chain[i * 25] = f"step{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(base)] * 40 + ["a b", "A, b.", "b a", "", None, "?!", "solo", "É é", "é é"] + [" ".join(text(60)) for _ in range(40)]
    draw.shuffle(texts)
    return texts


def test_equals_all_pairs(llm, tables, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 16)  # buckets of several chunks
    texts = corpus()
    rows = numbered(texts)
    got = queries.op7_ngram_join(llm, tables(documents=(rows, DOCS))).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in got} == plain(list(enumerate(texts)))
    assert len(got) == len(rows)


def test_one_of_each_group_stays(llm):
    texts = corpus()
    rows = numbered(texts) + [doc(3, texts[3]), doc(None, "only here"), doc(None, "only here")]
    kept = ngram_join.first_of_groups(llm.createDataFrame(rows, DOCS)).collect()
    want = {group for _, _, group in plain(list(enumerate(texts))).values()}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(want)
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["only here"]
    assert tuple(kept[0])[2:] == ("k", 1, "s", "d", "h")


def test_empty_table(llm, tables):
    assert queries.op7_ngram_join(llm, tables(documents=([], DOCS))).count() == 0


def test_words():
    text = "It's 12 Ünits, ÉTÉ—x_y\u00a0z\x7f9 A"
    assert text.encode().translate(ngram_join.WORDS).split() == [w.encode() for w in re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]


def test_pruning_keeps_pairs_at_the_threshold():
    need = ngram_join.least_matches()
    draw = np.random.default_rng(1)
    seen = draw.binomial(1, 0.8, (20_000, ngram_join.HASHES)).cumsum(axis=1)
    looks = np.arange(ngram_join.STRETCH, ngram_join.HASHES + 1, ngram_join.STRETCH)
    assert (seen[:, looks - 1] >= need[looks]).all()
    assert need[ngram_join.HASHES] > 0.55 * ngram_join.HASHES


def test_components(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["vertex"]: r["label"] for r in components(llm.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_contracted_edges_grow_with_vertices(llm, monkeypatch):
    """Groups whose edges number the square of their vertices come down to about one edge a vertex."""
    from shiftlens.llm import components as module

    monkeypatch.setattr(module, "TOGETHER", 20)
    for m in (40, 160):
        edges = [(100 * g + 1000 * (i % 7) + i, 100 * g + 1000 * (j % 7) + j) for g in range(2) for i in range(m) for j in range(i)]
        frame = llm.createDataFrame(edges, "a int, b int").repartition(8)
        vertices = {v for e in edges for v in e}
        once = module.contracted(module.contracted(frame, "a"), "b")
        assert once.count() <= 3 * len(vertices)
        got = {r["vertex"]: r["label"] for r in components(frame).collect()}
        above = {v: v for v in vertices}

        def top(v):
            while above[v] != v:
                v = above[v]
            return v

        for a, b in edges:
            low, high = sorted((top(a), top(b)))
            above[high] = low
        assert got == {v: top(v) for v in vertices}

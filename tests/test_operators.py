"""Edge cases with hand-computed or brute-force answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.catalog import FEATURES, LOAN_COLUMNS, MARRIAGE_CODES
from shiftlens.functions.numeric import chi_square_p, erfc_positive, fixed_text, logit
from shiftlens.functions.text import tokens
from shiftlens.operators import (
    attribution as A,
    cohort as C,
    evidence as E,
    findings as N,
    grading as G,
    monitor as M,
    ordering as O,
    quality as K,
    retrieval as R,
    runs as U,
    scoring as S,
    search_index as I,
    vector_index as V,
    pair_ranks,
    term_scores as TS,
)
from shiftlens.operators.significance import two_proportion_p
from shiftlens.sources import corpus, tables as T


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        # month, channel, is_bad, score
        ("2025-01", "a", 0, 0.1),
        ("2025-01", "a", 1, 0.2),
        ("2025-01", "b", 0, 0.3),
        ("2025-01", None, 0, 0.3),
        ("2025-02", "a", 1, 0.6),
        ("2025-02", "c", 1, 0.7),
        ("2025-02", None, 0, 0.4),
    ]
    schema = "loan_month string, channel string, is_bad int, risk_score double"
    return spark.createDataFrame(rows, schema).cache()


T_, B_ = "loan_month = '2025-02'", "loan_month = '2025-01'"


def test_compare_fills_missing_segments_and_meets_null_keys(view):
    got = {r["segment"]: r for r in C.segment_compare(view, F.col("channel"), T_, B_).collect()}
    assert set(got) == {"a", "b", "c", None}
    assert got["b"]["n_target"] == 0 and got["b"]["mix_effect"] == pytest.approx(0)
    assert got["c"]["mix_effect"] == 0 and got["c"]["rate_effect"] == pytest.approx(1 / 3)
    assert (got[None]["n_base"], got[None]["n_target"]) == (1, 1)
    total = one(C.compare_summary(view, F.col("channel"), T_, B_))
    assert total["mix_effect"] + total["rate_effect"] == pytest.approx(total["diff"])


def test_compare_empty_sides(view):
    nobody = "loan_month = '1900-01'"
    assert C.segment_compare(view, F.col("channel"), nobody, B_).count() == 0
    rows = C.segment_compare(view, F.col("channel"), T_, nobody).collect()
    assert rows and all(r["share_base"] is None and r["mix_effect"] is None for r in rows)
    same = one(C.compare_summary(view, F.col("channel"), T_, T_))
    assert same["diff"] == 0 and same["mix_pct"] is None


def test_unknown_dimension_lists_valid_ones(view):
    with pytest.raises(ValueError, match="age_band"):
        C.segment_profile(view, "nope")


def test_two_proportions_undefined_cases(spark):
    df = spark.createDataFrame(
        [(0, 0, 1, 2), (0, 5, 0, 5), (5, 5, 5, 5), (30, 100, 10, 100)], "a int, b int, c int, d int"
    )
    cols = [F.col(c) for c in "abcd"]
    ps = [r[0] for r in df.select(two_proportion_p(*cols)).collect()]
    assert ps[:3] == [None, None, None]
    z = 0.2 / math.sqrt(0.2 * 0.8 * 0.02)
    assert ps[3] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def test_tails(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in zip(xs, [r[0] for r in df.select(erfc_positive(F.col("x"))).collect()]):
        assert got == pytest.approx(math.erfc(x), rel=2e-7)
    # published critical values at the 5 percent level
    table = {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 5: 11.070498}
    df = spark.createDataFrame(list(table.items()), "dof int, x double")
    for (p,) in df.select(chi_square_p(F.col("x"), F.col("dof"))).collect():
        assert p == pytest.approx(0.05, abs=1e-6)


def brute_psi(base, target, bins=10):
    edges = sorted(set(np.quantile(base, np.linspace(0, 1, bins + 1))))[1:-1]

    def share(xs):
        hits = np.bincount([sum(e <= x for e in edges) for x in xs], minlength=len(edges) + 1)
        return np.clip(hits / len(xs), 1e-6, None)

    b, t = share(base), share(target)
    return float(((t - b) * np.log(t / b)).sum())


@pytest.mark.parametrize("decimals", [4, None])
def test_psi(spark, decimals):
    rnd = random.Random(1)
    cases = {
        "spread": ([round(rnd.random(), 4) for _ in range(300)], [round(rnd.random() ** 2, 4) for _ in range(200)]),
        "constant": ([0.5] * 20, [0.1, 0.9]),
        "two_values": ([0.2] * 5 + [0.8] * 5, [0.2, 0.5]),
        "empty_bin": ([i / 100 for i in range(100)], [0.05] * 50),
    }
    for base, target in cases.values():
        rows = [("b", x) for x in base] + [("t", x) for x in target]
        df = spark.createDataFrame(rows, "side string, risk_score double")
        got = one(M.psi(df, "side = 't'", "side = 'b'", decimals=decimals))
        assert got["psi"] == pytest.approx(brute_psi(base, target), abs=1e-9)
        itself = one(M.psi(df, "side = 'b'", "side = 'b'", decimals=decimals))
        assert itself == {"psi": 0.0, "shift": "稳定"}


def brute_auc(labels, scores):
    pairs = [(p > q) + (p == q) / 2 for (a, p), (b, q) in itertools.product(zip(labels, scores), repeat=2) if a > b]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("decimals", [4, None])
def test_auc_and_ks(spark, decimals):
    rnd = random.Random(2)
    rows = [(rnd.choice("xy"), int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(200)]
    rows += [("one_label", 1, 0.5), ("one_label", 1, 0.7), ("ties", 0, 0.4), ("ties", 1, 0.4)]
    df = spark.createDataFrame(rows, "g string, is_bad int, risk_score double")
    got = {r["g"]: r for r in M.auc_ks(df, ["g"], decimals=decimals).collect()}
    for g in "xy":
        part = [(b, s) for k, b, s in rows if k == g]
        labels, scores = zip(*part)
        assert got[g]["auc"] == pytest.approx(brute_auc(labels, scores))
        gaps = [
            np.mean([s >= c for b, s in part if b]) - np.mean([s >= c for b, s in part if not b])
            for c in set(scores)
        ]
        assert got[g]["ks"] == pytest.approx(max(0, *gaps))
    assert got["one_label"]["auc"] is None and got["one_label"]["ks"] is None
    assert got["ties"]["auc"] == 0.5 and got["ties"]["ks"] == 0
    flipped = df.withColumn("risk_score", 1 - F.col("risk_score"))
    other = {r["g"]: r for r in M.auc_ks(flipped, ["g"], decimals=decimals).collect()}
    assert got["x"]["auc"] + other["x"]["auc"] == pytest.approx(1)


def test_ranks_with_hot_ties_and_quantiles(spark):
    rnd = random.Random(3)
    rows = [(q, i, rnd.choice([0.0, 0.0, 0.0, rnd.random()])) for q in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "q int, id int, s double")
    got = {(r["q"], r["id"]): r["rank"] for r in O.global_rank(df, ["q"], "s", "id").collect()}
    for q in (1, 2):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[(q, r[1])] for r in order] == list(range(1, 501))
    counts = df.groupBy("q", "s").agg(F.count("*").alias("n"))
    probs = [0, 0.1, 0.5, 0.9, 1]
    for r in O.exact_quantiles(counts, "s", "n", probs, ["q"]).collect():
        want = np.quantile([s for q, _, s in rows if q == r["q"]], probs)
        assert r["quantiles"] == pytest.approx(list(want))


def test_samples_and_rates(spark):
    df = spark.createDataFrame([(str(n), n) for n in (99, 100, 299, 300)], "k string, n int")
    got = {r["subject"]: r["severity"] for r in N.sample_findings(df, "k").collect()}
    assert got == {"99": "insufficient", "100": "indicative", "299": "indicative"}

    def checks(values):
        rows = spark.createDataFrame([(v,) for v in values], "bad_rate double")
        return {r["check_name"] for r in N.result_findings(rows).collect()}

    assert checks([0.123, 100.0]) == {"rate_scaled"}
    assert checks([-0.123, 100.0]) == {"rate_scaled"}
    assert checks([0.123, 100.1]) == {"rate_out_of_range"}
    assert checks([-0.123, 0.5]) == {"rate_out_of_range"}
    assert checks([0.25, 0.5]) == {"rate_too_coarse"}
    assert checks([0.2512, 0.5]) == set()
    zero = spark.createDataFrame([(0, None)], "n int, bad_rate double")
    assert {r["check_name"] for r in N.result_findings(zero).collect()} == {"no_match", "null_values"}


def test_quality_counts_null_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "marriage int")
    rules = {"undefined": K.undefined("marriage", MARRIAGE_CODES)}
    got = {r["check_name"]: r["n_hit"] for r in K.quality_check(df, None, rules).collect()}
    assert got == {"total": 3, "undefined": 2, "null:marriage": 1}


def loans_rows(spark, n=400):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        status = [rnd.randint(-2, 3) for _ in range(6)]
        bills = [float(rnd.randint(-100, 1000)) for _ in range(6)]
        pays = [float(rnd.randint(0, 9000)) for _ in range(6)]
        bad = int(rnd.random() < 0.2 + 0.15 * (status[0] > 0))
        rows.append((i, "2025-01", "a", "x", 500.0, 1, 1, 1, 30, *status, *bills, *pays, bad))
    kinds = ["bigint"] + ["string"] * 3 + ["double"] + ["int"] * 10 + ["double"] * 12 + ["int"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(LOAN_COLUMNS, kinds)))


def test_repay_ratio_edges(spark):
    df = spark.createDataFrame(
        [(0.0, 5.0), (-3.0, 5.0), (1.0, 9.0), (2.0, 1.0), (2.0, -1.0), (None, 1.0)],
        "bill_amt_2 double, pay_amt_1 double",
    )
    got = [r[0] for r in df.select(S.repay_ratio()).collect()]
    assert got == [None, None, 5.0, 0.5, -0.5, None]


def test_split_is_exact(spark):
    rows = S.stratified_split(S.build_features(loans_rows(spark), "user_id", "is_bad"))
    sizes = {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}
    assert sizes == {"test": 80, "valid": 64, "train": 256}


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(50)], "user_id bigint, a double, b double")
    odds = F.lit(-1.0) + 0.3 * F.col("a") - 0.2 * F.col("b")
    df = df.withColumn("risk_score", 1 / (1 + F.exp(-odds)))
    long = A.to_long(A.linear_attributions(df, {"a": 0.3 * F.col("a"), "b": -0.2 * F.col("b")}), ["a", "b"])
    assert one(A.additivity(long, df, "a > 3"))["gap"] < 1e-9
    assert N.additivity_findings(long, df, "a > 3").count() == 0


def brute_search(chunks, queries, k):
    words = {c: t for c, t, _ in chunks}
    n, mean = len(chunks), np.mean([len(t) for t in words.values()])
    df = {}
    for t in words.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, terms, vec in queries:
        def sparse(t):
            return sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in terms)

        def cos(v):
            return np.dot(v, vec) / np.linalg.norm(v) / np.linalg.norm(vec)

        fused = dict.fromkeys(words, 0.0)
        for score in ({c: round(sparse(t), 9) for c, t, _ in chunks}, {c: round(float(cos(v)), 9) for c, _, v in chunks}):
            for r, c in enumerate(sorted(score, key=lambda c: (-score[c], c)), 1):
                fused[c] += 1 / (60 + r)
        out[q] = sorted(fused, key=lambda c: (-fused[c], c))[:k]
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_hybrid_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERIES", block)
    monkeypatch.setattr(V, "PACK", block)
    monkeypatch.setattr(V, "BLOCK", 8 * block)
    monkeypatch.setattr(I, "BUNCH", block)
    rnd = random.Random(5)
    vocab = ["the"] * 20 + [f"w{i}" for i in range(60)]
    chunks = [
        (i, [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))], [rnd.gauss(0, 1) for _ in range(4)])
        for i in range(400)
    ]
    # a third of all chunks are copies of one
    chunks += [(400 + i, chunks[0][1], chunks[0][2]) for i in range(200)]
    queries = [(q, [rnd.choice(vocab) for _ in range(5)], [rnd.gauss(0, 1) for _ in range(4)]) for q in range(5)]
    got = I.hybrid_search(
        spark.createDataFrame(chunks, "chunk_id bigint, terms array<string>, vec array<double>"),
        spark.createDataFrame(queries, "query_id bigint, terms array<string>, vec array<double>"),
        3,
    ).orderBy("query_id", "hit_rank")
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert found == brute_search(chunks, queries, 3)


def test_floor_of_term_weights_is_exact(spark):
    chunks = 10_000
    df = spark.range(120_000).selectExpr("string(id) AS term", "1 + id * id % 37 + IF(id < 8, 9000, 0) AS df")
    held = df.toPandas()
    raw = np.log(chunks - held["df"] + 0.5) - np.log(held["df"] + 0.5)
    found = R.weights(df.repartition(7), F.lit(chunks)).where("term = '0'").first()["idf"]
    assert abs(found - R.BM25_EPSILON * math.fsum(raw) / len(raw)) < 2e-14


def test_sparse_ranks_need_no_vectors(spark):
    chunks = spark.createDataFrame([(1, ["a"]), (2, ["b", "b"]), (3, ["c"]), (4, ["b"]), (5, ["d"])], "chunk_id bigint, terms array<string>")
    asked = spark.createDataFrame([(7, ["b"]), (8, ["z"])], "query_id bigint, terms array<string>")
    got = {(r["query_id"], r["chunk_id"]): r["sparse_rank"] for r in R.sparse_ranks(chunks, asked).collect()}
    assert len(got) == 10 and [got[8, c] for c in range(1, 6)] == [1, 2, 3, 4, 5]
    assert [got[7, c] for c in (2, 4, 1, 3, 5)] == [1, 2, 3, 4, 5]


def test_markdown_sections_and_tokens(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Title\nintro\n\n## One\nbody 1\n### deep\n## Two  \nbody 2\n", "utf-8")
    (tmp_path / "a.md").write_text("## Only\ntext", "utf-8")
    (tmp_path / "skip.txt").write_text("# no", "utf-8")
    rows = R.split_sections(corpus.read_markdown(spark, str(tmp_path))).orderBy("doc", "part").collect()
    assert [(r["doc"], r["section"]) for r in rows] == [("a", "Only"), ("b", "概述"), ("b", "One"), ("b", "Two")]
    assert rows[0]["text"] == "【a / Only】\n## Only\ntext"
    assert rows[1]["text"] == "【Title】\nintro"
    got = spark.createDataFrame([("Ab, c_1! 坏账率 x",)], "t string").select(tokens(F.col("t"))).first()[0]
    assert got == ["ab", "c_1", "坏账", "账率", "x"]


def test_ungrounded_numbers(spark):
    evidence = ["rate | n\n0.2115 | 1,234", "其他 19.50%"]
    report = "2025-10 坏账率 21.15%，上升 1.65pp，样本 1234 人，26-30岁，另有 77.7 与 33%，再提 77.7，共 3 项"
    df = spark.createDataFrame([(report, evidence), (report, ["no numbers"])], "r string, e array<string>")
    got = [r["ungrounded"] for r in E.ungrounded(df, "r", "e").collect()]
    assert got == [["77.7", "33%"], []]


def test_judgements_and_failures(spark):
    texts = ['{"passed": true}', '{"passed": 1, "reason": "x"}', '{"passed": "', "passed：TRUE", "no"]
    more = {'{"passed": "false"}': True, "{'passed': true}": False, '{"passed": 0}': False,
            '{"passed": false} then {"passed": true}': True, '{"passed": ""}': False, '[]': False}
    df = spark.createDataFrame([(t,) for t in more], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", G.judgement(F.col("t"))["passed"].alias("p")).collect()}
    assert got == more
    long = spark.createDataFrame([("x" * 500,)], "t string").select(G.judgement(F.col("t"))["reason"])
    assert len(long.first()[0]) > 500
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(G.judgement(F.col("t")).alias("j"))
    assert [r["j"]["passed"] for r in df.collect()] == [True, True, False, True, False]


def test_latest_and_append(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, seq int, v string")
    got = {r["id"]: r["v"] for r in U.latest(rows, ["id"], "seq").collect()}
    assert got == {"a": "y", "b": "z"}
    path, schema = str(tmp_path / "out"), "id string, v string"
    for batch in ([("a", "1")], [("a", "2"), ("b", "2")]):
        T.append_new(spark.createDataFrame(batch, schema), path, "id", schema)
    assert sorted(map(tuple, T.read_json_lines(spark, path, schema).collect())) == [("a", "1"), ("b", "2")]


def test_planted_period_is_the_only_flag(spark):
    rows = [(c, f"2025-{m:02d}", int(i % 100 < (45 if (c, m) == ("b", 6) else 20)))
            for c in "abc" for m in range(1, 13) for i in range(200)]
    df = spark.createDataFrame(rows, "channel string, loan_month string, is_bad int")
    flagged = C.anomaly_scan(df).where("flag <> 'none'").collect()
    assert [(r["channel"], r["loan_month"], r["flag"]) for r in flagged] == [("b", "2025-06", "up")]


def test_fixed_text(spark):
    df = spark.createDataFrame([(1.5,), (-0.004,), (12.345,), (-3.0,)], "x double")
    assert [r[0] for r in df.select(fixed_text(F.col("x"), 2)).collect()] == ["1.50", "0.00", "12.35", "-3.00"]


def test_scores_count_as_they_come(spark):
    rows = [(0.12341, 0), (0.12342, 1), (0.12343, 0), (0.12344, 0)]
    df = spark.createDataFrame(rows, "risk_score double, is_bad int")
    assert M.auc_ks(df).first()["auc"] == pytest.approx(1 / 3)
    assert M.auc_ks(df, decimals=4).first()["auc"] == 0.5


def test_rate_differences_have_no_cap(spark):
    rates = [f"{i / 1000:.4f}" for i in range(1, 900)]
    df = spark.createDataFrame([("gap 89.70pp and 95.10pp", [" ".join(rates)])], "r string, e array<string>")
    assert E.ungrounded(df, "r", "e").first()["ungrounded"] == ["95.10pp"]


def test_nan_counts_as_missing(spark):
    from shiftlens.operators import findings, quality

    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,)], "risk_score double")
    assert quality.null_counts(df).first()["n_null"] == 2
    assert [r[0] for r in findings.score_findings(df).select("check_name").collect()] == ["score_missing"]


def test_packed_ranks_equal_joined_ones(spark, monkeypatch):
    """Stretches of some pairs, ties, chunks without terms or vectors, and more queries than a block."""
    monkeypatch.setattr(pair_ranks, "TOGETHER", 40)
    monkeypatch.setattr(pair_ranks, "QUERY_BLOCK", 3)
    monkeypatch.setattr(TS, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(8)
    letters, nan = [*"abcdefgh"], float("nan")
    vecs = [[float(x) for x in v] for v in draw.integers(-2, 3, (12, 3))] + [None, None, [nan, 1.0, 2.0], [1.0, 2.0], [0.0, None, 1.0]]
    rows = [(int(i * 7 - 300), [*draw.choice(letters, draw.integers(0, 6))] if i % 9 else None, vecs[draw.integers(len(vecs))]) for i in range(200)]
    asked = [(q, [*draw.choice([*letters, "z"], 3)] if q else ["z"], vecs[draw.integers(12)] if q else None) for q in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, terms array<string>, vec array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id bigint, terms array<string>, vec array<double>")
    packed = [(R.dense_ranks(chunks, queries), "dense_rank"), (R.sparse_ranks(chunks, queries), "sparse_rank")]
    assert all("Join" not in df._jdf.queryExecution().executedPlan().toString() for df, _ in packed)
    with monkeypatch.context() as m:
        m.setattr(R, "_packable", lambda *_: False)
        joined = [(R.dense_ranks(chunks, queries), "dense_rank"), (R.sparse_ranks(chunks, queries), "sparse_rank")]
    show = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for (a, _), (b, _) in zip(packed, joined):
        assert a.columns == b.columns and show(a) == show(b) and a.count() == 1600
    assert show(R.fuse(packed, parts=3)) == show(R.fuse(joined))


def test_ranks_of_repeated_ids(spark):
    """As before: what is not told apart by its id is joined by it."""
    chunks = spark.createDataFrame([(1, ["a"], [1.0]), (1, ["a"], [1.0]), (2, ["b"], None)], "chunk_id bigint, terms array<string>, vec array<double>")
    queries = spark.createDataFrame([(5, ["a"], [1.0])], "query_id bigint, terms array<string>, vec array<double>")
    assert [r["chunk_id"] for r in R.sparse_ranks(chunks, queries).orderBy("sparse_rank").collect()].count(1) == 4
    assert sorted(r["chunk_id"] for r in R.dense_ranks(chunks, queries).collect()) == [1, 1, 2]


def test_small_files_are_read_together(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"page {i}.md").write_text(f"# Page {i}\n## Part\ntext", "utf-8")
    docs = corpus.read_markdown(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    with_small_parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert corpus.read_markdown(spark, str(tmp_path)).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_small_parts)
    assert {r["doc"] for r in docs.collect()} == {f"page {i}" for i in range(400)}

"""Sketches, laid-out tables, followed folders, filters, bands and files as they come."""

import random

import pytest
from pyspark.sql import functions as F

from shiftlens.catalog import LOANS_SCHEMA
from shiftlens.functions.text import REPORT_NUMBER, numbers
from shiftlens.operators import attribution as A, cohort as C, evidence as E, findings as N, monitor as M
from shiftlens.operators import predicates as X, sketches as K
from shiftlens.sources import tables as T
from shiftlens.sources.layout import write_laid_out
from shiftlens.streaming import monitor as S


def test_laid_out_tables_join_without_exchange(spark, tmp_path):
    facts = spark.range(2000).selectExpr("id AS user_id", "concat('2025-0', 1 + id % 4) AS loan_month", "id % 3 AS is_bad")
    scores = spark.range(0, 2000, 2).selectExpr(
        "id AS user_id", "id / 2000 AS risk_score", "'x' AS risk_level", "'test' AS dataset"
    )
    left = write_laid_out(facts, str(tmp_path / "facts"), month="loan_month", buckets=4)
    right = write_laid_out(scores, str(tmp_path / "scores"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = C.base_view(spark.table(left), spark.table(right)).where("loan_month = '2025-01'")
        got = {r["user_id"] for r in view.select("user_id").collect()}
        plan = view._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {left}")
        spark.sql(f"DROP TABLE {right}")
    assert got == {i for i in range(0, 2000, 2) if i % 4 == 0}
    assert "Exchange" not in plan
    assert "PartitionFilters: [isnotnull(loan_month" in plan


def test_sketches_merge(spark):
    draw = random.Random(1)
    rows = [(i % 5000, f"2025-{1 + i % 12:02d}", draw.random()) for i in range(30_000)]
    view = spark.createDataFrame(rows, "user_id bigint, loan_month string, risk_score double")
    held = T.stored(K.sketched(view, ["loan_month"]))
    found = K.score_quantiles(held, [0.5, 0.9]).first()
    scores = sorted(r[2] for r in rows)
    assert found["n"] == 30_000
    for p, q in zip((0.5, 0.9), found["quantiles"]):
        rank = sum(s <= q for s in scores) / len(scores)
        assert abs(rank - p) < K.RANK_BOUND
    early, late = F.col("loan_month") <= "2025-03", F.col("loan_month") > "2025-02"
    got = K.overlap(held, early, late).first()
    a = {u for u, m, _ in rows if m <= "2025-03"}
    b = {u for u, m, _ in rows if m > "2025-02"}
    # fewer users than a sketch has entries are counted exactly
    assert [got[c] for c in ("n_left", "n_right", "n_both", "n_either", "n_left_only")] == [
        len(a), len(b), len(a & b), len(a | b), len(a - b)
    ]
    same = K.psi(held, early, early).first()
    assert same["psi"] == pytest.approx(0, abs=1e-9) and same["shift"] == "稳定"
    nobody = K.psi(held, F.lit(False), early).first()
    assert nobody["psi"] is None and nobody["shift"] is None


def test_followed_folder_goes_on_after_a_stop(spark, tmp_path):
    schema = "ts timestamp, kind string, value double"
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def arrive(*rows):
        frame = spark.createDataFrame([(t, k, v) for t, k, v in rows], "ts string, kind string, value double")
        frame.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(source)

    def run():
        stream = S.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        query = S.follow(S.windowed(stream, ["kind"], aggregates={"total": F.sum("value")}), out, marks)
        query.awaitTermination()
        return S.late_rows(query)

    arrive(("2025-01-01 01:00:00", "a", 1.0), ("2025-01-01 02:00:00", "a", 2.0), ("2025-01-01 03:00:00", "b", 5.0))
    assert run() == 0
    # within the delay: the first day changes once more
    arrive(("2025-01-02 01:00:00", "a", 4.0), ("2025-01-01 23:00:00", "a", 3.0))
    arrive(("2025-01-05 01:00:00", "b", 1.0))
    assert run() == 0
    # the first day is closed by now
    arrive(("2025-01-01 04:00:00", "a", 100.0), ("2025-01-05 02:00:00", "b", 2.0))
    assert run() == 1
    assert run() == 0  # nothing new
    got = {(str(r["start"])[:10], r["kind"]): (r["n"], r["total"]) for r in S.current(spark, out, ["kind"]).collect()}
    assert got == {
        ("2025-01-01", "a"): (3, 6.0), ("2025-01-01", "b"): (1, 5.0),
        ("2025-01-02", "a"): (1, 4.0), ("2025-01-05", "b"): (2, 3.0),
    }


def test_filters_are_checked(spark):
    view = spark.createDataFrame([("信息流", "2025-01", 1), ("门店", "2025-02", 0)], "channel string, loan_month string, n int")
    known = X.domain(view, ["channel"])
    formats = {"loan_month": r"^2025-\d\d$"}
    filters = [
        (1, "channel = '信息流' AND n > 0"), (2, "CHANNEL in ('门店', '门点') or '流' <> channel"), (3, "loan_month >= '2025/01'"),
        (4, "n in (select 1)"), (5, "n = 1 -- x"), (6, "channel = 'select; it''s'"), (7, None), (8, ""), (9, "sub_channel = 'x'"),
        (10, "drop table x"),
    ]
    rows = spark.createDataFrame(filters, "id int, filter string")
    got = sorted(tuple(r) for r in X.filter_findings(rows, known, ["channel"], formats).select("id", "check_name", "subject").collect())
    assert got == [
        (2, "unknown_value", "channel=流"), (2, "unknown_value", "channel=门点"), (3, "odd_format", "loan_month=2025/01"),
        (4, "subquery_or_command", "n in (select 1)"), (5, "comment_or_statement", "n = 1 -- x"),
        (6, "unknown_value", "channel=select; it's"), (10, "subquery_or_command", "drop table x"),
    ]
    assert X.checked(view, "channel = '门店'", known, ["channel"], formats).count() == 1
    with pytest.raises(ValueError, match="channel=门点"):
        X.checked(view, "channel = '门点'", known, ["channel"])


def test_bands_find_what_every_pair_would(spark):
    draw = random.Random(3)
    written = lambda: draw.choice(["{:.0f}", "{:.1f}", "{:.3f}", "{:.10f}"]).format(draw.choice([1, -1]) * draw.random() * draw.choice([1, 50, 1e6]))
    items = [(draw.choice(["k", "l", None]), i, written() + draw.choice(["", "%", " pp"])) for i in range(400)]
    items += [("k", 900, "0.5"), ("k", 901, "99999999999999999999"), ("hot", 902, "0")]
    pool = [(k, float(t.split("%")[0].split(" ")[0]) / draw.choice([1, 1, 100]) + draw.choice([0, 0.04, 0.5])) for k, _, t in items[::2]]
    pool += [("k", None), ("k", 0.45), ("k", 1e20)]
    parsed = spark.createDataFrame(items, "key string, i int, t string").select(
        "key", "i", F.explode(numbers(F.col("t"), REPORT_NUMBER)).alias("x")
    ).select("key", "i", "x.*")
    got = {r["i"] for r in E.banded(parsed, spark.createDataFrame(pool, "key string, value double"), ["key"]).collect()}
    want = set()
    for r in parsed.collect():
        tol = 0.5 * 10.0 ** -(len(r["raw"].split(".")[1]) if "." in r["raw"] else 0) + 1e-9
        near = any(
            abs(abs(v) - abs(r["value"])) <= tol or r["unit"] and abs(abs(v) * 100 - abs(r["value"])) <= tol
            for k, v in pool if k == r["key"] and v is not None
        )
        if not near:
            want.add(r["i"])
    assert got == want and 0 < len(want) < len(items)


def test_raw_sheet_and_nested_records(spark, tmp_path):
    sheet = tmp_path / "sheet"
    sheet.mkdir()
    for n in range(2):
        (sheet / f"{n}.csv").write_text(f"X0,X1,Y,X2\nID,LIMIT_BAL,default payment next month,NOTE\n{n},2000.5,1,a\n{n + 5},,0,\n\nsum,9,9,b\n")
    rows = T.read_sheet(spark, str(sheet), LOANS_SCHEMA)
    good = sorted(tuple(r) for r in rows.where("unreadable IS NULL").select("user_id", "credit_limit", "is_bad", "channel").collect())
    assert good == [(0, 2000.5, 1, None), (1, 2000.5, 1, None), (5, None, 0, None), (6, None, 0, None)]
    assert T.unreadable_findings(rows, "sheet").first()["value"] == 2

    lines = tmp_path / "runs.jsonl"
    lines.write_text('{"id":"Q1","grade":{"passed":true,"checks":[{"type":"n"}]},"steps":[]}\n\n{"id":"Q2"\n{"id":"Q3","steps":[{"kind":"x","is_error":true}]}\n')
    runs = T.read_checked_json(spark, str(lines), T.RUN_SCHEMA)
    assert [r["id"] for r in runs.where("unreadable IS NULL").orderBy("id").collect()] == ["Q1", "Q3"]
    assert runs.where("unreadable IS NOT NULL").first()["unreadable"] == '{"id":"Q2"'
    assert T.unreadable_findings(runs.where("unreadable IS NULL"), "runs").count() == 0


def test_append_keeps_one_of_repeated_keys(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "id string, n int"
    T.append_new(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema), path, "id", schema)
    T.append_new(spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], schema), path, "id", schema)
    assert sorted(map(tuple, T.read_json_lines(spark, path, schema).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_no_base_and_tiny_cohorts(spark):
    rows = [("2025-01", "a", i % 2, 0.1 + 0.001 * (i % 700), i) for i in range(900)] + [("2025-02", "b", 1, 1.5, 900)]
    view = spark.createDataFrame(rows, "loan_month string, channel string, is_bad int, risk_score double, user_id bigint")
    alone = C.segment_compare(view, "channel", "loan_month = '2025-01'", None)
    assert "mix_effect" not in alone.columns and alone.first()["n"] == 900
    summary = C.compare_summary(view, "channel", "loan_month = '2025-01'").first()
    assert (summary["n_base"], summary["rate_base"], summary["diff"]) == (0, None, None)
    assert M.psi(view, "channel = 'a'", None).first()["psi"] is None
    shift = C.share_shift(view, "is_bad = 1", "channel = 'a'").first()
    assert (shift["share_base"], shift["share_target"], shift["shift"]) == (None, 0.5, None)
    shap = view.selectExpr("user_id", "'f' AS feature", "risk_score AS shap_value")
    assert A.compare(shap, view, "channel = 'a'").columns == ["feature", "mean_abs_shap", "mean_shap", "n_users"]
    both = A.compare(shap, view, "channel = 'a'", "channel = 'b'").first()
    assert (both["n_target"], both["n_base"]) == (900, 1) and both["total_diff"] == pytest.approx(both["diff"])
    # one row against nobody
    got = sorted(tuple(r) for r in N.summary_findings(view, "channel = 'b'", "user_id < 0").collect())
    assert [g[0] for g in got] == ["empty_base", "sample_size", "score_out_of_range"]
    tiny = N.quality_findings(view.withColumns({"education": F.lit(9), "marriage": F.lit(1)}), "channel = 'b'")
    assert sorted(r["check_name"] for r in tiny.collect()) == ["sample_size", "undefined_code"]
    sizes = N.attribution_findings(shap, view.where("user_id < 900"), "user_id < 3", "user_id < 0", 10.0)
    assert sorted(r["check_name"] for r in sizes.collect()) == ["empty_base", "sample_size"]

"""A cross-section of the registered queries against their oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "cohort_rates_named",
    "profile_all_dimensions",
    "segment_compare_limit_band",
    "compare_summary_city_tier",
    "anomaly_scan",
    "chi_square_sex",
    "psi_segment",
    "score_bins_unrounded",
    "performance",
    "auc_ks_unrounded",
    "attribution_compare",
    "attribution_additivity",
    "assigned_fields",
    "stratified_split",
    "quality_check",
    "compare_findings",
    "sections_documents",
    "bm25_scores",
    "dense_ranks",
    "hybrid_search",
    "ungrounded_numbers",
    "graded_answers",
    "system_summary",
    "resumed_results",
    "canonical_loans",
    "segment_compare_alone",
    "dense_first",
    "filter_findings",
    "grounded_documents",
    "nested_runs",
]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r)
        for r in frame.itertuples(index=False)
    )


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, oracle, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize(
    "name", ["summary_findings_late", "quality_findings_all", "attribution_findings_late"]
)
def test_findings_of_whole_cohorts(spark, oracle, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert plain(got) == plain(oracle.execute(entry.oracle_sql()[name]).df())
    assert len(got) > 0 and not (got.check_name == "empty_base").any()


def test_findings_of_attributions_have_both_sides(spark, oracle):
    got = entry.queries()["attribution_findings"](spark, FOLDER).toPandas()
    assert plain(got) == plain(oracle.execute(entry.oracle_sql()["attribution_findings"]).df())
    assert {"target", "base"} <= set(got[got.check_name == "additivity"].subject)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_a_package(monkeypatch):
    """The queries of the library stay where what the training-data operators need cannot be imported."""
    import sys

    for name in [m for m in sys.modules if m.startswith("shiftlens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow.compute", None)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    names = set(entry.queries())
    assert "segment_compare_channel" in names and "pipeline" not in names

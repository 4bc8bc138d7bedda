"""Column lists, value domains, segment dimensions and thresholds.

The literal values here are fixed: results have to carry the same labels, cut points and limits
as the data they are compared with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

# Column order of the fact table.
STATUS_COLUMNS = [f"pay_status_{i}" for i in range(1, 7)]
BILL_COLUMNS = [f"bill_amt_{i}" for i in range(1, 7)]
PAYMENT_COLUMNS = [f"pay_amt_{i}" for i in range(1, 7)]
PROFILE_COLUMNS = ["credit_limit", "sex", "education", "marriage", "age"]
RAW_FEATURES = PROFILE_COLUMNS + STATUS_COLUMNS + BILL_COLUMNS + PAYMENT_COLUMNS
DERIVED_FEATURES = ["utilization_1", "max_pay_status", "n_overdue_months", "repay_ratio_1"]
FEATURES = RAW_FEATURES + DERIVED_FEATURES
LOAN_COLUMNS = ["user_id", "loan_month", "channel", "city_tier"] + RAW_FEATURES + ["is_bad"]
SCORE_COLUMNS = ["risk_score", "risk_level", "dataset"]

# Headings of the published raw sheet and the names used here. Status 0 is the latest
# month and the sheet has no status 1.
RAW_HEADINGS = {
    "ID": "user_id",
    "LIMIT_BAL": "credit_limit",
    "SEX": "sex",
    "EDUCATION": "education",
    "MARRIAGE": "marriage",
    "AGE": "age",
    "PAY_0": "pay_status_1",
    "PAY_2": "pay_status_2",
    "PAY_3": "pay_status_3",
    "PAY_4": "pay_status_4",
    "PAY_5": "pay_status_5",
    "PAY_6": "pay_status_6",
    "default payment next month": "is_bad",
    **{f"BILL_AMT{i}": f"bill_amt_{i}" for i in range(1, 7)},
    **{f"PAY_AMT{i}": f"pay_amt_{i}" for i in range(1, 7)},
}

LOANS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("loan_month", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("city_tier", T.StringType()),
        T.StructField("credit_limit", T.DoubleType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("education", T.IntegerType()),
        T.StructField("marriage", T.IntegerType()),
        T.StructField("age", T.IntegerType()),
        *[T.StructField(c, T.IntegerType()) for c in STATUS_COLUMNS],
        *[T.StructField(c, T.DoubleType()) for c in BILL_COLUMNS + PAYMENT_COLUMNS],
        T.StructField("is_bad", T.IntegerType()),
    ]
)

# Allowed values per coded or named column.
CHANNELS = ["APP自然流量", "信息流广告", "合作方导流", "线下门店"]
CITY_TIERS = ["一线", "二线", "三线及以下"]
RISK_LEVELS = ["高", "中", "低"]
DATASETS = ["train", "valid", "test"]
MONTHS = [f"2025-{m:02d}" for m in range(1, 13)]
MONTH_PATTERN = "^2025-(0[1-9]|1[0-2])$"
EDUCATION_CODES = [1, 2, 3, 4]
MARRIAGE_CODES = [1, 2, 3]
AGE_RANGE = (18, 100)
STATUS_RANGE = (-2, 9)

# Limits.
MIN_SAMPLE = 100
INDICATIVE_SAMPLE = 300
PSI_SLIGHT = 0.1
PSI_LARGE = 0.25
PSI_FLOOR = 1e-6
LEVEL_HIGH = 0.5
LEVEL_MID = 0.25
IDENTITY_TOLERANCE = 1e-6
ADDITIVITY_TOLERANCE = 0.05
REPAY_RATIO_CAP = 5.0

# How result columns are recognised by name.
RATE_NAME = r"(?i)(rate|ratio|share|pct|率|占比|比例)"
COUNT_NAME = r"(?i)(^(n|cnt|count|num|users?|n_users|样本量?|人数|用户数)$|^n_|_cnt$|_count$|_n$)"

UNDEFINED_LABEL = "未知(未定义编码)"


@dataclass(frozen=True)
class Dimension:
    """A named way to cut the base view: a label and its place in the order of labels."""

    label: Callable[[], Column]
    rank: Callable[[], Column]


def _banded(column: str, bands: list[tuple[float | None, str]]) -> Dimension:
    """Bands closed above; the last one (no bound) also takes nulls."""

    def pick(values: list) -> Column:
        col, out = F.col(column), None
        for (upper, _), value in zip(bands[:-1], values):
            out = (F if out is None else out).when(col <= F.lit(upper), F.lit(value))
        return out.otherwise(F.lit(values[-1]))

    return Dimension(
        lambda: pick([name for _, name in bands]), lambda: pick(list(range(1, len(bands) + 1)))
    )


def _coded(column: str, names: dict[int, str], other: str) -> Dimension:
    def pick(values: list, last) -> Column:
        col, out = F.col(column), None
        for code, value in zip(names, values):
            out = (F if out is None else out).when(col == F.lit(code), F.lit(value))
        return out.otherwise(F.lit(last))

    ranks = list(range(1, len(names) + 1))
    return Dimension(
        lambda: pick(list(names.values()), other), lambda: pick(ranks, len(names) + 1)
    )


def _split(condition: Callable[[], Column], hit: str, miss: str) -> Dimension:
    return Dimension(
        lambda: F.when(condition(), hit).otherwise(miss),
        lambda: F.when(condition(), 1).otherwise(2),
    )


def _plain(column: str) -> Dimension:
    return Dimension(lambda: F.col(column), lambda: F.lit(0))


def worst_status() -> Column:
    return F.greatest(*[F.col(c) for c in STATUS_COLUMNS])


def _overdue_history() -> Dimension:
    def pick(two: object, one: object, none: object) -> Column:
        worst = worst_status()
        return F.when(worst >= 2, F.lit(two)).when(worst == 1, F.lit(one)).otherwise(F.lit(none))

    return Dimension(lambda: pick("历史M2+", "历史M1", "无逾期"), lambda: pick(1, 2, 3))


# Segment dimensions with their labels and cut points.
DIMENSIONS: dict[str, Dimension] = {
    "age_band": _banded(
        "age",
        [(25, "25岁及以下"), (30, "26-30岁"), (40, "31-40岁"), (50, "41-50岁"), (None, "50岁以上")],
    ),
    "limit_band": _banded(
        "credit_limit",
        [
            (30000, "3万及以下"),
            (50000, "3-5万"),
            (100000, "5-10万"),
            (200000, "10-20万"),
            (None, "20万以上"),
        ],
    ),
    "young_low": _split(
        lambda: (F.col("age") <= 30) & (F.col("credit_limit") <= 50000), "年轻低额度客群", "其他客群"
    ),
    "recent_overdue": _split(lambda: F.col("pay_status_1") >= 1, "近期逾期客群", "近期未逾期"),
    "max_overdue": _overdue_history(),
    "education": _coded(
        "education", {1: "研究生", 2: "本科", 3: "高中", 4: "其他"}, UNDEFINED_LABEL
    ),
    "marriage": _coded("marriage", {1: "已婚", 2: "单身", 3: "其他"}, UNDEFINED_LABEL),
    "sex": _coded("sex", {1: "男"}, "女"),
    "channel": _plain("channel"),
    "city_tier": _plain("city_tier"),
    "loan_month": _plain("loan_month"),
    "risk_level": _plain("risk_level"),
}


def dimension(name: str) -> Dimension:
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}; valid ones are {', '.join(DIMENSIONS)}")
    return DIMENSIONS[name]

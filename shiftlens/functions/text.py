"""Text expressions: tokens, sections, numbers inside prose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Runs of Han characters, or runs of other letters, digits and underscores.
RUNS = r"(\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+)"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens; a run of Han characters gives its overlapping pairs."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(1))

    def expand(run: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
            lambda i: F.substring(run, i, F.lit(2)),
        )
        return F.when(run.rlike(r"^\p{IsHan}"), pairs).otherwise(F.array(run))

    # most texts hold no Han character, and their runs are the tokens
    return F.when(text.rlike(r"\p{IsHan}"), F.flatten(F.transform(runs, expand))).otherwise(runs)


# all that counts as white space, also outside ASCII
_BLANK = "".join(
    map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(text: Column) -> Column:
    """Without white space at both ends; looks at the ends only, where a pattern tries every place of the text."""
    return F.btrim(text, F.lit(_BLANK))


# How a number is written in evidence and in reports, and what is not a finding.
EVIDENCE_NUMBER = r"(?<![A-Za-z0-9_.])([-+]?\d+(?:,\d{3})*(?:\.\d+)?)\s*(%)?"
REPORT_NUMBER = (
    r"(?<![A-Za-z0-9_.\-])([-+]?\d+(?:,\d{3})*(?:\.\d+)?)\s*(%|％|pp|个百分点|百分点)?"
)
ANSWER_NUMBER = r"(?<![A-Za-z0-9_.])([-+]?\d+(?:,\d{3})*(?:\.\d+)?)\s*(%|％)?"
REPORT_NOISE = [
    r"\d{4}-\d{2}(?:-\d{2})?|\d+\s*[-~～至]\s*\d+\s*(?:岁|万|月)",
    r"(?:pay_status|bill_amt|pay_amt|utilization|repay_ratio)_\d",
    r"[QqMm]\d\+?",
]
TRIVIAL_NUMBERS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 100, 300, 2025]
POINT_UNITS = ["pp", "个百分点", "百分点"]


def numbers(text: Column, pattern: str) -> Column:
    """All numbers as array<struct<raw, unit, value>>; unit is '' when there is none."""
    raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(
        raws,
        units,
        lambda raw, unit: F.struct(
            raw.alias("raw"),
            F.coalesce(unit, F.lit("")).alias("unit"),
            F.regexp_replace(raw, ",", "").cast("double").alias("value"),
        ),
    )


def decimals(raw: Column) -> Column:
    """Digits after the point in a written number."""
    at = F.instr(raw, ".")
    return F.when(at > 0, F.length(raw) - at).otherwise(0)

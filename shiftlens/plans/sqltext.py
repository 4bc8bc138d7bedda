"""Oracle fragments shared by several queries."""

from __future__ import annotations

from shiftlens.functions.numeric import ERFC_FIT

# Band edges and labels, once more in SQL.
DIMENSION_SQL = {
    "age_band": (
        "CASE WHEN age<=25 THEN '25岁及以下' WHEN age<=30 THEN '26-30岁' WHEN age<=40 THEN '31-40岁'"
        " WHEN age<=50 THEN '41-50岁' ELSE '50岁以上' END"
    ),
    "limit_band": (
        "CASE WHEN credit_limit<=30000 THEN '3万及以下' WHEN credit_limit<=50000 THEN '3-5万'"
        " WHEN credit_limit<=100000 THEN '5-10万' WHEN credit_limit<=200000 THEN '10-20万'"
        " ELSE '20万以上' END"
    ),
    "young_low": (
        "CASE WHEN age<=30 AND credit_limit<=50000 THEN '年轻低额度客群' ELSE '其他客群' END"
    ),
    "recent_overdue": "CASE WHEN pay_status_1>=1 THEN '近期逾期客群' ELSE '近期未逾期' END",
    "max_overdue": (
        "CASE WHEN max_pay_status>=2 THEN '历史M2+' WHEN max_pay_status=1 THEN '历史M1'"
        " ELSE '无逾期' END"
    ),
    "education": (
        "CASE education WHEN 1 THEN '研究生' WHEN 2 THEN '本科' WHEN 3 THEN '高中' WHEN 4 THEN '其他'"
        " ELSE '未知(未定义编码)' END"
    ),
    "marriage": (
        "CASE marriage WHEN 1 THEN '已婚' WHEN 2 THEN '单身' WHEN 3 THEN '其他'"
        " ELSE '未知(未定义编码)' END"
    ),
    "sex": "CASE sex WHEN 1 THEN '男' ELSE '女' END",
    "channel": "channel",
    "city_tier": "city_tier",
    "loan_month": "loan_month",
    "risk_level": "risk_level",
}


def erfc_sql(x: str) -> str:
    t = f"(1.0/(1.0+0.5*({x})))"
    poly = repr(ERFC_FIT[-1])
    for coef in reversed(ERFC_FIT[:-1]):
        poly = f"({coef!r}+{t}*{poly})"
    return f"({t}*exp(-({x})*({x})+{poly}))"


def z_sql(b1: str, n1: str, b2: str, n2: str) -> str:
    p = f"(({b1}+{b2})/CAST({n1}+{n2} AS DOUBLE))"
    var = f"({p}*(1-{p})*(1.0/{n1}+1.0/{n2}))"
    return (
        f"CASE WHEN {n1}>0 AND {n2}>0 THEN CASE WHEN {var}>0 THEN"
        f" ({b1}/CAST({n1} AS DOUBLE)-{b2}/CAST({n2} AS DOUBLE))/sqrt({var}) END END"
    )


def p_sql(z: str) -> str:
    return erfc_sql(f"abs({z})/sqrt(2.0)")


def auc_sql(source: str, score: str = "risk_score", by: str = "") -> str:
    """AUC and KS from counts per score; ``by`` is an optional grouping column."""
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    tail = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {lead}sum(pos+neg) AS n,
  CASE WHEN max(tp)>0 AND max(tn)>0 THEN sum(neg*(above+pos/2.0))/(max(tp)*CAST(max(tn) AS DOUBLE)) END AS auc,
  CASE WHEN max(tp)>0 AND max(tn)>0 THEN greatest(0.0, max((above+pos)/CAST(tp AS DOUBLE)-(nabove+neg)/CAST(tn AS DOUBLE))) END AS ks
FROM (SELECT *, coalesce(sum(pos) OVER w, 0) AS above, coalesce(sum(neg) OVER w, 0) AS nabove,
    sum(pos) OVER (PARTITION BY {by or "1"}) AS tp, sum(neg) OVER (PARTITION BY {by or "1"}) AS tn
  FROM (SELECT {lead}{score} AS s, sum(is_bad) AS pos, sum(1-is_bad) AS neg FROM {source} GROUP BY {lead}s)
  WINDOW w AS ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
{tail}"""


def draw_sql(key: str, salt: int) -> str:
    first, second = 48271 + 7919 * salt, 69621 + 104729 * salt
    h = f"((({key} % 2147483647)*{first}+{salt}) % 2147483647)"
    h = f"xor({h}, {h} >> 15)"
    h = f"(({h}*{second}) % 2147483647)"
    h = f"xor({h}, {h} >> 13)"
    return f"(CAST({h} AS DOUBLE)/2147483648.0)"


def fixed_sql(x: str, decimals: int) -> str:
    scaled = f"CAST(round(abs({x})*{10.0**decimals!r}, 0) AS BIGINT)"
    unit = 10**decimals
    sign = f"CASE WHEN ({x})<0 AND {scaled}>0 THEN '-' ELSE '' END"
    if decimals == 0:
        return f"({sign} || CAST({scaled} AS VARCHAR))"
    rest = f"lpad(CAST({scaled} % {unit} AS VARCHAR), {decimals}, '0')"
    return f"({sign} || CAST({scaled} // {unit} AS VARCHAR) || '.' || {rest})"

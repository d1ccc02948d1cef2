"""Column expressions: cleaning, calendar, tiers, rule lists, text.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation; nothing here runs Python per row.
Rule tables that must equal the reference are kept together below, as fixed
values, in their natural order.
"""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (rules of the reference, kept verbatim in order).

TRUE_TOKENS = ("true", "1", "yes", "y", "t")
NULL_TOKENS = ("nan", "None", "NaN")

# Meal-period schemes: (label, start hour inclusive, end hour exclusive); the
# rest is "late_night".
MEAL_SCHEMES = {
    "segmentation": [("morning", 6, 11), ("lunch", 11, 16), ("dinner", 16, 23)],
    "serving": [("breakfast", 5, 11), ("lunch", 11, 16), ("dinner", 16, 22)],
    "training": [("breakfast", 6, 11), ("lunch", 11, 15), ("afternoon", 15, 18),
                 ("dinner", 18, 23)],
}

# RFM segment rules, first match wins.
RFM_SEGMENTS = [
    "No Transaction History", "Champions", "Loyal Customers", "New / Promising",
    "Potential Loyalists", "Need Attention", "At Risk", "Cannot Lose Them",
    "Lost / Hibernating", "Others",
]

VALUE_TIERS = [(12, "High-Value"), (8, "Mid-Value")]   # then >0 Low-Value, else No-History
VOLUME_TIERS = [(35, "High"), (7, "Medium")]          # weekly mean; else Low

# Order state machine: allowed next states.
ALLOWED_TRANSITIONS = {
    "draft": ["in_progress", "cancelled"],
    "in_progress": ["served", "cancelled"],
    "served": ["paid", "cancelled"],
    "paid": [],
    "cancelled": [],
}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall_clock(v) -> Column:
    """A datetime constant as TIMESTAMP_NTZ, so comparisons with the
    (zone-less) order timestamps do not depend on the session time zone."""
    if isinstance(v, dt.datetime):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v)


# ---------------------------------------------------------------------------
# Cleaning and coercion (SRC7, SRC8, SF1, SF2, PRJ1, PRJ2)

def to_bool(c) -> Column:
    """Text to boolean: true/1/yes/y/t (any case, trimmed) → true (SRC8)."""
    return F.lower(F.trim(col_(c).cast("string"))).isin(*TRUE_TOKENS)


def clean_token(c) -> Column:
    """NULL and 'nan'/'None' tokens → '' after trimming (SF2)."""
    t = F.trim(F.coalesce(col_(c).cast("string"), F.lit("")))
    return F.when(t.isin(*NULL_TOKENS), F.lit("")).otherwise(t)


def present(c) -> Column:
    return (clean_token(c) != "").cast("int")


def clip(c, lo=None, hi=None) -> Column:
    """Clip to [lo, hi] (PRJ1)."""
    x = col_(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def finite(c, default=None) -> Column:
    """±inf and NaN → NULL (or ``default``) (PRJ2)."""
    x = col_(c).cast("double")
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    out = F.when(bad, F.lit(None).cast("double")).otherwise(x)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def safe_div(a, b) -> Column:
    """a / b with a zero or NULL denominator → NULL (SF17)."""
    return F.try_divide(col_(a), F.nullif(col_(b), F.lit(0)))


def contains_ci(c, text: str) -> Column:
    """Case-insensitive substring test (FIL5, SF1)."""
    return F.lower(col_(c)).contains(text.lower())


def starts_ci(c, prefix: str) -> Column:
    return F.lower(F.trim(col_(c))).startswith(prefix.lower())


def norm_key(c) -> Column:
    """Case- and space-insensitive key (JN14)."""
    return F.lower(F.trim(col_(c)))


def mask_tail(c, keep: int = 4, mask: str = "*") -> Column:
    """Mask all but the last ``keep`` characters of an identifier (PRJ7)."""
    s = F.regexp_replace(col_(c).cast("string"), r"\s+", "")
    n = F.length(s)
    return F.when(n <= keep, s).otherwise(
        F.concat(F.repeat(F.lit(mask), n - keep), F.substring(s, -keep, keep)))


def slug(name: str) -> str:
    """Column-name slug, at plan time (SF3)."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def set_text(c, sep: str = ", ") -> Column:
    """Sorted, joined text of an array (SF4)."""
    return F.array_join(F.sort_array(col_(c)), sep)


def split_list(c, sep: str = ",") -> Column:
    """Comma list → trimmed array, empties dropped (SF29)."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), sep)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


# ---------------------------------------------------------------------------
# Calendar (SF7–SF11)

def weekday0(d) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(col_(d))


def calendar_cols(ts: str = "order_ts") -> dict[str, Column]:
    d = F.col(ts)
    return {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d),
        "day": F.dayofmonth(d), "hour": F.hour(d), "weekday": weekday0(d),
        "weekday_name": F.date_format(d, "EEEE"), "iso_week": F.weekofyear(d),
        "is_weekend": (weekday0(d) >= 5).cast("int"),
    }


def cyclic(c, period: float) -> tuple[Column, Column]:
    """sin/cos encoding of ``c / period`` (SF8)."""
    ang = F.lit(2 * math.pi) * col_(c).cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def parse_order_ts(date_c, time_c) -> Column:
    """Date + '08:30 PM' text → timestamp; bad text → NULL (SF9)."""
    return F.try_to_timestamp(F.concat_ws(" ", col_(date_c).cast("string"), F.upper(F.trim(col_(time_c)))),
                              F.lit("yyyy-MM-dd hh:mm a"))


def weeks_since(d, start) -> Column:
    """Whole weeks since ``start`` (SF10)."""
    return F.floor(F.datediff(col_(d), F.lit(start) if not isinstance(start, Column) else start) / 7)


def week_start_tue(d) -> Column:
    """Start (Tuesday) of the Tuesday–Monday week holding ``d`` (SF11)."""
    return F.date_add(F.date_trunc("week", F.date_sub(col_(d).cast("date"), 1)).cast("date"), 1)


def meal_period(hour, scheme: str = "segmentation") -> Column:
    """Meal period of an hour under one of three schemes (SF12)."""
    h = col_(hour)
    out = None
    for label, lo, hi in MEAL_SCHEMES[scheme]:
        cond = (h >= lo) & (h < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    out = out.otherwise("late_night")
    if scheme == "segmentation":
        out = F.when(h.isNull(), "unknown").otherwise(out)
    return out


def time_flags(hour, weekday) -> dict[str, Column]:
    """Weekend, odd hour (<6 or ≥23), morning 6–10, lunch 11–15, dinner 18–22 (SF13)."""
    h = col_(hour)
    return {
        "is_weekend": col_(weekday).isin(5, 6).cast("int"),
        "is_odd_hour": ((h < 6) | (h >= 23)).cast("int"),
        "is_morning": h.between(6, 10).cast("int"),
        "is_lunch": h.between(11, 15).cast("int"),
        "is_dinner": h.between(18, 22).cast("int"),
    }


# ---------------------------------------------------------------------------
# Money and orders (SF15–SF18)

def discount_rate(pct) -> Column:
    """Values above 1 are per cent (SF15)."""
    d = F.coalesce(col_(pct).cast("double"), F.lit(0.0))
    return F.when(d > 1, d / 100).otherwise(d)


def cents(x: Column) -> Column:
    """Rounded half up to two decimals, as a decimal."""
    return F.round(x.cast("decimal(20,6)"), 2).cast("decimal(20,2)")


def order_totals(lines, amount: Column, pct: Column, key: str = "order_id"):
    """Subtotal of the lines, discount of ``pct`` per cent and what is left, each rounded to cents (SF16)."""
    o = lines.groupBy(key).agg(F.sum(cents(amount)).cast("decimal(20,2)").alias("_s"), pct.alias("_p"))
    o = o.withColumn("_d", cents(F.col("_s").cast("double") * F.col("_p") / 100))
    return o.select(key, F.col("_s").cast("double").alias("subtotal"), F.col("_d").cast("double").alias("discount_amount"),
                    (F.col("_s") - F.col("_d")).cast("double").alias("total_amount"))


def line_amount(price, qty, discount_pct) -> Column:
    """round(price·qty·(1 − d/100), 2) (SF16), rounded half-up on a decimal so
    the result does not depend on the binary representation of the double."""
    x = col_(price) * col_(qty) * (1 - col_(discount_pct) / 100)
    return F.round(x.cast("decimal(20,6)"), 2).cast("double")


def engagement(expected, actual) -> dict[str, Column]:
    """Visit gap, ratio and under-engaged flag (SF18)."""
    gap = col_(expected) - col_(actual)
    return {"visit_gap": gap, "visit_ratio": safe_div(actual, expected),
            "under_engaged_flag": (gap > 0).cast("int")}


# ---------------------------------------------------------------------------
# Segment rules (SF19–SF21)

def rfm_segment(r, f, m, score=None) -> Column:
    """Ordered RFM rule list, first match wins (SF19)."""
    r, f, m = col_(r), col_(f), col_(m)
    out = F.when((r >= 4) & (f >= 4) & (m >= 4), RFM_SEGMENTS[1])
    if score is not None:
        out = F.when(col_(score) == 0, RFM_SEGMENTS[0]).when((r >= 4) & (f >= 4) & (m >= 4), RFM_SEGMENTS[1])
    return (out.when((r >= 3) & (f >= 4), RFM_SEGMENTS[2])
            .when((r >= 4) & (f <= 2), RFM_SEGMENTS[3])
            .when((r >= 3) & (f >= 2) & (m >= 3), RFM_SEGMENTS[4])
            .when((r == 3) & (f <= 2), RFM_SEGMENTS[5])
            .when((r == 2) & (f >= 3), RFM_SEGMENTS[6])
            .when((r <= 2) & (f >= 4) & (m >= 4), RFM_SEGMENTS[7])
            .when((r <= 2) & (f <= 2) & (m <= 2), RFM_SEGMENTS[8])
            .otherwise(RFM_SEGMENTS[9]))


def value_tier(score) -> Column:
    """≥12 High, ≥8 Mid, >0 Low, else No-History (SF20)."""
    s = col_(score)
    return (F.when(s >= VALUE_TIERS[0][0], VALUE_TIERS[0][1])
            .when(s >= VALUE_TIERS[1][0], VALUE_TIERS[1][1])
            .when(s > 0, "Low-Value").otherwise("No-History"))


def volume_tier(weekly_mean) -> Column:
    """≥35 High, ≥7 Medium, else Low units per week (SF21)."""
    s = col_(weekly_mean)
    return (F.when(s >= VOLUME_TIERS[0][0], VOLUME_TIERS[0][1])
            .when(s >= VOLUME_TIERS[1][0], VOLUME_TIERS[1][1]).otherwise("Low"))


# ---------------------------------------------------------------------------
# Inventory and forecast rules (SF22–SF26)

def stock_status(stock, forecast) -> Column:
    """Understocked if stock < forecast, Overstocked if > 2×, else Optimal (SF22)."""
    s, f = col_(stock), col_(forecast)
    return F.when(s < f, "Understocked").when(s > f * 2, "Overstocked").otherwise("Optimal")


def shortage_status(need, stock) -> Column:
    """CRITICAL if shortage > 30 % of need, LOW if any shortage, WARNING if
    stock < 1.2×need, else OK (SF23)."""
    n, s = col_(need), col_(stock)
    short = F.greatest(F.lit(0.0), n - s)
    return (F.when(short > 0.3 * n, "CRITICAL").when(short > 0, "LOW")
            .when(s < 1.2 * n, "WARNING").otherwise("OK"))


SEVERITY_ORDER = {"CRITICAL": 0, "LOW": 1, "WARNING": 2, "OK": 3}


def severity_rank(c) -> Column:
    """Custom sort key CRITICAL < LOW < WARNING < OK (TK5)."""
    x = col_(c)
    out = None
    for k, v in SEVERITY_ORDER.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(len(SEVERITY_ORDER))


def trend_pct(pred, recent) -> Column:
    """Percent change of prediction versus recent mean, one decimal (SF24)."""
    p, r = col_(pred), col_(recent)
    return F.when(r > 0, F.round((p - r) / r * 100, 1)).otherwise(F.lit(0.0))


def trend_direction(t) -> Column:
    return F.when(col_(t) > 0, "up").when(col_(t) < 0, "down").otherwise("stable")


def sigmoid(x) -> Column:
    """Numerically stable logistic (SF26)."""
    z = col_(x).cast("double")
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def explain_rule(antecedent, consequent, confidence, lift) -> Column:
    """Templated recommendation explanation (SF6)."""
    return F.format_string("Customers who buy %s also buy %s (%.0f%% confidence, %.1fx lift)",
                           col_(antecedent), col_(consequent), F.rint(col_(confidence) * 100), F.bround(col_(lift), 1))


def json_field(c, key: str, kind: str = "bigint") -> Column:
    """Extract one field of JSON text (SF28)."""
    return F.get_json_object(col_(c), f"$.{key}").try_cast(kind)

"""Column functions: cleaning, guarded arithmetic, dates, labels and display text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text -------------------------------------------------------------------------------------

def trimmed(c: ColumnLike) -> Column:
    return F.trim(_c(c))


def blank_to_null(c: ColumnLike) -> Column:
    """Blank text counts as missing."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def digits(c: ColumnLike) -> Column:
    """Only the decimal digits of a text."""
    return F.regexp_replace(_c(c), "[^0-9]", "")


def digits_int(c: ColumnLike) -> Column:
    """Digits of a text as int, NULL when there are none."""
    return F.nullif(digits(c), F.lit("")).try_cast("int")


# fixed values: the two employment texts that are not "<n> year(s)"
EMP_TEXT_YEARS = {"10+ years": 11, "< 1 year": 0}


def emp_years(c: ColumnLike) -> Column:
    """Employment text to whole years; NULL for anything unknown."""
    c = _c(c)
    known = F
    for text, years in EMP_TEXT_YEARS.items():
        known = known.when(c == text, F.lit(years))
    return known.when(c.rlike(r"^\d+ year"), digits_int(c))


def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep and rename columns: ``mapping`` is new name -> old name."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


# ---- numbers ----------------------------------------------------------------------------------

def to_number(c: ColumnLike) -> Column:
    """Double, NULL when the text is not a number."""
    return _c(c).try_cast("double")


def or_zero(c: ColumnLike) -> Column:
    return F.coalesce(_c(c), F.lit(0))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL to 0 on the given columns, types kept."""
    return df.na.fill(0, subset=[c for c in cols if c in df.columns])


def guarded_ratio(num: ColumnLike, den: ColumnLike, default: float = 0.0) -> Column:
    """num / den in double where den > 0, otherwise ``default``; a NULL numerator stays NULL."""
    d = _c(den).cast("double")
    return F.when(d > 0, _c(num).cast("double") / d).otherwise(F.lit(default))


def pct_to_frac(c: ColumnLike) -> Column:
    return F.coalesce(_c(c).cast("double"), F.lit(0.0)) / F.lit(100.0)


def flag_positive(c: ColumnLike) -> Column:
    return F.when(_c(c) > 0, 1).otherwise(0)


def safe_growth(x: ColumnLike, prev: ColumnLike, scale: int = 4) -> Column:
    """Percent growth over ``prev``, NULL when prev is 0 or missing."""
    prev = _c(prev)
    return F.round((_c(x) - prev) / F.nullif(prev, F.lit(0)) * 100, scale)


def clip(c: ColumnLike, lo: ColumnLike | float, hi: ColumnLike | float) -> Column:
    """Limit to [lo, hi]; the upper limit wins when they cross."""
    lo = F.lit(lo) if isinstance(lo, (int, float)) else _c(lo)
    hi = F.lit(hi) if isinstance(hi, (int, float)) else _c(hi)
    return F.when(_c(c).isNotNull(), F.least(F.greatest(_c(c), lo), hi))


def bool_int(c: ColumnLike) -> Column:
    return _c(c).cast("int")


def bucket_label(c: ColumnLike) -> Column:
    """Number as text with two decimals."""
    return F.round(_c(c).cast("decimal(18,10)"), 2).cast("string")


# ---- dates ------------------------------------------------------------------------------------

def year_of(c: ColumnLike) -> Column:
    return F.year(_c(c))


def month_of(c: ColumnLike) -> Column:
    return F.month(_c(c))


def month_start(c: ColumnLike) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(_c(c).cast("date"), "MM")


def month_diff(a: ColumnLike, b: ColumnLike, default: int = 0) -> Column:
    """Calendar months from b to a, days ignored; ``default`` when either is missing."""
    a, b = _c(a), _c(b)
    return F.coalesce((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b)), F.lit(default))


def age_years(a: ColumnLike, b: ColumnLike) -> Column:
    """Complete years from b to a, truncated toward zero when a is before b."""
    a, b = _c(a), _c(b)

    def whole(later: Column, earlier: Column) -> Column:
        month_day = [F.month(later) * 100 + F.dayofmonth(later),
                     F.month(earlier) * 100 + F.dayofmonth(earlier)]
        return F.year(later) - F.year(earlier) - (month_day[0] < month_day[1]).cast("int")

    return F.when(a >= b, whole(a, b)).otherwise(-whole(b, a))


# ---- labels -----------------------------------------------------------------------------------

def binary_target(c: ColumnLike, positive: Iterable[str], negative: Iterable[str]) -> Column:
    """1 / 0 / NULL from two value lists."""
    return F.when(_c(c).isin(*positive), 1).when(_c(c).isin(*negative), 0)


def binarize(c: ColumnLike, values: Iterable) -> Column:
    """Membership as 1/0; NULL counts as not a member."""
    return F.coalesce(_c(c).isin(*values), F.lit(False)).cast("int")


def label_at(c: ColumnLike, threshold: float) -> Column:
    return F.when(_c(c) >= threshold, 1).otherwise(0)


# fixed values: tier limits and approval threshold
TIER_LIMITS = {"low": 0.10, "medium": 0.25}
TOP_TIER = "high"
APPROVAL_THRESHOLD = 0.20


def risk_tier(c: ColumnLike) -> Column:
    out = F
    for name, limit in TIER_LIMITS.items():
        out = out.when(_c(c) < limit, name)
    return out.when(_c(c).isNotNull(), TOP_TIER)


def approved(c: ColumnLike, threshold: float = APPROVAL_THRESHOLD) -> Column:
    return _c(c) < threshold


def direction(c: ColumnLike) -> Column:
    return F.when(_c(c) > 0, "increases_risk").otherwise("decreases_risk")


# ---- comparing and showing values ---------------------------------------------------------------

def differs(a: ColumnLike, b: ColumnLike, tol: float = 1e-6) -> Column:
    """Relative numeric difference beyond ``tol`` when both parse as numbers, else text inequality."""
    a, b = _c(a), _c(b)
    x, y = a.try_cast("double"), b.try_cast("double")
    scale = F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    numeric = F.abs(x - y) / scale > tol
    text = ~a.cast("string").eqNullSafe(b.cast("string"))
    return F.when(x.isNotNull() & y.isNotNull(), numeric).otherwise(text)


def format_value(c: ColumnLike) -> Column:
    """Whole numbers without decimals, other numbers with two, other text unchanged."""
    c = _c(c)
    v = c.try_cast("double")
    return (F.when(v.isNull(), c.cast("string"))
            .when(v == F.floor(v), F.floor(v).cast("bigint").cast("string"))
            .otherwise(F.format_string("%.2f", v)))


# ---- fixed bins -------------------------------------------------------------------------------

def unit_edges(bins: int) -> list[float]:
    """Equal-width edges on [0, 1] as the exact doubles i * (1 / bins), last one 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_left_closed(c: ColumnLike, bins: int) -> Column:
    """Bin number for [lo, hi) bins on [0, 1], the last one closed; NULL outside."""
    c, edges = _c(c), unit_edges(bins)
    pos = sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((c >= 0.0) & (c <= 1.0), pos)


def bin_right_closed(c: ColumnLike, bins: int) -> Column:
    """Bin number for (lo, hi] bins on [0, 1], with 0 in the first bin; NULL outside."""
    c, edges = _c(c), unit_edges(bins)
    pos = sum((F.when(c > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((c >= 0.0) & (c <= 1.0), pos)

"""Column expressions: arithmetic guards, bins, dates, geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(c, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL."""
    c = _c(c)
    out = F.when(c.isNull(), F.lit(None))
    if lo is not None:
        out = out.when(c < lo, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = out.when(c > hi, F.lit(hi) if not isinstance(hi, Column) else hi)
    return out.otherwise(c)


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def div0(a, b) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(_c(b) == 0, 0.0).otherwise(_c(a) / _c(b))


def correlation(a, b, over=None) -> Column:
    """Pearson correlation as an aggregate or over a window; NULL where a side does not vary."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    at = (lambda x: x.over(over)) if over is not None else (lambda x: x)
    spread = lambda x: at(F.stddev_pop(F.when(both, x)))
    return F.try_divide(at(F.covar_pop(a, b)), spread(a) * spread(b))


def round_bin(c, digits: int = 0, lo=None, hi=None) -> Column:
    """Clip, then round half to even to ``digits`` places."""
    return F.bround(clip(c, lo, hi), digits)


def round_to(c, step: int) -> Column:
    """Nearest multiple of ``step``, half to even."""
    return (F.bround(_c(c) / step) * step).cast("bigint")


def to_int_with_null(c, sentinels=(-1,)) -> Column:
    """Float category code to int; sentinels and NaN become NULL."""
    c = _c(c)
    return F.when(c.isin(*sentinels) | F.isnan(c), None).otherwise(c.cast("int"))


def int_part(c) -> Column:
    return F.signum(_c(c)) * F.floor(F.abs(_c(c)))


def frac_part(c) -> Column:
    return _c(c) - int_part(c)


def win_rate(wins, draws, losses) -> Column:
    """Share of points, a draw being half; NULL without games."""
    w, d, l = _c(wins), _c(draws), _c(losses)
    return safe_div(w + d * 0.5, w + d + l)


def matches_all(c, parts) -> Column:
    """Every given substring occurs."""
    return reduce(lambda a, b: a & b, [_c(c).contains(p) for p in parts])


def map_values(c, mapping: dict, default=None) -> Column:
    """Value lookup in a small fixed mapping."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(c)), F.lit(default))


def split_key(c, sep: str, index: int) -> Column:
    """Part ``index`` (from 0) of a composite key."""
    return F.get(F.split(_c(c), sep), F.lit(index))


def build_key(cols, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


# dates


def instant(c) -> Column:
    """timestamp_ntz or timestamp as timestamp (session zone UTC)."""
    return _c(c).cast("timestamp")


def micros(c) -> Column:
    return F.unix_micros(instant(c))


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    return F.to_date(_c(c), fmt)


def shift_days(c, n: int) -> Column:
    return F.date_add(_c(c).cast("date"), n)


def days_between(later, earlier) -> Column:
    return F.datediff(_c(later), _c(earlier))


def epoch(c, fmt: str | None = None) -> Column:
    """Epoch seconds of a timestamp, or of text such as 01/02/2022 with its format."""
    return F.unix_timestamp(_c(c), fmt) if fmt else F.unix_seconds(instant(c))


def calendar_parts(c) -> dict[str, Column]:
    """Calendar attributes; Monday is 0, weeks are ISO weeks."""
    d = _c(c).cast("date")
    first = lambda unit: (F.trunc(d, unit) == d).cast("int")
    last_of_quarter = F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)
    last_of_year = F.date_sub(F.add_months(F.trunc(d, "year"), 12), 1)
    return {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "week": F.weekofyear(d),
        "day": F.dayofmonth(d), "dayofweek": F.weekday(d), "dayofyear": F.dayofyear(d),
        "is_month_start": first("month"), "is_month_end": (F.last_day(d) == d).cast("int"),
        "is_quarter_start": first("quarter"), "is_quarter_end": (last_of_quarter == d).cast("int"),
        "is_year_start": first("year"), "is_year_end": (last_of_year == d).cast("int"),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def time_to_frame(c, fps: float) -> Column:
    return F.floor(_c(c) * fps)


def frame_to_time(c, fps: float) -> Column:
    return _c(c) / fps


# geometry


def distance(a, b) -> Column:
    """Euclidean distance of two points given as lists of columns."""
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow(_c(p) - _c(q), 2) for p, q in zip(a, b)]))


def angle(a, b) -> Column:
    """Angle between two vectors in radians; NULL for a zero vector."""
    dot = reduce(lambda x, y: x + y, [_c(p) * _c(q) for p, q in zip(a, b)])
    size = lambda v: F.sqrt(reduce(lambda x, y: x + y, [_c(p) * _c(p) for p in v]))
    cos = F.try_divide(dot, size(a) * size(b))
    return F.acos(F.when(cos > 1, 1.0).when(cos < -1, -1.0).otherwise(cos))


def arccos_ratio(a, b) -> Column:
    """acos(a / b); NULL outside the domain."""
    r = safe_div(a, b)
    return F.when(F.abs(r) <= 1, F.acos(r))

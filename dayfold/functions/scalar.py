"""Column to Column helpers. Missing values stay missing in every one of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayfold.schema import BUCKETS, PROB_EPS


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(value: Column | str) -> Column:
    """Text or number to double; unparseable text and NaN become null."""
    number = _c(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def finite(value: Column | str) -> Column:
    """NaN and both infinities become null."""
    number = _c(value).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def bounded(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps null: greatest/least alone would turn a null into a bound."""
    column = _c(value)
    clipped = column
    if high is not None:
        clipped = F.least(clipped, F.lit(float(high)))
    if low is not None:
        clipped = F.greatest(clipped, F.lit(float(low)))
    return F.when(column.isNotNull(), clipped)


def probability(value: Column | str, low: float = PROB_EPS, high: float = 1.0 - PROB_EPS) -> Column:
    return bounded(value, low, high)


def logit(value: Column | str) -> Column:
    p = probability(value)
    return F.ln(p / (1.0 - p))


def sigmoid(value: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(value)))


def temper(value: Column | str, temp, bias, low: float, high: float) -> Column:
    """Temperature and bias on the logit scale, clipped to the business range."""
    return probability(sigmoid(_c(temp) * logit(value) + _c(bias)), low, high)


def log1p_floor(value: Column | str) -> Column:
    """log1p of the value with negatives raised to zero."""
    return F.log1p(bounded(value, low=0.0))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that gives null for a zero denominator (plain / raises in ANSI mode)."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def variation(mean: Column | str, std: Column | str) -> Column:
    """Coefficient of variation: std over |mean|, null when the mean is zero."""
    return ratio(std, F.abs(_c(mean)))


def column_or(df: DataFrame, name: str, fill: float | None = 0.0) -> Column:
    """The column with nulls filled, or the constant when the frame lacks it."""
    constant = F.lit(fill).cast("double")
    if name not in df.columns:
        return constant
    column = F.col(name).cast("double")
    return column if fill is None else F.coalesce(column, constant)


def iso_date(value: Column | str) -> Column:
    return F.coalesce(F.date_format(_c(value), "yyyy-MM-dd"), F.lit(""))


def contains_any(label: Column | str, keywords: Iterable[str]) -> Column:
    """1.0 when the lower-cased label contains one of the keywords as a substring."""
    lowered = F.lower(_c(label))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | lowered.contains(word)
    return hit.cast("double")


def hour_bucket(ts: Column | str) -> Column:
    hour = F.hour(_c(ts))
    named = F.when(hour < 6, BUCKETS[0])
    for i, name in enumerate(BUCKETS[1:], start=1):
        named = named.when((hour >= 6 * i) & (hour < 6 * (i + 1)), name)
    return named.otherwise("unknown")


def base_calendar(day: Column | str) -> dict[str, Column]:
    weekday = F.weekday(_c(day))
    return {
        "d_dayofweek": weekday.cast("double"),
        "d_is_weekend": (weekday >= 5).cast("double"),
        "d_month": F.month(_c(day)).cast("double"),
    }


def model_calendar(day: Column | str, subject: Column | str) -> dict[str, Column]:
    weekday = F.weekday(_c(day))
    digits = F.regexp_extract(_c(subject), r"(\d+)", 1)
    return {
        "dow": weekday,
        "month": F.month(_c(day)),
        "week": F.weekofyear(_c(day)),
        "is_weekend": (weekday >= 5).cast("int"),
        "subject_num": F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(-1)),
    }


def log_loss_term(y: Column | str, p: Column | str) -> Column:
    """Loss of one row; null when label or prediction is missing. Binary labels need one logarithm."""
    label, prob = _c(y).cast("double"), probability(p)
    general = -(label * F.ln(prob) + (1.0 - label) * F.ln(1.0 - prob))
    return F.when(label == 1.0, -F.ln(prob)).when(label == 0.0, -F.ln(1.0 - prob)).otherwise(general)


def compact_text(value: Column | str, limit: int = 220) -> Column:
    """Cut long text to the limit, three dots included."""
    text = _c(value)
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)

"""Score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null for a zero denominator."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """From unrounded precision and recall; null where either is, or both are 0."""
    p, r = F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    return F.round(F.try_divide(2 * p * r, p + r), 6)


def term_priority(confidence: Column, frequency: Column, boost: Column) -> Column:
    """Weight of a glossary term: confidence, log frequency and the boost of its type, at most 1."""
    return F.round(F.least(F.lit(1.0), 0.4 * confidence + 0.3 * F.log1p(frequency) / F.log1p(F.lit(1000.0)) + 0.3 * boost), 4)


def weakest(*confidences: Column) -> Column:
    return F.round(F.least(*confidences), 6)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    common = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(ratio(common, (a1 - a0) + (b1 - b0) - common), F.lit(0.0))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open validity: an unknown start is never valid, an open end always lasts."""
    return F.coalesce((start <= at) & (end.isNull() | (at < end)), F.lit(False))


def first_that(*rules: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first rule that holds; a null condition does not hold."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def codes(*rules: tuple[Column, str]) -> Column:
    """Sorted codes of all rules that hold."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in rules]), lambda x: x.isNotNull()))

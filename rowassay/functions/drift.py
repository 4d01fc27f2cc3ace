"""Change, stability and drift-band expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowassay import constants as C
from rowassay.functions.scoring import banded


def absolute_change(base: Column, target: Column) -> Column:
    return target - base


def relative_change(base: Column, target: Column) -> Column:
    """|target - base| over max(|base|, 1); NULL when a side is NULL."""
    return F.when(base.isNotNull(), F.abs(target - base) / F.greatest(F.abs(base), F.lit(1.0)))


def psi_term(base_count: Column, base_total: Column, target_count: Column, target_total: Column) -> Column:
    """One category's part of the population-stability index."""
    floor = F.lit(C.PSI_EPSILON)

    def share(count: Column, total: Column) -> Column:
        value = count.cast("double") / total.cast("double")
        return F.when(value <= 0.0, floor).otherwise(value)

    base, target = share(base_count, base_total), share(target_count, target_total)
    return F.when(
        (F.coalesce(base_total, F.lit(0)) > 0) & (F.coalesce(target_total, F.lit(0)) > 0),
        (target - base) * F.ln(target / base),
    ).otherwise(F.lit(0.0))


def numeric_drift_band(relative: Column, bands=C.NUMERIC_DRIFT_BANDS) -> Column:
    return banded(relative, bands, C.NO_DRIFT_BAND)


def psi_drift_band(psi: Column, bands=C.PSI_DRIFT_BANDS) -> Column:
    return banded(psi, bands, C.NO_DRIFT_BAND)


def score_drift_band(delta: Column, bands=C.SCORE_DRIFT_BANDS) -> Column:
    return banded(F.abs(delta), bands, C.NO_DRIFT_BAND)

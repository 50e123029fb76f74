"""Standard scaling fitted on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES

Fitted = Mapping[str, Mapping[str, Column]]


def fit_scaler(train: DataFrame, by: Sequence[str] = (), names: Sequence[str] = FEATURES,
               digits: int | None = None) -> DataFrame:
    """Per group: a struct (mean, scale) per feature. Population deviation; a constant feature gets scale 1.

    ``digits`` rounds the fitted values, which makes everything derived from them reproducible bit by bit.
    """
    def tidy(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    fitted = []
    for name in names:
        value = F.col(name).cast("double")
        spread = tidy(F.stddev_pop(value))
        scale = F.when(spread > 0, spread).otherwise(F.lit(1.0))
        fitted.append(F.struct(tidy(F.avg(value)).alias("mean"), scale.alias("scale")).alias(name))
    return train.groupBy(*by).agg(*fitted)


def scaler_table(scaler: DataFrame, by: Sequence[str] = (), names: Sequence[str] = FEATURES) -> DataFrame:
    """The fitted values as one row per (group, feature)."""
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"{n}.mean").alias("mean"), F.col(f"{n}.scale").alias("scale"))
               for n in names]
    return scaler.select(*by, F.inline(F.array(*entries)))


def fitted_values(scaler: DataFrame, names: Sequence[str] = FEATURES) -> Fitted:
    """Run the fit of a single-group scaler: two numbers per feature, which then enter plans as literals."""
    row = scaler.first()
    return {name: {"mean": F.lit(row[name]["mean"]), "scale": F.lit(row[name]["scale"])} for name in names}


def scaler_numbers(scaler: DataFrame, names: Sequence[str] = FEATURES) -> dict[str, dict[str, float]]:
    """The fit of a single-group scaler as plain numbers, for storing it."""
    row = scaler.first()
    return {name: {"mean": float(row[name]["mean"]), "scale": float(row[name]["scale"])} for name in names}


def scaled(fitted: Fitted | Column, names: Sequence[str] = FEATURES) -> dict[str, Column]:
    return {name: (F.col(name) - fitted[name]["mean"]) / fitted[name]["scale"] for name in names}


def unscaled(fitted: Fitted | Column, names: Sequence[str] = FEATURES) -> dict[str, Column]:
    return {name: F.col(name) * fitted[name]["scale"] + fitted[name]["mean"] for name in names}


def apply_scaler(rows: DataFrame, fitted: Fitted, names: Sequence[str] = FEATURES) -> DataFrame:
    """Scale in place; a projection that keeps the scan's pruning."""
    made = scaled(fitted, names)
    return rows.select(*[made[name].alias(name) if name in names else F.col(name) for name in rows.columns])


def invert_scaler(rows: DataFrame, fitted: Fitted, names: Sequence[str] = FEATURES) -> DataFrame:
    made = unscaled(fitted, names)
    return rows.select(*[made[name].alias(name) if name in names else F.col(name) for name in rows.columns])


def apply_scaler_by(rows: DataFrame, scaler: DataFrame, by: Sequence[str],
                    names: Sequence[str] = FEATURES) -> DataFrame:
    """Scale every group (fold) with its own fit; the broadcast side has one row per fold."""
    packed = scaler.select(*by, F.struct(*names).alias("_fit"))
    made = scaled(F.col("_fit"), names)
    return rows.join(F.broadcast(packed), list(by)).select(
        *[made[name].alias(name) if name in names else F.col(name) for name in rows.columns])

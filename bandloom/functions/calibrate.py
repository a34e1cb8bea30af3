"""Counts to physical units, gain features, and the units' labels as column metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NV = 1e-9


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null: NaN means missing."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _auto(x: Column, g: Column, f) -> Column:
    x, g = finite(x), finite(g)
    return F.when((g > 0) & (x >= 0), f(x, g))


def _cross(x: Column, a: Column, b: Column, f) -> Column:
    x, a, b = finite(x), finite(a), finite(b)
    return F.when((a > 0) & (b > 0), f(x, F.sqrt(a * b)))


def nv_auto(counts: Column, gain: Column) -> Column:
    """Amplitude density in nV/sqrt(Hz); null unless the gain is positive and the power not negative."""
    return _auto(counts, gain, lambda x, g: F.sqrt(x / g))


def nv_cross(counts: Column, gain_a: Column, gain_b: Column) -> Column:
    """Signed amplitude density of a real or imaginary part."""
    return _cross(counts, gain_a, gain_b, lambda x, g: F.signum(x) * F.sqrt(F.abs(x) / g))


def nv2_auto(counts: Column, gain: Column) -> Column:
    return _auto(counts, gain, lambda x, g: x / g)


def nv2_cross(counts: Column, gain_a: Column, gain_b: Column) -> Column:
    return _cross(counts, gain_a, gain_b, lambda x, g: x / g)


def asd_to_psd(asd: Column) -> Column:
    """nV/sqrt(Hz) to V^2/Hz, sign kept."""
    return F.signum(asd) * F.pow(F.abs(asd) * NV, F.lit(2.0))


def psd_to_asd(psd: Column) -> Column:
    return F.signum(psd) * F.sqrt(F.abs(psd)) / NV


#: Fixed order of the features of one channel.
FEATURES = ("one", "therm", "adc", "v8", "v12", "i8", "therm2", "adc2", "therm_adc")


def gain_features(channel: Column, therm: Column, adc0: Column, adc1: Column, v8: Column, v12: Column, i8: Column) -> Column:
    """array of the nine features: channels 0 and 1 read the first converter's temperature, 2 and 3 the second's."""
    adc = F.when(channel <= 1, adc0).otherwise(adc1)
    return F.array(F.lit(1.0), therm, adc, v8, v12, i8, therm * therm, adc * adc, therm * adc)


def gain_level(code: Column) -> Column:
    """L, M, H for 0, 1, 2 or the letters themselves; anything else, fractions and NaN included, is null."""
    text = F.upper(F.trim(code.cast("string")))
    number = text.try_cast("double")
    return F.when(text.isin("L", "M", "H"), text).when(number == 0, "L").when(number == 1, "M").when(number == 2, "H")


def label(df: DataFrame, column: str, units: str | None = None, frame: str | None = None) -> DataFrame:
    """Attach units and frame to a column; a projection keeps them only if they are attached again."""
    old = df.schema[column].metadata or {}
    return df.withMetadata(column, old | {k: v for k, v in (("units", units), ("frame", frame)) if v is not None})


def units_of(df: DataFrame, column: str) -> str | None:
    return (df.schema[column].metadata or {}).get("units")


def frame_of(df: DataFrame, column: str) -> str | None:
    return (df.schema[column].metadata or {}).get("frame")


def describe(df: DataFrame, column: str) -> str:
    return f"{column} [{units_of(df, column) or 'no units'}; {frame_of(df, column) or 'no frame'}]"

"""Closed-form sky spectra and conversions; frequencies in MHz, temperatures in K, brightness in W/m^2/Hz/sr."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boltzmann's constant, the speed of light, the impedance of free space (rounded), in SI.
K_B, C_LIGHT, Z_0 = 1.380649e-23, 299792458.0, 377.0


def power(f: Column, p: float) -> Column:
    return F.pow(f, F.lit(p))


def brightness_novaco_brown(f: Column) -> Column:
    return 1.36e-19 * power(f, -0.76) * F.exp(-3.28 * power(f, -0.64))


def brightness_cane(f: Column) -> Column:
    tau = 5 * power(f, -2.1)
    return 2.48e-20 * power(f, -0.52) * (1 - F.exp(-tau)) / tau + 1.06e-20 * power(f, -0.8) * F.exp(-tau)


def to_temperature(b: Column, f: Column) -> Column:
    return b * C_LIGHT**2 / (2 * K_B) / F.pow(f * 1e6, F.lit(2.0))


def to_brightness(t: Column, f: Column) -> Column:
    return 2 * K_B * t * F.pow(f * 1e6, F.lit(2.0)) / C_LIGHT**2


def temperature_novaco_brown(f: Column) -> Column:
    return to_temperature(brightness_novaco_brown(f), f)


def temperature_cane(f: Column) -> Column:
    return to_temperature(brightness_cane(f), f)


def temperature_broken_law(f: Column) -> Column:
    """One power law above 2 MHz, a flatter one below."""
    return 16.3e6 * F.when(f < 2, power(f / 2, -0.3)).otherwise(power(f / 2, -2.53))


def to_voltage(b: Column, length_m: float, coupling: float) -> Column:
    """V^2/Hz at a short dipole of effective length ``length_m``."""
    return 4 * 3.141592653589793 / 3 * Z_0 * coupling**2 * length_m**2 * b

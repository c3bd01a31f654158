"""Unit conversions and the water physics they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds in a day, millimetres in a metre.
SECONDS_PER_DAY = 60 * 60 * 24
MM_PER_M = 1000

# Latent heat of vaporisation, Henderson-Sellers (1984), J/kg.
H_VAP_SCALE = 1.91846e6
H_VAP_SHIFT = 33.91
KELVIN = 273.15

# Density of water, Chen et al. (1977); polynomials in degrees C, lowest power first.
RHO_AT_ONE_ATM = (0.99983952, 6.788260e-5, -9.08659e-6, 1.022130e-7, -1.35439e-9,
                  1.471150e-11, -1.11663e-13, 5.044070e-16, -1.00659e-18)
BULK_MODULUS = (19652.17, 148.1830, -2.29995, 0.01281, -4.91564e-5, 1.035530e-7)
PRESSURE_COEF_A = (3.26138, 5.223e-4, 1.324e-4, -7.655e-7, 8.584e-10)
PRESSURE_COEF_B = (7.2061e-5, -5.8948e-6, 8.69900e-8, -1.0100e-9, 4.3220e-12)
BAR_PER_PA = 1e-5

# Axis labels by variable.
UNIT_LABELS = {
    "le": "LE (W m-2 d-1)",
    "gpp": "GPP (gC m-2 d-1)",
    "ppfd": "PPFD (mol m-2 d-1)",
    "aet": "ET (mm m-2 d-1)",
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _poly(x: Column, coefs: tuple[float, ...]) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), reversed(coefs[:-1]), F.lit(coefs[-1]))


def per_day_to_per_second(x: str | Column) -> Column:
    return _c(x) / F.lit(float(SECONDS_PER_DAY))


def per_second_to_per_day(x: str | Column) -> Column:
    return _c(x) * F.lit(float(SECONDS_PER_DAY))


def latent_heat(temp: str | Column) -> Column:
    """J/kg at `temp` degrees C."""
    kelvin = _c(temp) + F.lit(KELVIN)
    return F.lit(H_VAP_SCALE) * F.pow(kelvin / (kelvin - F.lit(H_VAP_SHIFT)), F.lit(2.0))


def water_density(temp: str | Column, pressure: str | Column) -> Column:
    """kg/m3 at `temp` degrees C and `pressure` Pa."""
    t = _c(temp)
    bar = _c(pressure) * F.lit(BAR_PER_PA)
    stiff = _poly(t, BULK_MODULUS) + _poly(t, PRESSURE_COEF_A) * bar + _poly(t, PRESSURE_COEF_B) * bar * bar
    return F.lit(1000.0) * _poly(t, RHO_AT_ONE_ATM) * stiff / (stiff - bar)


def evapotranspiration(le, temp, pressure, h_vap=latent_heat, rho=water_density) -> Column:
    """mm/day from a latent heat flux in W/m2. Other formulas for either property can be passed in."""
    return F.lit(float(MM_PER_M * SECONDS_PER_DAY)) * _c(le) / (h_vap(temp) * rho(temp, pressure))


def water_balance_et(rain: str | Column, runoff: str | Column) -> Column:
    """Daily evapotranspiration as rain (per second) minus runoff (per day)."""
    return per_second_to_per_day(rain) - _c(runoff)


def unit_label(variable: str | Column) -> Column:
    """The unit of a variable; unknown variables give null."""
    pairs = [F.lit(v) for kv in UNIT_LABELS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), _c(variable))

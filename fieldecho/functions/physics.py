"""Sound speed, weather correction, loudness fall-off: column math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefn import is_night

# Gas constants, humidity terms and the measured warm bias of the weather grids.
GAMMA, GAS_CONSTANT, KELVIN = 1.4, 287.05, 273.15
NIGHT_BIAS_C, DAY_BIAS_C = -2.3, -0.3
GRID_BOX = (21.0, 53.0, -134.0, -60.0)


def speed_of_sound(temp_c: Column, rh_pct: Column | None = None) -> Column:
    """m/s in dry air, or with the first-order water-vapour term when humidity is given.

    With a humidity column, a null reading gives a null speed.
    """
    dry = F.sqrt(F.lit(GAMMA * GAS_CONSTANT) * (temp_c + KELVIN))
    if rh_pct is None:
        return dry
    vapour_kpa = 0.61078 * F.exp(17.27 * temp_c / (temp_c + 237.3))
    clamped = F.when(rh_pct.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), rh_pct)))
    return dry * (1 + 0.165 * (clamped / 100 * vapour_kpa / 101.325))


def diurnal_bias(temp_c: Column, local: Column, night: float = NIGHT_BIAS_C, day: float = DAY_BIAS_C) -> Column:
    """Add the (negative) bias of the hour's period to the temperature."""
    return temp_c + F.when(is_night(local), F.lit(night)).otherwise(F.lit(day))


def in_fine_grid(lat: Column, lon: Column) -> Column:
    la0, la1, lo0, lo1 = GRID_BOX
    return lat.between(la0, la1) & lon.between(lo0, lo1)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def falloff_term(amplitude: Column, dist: Column) -> Column:
    """log(amp) + log(distance): constant across recorders for a true 1/r source."""
    return F.when((amplitude > 0) & (dist > 0), F.log(amplitude) + F.log(dist))


def amplitude_consistency(tdoa: Column, log_diff: Column) -> Column:
    """Positive when the later recorder is the quieter one; null if it could not be measured."""
    return -F.signum(tdoa) * log_diff

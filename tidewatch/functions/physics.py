"""Scalars of stars, orbits and chords, as column expressions: they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants in cgs units, and the Sun.
G = 6.674e-8
SUN_DENSITY = 1.41
SUN_RADIUS = 6.957e10
SUN_TEMPERATURE = 5772.0
DAY = 86400.0
#: hc / (wavelength k) in kelvin, at 800 nm.
BAND = 1.438776877e-2 / 800e-9


def axis_ratio(period: Column, density: Column) -> Column:
    """Orbit over star radius, of a period in days around a star of this mean density."""
    seconds = period * DAY
    return F.pow(density * seconds * seconds * (G / (3 * math.pi)), F.lit(1 / 3))


def central_duration(period: Column, density: Column) -> Column:
    """Length of a central passage in days; half the period where the orbit would touch the star."""
    a = axis_ratio(period, density)
    return F.when(a <= 1, period / 2).otherwise(period / math.pi * F.asin(1 / F.greatest(a, F.lit(1.0))))


def chord_duration(period: Column, a: Column, ratio: Column, impact: Column, inner: bool = False) -> Column:
    """First to last contact (second to third, if inner) in days; 0 when there is no chord."""
    size = 1 - ratio if inner else 1 + ratio
    q = size * size - impact * impact
    return F.when(q <= 0, F.lit(0.0)).otherwise(period / math.pi * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(q, F.lit(0.0))) / a)))


def axis_of_duration(period: Column, ratio: Column, impact: Column, duration: Column) -> Column:
    """The orbit over star radius that gives this first-to-last duration."""
    s = F.sin(duration / period * math.pi)
    return F.sqrt(impact * impact + ((1 + ratio) * (1 + ratio) - impact * impact) / (s * s))


def density_of_axis(period: Column, a: Column) -> Column:
    seconds = period * DAY
    return a * a * a * (3 * math.pi / G) / (seconds * seconds)


def density_of_gravity(log_g: Column, radius: Column) -> Column:
    """Mean density from surface gravity (log cgs) and radius (suns)."""
    return 3 * F.pow(F.lit(10.0), log_g) / (radius * (4 * math.pi * G * SUN_RADIUS))


def main_sequence_temperature(density: Column) -> Column:
    return SUN_TEMPERATURE * F.pow(F.pow(density / SUN_DENSITY, F.lit(-1 / 2.1)), F.lit(0.4))


def main_sequence_density(temperature: Column) -> Column:
    return SUN_DENSITY * F.pow(F.pow(temperature / SUN_TEMPERATURE, F.lit(2.5)), F.lit(-2.1))


def star_parameters(temperature: Column, density: Column, mass: Column, radius: Column, log_g: Column) -> tuple[Column, Column]:
    """Temperature and mean density of a star from what a catalogue knows of it: its density, else that of its mass and
    radius, else of its gravity and radius; of the two, one that is still unknown is the main sequence's. Values that are
    not above 0, or not finite, are unknown; both are null when nothing is known."""

    def known(c: Column) -> Column:
        return F.when((c > 0) & (c < float("inf")), c)

    t, r = known(temperature), known(radius)
    d = F.coalesce(known(density), known(mass) * SUN_DENSITY / (r * r * r), density_of_gravity(known(log_g), r))
    return F.coalesce(t, main_sequence_temperature(d)), F.coalesce(d, main_sequence_density(t))


def brightness_ratio(companion: Column, star: Column) -> Column:
    """Brightness at 800 nm of a body of one temperature over one of another."""
    return F.expm1(BAND / star) / F.expm1(BAND / companion)


def occultation_depth(ratio: Column, a: Column, temperature: Column, albedo: float = 0.3, bond: float = 0.0, spread: float = 2 / 3) -> Column:
    day = temperature * F.sqrt(1 / a) * (spread * (1 - bond)) ** 0.25
    return ratio * ratio * brightness_ratio(day, temperature) + albedo * (ratio / a) * (ratio / a)


def largest_occultation(period: Column, temperature: Column, density: Column) -> Column:
    """The deepest occultation a planet can make, as a share of its transit; at most 0.15. Null for an unknown star."""
    a = F.greatest(axis_ratio(period, density), F.lit(1.0))
    known = temperature.isNotNull() & density.isNotNull()
    return F.when(known, F.least(occultation_depth(F.lit(1.0), a, temperature), F.lit(0.15)))


def period_of_duration(duration: Column, density: Column) -> Column:
    """The period in days whose central passage lasts `duration` days."""
    t = duration * DAY
    return t * t * t * density * (math.pi * math.pi * G / 3) / DAY


def limb_from_q(q1: Column, q2: Column) -> tuple[Column, Column]:
    return 2 * F.sqrt(q1) * q2, F.sqrt(q1) * (1 - 2 * q2)


def limb_to_q(u1: Column, u2: Column) -> tuple[Column, Column]:
    return (u1 + u2) * (u1 + u2), F.try_divide(u1, 2 * (u1 + u2))


def beyond_allowance(depth: Column, allowance: Column) -> Column:
    """What of a depth an allowance does not explain; all of it if the allowance is unknown or not above 0."""
    known = F.coalesce(F.nanvl(allowance, F.lit(0.0)), F.lit(0.0))
    return F.when(known > 0, depth - F.greatest(F.lit(0.0), F.least(depth, known))).otherwise(depth)


def inflation(beta: Column) -> Column:
    return F.greatest(F.coalesce(F.nanvl(beta, F.lit(1.0)), F.lit(1.0)), F.lit(1.0))


def pair_sigma(a: Column, a_error: Column, b: Column, b_error: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.sqrt(a_error * a_error + b_error * b_error))


def trapezoid(time: Column, period: Column | float, epoch: Column | float, depth: float, outer: float, inner: float) -> Column:
    """Share of light a dip with sloping sides takes at a time; 0 outside it. A box if inner is outer."""
    from tidewatch.operators.series import phase

    side, left = (outer - inner) / 2, outer / 2 - F.abs(phase(time, period, epoch))
    if side <= 0:
        return F.when(left > 0, F.lit(float(depth))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / side)) * depth

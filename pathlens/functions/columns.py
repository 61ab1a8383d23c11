"""Column expressions that several operators share."""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degree of the polynomial in `_log_erfc`, which leaves an error of about 4e-15.
DEGREE = 28


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Seconds with their fraction; null if either is null."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator isn't positive."""
    return F.when(denominator > 0, numerator / denominator)


def hash_bucket(identity: str | Column, salt: str, modulus: int) -> Column:
    """A salted bucket of an id, from the first 8 hex digits of its md5, the same in any engine."""
    digest = F.md5(F.concat(F.lit(salt), F.lit("|"), col(identity).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(modulus))


def hash_order(salt: str, *identity: str | Column) -> Column:
    """a reproducible pseudo-random order."""
    return F.sha2(F.concat_ws("|", *(col(c).cast("string") for c in identity), F.lit(salt)), 256)


def state_part(state: str | Column, part: int) -> Column:
    """DM2: part 0 (family) or 1 (stage) of `family:::stage`; null if there is none."""
    return F.try_element_at(F.split(col(state), ":::"), F.lit(part + 1))


def first_match(text: str | Column, patterns: list[str]) -> Column:
    """Whether any of the patterns occurs in the lower-cased text."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(col(text)), F.lit(p.lower())) for p in patterns), F.lit(False))


def status_chain(reasons: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first reason that holds."""
    return reduce(lambda chain, r: F.when(r[0], F.lit(r[1])).otherwise(chain), reversed(reasons), F.lit(otherwise))


def is_finite(x: str | Column) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x)) & (F.abs(col(x)) != float("inf"))


def clean_number(x: str | Column) -> Column:
    """A number, or null for what isn't one, NaN and infinities."""
    value = col(x).try_cast("double")
    return F.when(is_finite(value), value)


def _scaled_erfc(z: float) -> float:
    """erfc(z) exp(z^2) for z >= 0: directly, or far out by its continued fraction."""
    if z < 2:
        return math.erfc(z) * math.exp(z * z)
    return 1 / (math.sqrt(math.pi) * reduce(lambda rest, n: z + (n / 2) / rest, range(200, 0, -1), z))


@cache
def _log_erfc_coefficients() -> tuple[float, ...]:
    """Of powers of y = 2 t - 1, t = 2 / (2 + z): ln(erfc(z) exp(z^2) / t), interpolated at Chebyshev nodes."""
    nodes = np.cos(np.pi * (np.arange(DEGREE + 1) + 0.5) / (DEGREE + 1))
    values = [math.log(_scaled_erfc(4 / (y + 1) - 2) * 2 / (y + 1)) for y in nodes]
    return tuple(float(c) for c in np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(nodes, values, DEGREE)))


def _log_erfc(z: Column) -> Column:
    """ln erfc(z) for z >= 0, without underflow; one short polynomial, so that generated code stays small."""
    y = 4 / (2 + z) - 1
    return math.log(2) - F.log(2 + z) - z * z + reduce(lambda rest, c: F.lit(c) + y * rest, reversed(_log_erfc_coefficients()), F.lit(0.0))


def erfc(x: Column) -> Column:
    """The complementary error function, to about 1e-14."""
    value = F.exp(_log_erfc(F.abs(x)))
    return F.when(x >= 0, value).otherwise(2 - value)


def normal_survival(z: Column) -> Column:
    return F.lit(0.5) * erfc(z / F.lit(2.0**0.5))


def log_normal_survival(z: Column) -> Column:
    """ln P(Z > z), without underflow far out."""
    there = _log_erfc(F.abs(z) / F.lit(2.0**0.5)) - math.log(2)
    return F.when(z >= 0, there).otherwise(F.log1p(-F.exp(there)))


def log_survival(family: str | Column, t: Column, p1: Column, p2: Column) -> Column:
    """ln P(T > t). weibull: shape p1, scale p2; exponential: scale p2; loglogistic: shape p1, scale p2; lognormal: mu p1, sigma p2."""
    by = {
        "weibull": -F.pow(t / p2, p1),
        "exponential": -(t / p2),
        "loglogistic": -F.log1p(F.pow(t / p2, p1)),
        "lognormal": log_normal_survival((F.log(t) - p1) / p2),
    }
    positive = by[family] if isinstance(family, str) else reduce(lambda c, k: F.when(family == k, by[k]).otherwise(c), by, F.lit(None).cast("double"))
    return F.when(t <= 0, F.lit(0.0)).otherwise(positive)


def log_group_survival(age: Column, family: Column, p1: Column, p2: Column, shift: Column, atom: Column) -> Column:
    """ln P(T >= age), in seconds, of a group that begins at `shift` with a mass `atom` there: 0 up to and at the shift,
    then the family's in days beyond it; minus infinity where nothing is left."""
    after = F.when(atom < 1, F.log1p(-atom) + log_survival(family, (age - shift) / 86400.0, p1, p2)).otherwise(F.lit(float("-inf")))
    return F.when((age <= shift) | (age <= 0), F.lit(0.0)).otherwise(after)


def log_density(family: str | Column, t: Column, p1: Column, p2: Column) -> Column:
    """ln f(t) for t > 0, else null; parameters as for `log_survival`."""
    ratio = F.pow(t / p2, p1)
    by = {
        "weibull": F.log(p1 / p2) + (p1 - 1) * F.log(t / p2) - ratio,
        "exponential": -F.log(p2) - t / p2,
        "loglogistic": F.log(p1 / p2) + (p1 - 1) * F.log(t / p2) - 2 * F.log1p(ratio),
        "lognormal": -F.log(t * p2) - F.lit(0.9189385332046727) - F.pow((F.log(t) - p1) / p2, 2) / 2,
    }
    value = by[family] if isinstance(family, str) else reduce(lambda c, k: F.when(family == k, by[k]).otherwise(c), by, F.lit(None).cast("double"))
    return F.when(t > 0, value)


def log_interval(family: str | Column, low: Column, high: Column, p1: Column, p2: Column) -> Column:
    """Ln P(low < T <= high), from the difference of survivals in log space."""
    a, b = log_survival(family, low, p1, p2), log_survival(family, high, p1, p2)
    return a + F.log(F.greatest(-F.expm1(b - a), F.lit(1e-300)))

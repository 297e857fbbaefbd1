"""Distributions by their density alone: tabulated quantile functions, monotone, with a measured bound on their error."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.keyed import keyed_uniform

#: Stretches of the tables, and of the grid on which a density is summed.
KNOTS, GRID = 1024, 1 << 16
#: Tables reach to quantiles of exp(-REACH), about, from either end.
REACH = 34.0


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


#: By name, from parameters: the logarithm of a density over x, and the ends of where it is above 0.
DENSITIES: dict[str, Callable[..., tuple[Callable[[np.ndarray], np.ndarray], float, float]]] = {
    "gamma": lambda a: (lambda x: (a - 1) * np.log(x) - x - math.lgamma(a), 0.0, math.inf),
    "chi2": lambda df: (lambda x: (df / 2 - 1) * np.log(x) - x / 2 - math.lgamma(df / 2) - df / 2 * math.log(2), 0.0, math.inf),
    "beta": lambda a, b: (lambda x: (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - _log_beta(a, b), 0.0, 1.0),
    "lognorm": lambda s: (lambda x: -((np.log(x) / s) ** 2) / 2 - np.log(x * s * math.sqrt(2 * math.pi)), 0.0, math.inf),
    "invgauss": lambda mu: (lambda x: -((x - mu) ** 2) / (2 * x * mu**2) - 0.5 * np.log(2 * math.pi * x**3), 0.0, math.inf),
    "t": lambda df: (lambda x: math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df), -math.inf, math.inf),
    "gumbel_r": lambda: (lambda x: -x - np.exp(-x), -math.inf, math.inf),
}


@dataclass(frozen=True)
class Tabulated:
    """A continuous distribution. The table holds, at even steps of the log odds y of a quantile, a place s; s maps to x as `kind` says.

    error is the largest difference between u and the probability of at most quantile(u), measured between the table's knots.
    """

    kind: str
    loc: float
    scale: float
    low: float
    high: float
    first: float
    last: float
    places: tuple[float, ...]
    error: float

    @staticmethod
    def of(name: str, loc: float = 0.0, scale: float = 1.0, **shape: float) -> Tabulated:
        if name not in DENSITIES:
            raise ValueError(f"unknown distribution {name}")
        try:
            log_density, low, high = DENSITIES[name](**shape)
        except TypeError as e:
            raise ValueError(f"{name}: {e}") from None
        return Tabulated.from_density(log_density, low, high, loc, scale)

    @staticmethod
    def from_density(log_density: Callable[[np.ndarray], np.ndarray], low: float, high: float, loc: float = 0.0, scale: float = 1.0) -> Tabulated:
        """From the logarithm of any density on (low, high), up to a factor."""
        if scale <= 0:
            raise ValueError("the scale must be above 0")
        kind = "line" if math.isinf(low) and math.isinf(high) else "ray" if math.isinf(high) else "stretch"
        if kind != "line" and math.isinf(low):
            raise ValueError("turn the density around")
        s = np.linspace(-700, 700, GRID + 1) if kind != "line" else np.linspace(-40, 40, GRID + 1)
        with np.errstate(all="ignore"):
            if kind == "stretch":
                x, log_slope = low + (high - low) / (1 + np.exp(-s)), -np.abs(s) - 2 * np.log1p(np.exp(-np.abs(s)))
            elif kind == "ray":
                x, log_slope = low + np.exp(s), s
            else:
                x, log_slope = np.sinh(s), np.abs(s) + np.log1p(np.exp(-2 * np.abs(s))) - math.log(2)
            mass = np.nan_to_num(log_density(x) + log_slope, nan=-np.inf, posinf=-np.inf)
        held = np.flatnonzero(mass > mass.max() - 2 * REACH)  # a finer grid, where there is anything
        if len(held) < 3:
            raise ValueError("a density needs a place where it is above 0")
        s = np.linspace(s[max(0, held[0] - 1)], s[min(GRID, held[-1] + 1)], GRID + 1)
        with np.errstate(all="ignore"):
            if kind == "stretch":
                x, log_slope = low + (high - low) / (1 + np.exp(-s)), -np.abs(s) - 2 * np.log1p(np.exp(-np.abs(s)))
            elif kind == "ray":
                x, log_slope = low + np.exp(s), s
            else:
                x, log_slope = np.sinh(s), np.abs(s) + np.log1p(np.exp(-2 * np.abs(s))) - math.log(2)
            mass = np.exp(np.nan_to_num(log_density(x) + log_slope, nan=-np.inf, posinf=-np.inf) - mass.max())
        step = (mass[1:] + mass[:-1]) / 2
        below, above = np.cumsum(step)[:-1], np.cumsum(step[::-1])[::-1][1:]
        with np.errstate(all="ignore"):
            odds = np.log(below) - np.log(above)  # at s[1:-1]; both tails keep their precision
        sound = np.isfinite(odds) & (np.abs(odds) < REACH)
        odds, s = np.maximum.accumulate(odds[sound]), s[1:-1][sound]
        first, last = float(odds[0]), float(odds[-1])
        y = np.linspace(first, last, KNOTS + 1)
        places = np.interp(y, odds, s)
        middle = (y[1:] + y[:-1]) / 2
        off = np.abs(1 / (1 + np.exp(-np.interp((places[1:] + places[:-1]) / 2, s, odds))) - 1 / (1 + np.exp(-middle)))
        return Tabulated(kind, float(loc), float(scale), float(low), float(high), first, last, tuple(places.tolist()), float(off.max()))

    def _x(self, s: Column) -> Column:
        if self.kind == "stretch":
            x = self.low + (self.high - self.low) / (1 + F.exp(-s))
        else:
            x = F.exp(s) + self.low if self.kind == "ray" else F.sinh(s)
        return x * self.scale + self.loc

    def quantile(self, u: Column) -> Column:
        """The least value that is not exceeded with the probability u, for u in (0, 1); beyond the table's ends, its ends."""
        y = F.log(u) - F.log(1 - u)
        at = F.least(F.lit(float(KNOTS)), F.greatest(F.lit(0.0), (F.coalesce(y, F.when(u <= 0, F.lit(self.first)).otherwise(F.lit(self.last))) - self.first) * (KNOTS / (self.last - self.first))))
        i = F.least(F.lit(KNOTS - 1), F.floor(at)).cast("int")
        table = F.lit(list(self.places))
        return self._x(F.element_at(table, i + 1) + (at - i) * (F.element_at(table, i + 2) - F.element_at(table, i + 1)))

    def draw(self, seed: int | str, *keys: str | Column) -> Column:
        """A value by the row's keys (see keyed_uniform)."""
        return self.quantile(keyed_uniform(seed, *keys))

    def cdf(self, x: float) -> float:
        """The probability of at most x."""
        z = (x - self.loc) / self.scale
        if z <= self.low:
            return 0.0
        if z >= self.high:
            return 1.0
        s = math.log((z - self.low) / (self.high - z)) if self.kind == "stretch" else math.log(z - self.low) if self.kind == "ray" else math.asinh(z)
        y = float(np.interp(s, self.places, np.linspace(self.first, self.last, KNOTS + 1)))
        return 1 / (1 + math.exp(-y))

    def sf(self, x: float) -> float:
        return 1 - self.cdf(x)

    def definition_interval(self, epsilon: float = 0.0) -> tuple[float, float]:
        """The quantiles epsilon and 1 - epsilon; without epsilon, the ends of where the density is above 0."""
        if not 0 <= epsilon <= 1:
            raise ValueError("epsilon must be between 0 and 1")

        def at(u: float) -> float:
            if u in (0, 1):
                return (self.low if u == 0 else self.high) * self.scale + self.loc
            s = float(np.interp(math.log(u) - math.log1p(-u), np.linspace(self.first, self.last, KNOTS + 1), self.places))
            x = self.low + (self.high - self.low) / (1 + math.exp(-s)) if self.kind == "stretch" else math.exp(s) + self.low if self.kind == "ray" else math.sinh(s)
            return x * self.scale + self.loc

        return at(epsilon), at(1 - epsilon)

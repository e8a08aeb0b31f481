"""Two-regime Markov-switching GARCH(1,1), with one collapsed variance between steps.

The filter is causal, so with frozen parameters one pass over a key's returns
gives for every day what filtering its prefix would. Fits are one task for each
key and start; the best start of a key is an aggregate.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import pit

LEAST = 30
FLOOR = 0.02
TINY = 1e-300
# Bounds of the parameters.
MOST_ALPHA, MOST_PERSISTENCE = 0.3, 0.98
# The starts of a fit (alpha, beta, chances to stay, omega as shares of the variance).
STARTS = [
    ((0.05, 0.08), (0.85, 0.80), (0.90, 0.85), (0.3, 1.5)),
    ((0.05, 0.05), (0.90, 0.70), (0.95, 0.90), (0.5, 3.0)),
    ((0.10, 0.10), (0.80, 0.80), (0.85, 0.80), (0.8, 5.0)),
]


@dataclass
class Params:
    omega: tuple[float, float]
    alpha: tuple[float, float]
    beta: tuple[float, float]
    stay: tuple[float, float]
    initial: tuple[float, float] = (0.5, 0.5)

    def unconditional(self, k: int) -> float:
        """M14."""
        rest = 1 - self.alpha[k] - self.beta[k]
        return self.omega[k] / rest if rest > 1e-6 else self.omega[k]

    @property
    def turbulent(self) -> int:
        """The regime with more variance, whatever its number."""
        return int(self.unconditional(1) > self.unconditional(0))


def _density(x2: float, variance: float) -> float:
    """M13."""
    return math.exp(-0.5 * x2 / variance) / math.sqrt(2 * math.pi * variance) if variance > 0 else TINY


def filtered(returns: Sequence[float], p: Params) -> tuple[list[tuple[float, float]], float]:
    """Probabilities of the regimes after each return, and the log-likelihood."""
    (w0, w1), (a0, a1), (b0, b1), (s0, s1) = p.omega, p.alpha, p.beta, p.stay
    q0, q1 = p.initial
    variance = q0 * p.unconditional(0) + q1 * p.unconditional(1)
    squared, total, out = variance, 0.0, []
    for r in returns:
        h0, h1 = w0 + a0 * squared + b0 * variance, w1 + a1 * squared + b1 * variance
        ahead0 = s0 * q0 + (1 - s1) * q1
        ahead1 = (1 - s0) * q0 + s1 * q1
        squared = r * r
        f0, f1 = ahead0 * _density(squared, h0), ahead1 * _density(squared, h1)
        mixed = f0 + f1
        if mixed <= 0:
            mixed = TINY
        q0, q1 = f0 / mixed, f1 / mixed
        variance = q0 * h0 + q1 * h1
        total += math.log(mixed)
        out.append((q0, q1))
    return out, total


def log_likelihood(returns: Sequence[float], p: Params) -> float:
    return filtered(returns, p)[1]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def unpack(x: Sequence[float], floor: float) -> Params:
    """Free numbers as parameters inside their bounds; omega never falls under ``floor``."""
    alpha = tuple(_sigmoid(v) * MOST_ALPHA for v in x[2:4])
    beta = tuple(_sigmoid(v) * (MOST_PERSISTENCE - a) for v, a in zip(x[4:6], alpha))
    return Params(tuple(floor + math.exp(min(v, 700)) for v in x[:2]), alpha, beta, tuple(map(_sigmoid, x[6:8])))


def pack(p: Params, floor: float) -> list[float]:
    """M12 the other way."""
    omega = [math.log(max(w - floor, 1e-12)) for w in p.omega]
    alpha = [_logit(a / MOST_ALPHA) for a in p.alpha]
    beta = [_logit(b / (MOST_PERSISTENCE - a)) for a, b in zip(p.alpha, p.beta)]
    return [*omega, *alpha, *beta, *map(_logit, p.stay)]


def nelder_mead(f: Callable[[list[float]], float], start: Sequence[float], most: int = 2000, tolerance: float = 1e-8) -> tuple[list[float], float, int, bool]:
    """(place, value, rounds, converged) of a minimum by reflection, expansion, contraction and shrinking."""
    points = [list(start)]
    for i, v in enumerate(start):
        points.append([*start[:i], v * 1.05 if v else 0.00025, *start[i + 1 :]])
    simplex = [(f(p), p) for p in points]
    n = len(start)
    for done in range(most):
        simplex.sort(key=lambda s: s[0])
        if abs(simplex[-1][0] - simplex[0][0]) < tolerance:
            return simplex[0][1], simplex[0][0], done, True
        worst = simplex[-1]
        middle = [sum(s[1][i] for s in simplex[:-1]) / n for i in range(n)]

        def along(t: float, point: list[float] = worst[1]) -> tuple[float, list[float]]:
            """The point ``t`` of the way from the middle to ``point``."""
            place = [m + t * (x - m) for m, x in zip(middle, point)]
            return f(place), place

        mirrored = along(-1.0)
        if mirrored[0] < simplex[0][0]:
            further = along(-2.0)
            simplex[-1] = further if further[0] < mirrored[0] else mirrored
        elif mirrored[0] < simplex[-2][0]:
            simplex[-1] = mirrored
        else:
            nearer = along(0.5)
            if nearer[0] < worst[0]:
                simplex[-1] = nearer
            else:
                best = simplex[0][1]
                shrunk = [[b + 0.5 * (x - b) for b, x in zip(best, s[1])] for s in simplex[1:]]
                simplex[1:] = [(f(p), p) for p in shrunk]
    value, place = min(simplex, key=lambda s: s[0])
    return place, value, most, False


def fit_start(returns: Sequence[float], start: int, most: int = 2000) -> tuple[Params, float] | None:
    """One start of a fit; None if its likelihood isn't finite."""
    if len(returns) < LEAST:
        raise ValueError(f"{LEAST} returns are needed, not {len(returns)}")
    sample = math.fsum(r * r for r in returns) / len(returns)
    floor = FLOOR * sample
    if sample <= 0:
        return None
    alpha, beta, stay, shares = STARTS[start]
    first = Params(tuple(s * sample for s in shares), alpha, beta, stay)

    def cost(x: list[float]) -> float:
        value = log_likelihood(returns, unpack(x, floor))
        return -value if math.isfinite(value) else 1e300

    place, value, _, _ = nelder_mead(cost, pack(first, floor), most)
    return (unpack(place, floor), -value) if value < 1e300 else None


def fit(returns: Sequence[float], regimes: int = 2, most: int = 2000) -> tuple[Params, float]:
    """The best of all starts."""
    if regimes != 2:
        raise ValueError("two regimes are supported")
    found = [x for x in (fit_start(returns, k, most) for k in range(len(STARTS))) if x]
    if not found:
        raise ArithmeticError("no start gave a finite likelihood")
    return max(found, key=lambda x: x[1])


FITTED = "params string, log_likelihood double, start int"


def fit_all(returns: DataFrame, key: str = "ticker", day: str = "date", most: int = 2000) -> DataFrame:
    """C12, C15 over rows (key, day, ret): the best parameters of each key as JSON; keys with under 30 returns have none."""
    each = returns.withColumn("start", F.explode(F.array(*map(F.lit, range(len(STARTS))))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows["start"].iloc[0])
        series = rows.sort_values(day)["ret"].tolist()
        found = fit_start(series, start, most) if len(series) >= LEAST else None
        out = [] if found is None else [(rows[key].iloc[0], json.dumps(asdict(found[0])), found[1], start)]
        return pd.DataFrame(out, columns=[key, "params", "log_likelihood", "start"])

    kind = dict(returns.dtypes)[key]
    fits = each.groupBy(key, "start").applyInPandas(run, f"{key} {kind}, {FITTED}")
    best = F.max_by(F.struct("params", "log_likelihood"), F.struct("log_likelihood", -F.col("start")))
    return fits.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def params_of(text: str) -> Params:
    raw = json.loads(text)
    return Params(**{k: tuple(v) for k, v in raw.items()})


def filter_all(bars: DataFrame, params: DataFrame, key: str = "ticker", day: str = "date") -> DataFrame:
    """C14: (key, day, close, p_turbulent) for each row, from returns up to it; null before the second return.

    A key's rows are one task: the state of a day needs that of the day before.
    """
    rows = bars.select(key, day, "close").withColumn("ret", pit.pair_returns(key, day)).join(params.select(key, "params"), key)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(day)
        p = params_of(group["params"].iloc[0])
        known = group["ret"].notna()
        steps = iter(filtered(group["ret"][known].tolist(), p)[0])
        last, seen, out = None, 0, []
        for has in known:
            if has:
                last, seen = next(steps)[p.turbulent], seen + 1
            out.append(last if seen >= 2 else None)
        return group[[key, day, "close"]].assign(p_turbulent=pd.Series(out, index=group.index, dtype="float64"))

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {day} {kinds[day]}, close double, p_turbulent double")


def position(threshold, p: str = "p_turbulent"):
    """C14: out of the market in turbulence, in it otherwise; flat before the filter has a view."""
    return F.when(F.col(p).isNull(), 0.0).when(F.col(p) > threshold, 0.0).otherwise(1.0)


def calibrate(bars: DataFrame, until: str, key: str = "ticker", day: str = "date", most: int = 2000) -> DataFrame:
    """Parameters from returns up to a day."""
    return fit_all(pit.log_returns(pit.PointInTime(bars, key, day).as_of(until), key, day), key, day, most)


def run_cycle(bars: DataFrame, until: str, end: str, threshold: float = 0.5, key: str = "ticker", day: str = "date", most: int = 2000) -> DataFrame:
    """C17: calibrated up to ``until``, tested from there to ``end``: one report for each key."""
    views = filter_all(bars, calibrate(bars, until, key, day, most), key, day)
    return B.report(B.backtest(views, position(threshold), until, end, key=key, day=day), key)


def run_trials(bars: DataFrame, params: DataFrame, start: str, end: str, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7), key: str = "ticker", day: str = "date") -> DataFrame:
    """One fit, several thresholds: the best of them, and what is left of it after counting the trials."""
    views = filter_all(bars, params, key, day).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    days = B.backtest(views, position(F.col("threshold")), start, end, B.BPS, key, day, "threshold")
    return B.trials(days, key, "threshold")

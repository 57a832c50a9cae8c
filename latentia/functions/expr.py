"""Scalar expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))")


def moment(text: str) -> Column:
    """Microseconds of a literal date or time."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST('{text}' AS TIMESTAMP_NTZ))")


def bin_of(us: Column, width: int, offset: int = 0) -> Column:
    """Left-closed bins anchored at the epoch plus offset."""
    return F.floor((us - offset) / width).cast("long")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def not_negative(x: Column) -> Column:
    """Negative, NaN and null become 0."""
    return F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def day_of(us: Column) -> Column:
    return F.floor(us / DAY).cast("long")


def period(us: Column, event: str, days: int = 4) -> Column:
    """pre, during (from the event for some days), post."""
    e = moment(event)
    return F.when(us < e, "pre").when(us < e + days * DAY, "during").otherwise("post")


def phase(us: Column, event: str) -> Column:
    """pre, early (4 days from the event), late (the 6 after those); null beyond."""
    e = moment(event)
    return F.when(us < e, "pre").when(us < e + 4 * DAY, "early").when(us < e + 10 * DAY, "late")


def day_between(us: Column, first: str, last: str) -> Column:
    """Whole days, both included."""
    return (us >= moment(first)) & (us < moment(last) + DAY)


def half_open(us: Column, first: str, end: str) -> Column:
    return (us >= moment(first)) & (us < moment(end) + DAY)


def closed(us: Column, first: str, end: str) -> Column:
    """Both ends included: a tick at the midnight that ends the last day belongs to it."""
    return us.between(moment(first), moment(end) + DAY)


def require(ok: Column, message: str, value: Column) -> Column:
    """value where ok, else an error that stops the query."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def chi2_gate(alarms_per_day: float, steps_per_day: int) -> tuple[float, float]:
    """(alpha, threshold) of a chi-squared gate with one degree of freedom."""
    alpha = alarms_per_day / steps_per_day
    return alpha, NormalDist().inv_cdf(1 - alpha / 2) ** 2


def normal_gate(n: int) -> float:
    """Threshold that one of n standard normal values passes on average."""
    return NormalDist().inv_cdf(1 - 1 / n)


def horizon(q: list[list[float]]) -> tuple[float, list[float], list[float]]:
    """Expected sojourn of a transient block: (H, sojourn from each state, quasi-stationary weights)."""
    import numpy as np

    m = np.array(q)
    sojourn = np.linalg.solve(np.eye(len(m)) - m, np.ones(len(m)))
    values, left = np.linalg.eig(m.T)
    w = np.abs(np.real(left[:, int(np.argmax(np.abs(values)))]))
    w /= w.sum()
    return float(w @ sojourn), sojourn.tolist(), w.tolist()


def horizon_of(pi: Column, states: Column) -> Column:
    """struct(h, sojourn, weights) of one or two transient states (0-based numbers) as expressions, null for more or none.

    Two states a, b: sojourns solve (I - Q) s = 1 by Cramer's rule; the weights are the left eigenvector of the larger
    eigenvalue, from whichever of its two equations has more weight.
    """
    at = lambda i, j: F.get(F.get(pi, F.get(states, F.lit(i))), F.get(states, F.lit(j)))
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 - x is worked out once, however often f names it

    def two(q: Column) -> Column:
        det = (1 - q["aa"]) * (1 - q["bb"]) - q["ab"] * q["ba"]
        sojourn = F.array((1 - q["bb"] + q["ab"]) / det, (1 - q["aa"] + q["ba"]) / det)
        top = (q["aa"] + q["bb"] + F.sqrt((q["aa"] - q["bb"]) * (q["aa"] - q["bb"]) + 4 * q["ab"] * q["ba"])) / 2
        equations = lambda t: F.greatest(F.struct((q["ba"] + t - q["aa"]).alias("w"), F.array(q["ba"], t - q["aa"]).alias("v")), F.struct((t - q["bb"] + q["ab"]).alias("w"), F.array(t - q["bb"], q["ab"]).alias("v")))
        weights = once(once(top, equations), lambda e: F.when(e["w"] > 0, F.transform(e["v"], lambda v: v / e["w"])).otherwise(F.array(F.lit(0.5), F.lit(0.5))))
        return once(F.struct(sojourn.alias("s"), weights.alias("w")), lambda x: F.struct((x["w"][0] * x["s"][0] + x["w"][1] * x["s"][1]).alias("h"), x["s"].alias("sojourn"), x["w"].alias("weights")))

    block = F.struct(at(0, 0).alias("aa"), at(0, 1).alias("ab"), at(1, 0).alias("ba"), at(1, 1).alias("bb"))
    alone = 1 / (1 - at(0, 0))
    one = F.struct(alone.alias("h"), F.array(alone).alias("sojourn"), F.array(F.lit(1.0)).alias("weights"))
    return F.when(F.size(states) == 1, one).when(F.size(states) == 2, once(block, two))


MU1 = math.sqrt(2 / math.pi)

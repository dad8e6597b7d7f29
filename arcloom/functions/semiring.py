"""Weights as costs (-ln p): columns of the log and tropical semirings.

Zero (no path) is +inf, One is 0, both times are sums; plus is the log-sum of
probabilities or the least cost.  Vector weights are structs (kind, weight,
features).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = math.inf
ONE = 0.0
NO_WEIGHT = math.nan


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def log_plus(a: Column, b: Column) -> Column:
    """Cost of either of two events: -ln(exp(-a) + exp(-b))."""
    near, far = F.least(a, b), F.greatest(a, b)
    return F.when(far == math.inf, near).otherwise(near - F.log1p(F.exp(near - far)))


def plus(semiring: str) -> Callable[[Column, Column], Column]:
    return {"log": log_plus, "tropical": lambda a, b: F.least(a, b)}[semiring]


def log_sum(costs: Column) -> Column:
    """Cost of any of the events of an array of costs; of none, Zero."""
    return let(
        F.coalesce(F.array_min(costs), F.lit(math.inf)),
        lambda least: F.when(least == math.inf, least).otherwise(
            least - F.log(F.aggregate(costs, F.lit(0.0), lambda s, c: s + F.exp(least - c)))
        ),
    )


def add_log(a: Column, b: Column) -> Column:
    """ln(e**a + e**b) of log-probabilities."""
    return -log_plus(-a, -b)


def sub_log(a: Column, b: Column) -> Column:
    """ln(e**a - e**b) of log-probabilities, a >= b; equal ones give -inf."""
    return F.when(b == -math.inf, a).when(a == b, F.lit(-math.inf)).otherwise(a + F.log1p(-F.exp(b - a)))


def change_base(value: Column, base: Column | float) -> Column:
    return value * F.log(base if isinstance(base, Column) else F.lit(float(base)))


def probability(cost: Column) -> Column:
    return F.exp(-cost)


def power_scale(cost: Column, k: float) -> Column:
    return F.when(cost == math.inf, cost).otherwise(cost * k)


def without_weight(cost: Column) -> Column:
    return F.when(cost == math.inf, cost).otherwise(F.lit(0.0))


def is_member(cost: Column) -> Column:
    return ~F.isnan(cost) & (cost != -math.inf)


def entropy_term(cost: Column, forward: Column) -> Column:
    """p ln p of an arc weighted by the mass that reaches it; 0 for Zero and non-members."""
    return F.when((cost < math.inf) & is_member(cost), -cost * F.exp(-cost - forward)).otherwise(F.lit(0.0))


# Vector weights: struct<kind: string, weight: double, features: array<double>>,
# kind one of ZERO, ONE, NONE, OTHER.


def vector(weight: Column, features: Column) -> Column:
    return F.struct(F.lit("OTHER").alias("kind"), weight.alias("weight"), features.alias("features"))


def vector_constant(kind: str) -> Column:
    weight = {"ZERO": math.inf, "ONE": 0.0, "NONE": math.nan}[kind]
    return F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.array().cast("array<double>").alias("features"))


def vector_plus(a: Column, b: Column) -> Column:
    """The cheaper operand with its features; of equally cheap ones the second."""
    return F.when(a["weight"] < b["weight"], a).otherwise(b)


def vector_times(a: Column, b: Column) -> Column:
    absorbing = {"NONE": vector_constant("NONE"), "ZERO": vector_constant("ZERO")}
    return (
        F.when((a["kind"] == "NONE") | (b["kind"] == "NONE"), absorbing["NONE"])
        .when((a["kind"] == "ZERO") | (b["kind"] == "ZERO"), absorbing["ZERO"])
        .when(a["kind"] == "ONE", b)
        .when(b["kind"] == "ONE", a)
        .when(F.size(a["features"]) != F.size(b["features"]), absorbing["NONE"])
        .otherwise(vector(a["weight"] + b["weight"], F.zip_with(a["features"], b["features"], lambda x, y: x + y)))
    )


def vector_divide(a: Column, b: Column) -> Column:
    n = F.size(b["features"])
    padded = F.when(F.size(a["features"]) < n, resized(a["features"], n)).otherwise(a["features"])
    return (
        F.when(b["kind"] == "ONE", a)
        .when(b["kind"].isin("ZERO", "NONE") | (a["kind"] == "NONE"), vector_constant("NONE"))
        .when(a["kind"] == "ZERO", vector_constant("ZERO"))
        .otherwise(vector(a["weight"] - b["weight"], F.zip_with(padded, b["features"], lambda x, y: x - F.coalesce(y, F.lit(0.0)))))
    )


def resized(features: Column, n: Column) -> Column:
    """Padded with One, or cut, to n features."""
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(features), F.lit(0)))), F.lit(1), n)


def combined(features: Column, scales: Column) -> Column:
    """Sum of features times scales; a missing scale counts as 0."""
    return F.aggregate(F.zip_with(features, scales, lambda f, s: F.coalesce(f * s, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)


def vector_update(a: Column, scales: Column) -> Column:
    return F.when(a["kind"] == "OTHER", vector(combined(a["features"], scales), a["features"])).otherwise(a)


def vector_equal(a: Column, b: Column, delta: float = 0.0) -> Column:
    same = F.forall(F.zip_with(a["features"], b["features"], lambda x, y: F.coalesce(F.abs(x - y) <= delta, F.lit(False))), lambda s: s)
    other = (a["kind"] == "OTHER") & (b["kind"] == "OTHER")
    return F.when(other, (F.abs(a["weight"] - b["weight"]) <= delta) & same).otherwise(a["kind"] == b["kind"])


def vector_member(a: Column) -> Column:
    return (a["kind"] != "NONE") & is_member(a["weight"]) & F.forall(a["features"], is_member)


def vector_hash(a: Column) -> Column:
    return F.xxhash64(a["kind"], a["weight"], a["features"])


def vector_quantize(a: Column, digits: int) -> Column:
    return F.when(a["kind"] == "OTHER", vector(F.round(a["weight"], digits), F.transform(a["features"], lambda f: F.round(f, digits)))).otherwise(a)


def vector_text(a: Column) -> Column:
    shown = F.concat_ws(",", F.array(a["weight"].cast("string")), F.transform(a["features"], lambda f: f.cast("string")))
    return F.when(a["kind"] == "OTHER", shown).otherwise(a["kind"])

"""Column expressions on numbers: guards, ratios, rewards, losses, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, or 0.0 where d is not positive: the rate of nothing is zero."""
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))


def share(condition: Column) -> Column:
    """Aggregate: share of all rows that meet a condition, 0.0 without rows."""
    return safe_ratio(F.count_if(condition), F.count(F.lit(1)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over the rows that have both sides, null for a constant side or fewer than two of them."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((F.count_if(both) >= 2) & (sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def slope(y: Column, x: Column) -> tuple[Column, Column]:
    """Aggregates: least-squares slope and intercept, null for a constant x."""
    ok = F.var_pop(x) > 0
    b = F.when(ok, F.covar_pop(x, y) / F.var_pop(x))
    return b, F.avg(y) - b * F.avg(x)


def reliability_weight(std: Column, floor: float = 5.6) -> Column:
    return F.lit(1.0) / F.greatest(std, F.lit(floor))


def closeness(value: Column, target: Column, tolerance: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(value - target) / F.lit(tolerance))


def effective_sigma(std: Column, n: Column, total: int, unknown: float) -> Column:
    """The spread to weigh by: the worst one known where one of several members answered."""
    return F.when((n == 1) & F.lit(total > 1), F.lit(unknown)).otherwise(F.greatest(F.lit(0.0), std))


def target_reward(value: Column, std: Column, target: Column, n: Column, total: int, tolerance: float = 100.0, sigma0: float = 20.0, unknown: float = 45.2) -> dict[str, Column]:
    """closeness, confidence, value, gated and reason of a prediction against its target."""
    none = n == 0
    bad = ~(is_finite(value) & is_finite(std) & is_finite(target))
    near = closeness(value, target, tolerance)
    coverage = n / F.lit(float(total))
    trust = coverage * (F.lit(1.0) / (F.lit(1.0) + effective_sigma(std, n, total, unknown) / F.lit(sigma0)))
    zero = F.lit(0.0)
    return {
        "closeness": F.when(none | bad, zero).otherwise(near),
        "confidence": F.when(none | bad, zero).otherwise(trust),
        "value": F.when(none | bad, zero).otherwise(near * trust),
        "gated": none | bad,
        "reason": F.when(none, F.lit("no_contributing_members")).when(bad, F.lit("non_finite")),
    }


def k3(ref: Column, logp: Column, bound: float = 20.0) -> Column:
    """exp(x) - x - 1 of the clamped log ratio: a KL estimate that is never negative."""
    x = F.greatest(F.lit(-bound), F.least(F.lit(bound), ref - logp))
    return F.exp(x) - x - F.lit(1.0)


def clipped_surrogate(ratio: Column, advantage: Column, eps: float = 0.2) -> Column:
    return -F.least(ratio * advantage, F.greatest(F.lit(1 - eps), F.least(F.lit(1 + eps), ratio)) * advantage)


def huber(error: Column, delta: float = 1.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, F.lit(0.5) * error * error).otherwise(F.lit(delta) * (a - F.lit(0.5 * delta)))


def length_penalty(total: Column, length: Column, alpha: float) -> Column:
    return total / F.pow(F.greatest(length, F.lit(1)).cast("double"), F.lit(alpha))


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    return F.when(seen, F.when(logit < 0, logit * penalty).otherwise(logit / penalty)).otherwise(logit)


def learning_rate(name: str, step: Column, total: int, warmup: int, cycles: float = 0.5) -> Column:
    """Factor on the base rate at an optimiser step: linear warm-up, then as the name says."""
    s = step.cast("double")
    timescale = warmup or 10000
    if name == "constant":
        after: Column = F.lit(1.0)
    elif name == "linear":
        after = F.greatest(F.lit(0.0), (F.lit(float(total)) - s) / F.lit(float(max(1, total - warmup))))
    elif name == "inverse_sqrt":
        after = F.sqrt(F.lit(float(timescale)) / F.greatest(s, F.lit(float(timescale))))
    elif name == "cosine":
        done = F.least(F.lit(1.0), (s - F.lit(float(warmup))) / F.lit(float(max(1, total - warmup))))
        after = F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi * 2.0 * cycles) * done)))
    else:
        raise ValueError(f"unknown schedule {name!r}")
    return F.when(s < warmup, s / F.lit(float(max(1, warmup)))).otherwise(after)


def position_bucket(offset: Column, buckets: int = 32, far: int = 128, both: bool = True) -> Column:
    """Logarithmic bucket of a position difference: exact when near, shared when far."""
    half = buckets // 2 if both else buckets
    side = F.when(offset > 0, F.lit(half)).otherwise(F.lit(0)) if both else F.lit(0)
    distance = F.abs(offset) if both else F.greatest(-offset, F.lit(0))
    exact = half // 2
    scaled = F.ln(F.greatest(distance, F.lit(1)) / F.lit(float(exact))) / F.lit(math.log(far / exact)) * F.lit(float(half - exact))
    large = F.least(F.lit(exact) + F.floor(scaled + F.lit(1e-9)).cast("long"), F.lit(half - 1))
    return (side + F.when(distance < exact, distance).otherwise(large)).cast("long")


def parameter_count(c: dict[str, Column]) -> Column:
    """Parameters of an encoder-decoder from its sizes (d_model, d_kv, heads, d_ff, layers,
    decoder_layers, vocab, buckets, gated, tied)."""
    inner = c["heads"] * c["d_kv"]
    attention = F.lit(4) * c["d_model"] * inner
    feed = F.when(c["gated"], F.lit(3)).otherwise(F.lit(2)) * c["d_model"] * c["d_ff"]
    bias = c["buckets"] * c["heads"]
    encoder = c["layers"] * (attention + feed + F.lit(2) * c["d_model"]) + bias + c["d_model"]
    decoder = c["decoder_layers"] * (F.lit(2) * attention + feed + F.lit(3) * c["d_model"]) + bias + c["d_model"]
    return c["vocab"] * c["d_model"] * F.when(c["tied"], F.lit(1)).otherwise(F.lit(2)) + encoder + decoder


def step_budget(n: Column, batch: int, accumulate: int, epochs: int) -> Column:
    return (F.ceil(F.ceil(n / F.lit(batch)) / F.lit(accumulate)) * F.lit(epochs)).cast("long")


def verdict(delta: Column, margin: Column, low: Column, same_sampling: Column) -> Column:
    """True if the gain reaches its margin and its interval lies above zero; null (not false) when
    anything is unmeasured or the arms were sampled differently."""
    known = delta.isNotNull() & margin.isNotNull() & low.isNotNull() & F.coalesce(same_sampling, F.lit(False))
    return F.when(known, (delta >= margin) & (low > 0))


def all_measured(*clauses: Column) -> Column:
    """Three-valued AND that is null as soon as a clause is, even beside a false one."""
    unknown = clauses[0].isNull()
    both = clauses[0]
    for c in clauses[1:]:
        unknown, both = unknown | c.isNull(), both & c
    return F.when(~unknown, both)

"""Column expressions over arrays of doubles: softmax, losses, combinations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clamps of the teacher's log mean and of the evaluation's likelihood.
TEACHER_EPS, EVAL_EPS = 1e-9, 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """exp(z / T) normalised, the largest taken out first. Give a plain column: it is read more than once."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = F.transform(logits, lambda z: F.exp((z - F.array_max(logits)) / t))
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / total(p)))[0]


def argmax(values: Column) -> Column:
    """Index (from 0) of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def nll_at(logits: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    """Negative log-likelihood of the label by log-sum-exp, without a clamp."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    return F.log(total(F.transform(logits, lambda z: F.exp((z - top) / t)))) - (F.get(logits, label) - top) / t


def nll(probs: Column, label: Column) -> Column:
    return -F.log(F.greatest(F.get(probs, label), F.lit(EVAL_EPS)))


def brier(probs: Column, label: Column) -> Column:
    """The sum over classes of squared differences to the one-hot label."""
    return F.aggregate(F.transform(probs, lambda p, i: (p - (i == label).cast("double")) * (p - (i == label).cast("double"))), F.lit(0.0), lambda a, v: a + v)


def expected_level(probs: Column) -> Column:
    return total(F.transform(probs, lambda p, i: p * i))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def normalised(values: Column) -> Column:
    return F.transform(F.array(values), lambda v: F.transform(v, lambda x: x / total(v)))[0]


def cyclic_combine(by_layout: Column) -> Column:
    """Distributions of one question in key order, one a layout: exp of the mean of log max(p, eps), normalised."""
    keys = F.sequence(F.lit(0), F.size(by_layout[0]) - 1)
    means = F.transform(keys, lambda k: total(F.transform(by_layout, lambda p: F.log(F.greatest(F.get(p, k), F.lit(TEACHER_EPS))))) / F.size(by_layout))
    return softmax(means)


def restricted(logprobs: Column) -> Column:
    """struct(probs, mass): softmax over the label log-probabilities, and what they are of the whole vocabulary."""
    return F.struct(softmax(logprobs).alias("probs"), total(F.transform(logprobs, F.exp)).alias("mass"))


def blend(keys: Column, gold: Column, teacher: Column, gold_weight: float = 0.5) -> Column:
    """Target in key order: weight on the gold key, the rest by the teacher's map; one-hot without a teacher."""
    w = float(gold_weight)
    return F.transform(keys, lambda k: F.when(teacher.isNull(), (k == gold).cast("double")).otherwise(w * (k == gold).cast("double") + (1 - w) * F.try_element_at(teacher, k)))


def soft_ce(logits: Column, target: Column) -> Column:
    top = F.array_max(logits)
    norm = F.log(total(F.transform(logits, lambda z: F.exp(z - top)))) + top
    return -total(F.zip_with(logits, target, lambda z, t: t * (z - norm)))


def temperature_grid(low: float = 0.25, high: float = 4.0, points: int = 121) -> list[float]:
    """Log-spaced temperatures."""
    a, step = math.log(low), (math.log(high) - math.log(low)) / (points - 1)
    return [math.exp(a + step * i) for i in range(points)]

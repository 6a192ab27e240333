"""The order in which training reads its records: a keyed permutation for each epoch, without a sort.

A row's number is taken through a Feistel network over two digits whose ranges multiply to a little more than the
number of rows; what lands beyond is taken through again until it lands inside. That is one to one for every
key, so each epoch is a permutation, any row's place is known from its number alone, and a run goes on from
any step without what came before.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.store import numbered

#: A prime under 2^31: products of two remainders fit a long. Rounds of the network; times that a number is taken through at most.
PRIME, ROUNDS, WALK = 2_147_483_647, 6, 64
#: The one-cycle schedule's first rate is the largest one over START, its last one the first over END.
START, END = 25.0, 1e4


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """Two numbers from 1 to 2^28 for each round."""
    digits = [hashlib.sha256(f"{seed}:epoch:{epoch}:{k}".encode()).hexdigest() for k in range(ROUNDS)]
    return [(int(d[:7], 16) + 1, int(d[7:14], 16) + 1) for d in digits]


def digit_ranges(n: int) -> tuple[int, int]:
    """Two ranges, nearly equal, whose product is n or a little more."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-max(n, 1) // a)


def _through(x: Column, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    """x, from 0 to a * b - 1, through all rounds: in turn one digit moves by a mixed value of the other."""
    pair = F.struct(F.floor(x / F.lit(b)).cast("long").alias("left"), (x % F.lit(b)).alias("right"))
    steps = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(m).cast("long").alias("m"), F.lit(j % 2 == 0).alias("first")) for j, (k, m) in enumerate(keys)))

    def move(d: Column, s: Column) -> Column:
        by = F.when(s["first"], d["right"]).otherwise(d["left"]) + s["k"]
        square = (by * by) % F.lit(PRIME)
        mixed = (square * s["m"] + by) % F.lit(PRIME)
        return F.struct(F.when(s["first"], (d["left"] + mixed) % F.lit(a)).otherwise(d["left"]).alias("left"), F.when(s["first"], d["right"]).otherwise((d["right"] + mixed) % F.lit(b)).alias("right"))

    return F.aggregate(steps, pair, move, lambda d: d["left"] * F.lit(b) + d["right"])


def permuted(number: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of a row's number (0 to n - 1) in the epoch's order: one to one.

    n is under 2^60. A number can only leave the range as often as there are places beyond n; of many rows, where these
    are a share of one in sqrt(n), WALK times are never reached, and an error would tell.
    """
    if not 0 <= n < 1 << 60:
        raise ValueError("under 2^60 rows")
    a, b = digit_ranges(n)
    keys = round_keys(seed, epoch)
    x = _through(number.cast("long"), a, b, keys)
    beyond = a * b - n
    if not beyond:
        return x
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(beyond, WALK))), x, lambda v, _: F.when(v < n, v).otherwise(_through(v, a, b, keys)))
    return F.transform(F.array(walked), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a row without a place")).cast("long")))[0]


def one_cycle(step: Column, total: int, top: float, rising: float) -> Column:
    """The learning rate of a step (from 0) of the one-cycle schedule: up to `top` over the share `rising` of all steps, then down, both along a cosine."""
    low = top / START
    peak, last = rising * total - 1, total - 1
    curve = lambda begin, end, share: F.lit(end) + F.lit((begin - end) / 2) * (1 + F.cos(F.lit(math.pi) * share))
    up = curve(low, top, step / F.lit(peak)) if peak > 0 else F.lit(top)
    return F.when(step <= F.lit(peak), up).otherwise(curve(top, low / END, (step - F.lit(peak)) / F.lit(float(last - peak) or 1.0)))


def epoch_plan(records: DataFrame, *order: str, epochs: int, accumulation: int, seed: int, top_rate: float = 1e-4, rising: float = 0.1, from_step: int = 0) -> DataFrame:
    """A row for each record and epoch: the columns of order, epoch, position, step, slot, weight and rate.

    Records are numbered in the order given, which makes them distinct; position is the place in the epoch, step the optimizer step
    over all epochs, slot the place among the records that the step accumulates, weight what each adds to the mean (an
    epoch's last step may hold fewer). With from_step only what is left from that step on. No records, no rows.
    """
    if accumulation < 1 or epochs < 1:
        raise ValueError("one epoch and one record a step at least")
    own = numbered(records.select(*(F.col(f"`{c}`") for c in order)), *order, name="__number")
    n = own.count()
    steps = -(-n // accumulation)
    places = F.array(*(F.struct(F.lit(e).alias("epoch"), permuted(F.col("__number"), n, seed, e).alias("position")) for e in range(epochs)))
    rows = own.select(*(F.col(f"`{c}`") for c in order), F.inline(places))
    within = F.floor(F.col("position") / F.lit(accumulation)).cast("long")
    rows = rows.withColumns({"step": F.col("epoch") * F.lit(steps) + within, "slot": (F.col("position") % F.lit(accumulation)).cast("int"), "weight": 1 / F.least(F.lit(accumulation), F.lit(n) - within * F.lit(accumulation))})
    rows = rows.withColumn("rate", one_cycle(F.col("step"), max(1, epochs * steps), top_rate, rising))
    return rows.where(F.col("step") >= F.lit(from_step)) if from_step else rows

"""Vectors as whole numbers: the columns and matrices that the exact operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components are whole numbers under this; a vector with a larger one takes no part.
LARGEST = 2.0**58
#: The largest number that a long holds.
LONG = (1 << 63) - 1


def whole(vec: Column, scale: int, plus: int = 0) -> Column:
    """floor(scale * c) + plus of each component c, as double, in an array of longs; null if the vector is null, holds a null or
    non-finite component or one that is LARGEST or more when scaled."""
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < F.lit(LARGEST)))
    return F.when(v.isNotNull() & fine, F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(plus)))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equally many longs as the rows of a matrix."""
    offsets = lists.offsets.to_numpy()
    width = int(offsets[1] - offsets[0]) if len(lists) else 0
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(lists), width)


def largest(x: np.ndarray) -> int:
    """The largest absolute value; of nothing: 0."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def holding(x: np.ndarray, bound: int) -> np.ndarray:
    """x in the fastest kind of number that holds all whole numbers up to bound: doubles, longs, or Python's own."""
    return x.astype(np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object)

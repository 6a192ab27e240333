"""The scorer interface: records in, logits out, in Arrow batches; a model is loaded once a task."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """load() runs once in each task; score() gives a logit for each key of each row."""

    def load(self) -> None: ...

    def score(self, states: list[str], keys: list[list[str]]) -> list[list[float]]: ...


class MarkerScorer:
    """Characters that mark a language, scaled by length; keys without markers have a constant."""

    def __init__(self, markers: dict[str, str], scale: float, constant: float):
        self.markers, self.scale, self.constant = markers, scale, constant

    def load(self) -> None:
        self.sets = {k: set(v) for k, v in self.markers.items()}

    def score(self, states: list[str], keys: list[list[str]]) -> list[list[float]]:
        out = []
        for text, own in zip(states, keys, strict=True):
            low = (text or "").lower()
            counts = {k: sum(c in marks for c in low) for k, marks in self.sets.items()}
            out.append([self.scale * counts[k] / max(1, len(low)) if k in counts else self.constant for k in own])
        return out


class PositionBiased:
    """A scorer for tests: another scorer's logits and a bias by place."""

    def __init__(self, inner: Scorer, bias: list[float]):
        self.inner, self.bias = inner, bias

    def load(self) -> None:
        self.inner.load()

    def score(self, states: list[str], keys: list[list[str]]) -> list[list[float]]:
        return [(np.array(z) + self.bias[: len(z)]).tolist() for z in self.inner.score(states, keys)]


def score(records: DataFrame, scorer: Scorer, state: str = "state", keys: str = "keys", by_length: bool = True) -> DataFrame:
    """records with logits. by_length: each task's rows sorted by length, so that batches hold like sizes."""
    rows = records.sortWithinPartitions(F.length(state)) if by_length else records
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.load()
        for batch in batches:
            yield batch.assign(logits=scorer.score(batch[state].tolist(), [list(k) for k in batch[keys]]))

    return rows.mapInPandas(run, f"{fields}, logits array<double>")

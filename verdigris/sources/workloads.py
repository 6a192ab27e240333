"""Requests whose states have an exact number of tokens, by a tokenizer's own count."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Profiles of requests: tokens of the state with its delimiter, and questions.
PROFILES = {"state128_q1": (128, 1), "state512_q8": (512, 8), "state2048_q32": (2048, 32)}
#: What a filler text is made of.
FILLER = ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel")
#: Characters around the first cut that are tried; words that may be put behind a cut.
NEAR, BEHIND = 64, 8
#: States that a task makes.
PER_TASK = 1024


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already share the cores
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def token_counter(path: str) -> Callable[[str], int]:
    """Tokens of a text, by a tokenizer's file."""
    return lambda text: len(_tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0])  # without offsets


def token_ends(path: str, text: str) -> list[int]:
    """Where each token of the text ends, in characters."""
    return [end for _, end in _tokenizer(path).encode(text, add_special_tokens=False).offsets]


def exact_prefix(text: str, n: int, count: Callable[[str], int], first: int | None = None) -> str | None:
    """A beginning of the text, with a few words behind it if need be, that has exactly n tokens; None if there is none.

    The number of tokens of a beginning mostly, not always, grows with it: where a cut parts or joins tokens the one before
    changes too. So a cut is looked for by bisection (or begun at `first`), then around it, and what is still missing is put behind.
    """
    if n == 0:
        return ""
    low, high = 0, len(text)
    if first is not None and count(text[:first]) == n:
        return text[:first]
    if count(text) < n:
        return None
    while low < high:
        middle = (low + high) // 2
        if count(text[:middle]) < n:
            low = middle + 1
        else:
            high = middle
    near = sorted(range(max(0, low - NEAR), min(len(text), low + NEAR) + 1), key=lambda k: abs(k - low))
    for cut in near:
        if count(text[:cut]) == n:
            return text[:cut]
    for cut in near:
        longer = text[:cut]
        for k in range(BEHIND):
            longer += f" {FILLER[k % len(FILLER)]}"
            if count(longer) == n:
                return longer
    return None


@lru_cache(maxsize=4096)
def _size(path: str, part: str) -> int:
    return token_counter(path)(f" {part}")


def _grown(begin: str, parts: Sequence[str], turn: int, n: int, path: str) -> str:
    """begin and the parts in turn, from the one numbered turn on, cut to exactly n tokens."""
    count, text, k, ends = token_counter(path), begin, turn, token_ends(path, begin)
    while len(ends) < n:
        added, missing = [], n - len(ends)
        while missing > 0:  # by the parts' own sizes; joined they may have fewer
            added.append(f" {parts[k % len(parts)]}")
            missing -= max(1, _size(path, parts[k % len(parts)]))
            k += 1
        text += "".join(added)
        ends = token_ends(path, text)
    found = exact_prefix(text, n, count, ends[n - 1] if n else 0)
    if found is None:
        raise ValueError(f"no text of {n} tokens begins with {begin!r}")
    return found


@lru_cache(maxsize=4096)
def _tail(parts: tuple[str, ...], turn: int, n: int, path: str) -> str | None:
    """The parts in turn cut to n tokens, as they follow any beginning; None if there is no such text."""
    try:
        return _grown("", parts, turn, n, path)
    except ValueError:
        return None


def _state(begin: str, parts: tuple[str, ...], turn: int, n: int, path: str) -> str:
    """As _grown. Beginnings of as many tokens share what follows them, where the whole text then has n tokens; else it is cut by itself."""
    count = token_counter(path)
    missing = n - count(begin)
    if missing > 0:
        tail = _tail(parts, turn % len(parts), missing, path)
        if tail is not None and count(begin + tail) == n:
            return begin + tail
    return _grown(begin, parts, turn, n, path)


def filler(n: int, path: str) -> str:
    """A text of exactly n tokens."""
    return _grown(FILLER[0], FILLER, 1, n, path)


def exact_states(number: Column, size: Column, sentences: Sequence[str], path: str) -> Column:
    """For each row a state of exactly `size` tokens: a ticket number, and the sentences in turn from the ticket's own on. Null size: null."""

    told = tuple(sentences)

    @F.pandas_udf("string")
    def states(numbers: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(n) else _state(f"Ticket {1000 + int(i)}.", told, int(i), int(n), path) for i, n in zip(numbers, sizes, strict=True)], dtype=object)

    return states(number, size)


def counted(text: Column, path: str) -> Column:
    """The tokens of a text; null: null."""

    @F.pandas_udf("long")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = token_counter(path)
        for part in texts:
            yield part.map(lambda t: None if t is None else count(t)).astype("Int64")

    return counts(text)


def profiled(rows: DataFrame, number: str, sentences: Sequence[str], path: str, profiles: dict[str, tuple[int, int]] = PROFILES) -> DataFrame:
    """A request of each profile for each row: number, profile, questions and state, which with its delimiter has the profile's tokens."""
    each = F.array(*(F.struct(F.lit(name).alias("profile"), F.lit(size).alias("tokens"), F.lit(asked).alias("questions")) for name, (size, asked) in profiles.items()))
    # A row is much work, of however few bytes: by a given number of parts, which adaptive execution doesn't merge.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * len(profiles) // PER_TASK))
    out = rows.select(F.col(number), F.inline(each)).repartition(parts, number, "profile")
    return out.select(number, "profile", "questions", exact_states(F.col(number), F.col("tokens") - 1, sentences, path).alias("state"))

"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: lower case, look-alike letters of other scripts to Latin ones, digits and signs that stand for letters
to those letters where a letter is beside them, everything else that is no letter to a space. The lexicon
holds word beginnings (a whole word ends in a space) with weights: the log odds of the beginning in toxic
against other documents, learned from labelled rows. Matches inside an exception phrase don't count. The
score is a logistic curve over the weighted matches, normalised by the document's length in words.

Fitting reads a bounded sample of the labelled rows (SAMPLE documents, drawn by a hash of the id); scoring
reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, stored, with_scores

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h", "г": "r", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
#: Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum line", "pond scum")
#: Documents of the fitting sample; documents that a lexicon entry must be in; letters of the shortest and the longest
#: beginning (whole words have any length).
SAMPLE, SUPPORT, SHORTEST, LONGEST = 20_000, 8, 5, 9
#: Entries with evidence that a fit may have, what reaches the driver; more are refused. A sample of SAMPLE documents has far fewer.
ENTRIES = 200_000
#: Entries that a task counts before it passes the counts on.
COUNTED = 200_000
#: An entry's log odds, less one and a half standard errors, must be over this.
LEAST_ODDS = 1.5

_TABLE = str.maketrans(HOMOGLYPHS | {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)})
_DIGIT = re.compile(r"(?<=[^\W\d_])[0134578]|[0134578@$!](?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Letters in lower case with single spaces between words, and one at either end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    text = _DIGIT.sub(lambda m: STANDS_FOR[m[0]], text)
    return f" {_OTHER.sub(' ', text).strip()} "


def _beginnings(words: set[str]) -> set[str]:
    """The beginnings of words that can be lexicon entries; a whole word ends in a space."""
    found = set()
    for w in words:
        found.add(f"{w} ")
        found.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return found


def _count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (entry, in toxic documents, in others): partial sums, passed on whenever there are COUNTED of them."""
    toxic, other = Counter(), Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        names = list(toxic.keys() | other.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[e] for e in part], pa.int64()), pa.array([other[e] for e in part], pa.int64())], names=["entry", "toxic", "other"])
        toxic.clear()
        other.clear()

    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1), strict=True):
            (toxic if label.as_py() else other).update(_beginnings(set(fold(text.as_py() or "").split())))
            if len(toxic) + len(other) > COUNTED:
                yield from flushed()
    yield from flushed()


def _choose(entries: list[tuple[str, float]]) -> dict[str, float]:
    """Entries and weights (log odds) of those given, the surest first; one that begins like a chosen entry must be much heavier than it."""
    chosen: dict[str, float] = {}
    for entry, odds in entries:
        if any(entry[:k] in chosen and odds < chosen[entry[:k]] + 1 for k in range(SHORTEST, len(entry))):
            continue
        chosen[entry] = odds
    return chosen


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    """Of the entries and the exception phrases, each after a space."""
    found = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        found.add_word(f" {entry}", (len(entry), weight))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 1, None))
    found.make_automaton()
    return found


def matched(text: str, machine: ahocorasick.Automaton) -> tuple[float, int, int]:
    """Of a text: the weights of its lexicon words, how many they are, and the words in all.

    A word counts once, by its heaviest entry; a word inside an exception phrase doesn't count.
    """
    folded = fold(text)
    words = folded.count(" ") - 1
    if words < 1 or folded == "  ":
        return 0.0, 0, 0
    best: dict[int, float] = {}
    spared = []
    if len(machine):
        for end, (size, weight) in machine.iter(folded):
            start = end - size
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    hits = [w for at, w in best.items() if not any(a <= at < b for a, b in spared)]
    return sum(hits), len(hits), words


def _features(weight: float, hits: int, words: int) -> tuple[float, float, float]:
    """Weighted matches a hundred words, dampened; whether there is any; and the evidence beyond chance in a text of this length."""
    return math.log1p(100 * weight / (words + 20)), float(hits > 0), math.log1p(weight) - math.log1p(words / 50)


def _sample_features(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            rows = [_features(*matched(t or "", machine)) for t in batch.column(1).to_pylist()]
            cols = np.array(rows, float).reshape(len(rows), 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[:, k]) for k in range(3))], names=["toxic", "a", "b", "c"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (the last: intercept) by Newton's method with a ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(labelled: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """The model: lexicon, coefficients and exception phrases, from at most about `sample` documents that labels (id_col, label_col) has.

    Labels are one an id (the largest where they differ); null labels don't count. The sampled ids are the
    only thing broadcast, `sample` rows at most but for the hash's chance. The sampled texts are written
    once, as a table of that bounded size, and read by each step. All entries with evidence are taken; more than
    ENTRIES are refused with a ValueError. Words in an exception phrase don't count in fitting either.
    """
    ids = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__vg_id")).agg(F.max(label_col).alias("__vg_y"))
    found = ids.agg(F.count("*").alias("n")).first()["n"]
    if not found:
        return {"lexicon": {}, "coefficients": [0.0, 0.0, 0.0, -6.0], "exceptions": exceptions}
    drawn = ids.where(F.pmod(F.xxhash64("__vg_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample / found)))
    rows = labelled.select(F.col(f"`{id_col}`").alias("__vg_id"), F.col(f"`{text_col}`").alias("__vg_text")).join(F.broadcast(drawn), "__vg_id").select(F.col("__vg_y").cast("long"), "__vg_text")
    rows = stored(rows, compression="zstd")
    totals = {r["y"]: r["n"] for r in rows.groupBy((F.col("__vg_y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_other:
        return {"lexicon": {}, "coefficients": [0.0, 0.0, 0.0, 6.0 if n_toxic else -6.0], "exceptions": exceptions}
    counts = arrow_rows(rows, _count_beginnings, "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    least = max(3, min(SUPPORT, n_toxic // 20))
    t, o = F.col("t"), F.col("o")
    odds = F.log((t + 0.5) / (n_toxic - t + 0.5)) - F.log((o + 0.5) / (n_other - o + 0.5))
    sure = odds - 1.5 * F.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
    entries = counts.select("entry", "t", odds.alias("odds"), sure.alias("sure")).where((t >= least) & (F.col("sure") > LEAST_ODDS))
    known = entries.orderBy(F.desc(F.col("sure") * F.sqrt("t")), "entry").limit(ENTRIES + 1).collect()
    if len(known) > ENTRIES:
        raise ValueError(f"more than {ENTRIES} lexicon entries: fit on a smaller sample")
    lexicon = _choose([(r["entry"], r["odds"]) for r in known])
    seen = arrow_rows(rows, _sample_features(lexicon, exceptions), "toxic bigint, a double, b double, c double").toPandas()
    y = (seen["toxic"].to_numpy() > 0).astype(float)
    return {"lexicon": lexicon, "coefficients": logistic(seen[["a", "b", "c"]].to_numpy(), y).tolist(), "exceptions": exceptions}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Every row of docs: the columns in keep, toxic_score (0 to 1), toxic_hits and toxic_words.

    A null or empty text, or one without letters, scores as a text without matches. Repeated rows stay. Only
    the text goes to Python; the columns in keep stay in the JVM.
    """
    lexicon, coefficients, exceptions = model["lexicon"], np.array(model["coefficients"]), tuple(model.get("exceptions", EXCEPTIONS))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(lexicon, exceptions)
        for batch in texts:
            seen = [matched(t.as_py() or "", machine) for t in batch]
            x = np.array([_features(*s) for s in seen], float).reshape(len(seen), 3)
            z = np.clip(np.column_stack((x, np.ones(len(x)))) @ coefficients, -30, 30)
            yield pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-z))), pa.array([s[1] for s in seen], pa.int64()), pa.array([s[2] for s in seen], pa.int64())], names=["toxic_score", "toxic_hits", "toxic_words"])

    return with_scores(docs, run, "toxic_score double, toxic_hits long, toxic_words long", text_col, keep)

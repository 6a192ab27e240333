"""Language ID by error-correcting output codes.

Every language has a codeword of -1 and 1; one binary classifier over hashed character n-grams (1 to 3)
predicts each bit. A classifier is the log-likelihood ratio of an n-gram between the languages with bit 1 and
those with bit 0, so that training is one pass that sums n-gram shares by language, over all labelled rows.
Decoding is loss-weighted: the language whose codeword has the least exponential loss against the margins,
each bit weighted by how well it separates the training profiles; where the second is near the first, the
row is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, with_scores

#: Buckets of the hashed n-grams; characters worked on at once; relative loss gap under which a row is ambiguous.
BUCKETS, AT_ONCE, AMBIGUOUS = 4096, 1 << 20, 0.1
#: The prediction for a text that is null or has no letters.
UNKNOWN = "und"
#: Languages that a model can have: what reaches the driver is this times BUCKETS numbers at most.
LANGUAGES = 1024
_SPACE = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points of lower-case text with everything that is no letter as a space."""
    return np.where(_is_letter()[codes], codes, _SPACE)


def ngram_shares(texts: list[str]) -> np.ndarray:
    """For each text the shares of its 1- to 3-grams by bucket, a row of BUCKETS that sums to 1 (to 0 if empty).

    Texts are worked on together, up to AT_ONCE characters; a longer text alone, in pieces that are summed.
    """
    out = np.zeros((len(texts), BUCKETS))
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= AT_ONCE and to - at < 512:
            size += len(texts[to])
            to += 1
        for piece in range(0, max(1, len(texts[at])), AT_ONCE) if to == at + 1 else (0,):
            part = [texts[at][max(0, piece - 2) : piece + AT_ONCE]] if to == at + 1 else texts[at:to]
            out[at:to] += _counts(part)
        at = to
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0)


def _counts(texts: list[str]) -> np.ndarray:
    low = [f"{t.lower()}  " for t in texts]  # two spaces: no n-gram goes on into the next text
    joined, sizes = "".join(low), np.array([len(t) for t in low])
    codes = _letters(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * BUCKETS
    counts = np.zeros(len(texts) * BUCKETS)
    word = codes != _SPACE
    shift = np.uint32(32 - 12)
    h = codes * np.uint32(2654435761)
    seen = word
    for n in (1, 2, 3):
        if n > 1:
            if len(codes) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + codes[n - 1 :] * np.uint32(3266489917)
            seen = seen[:-1] & (word[n - 1 :] | word[n - 2 : len(word) - 1])  # a gram may end, not go on, in a space
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(668265263 + n)
        counts += np.bincount(owner[: len(h)][seen] + (mixed[seen] >> shift), minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS)


def codewords(n: int) -> np.ndarray:
    """An n x bits matrix of -1 and 1. Up to 6 languages: all ways to part them; more: of 200 random codes of
    10 log2 n bits, drawn by a fixed seed, the one with the largest least distance between two rows."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        return np.array([[1, *bits] for bits in itertools.product((-1, 1), repeat=n - 1)][:-1], float).T if n > 2 else np.array([[1.0], [-1.0]])
    rng, best, most = np.random.default_rng(20_240), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        same = code @ code.T - 2 * bits * np.eye(n)
        least = (bits - same.max()) / 2
        if least > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, least
    return best


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model from all rows of docs whose language isn't null and whose text has letters.

    Each document counts as one, however long. Every task gives a row for each language and bucket that it
    has met, which are summed: what reaches the driver is languages times BUCKETS numbers. A column with more
    than LANGUAGES values is refused with a ValueError: it holds no languages.
    """
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(langs), 256):
                shares = ngram_shares(texts[at : at + 256].to_pylist())
                own = np.array(langs[at : at + 256], dtype=object)
                for lang in dict.fromkeys(own):
                    sums[lang] = sums.get(lang, 0) + shares[own == lang].sum(axis=0)
            if len(sums) > LANGUAGES:
                raise ValueError(f"more than {LANGUAGES} languages")
        for lang, vector in sums.items():
            used = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(vector[used])], names=["lang", "bucket", "share"])

    summed = arrow_rows(rows, run, "lang string, bucket int, share double").groupBy("lang", "bucket").agg(F.sum("share").alias("share")).limit(LANGUAGES * BUCKETS + 1).toPandas()
    langs = sorted(summed["lang"].unique())
    if len(langs) > LANGUAGES or len(summed) > LANGUAGES * BUCKETS:
        raise ValueError(f"more than {LANGUAGES} languages")
    profiles = np.zeros((len(langs), BUCKETS))
    profiles[[langs.index(x) for x in summed["lang"]], summed["bucket"]] = summed["share"]
    return train(langs, profiles)


def train(langs: list[str], profiles: np.ndarray) -> dict:
    """Classifiers and bit weights from the summed n-gram shares of each language."""
    if not langs:
        return {"langs": [], "code": np.zeros((0, 0)), "weights": np.zeros((BUCKETS, 0)), "middle": np.zeros(0), "half": np.ones(0), "trust": np.ones(0)}
    code = codewords(len(langs))
    typical = profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1e-12)
    smooth = 1e-6
    weights = np.zeros((BUCKETS, code.shape[1]))
    middle, half = np.zeros(code.shape[1]), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = typical[code[:, b] > 0], typical[code[:, b] < 0]
        if not len(one) or not len(zero):
            continue
        weights[:, b] = np.log(one.mean(axis=0) + smooth) - np.log(zero.mean(axis=0) + smooth)
        least, most = (one @ weights[:, b]).min(), (zero @ weights[:, b]).max()
        middle[b], half[b] = (least + most) / 2, max(1e-3, (least - most) / 2)
    return {"langs": langs, "code": code, "weights": weights, "middle": middle, "half": half, "trust": half / half.sum()}


def decode(model: dict, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of n-gram shares the index of the language, its score and whether it is ambiguous."""
    margins = (shares @ model["weights"] - model["middle"]) / model["half"]
    loss = np.stack([(np.exp(-np.clip(margins * c, -3, 3)) * model["trust"]).sum(axis=1) for c in model["code"]], axis=1)
    best = loss.argmin(axis=1)
    odds = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    score = (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
    if loss.shape[1] < 2:
        return best, score, np.zeros(len(best), bool)
    first, second = np.partition(loss, 1, axis=1)[:, :2].T
    return best, score, (second - first) < AMBIGUOUS * second


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Every row: the columns in keep, lang_pred, score (0 to 1) and ambiguous.

    A null text or one without letters is `und` with score 0; so is every text if the model knows no
    language. Repeated rows stay. A tie goes to the language that sorts first.
    """
    names = np.array([*model["langs"], UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n = len(batch)
            pred, score, unsure = np.full(n, len(names) - 1), np.zeros(n), np.ones(n, bool)
            for at in range(0, n if len(names) > 1 else 0, 256):
                texts = batch.slice(at, 256).to_pylist()
                own = np.array([k for k, t in enumerate(texts) if t and has_letters(t)], int)
                if len(own):
                    pred[at + own], score[at + own], unsure[at + own] = decode(model, ngram_shares([texts[k] for k in own]))
            yield pa.StructArray.from_arrays([pa.array(names[pred], pa.string()), pa.array(score), pa.array(unsure)], names=["lang_pred", "score", "ambiguous"])

    return with_scores(docs, run, "lang_pred string, score double, ambiguous boolean", text_col, keep)

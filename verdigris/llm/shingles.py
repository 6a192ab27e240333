"""Word shingles of whole texts, hashed to 64 bits with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the mixing steps (splitmix64) and of the combination of words.
_A, _B, _WORD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def forget() -> None:
    """Gives up the words' hashes that are kept."""
    _hashes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long columns of hashes; their order counts."""
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), len(columns), np.uint64)
        for c in columns:
            out = mix(out * _WORD + c)
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased; words are parted by space and U+0009 to U+000D."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of `size` words, as sorted hashes; of fewer words the whole as one; of none: empty."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    if n < size:
        return combine([words[k : k + 1] for k in range(n)])
    return np.unique(combine([words[k : n - size + 1 + k] for k in range(size)]))


def digest(values: np.ndarray) -> bytes:
    """128 bits of a sorted set: sets with one digest are taken as equal."""
    return xxhash.xxh3_128_digest(values.tobytes())

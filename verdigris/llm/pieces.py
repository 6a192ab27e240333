"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The texts of a batch are cut into marked words (a leading space becomes the mark). The distinct new words are
sorted, which is a depth-first walk of their trie: the forward state of every prefix that a word shares with
the one before is reused, and only the characters below the branch are computed.

The vocabulary is a byte-pair one: its segmentation isn't the path of the largest sum of scores but the one
that merging by score reaches. A sequence of pieces is that one exactly if every piece and every pair of
neighbours is what merging makes of their own characters. So the forward step at a character keeps, of the pieces
that end there, the one that may follow the survivor at its start: there is one for every prefix, and the
state is that piece. Runs of spaces, whose pieces all have the same score, are merged directly.

A unigram vocabulary is encoded by the plain Viterbi pass: the state of a prefix is the best sum of scores that ends
there and the piece that it ends with. Other kinds of vocabularies are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows

MARK = "\u2581"
MODEL = "piece_bpe_32k.model"
#: Fixed values of the library's format: kinds of vocabularies; what an unknown character scores under the lowest score.
UNIGRAM, BYTE_PAIR, UNKNOWN_PENALTY = 1, 2, 10.0
#: Words whose ids a worker keeps, those met since the last turn and those of the turn before, and pairs of pieces.
KEPT_WORDS, KEPT_JOINS = 300_000, 300_000
#: Texts and bytes of text that are encoded together: the more, the more prefixes their new words share.
TOGETHER, TOGETHER_BYTES = 2048, 6 << 20
#: Characters from which a text is merged with a heap of pairs; shorter ones by trying all pairs, which is faster there.
LONG = 256
_RUN = re.compile(f"({MARK}*)([^{MARK}]*)")


def model_path(name: str = MODEL) -> str:
    """Where the installed public vocabularies have the file."""
    return public_tokenizers.path(name)


def message_fields(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(number, value, start, end) of each field of a protocol buffer message; value: of an integer field, else 0."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        start, value, size = at, 0, {1: 8, 5: 4}.get(tag & 7, 0)
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 2:
            size = varint()
            start = at
        at += size
        yield tag >> 3, value, start, at


def model_kind(data: bytes) -> int:
    """The vocabulary's kind in a serialised model: field 3 of the training settings, which are field 2; 1 if it isn't there."""
    kind = UNIGRAM
    for number, _, start, end in message_fields(data):
        if number == 2:
            for inner, value, _, _ in message_fields(data[start:end]):
                kind = value if inner == 3 else kind
    return kind


class Vocabulary:
    """Pieces, scores and the forward pass over words."""

    def __init__(self, path: str, kind: int | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind or model_kind(model.serialized_model_proto())
        if self.kind not in (UNIGRAM, BYTE_PAIR):
            raise ValueError("neither a unigram nor a byte-pair vocabulary")
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.ids, self.scores, self.byte_ids = {}, {}, [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on past the end of a word")
        if not all(self.byte_ids):
            raise ValueError("a vocabulary without a piece for every byte")
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.by_id = np.zeros(n)  # what an id adds to a text's sum of scores; of an unknown character's bytes the first one
        self.by_id[list(self.ids.values())] = [self.scores[p] for p in self.ids]
        self.by_id[[i for b, i in enumerate(self.byte_ids) if b & 0xC0 != 0x80]] = self.unknown
        self.feeds = any("\n" in p for p in self.ids)
        self.joins: dict[str, dict[str, bool]] = {}
        self.n_joins = 0
        self.whole: dict[str, bool] = {}
        self.packed: dict[str, bytes] = {}
        self.trie: dict = {}
        for piece in self.ids:
            place = self.trie
            for c in piece:
                place = place.setdefault(c, {})
            place[""] = piece
        if kind is None and list(model.encode("  a ", out_type=str)) != self.pieces_of(f"{MARK}{MARK}{MARK}a{MARK}"):
            raise ValueError("the model's normaliser is not the one expected: a mark in front, nothing else changed")

    def merge(self, text: str) -> list[str]:
        """What merging makes of the characters: the pair of neighbours with the largest score, the first such, again and again."""
        if len(text) > LONG:
            return self._merge_long(text)
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """merge() of a long text: pairs wait in a heap, parts are linked to their neighbours; a pair whose parts have changed is passed over."""
        parts: list[str] = list(text)
        n = len(parts)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.scores.get
        waiting = [(-found, k, 1, 1) for k in range(n - 1) if (found := score(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, k, left, right = heapq.heappop(waiting)
            to = after[k]
            if len(parts[k]) != left or to >= n or len(parts[to]) != right:
                continue
            parts[k] += parts[to]
            parts[to] = ""
            after[k] = to = after[to]
            if to < n:
                ahead[to] = k
                if (found := score(parts[k] + parts[to])) is not None:
                    heapq.heappush(waiting, (-found, k, len(parts[k]), len(parts[to])))
            if (back := ahead[k]) >= 0 and (found := score(parts[back] + parts[k])) is not None:
                heapq.heappush(waiting, (-found, back, len(parts[back]), len(parts[k])))
        return [p for p in parts if p]

    def merge_marks(self, n: int) -> list[str]:
        """merge() of n marks. Where all pieces of marks have one score, the first pair that is a piece merges first: a new mark can only merge with the part before it, and what that makes with the one before."""
        sizes = {len(p) for p in self.ids if p.strip(MARK) == ""}
        if n <= LONG or len({self.scores[MARK * k] for k in sizes if k > 1}) > 1:
            return self.merge(MARK * n)
        parts: list[int] = []
        for _ in range(n):
            last = 1
            while parts and parts[-1] + last in sizes:
                last += parts.pop()
            parts.append(last)
        return [MARK * k for k in parts]

    def _whole(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = len(piece) == 1 or self.merge(piece) == [piece]
        return found

    def _joins(self, left: str, right: str) -> bool:
        if self.n_joins > KEPT_JOINS:
            self.joins.clear()
            self.n_joins = 0
        self.n_joins += 1
        found = self.joins.setdefault(left, {})[right] = self.merge(left + right) == [left, right]
        return found

    def id_bytes(self, piece: str) -> bytes:
        """The piece's id as bytes of int32, or for a character that the vocabulary lacks the ids of its UTF-8 bytes."""
        found = self.packed.get(piece)
        if found is None:
            own = self.ids.get(piece)
            ids = [own] if own is not None else [self.byte_ids[b] for b in piece.encode()]
            found = self.packed[piece] = np.array(ids, np.int32).tobytes()
        return found

    def forward(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each of the sorted, distinct words, which hold no mark but at most one in front: its ids.

        By end of prefix: the surviving piece, and the places in the trie of pieces where a piece that began
        earlier in the word could go on.
        """
        survivors: list[str] = []
        open_at: list[list[tuple[int, dict]]] = []
        root, joins, packed = self.trie, self.joins, self.id_bytes
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):  # noqa: B905  the shorter ends it
                if a != b:
                    break
                shared += 1
            del survivors[shared:], open_at[shared:]
            going = open_at[-1] if open_at else []
            for end in range(shared, len(word)):
                c, best, on = word[end], "", []
                for start, place in (*going, (end, root)):  # the longest piece first
                    place = place.get(c)
                    if place is None:
                        continue
                    on.append((start, place))
                    if not best and (piece := place.get("")) and self._whole(piece):
                        if start == 0:
                            best = piece
                        else:
                            left = survivors[start - 1]
                            known = joins.get(left)
                            joined = known.get(piece) if known is not None else None
                            if self._joins(left, piece) if joined is None else joined:
                                best = piece
                survivors.append(best or c)
                open_at.append(on)
                going = on
            parts, end = [], len(word)
            while end:
                piece = survivors[end - 1]
                parts.append(packed(piece))
                end -= len(piece)
            parts.reverse()
            yield word, b"".join(parts)
            before = word

    def best(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """forward() of a unigram vocabulary: the pieces with the largest sum of scores; a tie goes to the longer last piece.

        Words may have several marks in front. A character without a piece scores `unknown`. Sums are in double
        precision and by word; the library, with single-precision sums of whole texts, may return a lesser one.
        """
        state: list[tuple[float, str]] = []
        open_at: list[list[tuple[int, dict]]] = []
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):  # noqa: B905  the shorter ends it
                if a != b:
                    break
                shared += 1
            del state[shared:], open_at[shared:]
            going = open_at[-1] if open_at else []
            for end in range(shared, len(word)):
                c, best, on = word[end], None, []
                for start, place in (*going, (end, self.trie)):
                    place = place.get(c)
                    if place is None:
                        continue
                    on.append((start, place))
                    if piece := place.get(""):
                        total = self.scores[piece] + (state[start - 1][0] if start else 0.0)
                        if best is None or total > best[0]:
                            best = total, piece
                if c not in self.ids:
                    total = self.unknown + (state[end - 1][0] if end else 0.0)
                    if best is None or total > best[0]:
                        best = total, c
                state.append(best)
                open_at.append(on)
                going = on
            parts, end = [], len(word)
            while end:
                parts.append(self.id_bytes(state[end - 1][1]))
                end -= len(state[end - 1][1])
            yield word, b"".join(reversed(parts))
            before = word

    def pieces_of(self, marked: str) -> list[str]:
        """Of a marked text of known characters, directly: for checks."""
        if self.kind == BYTE_PAIR:
            return self.merge(marked)
        names = {i: p for p, i in self.ids.items()}
        return [names[i] for run in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) for _, ids in self.best([run]) for i in np.frombuffer(ids, np.int32).tolist()]


def _single_spaced(text: str | None) -> list[str]:
    """The words of a text with single spaces between them and none at an end; none of another text."""
    cut = text.split(" ") if text and MARK not in text else []
    return [] if "" in cut else cut


class Encoder:
    """Encodes batches of texts with one vocabulary; keeps the ids of words it has seen, as bytes."""

    def __init__(self, path: str, kind: int | None = None):
        self.vocabulary = Vocabulary(path, kind)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[int, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Ids of new words, each with its mark in front; a line feed, which no piece holds, parts a word."""
        v = self.vocabulary
        if v.kind == UNIGRAM:
            marked = {w: w if w.startswith(MARK) else MARK + w for w in words}
            found = dict(v.best(sorted(set(marked.values()))))
            self.words |= {w: found[m] for w, m in marked.items()}
            return
        split = {w: (MARK + w).split("\n") if not v.feeds else [MARK + w] for w in words}
        found = dict(v.forward(sorted({p for parts in split.values() for p in parts if p})))
        found[""] = b""
        feed = v.id_bytes("\n")
        for w, parts in split.items():
            self.words[w] = feed.join([found[p] for p in parts])

    def _run(self, n: int) -> bytes:
        """Ids of n marks in a row; those of short runs are kept."""
        if n > LONG:
            return b"".join(map(self.vocabulary.id_bytes, self.vocabulary.merge_marks(n)))
        found = self.marks.get(n)
        if found is None:
            found = self.marks[n] = b"".join(map(self.vocabulary.id_bytes, self.vocabulary.merge_marks(n)))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of int32; none for a null or empty text."""
        words, spaced = set(), {}
        for k, t in enumerate(texts):
            if c := _single_spaced(t):
                words.update(c)
            elif t:
                spaced[k] = _RUN.findall(MARK + t.replace(" ", MARK))
        if self.vocabulary.kind == UNIGRAM:  # a run of marks goes with its word
            spaced = {k: [("", marks + word) for marks, word in runs if marks or word] for k, runs in spaced.items()}
        words.update(w for runs in spaced.values() for _, w in runs if w)
        if len(self.words) + len(words) > KEPT_WORDS // 2:
            self.older, self.words = self.words, {}
        new = words - self.words.keys()
        known = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in known)
        if new := new - known:
            self._learn(new)
        get = self.words.__getitem__
        out = []
        for k, t in enumerate(texts):
            if k in spaced:
                out.append(b"".join(self._spaced(spaced.pop(k))))
            else:  # cut once more: the words of all texts at once would take many times the texts' bytes
                out.append(b"".join(map(get, _single_spaced(t))))
        return out

    def _spaced(self, runs: list[tuple[str, str]]) -> Iterator[bytes]:
        """A word takes the last mark before it, unless that mark stays alone: then it merges with those before."""
        lone = self.vocabulary.id_bytes(MARK)
        for marks, word in runs:
            n = len(marks)
            if self.vocabulary.kind == UNIGRAM:
                yield self.words[word]
            elif not word:
                yield self._run(n) if n else b""
            elif self.words[word].startswith(lone):
                yield self._run(n)
                yield self.words[word][4:]
            else:
                yield self._run(n - 1) if n > 1 else b""
                yield self.words[word]

    def forget(self) -> None:
        """Gives up what it has seen, not the vocabulary: a worker that waits for its next task stays small."""
        self.words, self.older = {}, {}
        self.vocabulary.joins, self.vocabulary.n_joins = {}, 0

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        out = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist()))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _encoder(path: str, kind: int | None = None) -> Encoder:
    """The worker's own; its vocabulary outlives a task."""
    return Encoder(path, kind)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most TOGETHER rows and TOGETHER_BYTES of its last column (a longer text alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    at = total = 0
    for k, size in enumerate(sizes):
        if k > at and (k - at >= TOGETHER or total + size > TOGETHER_BYTES):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)


def _id_lists(found: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[Column, ...] = (), path: str | None = None, round_trip: bool = False, largest_sum: bool = False) -> DataFrame:
    """Every row: the columns in keep, n_tokens, ids and, with round_trip, whether decoding gives the text back.

    largest_sum: by the Viterbi pass over the vocabulary's scores, whatever its kind, and with `score`, the sum of scores of the
    pieces, which no other way to cut the text exceeds. A null or empty text has no ids (and comes back as empty). Texts are encoded whole, some MB at a time. Repeated rows stay. Equal to the library's encoding by the same model.
    """
    path = path or model_path()
    rows = docs.select(*keep, F.col(f"`{text_col}`").cast("string").alias("__vg_text"))
    schema = rows.schema[:-1].add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    if round_trip:
        schema = schema.add("round_trip", "boolean")
    if largest_sum:
        schema = schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, UNIGRAM if largest_sum else None)
        for whole in batches:
            for batch in _cut(whole):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found = encoder.encode(texts)
                added = [pa.array([len(x) // 4 for x in found], pa.int64()), _id_lists(found)]
                if round_trip:
                    same = [encoder.decode(np.frombuffer(x, np.int32)) == (t or "").replace(MARK, " ") for x, t in zip(found, texts, strict=True)]
                    added.append(pa.array(same, pa.bool_()))
                if largest_sum:
                    added.append(pa.array([float(encoder.vocabulary.by_id[np.frombuffer(x, np.int32)].sum()) for x in found], pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=schema.names)
        encoder.forget()

    return arrow_rows(rows, run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", keep: tuple[Column, ...] = (), path: str | None = None) -> DataFrame:
    """Every row: the columns in keep and text, decoded from ids_col; null ids give a null text."""
    path = path or model_path()
    picked = rows.select(*keep, F.col(f"`{ids_col}`").cast("array<int>").alias("__vg_ids"))
    schema = picked.schema[:-1].add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int32)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return arrow_rows(picked, run, schema)

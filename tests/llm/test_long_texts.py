"""Texts that made an operator slow: long runs of one character, long copies."""

import math
import random
import time
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, pieces


def test_long_runs_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    encoder = pieces.Encoder(pieces.model_path())
    texts = ["a" + " " * n + "b" for n in (16, 17, 255, 256, 257, 300, 1000, 5001)] + [" " * 1000, " " * 999 + "tail", "\t" * 3000, "a\t \t" * 500, "x" * 700]
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], np.int32).tolist() == model.encode(text)


def test_long_merge_equals_the_plain_one():
    vocabulary = pieces.Vocabulary(pieces.model_path())
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(f"{pieces.MARK * 3}theanionsre") for _ in range(rng.randint(2, pieces.LONG)))
        assert vocabulary._merge_long(text) == vocabulary.merge(text)
    assert all(vocabulary.merge_marks(n) == vocabulary._merge_long(pieces.MARK * n) for n in range(pieces.LONG + 1, 900, 7))


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\t" * 1_000_000, "x" * 1_000_000], ids=["spaces", "tabs", "one word"])
def test_a_million_characters_take_seconds(text):
    encoder = pieces.Encoder(pieces.model_path())
    start = time.perf_counter()
    ids = encoder.encode([text])[0]
    assert time.perf_counter() - start < 20
    assert encoder.decode(np.frombuffer(ids, np.int32)) == text


def test_a_long_item_copied_whole(spark):
    """5,000 words, copied as they are and with every 20th word changed: one row each, every run of hits verified once."""
    item = [f"w{k % 1777}x{k % 13}" for k in range(5000)]
    changed = [f"other{k}" if k % 20 == 7 else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["lead", "in", *item])), (2, " ".join(changed)), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    decontaminate.contaminated(docs, bench).collect()
    start = time.perf_counter()
    rows = decontaminate.contaminated(docs, bench).collect()
    assert time.perf_counter() - start < 30
    assert {(r["doc_id"], r["matched"], r["start"]) for r in rows} == {(1, 5000, 2), (2, 4750, 0)}


def test_one_hit_stands_for_an_alignment(spark):
    """Of all hits of a document and an item, exactly one for each way to lay the item on the document."""
    words, item = list("abcdefghijzzabcdefghij"), ["x", *"bcdefghij"]
    table = spark.createDataFrame([(words, at, item, own) for at in range(len(words)) for own in range(len(item))], "words array<string>, at int, item_words array<string>, item_at int")
    masks = decontaminate.SHORT[10]
    equal = lambda at, own, m: all(at + p < len(words) and own + p < len(item) and words[at + p] == item[own + p] for p in m)
    hits = {(at, own) for at in range(len(words)) for own in range(len(item)) if any(equal(at, own, m) for m in masks)}
    kept = {(r["at"], r["item_at"]) for r in table.where(decontaminate._first_hit([10], 13)).collect()} & hits
    assert len(hits) > 8 and kept == {(at, own) for at, own in hits if not any((at - own + k, k) in hits for k in range(own))} and len(kept) == 2


def test_largest_sums_of_whole_texts(spark, small, edge_docs):
    """The Viterbi query's scores against a plain pass over each whole marked text, ids decoded back, odd rows included."""
    vocabulary = pieces.Vocabulary(pieces.model_path())
    longest = max(map(len, vocabulary.ids))
    lookup = vocabulary.scores.get

    def best(text):
        marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
        sums = [0.0]
        for end in range(1, len(marked) + 1):
            known = [sums[k] + x for k in range(max(0, end - longest), end) if (x := lookup(marked[k:end])) is not None]
            sums.append(max(known, default=float("-inf")) if lookup(marked[end - 1]) is not None else max([*known, sums[-1] + vocabulary.unknown]))
        return sums[-1]

    texts = [r["text"][:800] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(120).collect()] + ["", "  two  spaces ", "a\nb", "日本語 ﬁ①", "x" * 300, "abc" + " " * 40 + "d"]
    rows = pieces.encode(spark.createDataFrame([(t,) for t in texts], "text string"), keep=(F.col("text"),), round_trip=True, largest_sum=True).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and math.isclose(r["score"], best(r["text"]), rel_tol=1e-9) for r in rows)
    odd = pieces.encode(edge_docs, keep=(F.col("doc_id"),), round_trip=True, largest_sum=True).collect()
    assert len(odd) == edge_docs.count() and all(r["round_trip"] for r in odd) and {r["score"] for r in odd if r["doc_id"] in (3, 4)} == {0.0}


def test_words_of_a_batch_are_not_held_at_once():
    """4 MB of texts are encoded within a few times the ids' bytes; the words of all of them as strings would take over 40 MB."""
    encoder = pieces.Encoder(pieces.model_path())
    texts = [" ".join(random.Random(k).choices(("the", "an", "one", "state", "of"), k=1000)) for k in range(1000)]
    encoder.encode(texts[:1])
    tracemalloc.start()
    found = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * sum(map(len, found)) and found[7] == encoder.encode([texts[7]])[0]

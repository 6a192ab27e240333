"""States of an exact number of tokens, by installed tokenizers."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from verdigris.sources import workloads

SENTENCES = ("The shoes arrived in the wrong size, twice.", "I can't log in — my naïve password isn't accepted!", "Order #48213: 日本語 note attached.", "Refund $19.99, please.")
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("file", FILES)
def test_every_size_is_met(file):
    path = public_tokenizers.path(file)
    count = workloads.token_counter(path)
    for n in (*range(60), 127, 511, 2047):
        assert count(workloads.filler(n, path)) == n
    long = "Ticket 7. " + " ".join(SENTENCES) * 3
    for n in range(1, 40):
        assert count(workloads.exact_prefix(long, n, count)) == n  # by bisection alone
    assert workloads.exact_prefix("too short", 50, count) is None


def test_profiles(spark):
    path = public_tokenizers.path(FILES[0])
    rows = workloads.profiled(spark.range(12), "id", SENTENCES, path).withColumn("n", workloads.counted(F.col("state"), path)).collect()
    assert len(rows) == 36 and all(r["n"] == workloads.PROFILES[r["profile"]][0] - 1 and r["questions"] == workloads.PROFILES[r["profile"]][1] for r in rows)
    assert len({r["state"] for r in rows}) == 36 and all(r["state"].startswith(f"Ticket {1000 + r['id']}.") for r in rows)
    assert spark.range(1).select(workloads.counted(F.lit(None).cast("string"), path)).first()[0] is None


def test_joining_changes_counts():
    """A counter for which a longer beginning can have fewer tokens: pairs of equal letters are one."""

    def count(text):
        n = k = 0
        while k < len(text):
            k += 2 if text[k : k + 2] in ("aa", "bb") else 1
            n += 1
        return n

    text = "abaabbabab" * 9
    assert all((found := workloads.exact_prefix(text, n, count)) is not None and count(found) == n for n in range(1, count(text) + 1))


def test_states_are_dealt_evenly(spark):
    path = public_tokenizers.path(FILES[0])
    rows = workloads.profiled(spark.range(4096), "id", SENTENCES, path, {"tiny": (12, 1)}).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 1.3 * workloads.PER_TASK  # four tasks, however few bytes the rows have


@pytest.mark.parametrize("file", FILES)
def test_shared_tails_make_the_same_states(file):
    path = public_tokenizers.path(file)
    for i in (0, 5, 8999, 9000, 123456):
        for n in (0, 1, 3, 9, 40, 127):
            begin = f"Ticket {1000 + i}."
            assert workloads._state(begin, SENTENCES, i, n, path) == workloads._grown(begin, SENTENCES, i, n, path)

"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only).

A seed is a hash of the words at the positions of a fixed mask; the positions between are ignored. MASKS hold six
words each and are chosen so that of any WINDOW aligned words of which at most two differ, one mask at one offset
reads only equal ones. Shorter items have masks of their own (SHORT), chosen in the same way for the words that may
differ in them: two of 10 to 12, one of 5 to 9, none of 1 to 4. Seeds of training texts and of benchmark items are joined; each hit fixes an alignment,
and around the first hit of each alignment the item is compared with the text word by word: the pair is contaminated if in some window of
WINDOW words (the whole item if it is shorter) at least 80 of 100 are equal, substituted words allowed.

Words are runs of letters and digits, lower-cased. There is no shortest item: one of a single word matches every
text that has the word.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

#: Positions that a seed reads.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Masks of shorter items by the fewest words that they are for; each row holds up to the next one's.
SHORT = {
    10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    4: ((0, 1, 2, 3),),
    3: ((0, 1, 2),),
    2: ((0, 1),),
    1: ((0,),),
}
WINDOW, PERCENT = 13, 80
#: Benchmark seeds and words up to which they are broadcast (about 100 bytes each in memory: some 50 MB).
BROADCAST_SEEDS, BROADCAST_WORDS = 500_000, 500_000
_BY_SIZE = {WINDOW: MASKS, **SHORT}
_REACH = max(m[-1] for m in MASKS) + 1


def words_of(text: Column) -> Column:
    """The words of a text; null: null."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _least(size: Column) -> Column:
    """The key of _BY_SIZE whose masks hold for so many aligned words."""
    return F.coalesce(*(F.when(size >= k, k) for k in _BY_SIZE))


def _seeds(rows: DataFrame, keep: list[str], sizes: Sequence[int] = (WINDOW,)) -> DataFrame:
    """rows (keep, words) with a row for each mask of sizes and each position at which it fits: keep, at (from 0), seed."""
    w, n = F.col("words"), F.size("words")
    masks = sorted({m for k in sizes for m in _BY_SIZE[k]})
    used = sorted({p for m in masks for p in m})
    # arrays_zip pads with nulls, so each mask goes on to its own last position, not to that of the longest one.
    shifted = F.arrays_zip(*(F.slice(w, F.lit(p + 1), F.greatest(n - p, F.lit(0))).alias(f"w{p}") for p in used))
    placed = rows.where(n > 0).select(*keep, F.posexplode(shifted).alias("at", "z"))
    seeds = F.array(*(F.when(F.col(f"z.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(str(m)), *(F.col(f"z.w{p}") for p in m))) for m in masks))
    return placed.select(*keep, "at", F.explode(seeds).alias("seed")).where(F.col("seed").isNotNull())


def _first_hit(sizes: Sequence[int], window: int) -> Column:
    """Whether a hit (words, at, item_words, item_at) is the first of its alignment: none of the item's masks reads equal words at an earlier place of the item.

    A copy of n words has about n hits of one alignment; the first stands for all of them. Most others are told by the
    place just before, or by the item's first places, where a search from the item's begin stops.
    """

    def read(mask: tuple[int, ...], place: Column) -> Column:
        own = lambda p: F.get("words", (F.col("at") - F.col("item_at") + place + p).cast("int")) == F.get("item_words", (place + p).cast("int"))
        return reduce(lambda a, b: a & b, map(own, mask))

    least = _least(F.least(F.lit(window), F.size("item_words")))
    hit = lambda place: F.coalesce(reduce(lambda a, b: a | b, ((least == k) & reduce(lambda a, b: a | b, (read(m, place) for m in _BY_SIZE[k])) for k in sizes)), F.lit(False))
    earlier = F.exists(F.sequence(F.lit(0), F.col("item_at").cast("int") - 1), hit)
    return (F.col("item_at") == 0) | ~(hit(F.col("item_at").cast("int") - 1) | earlier)


def _verified(hits: DataFrame, window: int, percent: int) -> DataFrame:
    """hits (doc, words, item, item_words, shift) that hold, with what is equal: doc, item, shift, matched, item_words."""
    equal = F.transform("item_words", lambda t, j: F.when((F.col("shift") + j >= 0) & (F.get(F.col("words"), (F.col("shift") + j).cast("int")) == t), 1).otherwise(0))
    size = F.least(F.lit(window), F.size("equal"))
    found = F.exists(
        F.sequence(F.lit(1), F.size("equal") - size + 1),
        lambda s: F.aggregate(F.slice("equal", s, size), F.lit(0), lambda a, v: a + v) * 100 >= size * percent,
    )
    return hits.withColumn("equal", equal).where(found).select("doc", "item", "shift", F.aggregate("equal", F.lit(0), lambda a, v: a + v).alias("matched"), F.size("equal").alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """A row for each pair of document and item that overlap: id_col, item_col, matched, item_words, overlap, start.

    matched: equal words at the best alignment; overlap: matched / item_words; start: the document's word (from
    0) at which the item begins there, the first of equally good ones; negative if the item's begin is missing.
    Null and empty texts match nothing, items of any number of words are held against all texts, with the masks
    that the items' sizes call for; masks don't cover a window over WINDOW or a percent under PERCENT; a null id is kept as null; rows that share an id are one document with
    several texts. An empty table on either side gives no row. Documents are read once and stay where they are
    if the benchmark's seeds are within the broadcast bounds, which are counted; else seeds are joined by a
    shuffle of (id, position, seed) and the texts that were hit are joined to them; both ways give the same rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), words_of(F.col(f"`{item_text_col}`").cast("string")).alias("item_words"))
    least = _least(F.least(F.lit(window), F.size("item_words")))
    items = checkpoint(items.where(F.size("item_words") > 0).distinct().withColumn("own", F.monotonically_increasing_id()))
    n_words, sizes = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0)), F.sort_array(F.collect_set(least))).first()
    sizes = sizes or [WINDOW]
    of_items = [_seeds(items.where(least == k).select("own", F.col("item_words").alias("words")), ["own"], [k]) for k in sizes]
    wanted = checkpoint(reduce(DataFrame.unionByName, of_items).withColumnRenamed("at", "item_at").distinct())
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if wanted.count() <= BROADCAST_SEEDS and n_words <= BROADCAST_WORDS:
        hits = _seeds(texts, ["doc", "words"], sizes).join(F.broadcast(wanted), "seed").join(F.broadcast(items), "own")
        hits = hits.where(_first_hit(sizes, window)).select("doc", "words", "item", "item_words", shift)
    else:
        # A hit finds its own text again by the id and a hash of the words; a hot seed is split by AQE, as nothing else needs its rows together.
        texts = texts.withColumn("print", F.xxhash64("words"))
        near = _seeds(texts, ["doc", "print"], sizes).join(wanted, "seed").select("doc", "print", "own", shift).distinct()
        hits = near.join(items, "own").join(texts, near["doc"].eqNullSafe(texts["doc"]) & (near["print"] == texts["print"])).select(near["doc"], "words", "own", "shift", "item", "item_words")
    held = _verified(hits, window, percent)
    best = held.groupBy("doc", "item").agg(F.max(F.struct("matched", (-F.col("shift")).alias("back"), "item_words")).alias("best"))
    return best.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("best.matched").cast("long").alias("matched"),
        F.col("best.item_words").cast("long").alias("item_words"),
        (F.col("best.matched") / F.col("best.item_words")).alias("overlap"),
        (-F.col("best.back")).cast("long").alias("start"),
    )


def oracle(window: int = WINDOW, percent: int = PERCENT) -> str:
    """The same in DuckDB SQL over documents and benchmark, by plain runs of four words instead of seeds.

    11 of 13 aligned words that are equal have a run of four, so both find the same for items of 13 words or more.
    Its items start at nine words and runs of four are too long for some shorter ones; contaminated() finds those too.
    """
    cut = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {cut} AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT item_id, {cut} AS t FROM benchmark WHERE text IS NOT NULL),
    bi AS (SELECT * FROM b WHERE len(t) >= {_REACH}),
    dg AS (SELECT doc_id, p, w[p:p+3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d)),
    bg AS (SELECT item_id, p, t[p:p+3] AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 2)) AS p FROM bi)),
    hits AS (SELECT DISTINCT dg.doc_id, bg.item_id, dg.p - bg.p AS shift FROM dg JOIN bg USING (g)),
    eq AS (SELECT h.doc_id, h.item_id, h.shift, len(bi.t) AS m,
             list_transform(range(1, len(bi.t) + 1), lambda j: CASE WHEN h.shift + j >= 1 AND h.shift + j <= len(d.w) AND d.w[h.shift + j] = bi.t[j] THEN 1 ELSE 0 END) AS e
           FROM hits h JOIN d USING (doc_id) JOIN bi USING (item_id)),
    ok AS (SELECT doc_id, item_id, shift, m, list_sum(e) AS matched FROM eq
           WHERE len(list_filter(range(1, CAST(m - least({window}, m) + 2 AS BIGINT)), lambda s: list_sum(e[s:s + least({window}, m) - 1]) * 100 >= least({window}, m) * {percent})) > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) AS r FROM ok)
    SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(m AS BIGINT) AS item_words,
           CAST(matched AS DOUBLE) / CAST(m AS DOUBLE) AS overlap, CAST(shift AS BIGINT) AS start
    FROM best WHERE r = 1
    """

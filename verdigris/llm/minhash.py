"""Near-duplicates by word shingles with bottom-k sketches from one hash function.

1. Sketches: a document's shingle set, hashed by one function; the K smallest hashes are its sketch. Documents
   with equal sets (equal size and 128-bit digest of the whole set) are one class; classes are numbered.
2. Inverted lists of retained values: a list's key is a run of three neighbouring values of a sketch, so that one
   common value alone makes no long list. Two sets of similarity 0.8 share such a run but for chance below 1e-9
   (always, if both have at most K values: their u common and other values have a run of three common ones
   for any u but 5); sets of 4 and 5 also meet in subsets of 4, smaller ones are similar only if equal.
3. Each list links its members to its smallest one, not all to all. Pairs are filtered by sizes, then by the
   similarity that the union's bottom-k sketch estimates, and verified on full sets.
4. What this leaves open: members of one list in different components. Lists of up to LIGHT members give their
   pairs across components. Classes of longer ones get sketches of WIDE values: pairs that share MET short
   lists there are tested, and whoever has so many short lists that similar sets must share MET of them is done.
   Only the others are compared in blocks: classes that long lists connect, of near sizes, in tiles of bounded
   weight, dealt in rounds of bounded disk. A pair of tiles is worked on in strips of ROWS rows, whose
   exact intersections are counted by matrix products; only links between components are returned.
5. Components of all verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, smallest_names
from .shared import arrow_rows, checkpoint, drop_shuffles, stored
from .shingles import digest, shingle_set

#: Values of a sketch; percent of similarity; members up to which a list gives its pairs; hashes in a tile.
K, PERCENT, LIGHT, TILE = 64, 80, 16, 1 << 18
#: Values of the longer sketches; short lists that a pair must share there; short lists of WIDE values of which similar sets share MET but for chance below 1e-9.
WIDE, MET, SURE = 512, 3, 365
#: Times that a round of tiles may repeat the sets that it compares; hashes that a round may have anyway.
REPEATS, ROUND = 6, 1 << 25
#: Members of a list that are dealt to one task together; tasks that a band of a region goes to.
PART, SALTS = 1024, 32
#: Rows of a strip, and shingles that two strips are compared on at once: a strip's arrays take some MB.
ROWS, AT_ONCE = 512, 2048
#: Standard errors that the estimate may be under the threshold.
SLACK = 6.0


def positive_set(text: str | None, size: int) -> np.ndarray:
    """The shingle set as sorted 63-bit hashes, which Spark's signed order sorts alike."""
    return np.unique((shingle_set(text, size) >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, print, sketch) of every row, in a table: set size, a digest of the set, the smallest K hashes."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.select("id").schema.add("n", "long").add("print", "binary").add("sketch", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [positive_set(t.as_py(), size) for t in batch.column(1)]
                heads = [s[:K] for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)), pa.array(np.concatenate(heads), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), lists], names=["id", "n", "print", "sketch"])

    return stored(arrow_rows(rows, run, schema))


def list_keys(classes: DataFrame) -> DataFrame:
    """(key, id, n): the inverted lists' rows of each class (id, n, sketch)."""
    k = F.size("sketch")
    runs = F.arrays_zip(F.slice("sketch", F.lit(1), k - 2).alias("x"), F.slice("sketch", F.lit(2), k - 2).alias("y"), F.slice("sketch", F.lit(3), k - 2).alias("z"))
    runs = classes.where(k >= 3).select("id", "n", F.inline(runs)).select(F.xxhash64("x", "y", "z").alias("key"), "id", "n")
    v = F.col("sketch")
    four = F.array(*(F.xxhash64(F.lit("four"), *(v[i] for i in range(5) if i != out)) for out in range(5)))
    small = classes.where(F.col("n").isin(4, 5)).select(F.explode(F.when(F.col("n") == 5, four).otherwise(F.array(F.xxhash64(F.lit("four"), *(F.get(v, F.lit(i)) for i in range(4)))))).alias("key"), "id", "n")
    return runs.unionByName(small)


def _near_sizes(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose similarity, by the union's bottom-k sketch, isn't SLACK standard errors under the threshold."""
    own = classes.select("id", "sketch")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    union = both.select("a", "b", "sa", "sb", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K).alias("u"))
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) / F.size("u")
    t = percent / 100
    return union.where(shared >= t - SLACK * math.sqrt(t * (1 - t)) / F.sqrt(F.size("u"))).select("a", "b")


def _texts_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the wanted classes (id), in a table: the text of each class's first document."""
    firsts = classes.select("id", "first").join(wanted.distinct(), "id", "left_semi")
    return stored(texts.join(firsts, "first").select("id", "text"), compression="zstd")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets have the similarity. Only texts of the pairs are dealt."""
    texts = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, texts)
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.int64)
        for batch in batches:
            linked = []
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                if text != last:  # rows come by b: runs of one text
                    last, x = text, positive_set(text, size)
                y = positive_set(batch.column(3)[k].as_py(), size)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return arrow_rows(rows.select("a", "b", F.col("tb"), F.col("ta")), run, "a long, b long")


class _Side:
    """One side of a pair of tiles: rows (side, id, component, set) by component, with the values of each strip."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray]]):
        rows = sorted(rows, key=lambda r: r[2])
        self.ids, self.components = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.sizes, self.sets = np.array([len(r[3]) for r in rows]), [r[3] for r in rows]
        self.strips = [slice(k, min(k + ROWS, len(rows))) for k in range(0, len(rows), ROWS)]
        self.flat = [np.concatenate(self.sets[s]) for s in self.strips]
        self.owner = [np.repeat(np.arange(s.stop - s.start), self.sizes[s]) for s in self.strips]

    def incidence(self, k: int, values: np.ndarray) -> np.ndarray:
        """Strip k's rows by sorted values: 1 where the row's set has the value."""
        at = np.searchsorted(values, self.flat[k])
        at[at == len(values)] = 0
        own = values[at] == self.flat[k]
        out = np.zeros((self.strips[k].stop - self.strips[k].start, len(values)), np.float32)
        out[self.owner[k][own], at[own]] = 1
        return out


def _tile_links(rows: list[tuple[int, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between components among rows (side, id, component, set): of side 0 with side 1, or of side 2 with itself.

    Exact intersection sizes by products of incidence matrices, strip by strip over the values that both strips
    have, so that memory doesn't grow with the rows. Of the links found only those that join components not
    joined yet are returned, and strips of one component are not compared.
    """
    left = [r for r in rows if r[0] != 1]
    if not left or (left[0][0] == 0 and len(left) == len(rows)):
        return []
    same = left[0][0] == 2
    one = _Side(left)
    two = one if same else _Side([r for r in rows if r[0] == 1])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, s in enumerate(one.strips):
        for j, t in enumerate(two.strips):
            if same and j < i:
                continue
            if len({find(int(c)) for c in np.unique(np.concatenate((one.components[s], two.components[t])))}) < 2:
                continue
            if same and i == j:
                values, times = np.unique(one.flat[i], return_counts=True)
                common = values[times > 1]
            else:
                common = np.intersect1d(one.flat[i], two.flat[j])
            counts = np.zeros((s.stop - s.start, t.stop - t.start), np.float32)
            for at in range(0, len(common), AT_ONCE):
                counts += one.incidence(i, common[at : at + AT_ONCE]) @ two.incidence(j, common[at : at + AT_ONCE]).T
            linked = (100 + percent) * counts.astype(np.float64) >= percent * (one.sizes[s][:, None] + two.sizes[t][None, :])
            linked &= one.components[s][:, None] != two.components[t][None, :]
            x, y = np.nonzero(linked)
            if not len(x):
                continue
            joins, first = np.unique(np.stack((one.components[s][x], two.components[t][y])), axis=1, return_index=True)
            for k in range(joins.shape[1]):
                p, q = find(int(joins[0, k])), find(int(joins[1, k]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(one.ids[s][x[first[k]]]), int(two.ids[t][y[first[k]]])))
    return out


def _by_list(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (key, id, members, ...) joined with lists (key, members, ...): a list is dealt out in parts of about PART members."""
    parts = F.ceil(F.col("members") / PART).cast("long")
    one = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts))
    two = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("members")
    return one.join(two, ["key", "part"]).drop("part")


def _tiled(heavy: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the classes that long lists (key, id, n, component, members) connect, by tiles; texts: (id, text) of these classes.

    Classes whose lists connect them are a region. A region's classes of sizes in one step of 100/percent
    are a band; a link's ends are in one band or two neighbouring ones. Bands are cut into tiles of about TILE
    hashes, and each tile meets itself, the others of its band and those of the next band.
    """
    stars = _by_list(heavy, heavy.groupBy("key", "members").agg(F.min("id").alias("a"))).select("a", F.col("id").alias("b"))
    regions = components(stars)
    band_of = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    members = heavy.select("id", "n", "component").distinct().join(regions.withColumnRenamed("component", "region"), "id").withColumn("band", band_of)
    bands = members.groupBy("region", "band").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    nearby = bands.join(bands.select("region", (F.col("band") - 1).alias("band"), F.col("tiles").alias("next_tiles")), ["region", "band"], "left")
    nearby = nearby.join(bands.select("region", (F.col("band") + 1).alias("band"), F.col("tiles").alias("last_tiles")), ["region", "band"], "left")
    # A region can hold much of the table: its bands go to SALTS tasks each, for which the few rows of `nearby` are repeated.
    nearby = nearby.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("id", "region"), F.lit(SALTS))).join(nearby, ["region", "band", "salt"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))

    def meets(side: int, band: Column, first: Column, second: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), band.alias("low"), first.cast("int").alias("p"), second.cast("int").alias("q"))

    band, tile = F.col("band"), F.col("tile")
    within = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.when(o == tile, meets(2, band * 2, tile, tile)).when(o > tile, meets(0, band * 2, tile, o)).otherwise(meets(1, band * 2, o, tile)))
    up = F.when(F.col("next_tiles").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("next_tiles") - 1), lambda o: meets(0, band * 2 + 1, tile, o)))
    down = F.when(F.col("last_tiles").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("last_tiles") - 1), lambda o: meets(1, band * 2 - 1, o, tile)))
    none = F.array().cast("array<struct<side:int,low:int,p:int,q:int>>")
    dealt = placed.select("region", "id", "component", "n", F.inline(F.concat(within, F.coalesce(up, none), F.coalesce(down, none)))).withColumn("round", F.xxhash64("region", "low", "p", "q"))
    # Each set goes to as many tasks as its tile has others to meet: in rounds, so that the disk which that takes doesn't grow with the square of the region.
    meetings = F.col("tiles") + F.coalesce("next_tiles", F.lit(0)) + F.coalesce("last_tiles", F.lit(0))
    weight = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * meetings), F.lit(0))).first()
    rounds = max(1, math.ceil(weight[1] / max(ROUND, REPEATS * weight[0])))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [positive_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "hashes"])

    sets = stored(arrow_rows(texts.join(members.select("id").distinct(), "id", "left_semi"), to_sets, "id long, hashes binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def links() -> pa.RecordBatch:
            found = _tile_links(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if held:
                        yield links()
                    held, key = [], row[:4]
                held.append((row[4], row[5], row[6], np.frombuffer(row[7], np.int64)))
        if held:
            yield links()

    out = None
    for k in range(rounds):
        own = dealt.where(F.pmod("round", F.lit(rounds)) == k).join(sets, "id")
        tiles = own.repartition("region", "low", "p", "q").sortWithinPartitions("region", "low", "p", "q").select("region", "low", "p", "q", "side", "id", "component", "hashes")
        found = checkpoint(arrow_rows(tiles, run, "a long, b long"))
        out = found if out is None else out.union(found)
    return out


def _widened(heavy: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest) of the rows of long lists: pairs (a, b) across components that share MET short lists of longer sketches, and the rows of classes that these lists may miss links of.

    A value that one of two sets lacks breaks three runs of the set that has it, or two of the other. So of two similar sets
    with n values in one at most 3 * (1 - t) * n of its runs aren't the other's, and a set with MET more short lists
    than that shares MET of them with each similar one. Of sets beyond WIDE only the first runs are listed, of which
    as large a part is broken but for chance: SURE is over its mean by six standard deviations and more. Sets of up to 5 values are left.
    """
    schema = "id long, n long, component long, sketch array<long>"
    known = texts.join(heavy.select("id", "component").distinct(), "id").select("id", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [positive_set(t.as_py(), size) for t in batch.column(2)]
                heads = pa.array([s[:WIDE] for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), batch.column(1), heads], names=["id", "n", "component", "sketch"])

    wide = stored(arrow_rows(known, run, schema))
    keys = list_keys(wide.where(F.col("n") > 5).select(F.struct("id", "component").alias("id"), "n", "sketch")).select("key", "id.id", "n", "id.component")
    lists = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("c"), F.max("component").alias("d")).where(F.col("c") != F.col("d")).select("key", "members")
    opened = stored(keys.join(lists, "key"))
    long = opened.where(F.col("members") > LIGHT).groupBy("id").agg(F.count("*").alias("long"))
    short = F.least(F.col("n"), F.lit(WIDE)) - 2 - F.coalesce("long", F.lit(0))
    sure = (F.col("n") > 5) & (((F.col("n") * 100 <= WIDE * percent) & (short * 100 >= 3 * (100 - percent) * F.col("n") + 100 * MET)) | (short >= SURE))
    rest = wide.select("id", "n").join(long, "id", "left").where(~sure).select("id")
    light = opened.where(F.col("members") <= LIGHT)
    one, two = light.select("key", F.col("id").alias("a"), F.col("n").alias("x"), F.col("component").alias("c")), light.select("key", F.col("id").alias("b"), F.col("n").alias("y"), F.col("component").alias("d"))
    met = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & _near_sizes(F.col("x"), F.col("y"), percent))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("times")).where(F.col("times") >= MET).select("a", "b")
    return pairs, stored(heavy.join(rest, "id", "left_semi"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id and kept (the id is the component's smallest).

    Links are pairs with 100 * intersection >= percent * union of their shingle sets; percent is 80 or more.
    Ids are of any type that sorts. A document without words has an empty set and is linked with nothing.
    Equal sets are one class, never paired: equal means equal size and 128-bit digest of the whole set. Rows
    that share an id are one document with several texts: what links to any links to it. A null id is linked
    with nothing: component null, kept. An empty table gives no row. A hot list or class is split by AQE where
    it is joined, and summed before it is dealt elsewhere: tables between steps are written, so that none
    inherits a layout by key.
    """
    if percent < 80:
        raise ValueError("the lists' runs are laid out for a similarity of 0.8 or more")
    drop_shuffles(docs.sparkSession)
    rows = sketches(docs, id_col, text_col, size)
    known = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = stored(known.groupBy("n", "print").agg(F.min("id").alias("first"), F.first("sketch").alias("sketch")).withColumn("id", F.monotonically_increasing_id()))
    texts = docs.select(F.col(f"`{id_col}`").alias("first"), F.col(f"`{text_col}`").cast("string").alias("text"))
    links = class_links(classes, texts, size, percent)
    # Rows that share an id join the classes of their texts, which may have other first documents.
    several = known.groupBy("id").agg(F.min(F.struct("n", "print")).alias("x"), F.max(F.struct("n", "print")).alias("y")).where(F.col("x") != F.col("y")).select("id")
    several = known.join(several, "id", "left_semi").select(F.col("id").alias("doc"), "n", "print").join(classes.select("n", "print", "id"), ["n", "print"])
    same_id = several.join(several.groupBy("doc").agg(F.min("id").alias("a")), "doc").select("a", F.col("id").alias("b"))
    # Each class by its component's smallest document, then each row by its class.
    roots = smallest_names(components(links.union(same_id)), classes)
    named = classes.select("n", "print", "first", "id").join(roots, "id", "left").select("n", "print", F.coalesce("root", "first").alias("root"))
    out = rows.join(named, ["n", "print"], "left").withColumn("root", F.when(F.col("n") == 0, F.col("id")).otherwise(F.when(F.col("id").isNotNull(), F.col("root"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))


def class_links(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes (id, n, sketch, first) as all links of their similarity do; texts: (first, text)."""
    keys = list_keys(classes)
    lists = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.max("id").alias("last"), F.count("*").alias("members")).where(F.col("least.id") != F.col("last"))
    # Most values are in one document alone: only rows of lists with two members go on.
    listed = stored(keys.join(lists, "key").select("key", "id", "n", "least", "members"))
    pairs = listed.where((F.col("id") != F.col("least.id")) & _near_sizes(F.col("n"), F.col("least.n"), percent)).select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct()
    pairs = checkpoint(_estimated(pairs, classes, percent))
    links = checkpoint(_verified(pairs, classes, texts, size, percent))
    found = components(links)
    labelled = listed.join(found, "id", "left").select("key", "id", "n", "members", F.coalesce("component", "id").alias("component"))
    open_lists = labelled.groupBy("key", "members").agg(F.min("component").alias("c"), F.max("component").alias("d")).where(F.col("c") != F.col("d")).select("key", "members")
    opened = stored(_by_list(labelled, open_lists))
    light = opened.where(F.col("members") <= LIGHT)
    one, two = light.select("key", F.col("id").alias("a"), F.col("n").alias("x"), F.col("component").alias("c")), light.select("key", F.col("id").alias("b"), F.col("n").alias("y"), F.col("component").alias("d"))
    across = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & _near_sizes(F.col("x"), F.col("y"), percent)).select("a", "b").distinct()
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = checkpoint(_estimated(across.join(tested, ["a", "b"], "left_anti"), classes, percent))
    every = links.union(checkpoint(_verified(across, classes, texts, size, percent)))
    heavy = opened.where(F.col("members") > LIGHT)
    if not heavy.isEmpty():
        own = _texts_of(heavy.select("id"), classes, texts)
        further, rest = _widened(heavy, own, size, percent)
        further = checkpoint(_estimated(further, classes, percent))
        every = every.union(checkpoint(_verified(further, classes, texts, size, percent)))
        if not rest.isEmpty():
            every = every.union(_tiled(rest, own, size, percent))
    return every

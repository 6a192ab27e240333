"""The whole corpus: public sources, policy cases, the showcase and custom corpora, admitted, split, capped and counted.

Every candidate is a record of one schema with a fate, the split that it goes to or why it is dropped, so that the
corpus is the records whose fate is a split, and the report a count of fates. Candidates are written to the shared folder once,
after conversion and admission; everything later reads that table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.functions import text as tx
from verdigris.operators import encoding, leakage, splits
from verdigris.session import small_batches
from verdigris.sources import catalog
from verdigris.sources import requests as rq
from verdigris.store import kept, numbered

#: What records can be for; other fates are reasons.
SPLITS = ("train", "dev", "calibration", "test", "showcase", "unseen")
RECORD = ("record_id", "group_id", "source_family", "schema_family", "state", "questions", "text_sha256", "provenance")


@dataclass(frozen=True)
class Recipe:
    """Records of each source, and the context that they must fit: tokens of a state, of a row and of a packed record."""

    seed: int = 42
    pool: int = 1600
    train: int = 1000
    test: int = 150
    showcase: int = 50
    variants: int = 10
    unseen: int = 100
    max_state: int = qs.MAX_STATE
    max_row: int = qs.MAX_ROW
    max_packed: int = encoding.MAX_PACKED


@dataclass(frozen=True)
class Part:
    """A public source's rows: by which column a row is named and which text groups rows; without train rows it is an unseen one."""

    spec: catalog.Spec
    key: str
    field: str
    evaluation: DataFrame
    train: DataFrame | None = None
    revision: str | None = None


def _record_id(part: Part, split: str) -> Column:
    return F.concat_ws("/", F.lit(part.spec.name), F.lit(split), F.col(f"`{part.key}`").cast("string"))


def _labelled(rows: DataFrame) -> Column:
    return F.coalesce(F.expr("try_cast(label as int)"), F.lit(0)) != -1 if "label" in rows.columns else F.lit(True)


def _identified(part: Part, rows: DataFrame, split: str) -> DataFrame:
    """rows with record_id, group_id, source_family, text_sha256, provenance, and whether they are labelled."""
    name, key, text = part.spec.name, F.col(f"`{part.key}`"), rq.row_text(rows, part.field)
    origin = catalog.ORIGINS.get(name)
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    said = rq.provenance(origin.repo if origin else name, origin.config if origin else None, part.revision, split, key, text, raw)
    out = rows.withColumns({"__text": text, "provenance": said, "labelled": _labelled(rows), "source_family": F.lit(name), "record_id": _record_id(part, split)})
    out = out.withColumn("text_sha256", tx.text_hash(F.col("__text"))).drop("__text")
    return out.withColumn("group_id", F.concat(F.lit(f"{name}/"), F.substring("text_sha256", 1, 20)))


def _first(part: Part, rows: DataFrame, split: str, seed: int, n: int) -> DataFrame:
    """The source's first n rows in the order of the seed: a top-n, written before anything is computed of their texts."""
    named = rows.withColumn("__id", _record_id(part, split))
    return kept(named.orderBy(tx.order_hash(F.col("__id"), seed), "__id").limit(n).drop("__id"))


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """rows with their rank in the order of the seed, within their source."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source_family").orderBy(tx.order_hash(F.col("record_id"), seed), "record_id")))


def _converted(part: Part, rows: DataFrame, seed: int, variant: bool = False) -> DataFrame:
    """Identified rows as records; those whose label names no key have valid = false."""
    found = catalog.records(rows, part.spec, F.col(f"`{part.key}`"), variant, seed, ("record_id", "group_id", "source_family", "text_sha256", "provenance"))
    return found.withColumn("record_id", F.concat("record_id", F.lit("/variant"))) if variant else found


def with_context(records: DataFrame, tokens: Callable[[Column], Column], ids: Mapping[str, int], recipe: Recipe) -> DataFrame:
    """records with `context` (ok, or the limit that is passed) and packed_tokens (null beyond a limit): states, instructions and descriptions as they read, packed and counted by the caller's tokens."""
    sizes = F.transform("questions", lambda q: F.size(q["descriptions"]))
    told = records.withColumns({"__state": py.render_content("state"), "__asks": py.render_all(F.transform("questions", lambda q: q["instructions"])), "__said": py.render_all(F.flatten(F.transform("questions", lambda q: q["descriptions"]))), "__sizes": sizes})
    start = lambda k: F.aggregate(F.slice("__sizes", F.lit(1), k), F.lit(0), lambda a, n: a + n)
    own = lambda q, k: F.slice("__said", start(k) + 1, F.size(q["descriptions"]))
    asked = F.transform("questions", lambda q, k: F.struct(F.coalesce(F.get("__asks", k), F.lit("")).alias("instructions"), encoding.option_texts(q["type"], q["keys"], own(q, k)).alias("options")))
    whole = F.struct(*(F.col(f"`{c}`") for c in records.columns))
    packed = encoding.encoded(told.select(whole.alias("record_id"), F.col("__state").alias("state"), asked.alias("questions")), tokens, ids, recipe.max_state, recipe.max_row, recipe.max_packed)
    return packed.select("record_id.*", F.col("status").alias("context"), F.size("ids").alias("packed_tokens"))


def _groups_within(records: DataFrame, seed: int, cap: int) -> DataFrame:
    """source_family and group_id of whole groups, in the seed's order, that stay within cap records of each source."""
    sized = records.groupBy("source_family", "group_id").agg(F.count("*").alias("rows"))
    return splits.take_groups(sized, "source_family", "rows", seed, cap).select("source_family", "group_id")


def _in(records: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
    return records.join(groups, ["source_family", "group_id"], kind)


def _every(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _fated(records: DataFrame, fate: str | Column) -> DataFrame:
    return records.withColumn("fate", F.lit(fate) if isinstance(fate, str) else fate)


def public(parts: Sequence[Part], recipe: Recipe, tokens: Callable[[Column], Column], ids: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """(candidates with their fates, rows that became no candidate): of all public sources.

    Official evaluation rows, twice as many as needed in the seed's order: showcase groups first, then test groups, the others
    `not_needed`. Train rows: a pool in the seed's order without unlabelled rows and texts of the source's evaluation rows; by
    group to train, dev, calibration and test; train capped, whole groups. The showcase's first records come again under the
    changed schema. Unseen sources give evaluation rows only. What doesn't fit the context is `context`.
    """
    seed, trained = recipe.seed, [p for p in parts if p.train is not None]
    near = 2 * (recipe.showcase + recipe.test)
    evaluation = {}
    official, pool, unseen, rows = [], [], [], []
    for p in parts:
        wanted = near if p.train is not None else 2 * recipe.unseen
        drawn = _first(p, p.evaluation.where(_labelled(p.evaluation)), "evaluation", seed, wanted)
        evaluation[p.spec.name] = _identified(p, drawn, "evaluation")
        found = _converted(p, evaluation[p.spec.name], seed)
        (official if p.train is not None else unseen).append(found)
    for p in trained:
        texts = _identified(p, p.evaluation, "evaluation").select("text_sha256").distinct().withColumn("seen", F.lit(True))
        drawn = _identified(p, _first(p, p.train, "train", seed + 1, recipe.pool), "train").join(texts, "text_sha256", "left")
        drawn = kept(drawn.withColumn("fate", F.when(~F.col("labelled"), "unlabelled").when(F.col("seen"), "official_overlap")))
        rows.append(drawn.where(F.col("fate").isNotNull()).select("source_family", "record_id", "fate"))
        pool.append(_converted(p, drawn.where(F.col("fate").isNull()), seed))
    checked = lambda frames: kept(with_context(_every(frames).where("valid").drop("valid"), tokens, ids, recipe))
    out = []
    if official:
        found = checked(official)
        fits = found.where("context = 'ok'")
        show = _groups_within(fits, seed, recipe.showcase)
        rest = _in(fits, show, "left_anti")
        test = _groups_within(rest, seed + 2, recipe.test)
        shown = _in(fits, show, "left_semi")
        out += [_fated(found.where("context <> 'ok'"), "context"), _fated(shown, "showcase"), _fated(_in(rest, test, "left_semi"), "test"), _fated(_in(rest, test, "left_anti"), "not_needed")]
        base = _ranked(shown, seed).where(F.col("rank") <= recipe.variants).select("record_id")
        changed = [_converted(p, evaluation[p.spec.name].join(base, "record_id", "left_semi"), seed, True) for p in trained if p.spec.variant_field]
        if changed:
            found = checked(changed)
            out.append(_fated(found, F.when(F.col("context") == "ok", "showcase").otherwise("context")))
        found = checked(pool)
        fits = found.where("context = 'ok'").withColumn("part", tx.split_of(F.col("group_id"), seed))
        own = fits.where("part = 'train'")
        taken = _groups_within(own, seed + 3, recipe.train)
        out += [_fated(found.where("context <> 'ok'"), "context"), _fated(fits.where("part <> 'train'"), F.col("part")).drop("part"), _fated(_in(own, taken, "left_semi"), "train").drop("part"), _fated(_in(own, taken, "left_anti"), "over_cap").drop("part")]
    if unseen:
        found = checked(unseen)
        fits = _ranked(found.where("context = 'ok'"), seed)
        out += [_fated(found.where("context <> 'ok'"), "context"), _fated(fits, F.when(F.col("rank") <= recipe.unseen, "unseen").otherwise("not_needed")).drop("rank")]
    spark = parts[0].evaluation.sparkSession
    dropped = _every(rows) if rows else spark.createDataFrame([], "source_family string, record_id string, fate string")
    columns = [*RECORD, "packed_tokens", "fate"]
    return _every([f.select(*columns) for f in out]), dropped


def policy_records(cases: DataFrame, generator: str) -> DataFrame:
    """Generated policy cases as records; their provenance tells the pair, and for a composed rule its style and the certificate of its label."""
    extra = [F.col(c) for c in ("pair_kind", "sibling", "render_style", "certificate") if c in cases.columns]
    text = py.casefold_hash(py.sorted_json("state"))
    said = F.to_json(F.struct(F.lit(generator).alias("generator"), F.col("family"), *extra, text.alias("text_sha256")), {"ignoreNullFields": "false"})
    asked = F.array(catalog.question(F.lit("decision"), F.col("type"), F.col("instructions"), F.col("keys"), F.col("descriptions"), F.col("gold"), F.col("task")))
    return cases.select("record_id", "group_id", F.lit(generator).alias("source_family"), F.concat(F.lit(f"{generator}."), "family").alias("schema_family"), "state", asked.alias("questions"), text.alias("text_sha256"), said.alias("provenance"))


def support_records(spark: SparkSession) -> DataFrame:
    """The showcase of support messages as records of three questions."""
    rows = rq.support_showcase(spark)
    one = catalog.question(F.col("qid"), F.col("type"), F.col("instructions"), F.col("keys"), F.col("descriptions"), F.col("gold"), F.concat(F.lit("support_"), "qid"))
    found = rows.groupBy("record_id", F.col("state").alias("message")).agg(F.sort_array(F.collect_list(one)).alias("questions"))  # three to a record
    state, text = F.to_json(F.struct("message")), tx.text_hash(F.col("message"))
    said = F.to_json(F.struct(F.lit("written for the showcase").alias("generator"), text.alias("text_sha256")))
    return found.select("record_id", F.col("record_id").alias("group_id"), F.lit("support").alias("source_family"), F.lit("support.triage").alias("schema_family"), state.alias("state"), "questions", text.alias("text_sha256"), said.alias("provenance"))


def custom_as_records(requests: DataFrame, name: str, seed: int, several: bool = False) -> DataFrame:
    """What rq.labelled_requests gives as records of a custom corpus, with hashes and fate: their split, or that a question has no valid label or there is none. A projection, no shuffle."""
    rows = rq.named_lines(requests, name, several)
    one = lambda q: catalog.question(q["qid"], q["type"], q["instructions"], q["keys"], q["descriptions"], q["gold"], F.concat(F.lit(f"{name}_"), q["qid"]))
    valid = (F.size("questions") > 0) & F.forall("questions", lambda q: q["gold"].isNotNull())
    said = F.to_json(F.struct(F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "line", "text_sha256", "notes"), {"ignoreNullFields": "false"})
    fate = F.when(valid, tx.split_of(F.col("group_id"), seed)).otherwise("invalid_label")
    return rows.select("record_id", "group_id", F.lit(name).alias("source_family"), F.coalesce("schema_family", F.lit(f"{name}.custom")).alias("schema_family"), F.col("text").alias("state"), F.sort_array(F.transform("questions", one)).alias("questions"), "text_sha256", said.alias("provenance"), "hashes", fate.alias("fate"))


def forbidden_texts(records: DataFrame, *further: DataFrame) -> DataFrame:
    """Hashes (hash) that no custom record may have: of the texts of records, their states and each of their long strings, and of further states (state)."""
    states = [records.select("state"), *(f.select("state") for f in further)]
    return records.select(F.col("text_sha256").alias("hash")).union(_every(states).select(F.explode(py.state_hashes("state")))).distinct()


def build(parts: Sequence[Part], recipe: Recipe, tokens: Callable[[Column], Column], ids: Mapping[str, int], policy: Mapping[str, DataFrame] | None = None, support: DataFrame | None = None, custom: DataFrame | None = None, demos: Sequence[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """(the corpus' records with their split, the report: source_family, fate and n of all that was looked at).

    policy: records by where they go: `pool` is split by group and capped for training, others are splits' names. support goes to
    the showcase. custom: records with hashes and a fate; one that has a text of showcase, test or the demos' states is `forbidden_text`. They are
    written once, and joined by name with what is forbidden, so that texts aren't shuffled. All pass the
    context check. A group or a text of one source in two splits is a ValueError.
    """
    small_batches(parts[0].evaluation.sparkSession)
    found, dropped = public(parts, recipe, tokens, ids)
    frames = [found]
    fits = lambda rows: F.when(F.col("context") != "ok", "context").otherwise(rows)
    columns = [*RECORD, "packed_tokens", "fate"]
    for name, rows in (policy or {}).items():
        rows = with_context(rows, tokens, ids, recipe)
        if name != "pool":
            frames.append(_fated(rows, fits(F.lit(name))).select(*columns))
            continue
        rows = kept(_fated(rows, fits(tx.split_of(F.col("group_id"), recipe.seed))))
        own = rows.where("fate = 'train'")
        taken = _groups_within(own, recipe.seed + 4, recipe.train)
        frames += [rows.where("fate <> 'train'").select(*columns), _in(own, taken, "left_semi").select(*columns), _fated(_in(own, taken, "left_anti"), "over_cap").select(*columns)]
    if support is not None:
        frames.append(_fated(with_context(support, tokens, ids, recipe), fits(F.lit("showcase"))).select(*columns))
    every = kept(_every(frames))
    if custom is not None:
        forbidden = forbidden_texts(every.where(F.col("fate").isin("showcase", "test")), *demos)
        own = kept(with_context(custom, tokens, ids, recipe))
        hit = kept(leakage.colliding(own, "record_id", "hashes", forbidden)).withColumn("hit", F.lit(True))
        fate = F.when(F.col("hit"), "forbidden_text").when(F.col("fate").isin(*SPLITS), fits(F.col("fate"))).otherwise(F.col("fate"))
        every = every.unionByName(own.join(hit, "record_id", "left").withColumn("fate", fate).select(*columns))
    corpus = every.where(F.col("fate").isin(*SPLITS)).withColumnRenamed("fate", "split")
    if not splits.disjointness(corpus).where("violations > 0").isEmpty():
        raise ValueError("a group or a text is in two splits")
    report = every.select("source_family", "fate").unionByName(dropped.select("source_family", "fate")).groupBy("source_family", "fate").agg(F.count("*").alias("n"))
    return corpus, report


def extended_panel(parts: Sequence[Part], corpus: DataFrame, recipe: Recipe, tokens: Callable[[Column], Column], ids: Mapping[str, int], per_source: int) -> tuple[DataFrame, DataFrame]:
    """(a panel of sources that were never trained on, the report of what was considered for it).

    Of each source the first per_source rows in the seed's order that are labelled and valid, share no text (whole, or a string of five
    words or more) with train, dev or calibration, and fit the context. Rows behind the last one taken aren't counted.
    """
    seen = corpus.where(F.col("split").isin("train", "dev", "calibration")).select(F.explode(py.state_hashes("state")).alias("hash"))
    frames, unlabelled = [], []
    for p in parts:
        named = _identified(p, p.evaluation, "evaluation")
        ranked = numbered(named.withColumn("__order", tx.order_hash(F.col("record_id"), recipe.seed)), "__order", "record_id", name="rank")
        frames.append(_converted(p, ranked.where("labelled"), recipe.seed).join(ranked.select("record_id", "rank"), "record_id"))
        unlabelled.append(ranked.where("not labelled").select("source_family", "rank", F.lit("unlabelled").alias("fate")))
    found = with_context(_every(frames), tokens, ids, recipe)
    hit = leakage.colliding(found.withColumn("hashes", py.state_hashes("state")), "record_id", "hashes", seen).withColumn("hit", F.lit(True))
    fate = F.when(~F.col("valid"), "unlabelled").when(F.col("hit"), "text_collision").when(F.col("context") != "ok", "context").otherwise("extended")
    found = kept(found.join(hit, "record_id", "left").withColumn("fate", fate).drop("hit", "valid", "context"))
    good = found.where("fate = 'extended'").withColumn("taken", F.row_number().over(Window.partitionBy("source_family").orderBy("rank"))).where(F.col("taken") <= per_source)
    last = good.groupBy("source_family").agg(F.max("taken").alias("size"), F.max("rank").alias("last"))
    looked = found.select("source_family", "rank", "fate").unionByName(_every(unlabelled)).join(last, "source_family", "left")
    full = F.coalesce(F.col("size") >= per_source, F.lit(False))  # a source that is not full was looked through
    report = looked.where(~full | (F.col("rank") <= F.col("last"))).groupBy("source_family", "fate").agg(F.count("*").alias("n"))
    return good.select(*RECORD, "packed_tokens", F.lit("extended").alias("split")), report

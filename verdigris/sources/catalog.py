"""Public classification sources as typed questions: one specification each, one way to apply them.

A specification says which columns make the state, how the question is put, which options it has and which key
is gold. Applying it is a projection: state (JSON text), qid, type, instructions, keys, descriptions, gold,
schema_family. Draws (wrapping, shuffling, leaving out descriptions) are hashes of the row's key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import questions as qs
from verdigris.functions import text as tx
from verdigris.operators.converters import described, shuffled, wrapped_state

#: Option ids with their descriptions, in canonical order; and those of the changed schema.
AGNEWS = {"world": "World news: politics, international affairs, conflicts", "sports": "Sports: games, athletes, teams, results", "business": "Business: companies, markets, economy, finance", "scitech": "Science and technology: research, gadgets, software, space"}
AGNEWS_VARIANT = {"sports": "Athletics, matches and tournaments", "scitech": "Research, computing, gadgets and space", "business": "Companies, earnings and markets", "world": "International politics, diplomacy and conflict"}
MNLI = {"entailment": "The hypothesis follows from the premise", "neutral": "The hypothesis may or may not be true given the premise", "contradiction": "The hypothesis contradicts the premise"}
MNLI_VARIANT = {"contradiction": "The premise rules the hypothesis out", "entailment": "The premise guarantees the hypothesis", "neutral": "The premise neither guarantees nor rules out the hypothesis"}
TREC = {"abbreviation": "Asks what an abbreviation stands for", "entity": "Asks about a thing, object, animal, product, or creative work", "description": "Asks for a definition, description, reason, or manner", "human": "Asks about a person, group, or organisation", "location": "Asks about a place", "number": "Asks for a number, date, count, or other numeric value"}
TREC_VARIANT = {"number": "A quantity, date or measurement", "location": "A place", "human": "A person or organisation", "entity": "A thing, product, animal or work", "description": "An explanation or definition", "abbreviation": "The expansion of an abbreviation"}
SST5 = ("very negative", "negative", "neutral", "positive", "very positive")
SST5_VARIANT = ("strongly negative opinion", "somewhat negative opinion", "mixed or no opinion", "somewhat positive opinion", "strongly positive opinion")
EMOTION = ("sadness", "joy", "love", "anger", "fear", "surprise")
AMAZON = ("1 star: very negative", "2 stars: negative", "3 stars: mixed", "4 stars: positive", "5 stars: very positive")
FOUR = ("a", "b", "c", "d")
#: Wordings of an intent's description, what an instruction may ask to look at, a passage question's criteria.
INTENT_WORDS = ("Customer asks about {}", "Issue concerning {}", "Request related to {}", "{}")
FOCUS = ("Use only the information given.", "Pick the single best fit.", "Consider the whole message.")
PASSAGE = {"true": "The passage supports a yes answer", "false": "The passage supports a no answer or does not say"}
#: Shares of instructions with a focus and of passage questions with criteria; of descriptions left out and put as objects.
FOCUSED, CRITERIA_SHARE, DRAWN, DRAWN_INTENTS = 0.15, 0.4, (0.3, 0.1), (0.5, 0.0)


@dataclass(frozen=True)
class Origin:
    """Where a source's rows come from: repository, configuration, branch to pin, splits, and the column that groups rows."""

    repo: str
    config: str | None
    branch: str | None
    train: str | None
    evaluation: str
    field: str


#: The public sources. With a train split: trained on; UNSEEN and EXTENDED only evaluate.
ORIGINS = {
    "agnews": Origin("fancyzhx/ag_news", None, None, "train", "test", "text"),
    "trec": Origin("CogComp/trec", None, "refs/convert/parquet", "train", "test", "text"),
    "banking77": Origin("legacy-datasets/banking77", None, None, "train", "test", "text"),
    "boolq": Origin("google/boolq", None, None, "train", "validation", "passage"),
    "mnli": Origin("nyu-mll/multi_nli", None, None, "train", "validation_matched", "premise"),
    "sst5": Origin("SetFit/sst5", None, None, "train", "test", "text"),
    "paws": Origin("google-research-datasets/paws", "labeled_final", None, None, "test", "sentence1"),
    "qnli": Origin("nyu-mll/glue", "qnli", None, None, "validation", "sentence"),
    "emotion": Origin("dair-ai/emotion", "split", None, None, "test", "text"),
    "mmlu": Origin("cais/mmlu", "all", None, None, "test", "question"),
    "arc": Origin("allenai/ai2_arc", "ARC-Challenge", None, None, "test", "question"),
    "sciq": Origin("allenai/sciq", None, None, None, "test", "question"),
    "tweet_offensive": Origin("cardiffnlp/tweet_eval", "offensive", None, None, "test", "text"),
    "imdb": Origin("stanfordnlp/imdb", None, None, None, "test", "text"),
    "amazon": Origin("SetFit/amazon_reviews_multi_en", None, None, None, "test", "text"),
    "dbpedia14": Origin("fancyzhx/dbpedia_14", None, None, None, "test", "content"),
}
TRAINABLE = tuple(n for n, o in ORIGINS.items() if o.train)
UNSEEN = ("paws", "qnli", "emotion")
EXTENDED = tuple(n for n in ORIGINS if n not in (*TRAINABLE, *UNSEEN))


def source_path(name: str, split: str, root: str, revision: str | None = None) -> str:
    """Where a source's split is kept under root: repository, configuration, revision (its branch if none is pinned), split."""
    o = ORIGINS[name]
    if split not in (o.train, o.evaluation):
        raise ValueError(f"{name} has no split {split}")
    return "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate((root, o.repo, o.config or "default", revision or o.branch or "main", split)))


def scan(spark: SparkSession, name: str, split: str, root: str, revision: str | None = None) -> DataFrame:
    """A source's split as it is kept under root, with `row`, each row's place in the split (files by name, from 0): what its records are named by.

    Rows are numbered where they are read: a row's place in its file, and the rows of the files before it, of which there is one number a file.
    """
    path = source_path(name, split, root, revision)
    rows = spark.read.parquet(path)
    place = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = place.groupBy("__file").agg(F.count("*").alias("n")).orderBy("__file").collect()
    before, starts = 0, []
    for f in files:
        starts.append((f["__file"], before))
        before += f["n"]
    known = spark.createDataFrame(starts, "__file string, __start long")
    return place.join(F.broadcast(known), "__file").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__start") + F.col("__at")).alias("row"))


def literal(values: Sequence[str | None]) -> Column:
    return F.array(*(F.lit(v).cast("string") for v in values)) if values else F.array().cast("array<string>")


@dataclass(frozen=True)
class Spec:
    """How a source's rows become a question. gold: a column that names a key; options: id to description, or level texts."""

    name: str
    qid: str
    kind: str
    text: Callable[[], Column]
    ask: Callable[[], Column]
    gold: Callable[[], Column]
    options: dict[str, str | None] | tuple[str, ...] = ()
    wrap: bool = True
    variant_field: str | None = None
    variant_ask: Callable[[], Column] | None = None
    variant_options: dict[str, str | None] | tuple[str, ...] = ()
    keys: Callable[[Column], tuple[Column, Column, Column]] | None = None  # from the row's key: keys, descriptions, gold
    drawn: tuple[float, float] | None = None  # shares of descriptions left out and put as objects
    focused: bool = False  # a share of instructions asks to look at something
    criteria: dict[str, str] | None = None  # of a yes/no question, for a share of rows
    worded: tuple[str, ...] = ()  # wordings that a row's descriptions are put in, one for all of them

    @property
    def family(self) -> str:
        return f"{self.name}.{self.qid}"


def say(text: str) -> Callable[[], Column]:
    return lambda: F.lit(text)


def quoting(before: str, column: str, after: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), F.col(column), F.lit(after))


def nth(values: Sequence[str], column: str) -> Callable[[], Column]:
    return lambda: F.get(literal(list(values)), F.col(column).cast("int"))


def boolean(test: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.when(test(), "true").otherwise("false")


def numbered(column: str) -> Callable[[], Column]:
    return lambda: F.col(column).cast("string")


def _mcq(key: Column, options: Column, labels: Column, answer: Column, seed: int = 7) -> tuple[Column, Column, Column]:
    """Neutral keys opt_1.. over options in hash order; gold: where the answer's option went."""
    order = shuffled(F.transform(qs.indices(F.size(options)), lambda i: i.cast("string")), key, seed)
    keys = F.transform(qs.indices(F.size(options)), lambda i: F.concat(F.lit("opt_"), (i + 1).cast("string")))
    right = (F.array_position(labels, answer) - 1).cast("string")
    return keys, F.transform(order, lambda i: F.get(options, i.cast("int"))), F.concat(F.lit("opt_"), F.array_position(order, right).cast("string"))


def _arc(key: Column) -> tuple[Column, Column, Column]:
    return _mcq(key, F.col("choices.text"), F.col("choices.label"), F.col("answerKey"))


def _sciq(key: Column) -> tuple[Column, Column, Column]:
    options = F.array("correct_answer", "distractor1", "distractor2", "distractor3")
    order = shuffled(F.array(*(F.lit(str(i)) for i in range(4))), key, 7)
    return literal(FOUR), F.transform(order, lambda i: F.get(options, i.cast("int"))), F.get(literal(FOUR), (F.array_position(order, F.lit("0")) - 1).cast("int"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


_COL = lambda name: lambda: F.col(name)
_YES = {"true": None, "false": None}
#: Fixed values below: the questions' texts.
SPECS = {
    s.name: s
    for s in (
        Spec("agnews", "topic", "choice", _COL("text"), say("What is the topic of this article?"), nth(list(AGNEWS), "label"), AGNEWS, True, "article", say("Which newspaper section would this story run in?"), AGNEWS_VARIANT, drawn=DRAWN, focused=True),
        Spec("trec", "answer_type", "choice", _COL("text"), say("What kind of answer does this question ask for?"), nth(list(TREC), "coarse_label"), TREC, True, "question", say("What type of information would a correct answer provide?"), TREC_VARIANT),
        Spec("boolq", "answer", "noul", _COL("passage"), lambda: tx.question_mark(F.col("question")), boolean(_COL("answer")), _YES, True, "passage", lambda: F.concat(F.lit("According to the passage: "), tx.question_mark(F.col("question"))), {"true": "The passage confirms it", "false": "The passage denies it or does not say"}, focused=True, criteria=PASSAGE),
        Spec("mnli", "relation", "choice", _COL("premise"), quoting('Hypothesis: "', "hypothesis", '" How does it relate to the premise?'), nth(list(MNLI), "label"), MNLI, True, "premise", quoting('Does the premise support, rule out, or leave open this hypothesis: "', "hypothesis", '"?'), MNLI_VARIANT, drawn=DRAWN, focused=True),
        Spec("sst5", "sentiment", "score", _COL("text"), say("What is the sentiment of this review sentence?"), numbered("label"), SST5, True, "review", say("How positive or negative is the writer's opinion?"), SST5_VARIANT, focused=True),
        Spec("emotion", "emotion", "choice", _COL("text"), say("Which emotion does the writer express?"), nth(EMOTION, "label"), dict.fromkeys(EMOTION), False),
        Spec("qnli", "answers", "noul", _COL("sentence"), quoting('Does the sentence contain the answer to this question: "', "question", '"'), boolean(lambda: F.col("label") == 0), _YES),
        Spec("paws", "paraphrase", "noul", _COL("sentence1"), quoting('Does this sentence mean the same thing: "', "sentence2", '"'), boolean(lambda: F.col("label") == 1), {"true": "Same meaning, possibly reworded", "false": "Different meaning, even if most words match"}),
        Spec("mmlu", "answer", "choice", lambda: _json(subject=F.translate("subject", "_", " "), question=F.col("question")), say("Which option correctly answers the question?"), nth(FOUR, "answer"), (), False, keys=lambda key: (literal(FOUR), F.col("choices"), nth(FOUR, "answer")())),
        Spec("arc", "answer", "choice", lambda: _json(question=F.col("question")), say("Which option correctly answers the question?"), _COL("answerKey"), (), False, keys=_arc),
        Spec("sciq", "answer", "choice", lambda: F.when(F.coalesce("support", F.lit("")) == "", _json(question=F.col("question"))).otherwise(_json(passage=F.col("support"), question=F.col("question"))), say("Which option answers the science question?"), say("a"), (), False, keys=_sciq),
        Spec("tweet_offensive", "offensive", "noul", _COL("text"), say("Is this post offensive?"), boolean(lambda: F.col("label") == 1), {"true": "Contains insults, threats, profanity directed at someone, or hateful content", "false": "Not offensive"}, False),
        Spec("imdb", "positive", "noul", lambda: tx.word_clip(F.replace("text", F.lit("<br />"), F.lit(" ")), 220), say("Is this movie review positive?"), boolean(lambda: F.col("label") == 1), {"true": "The reviewer liked the film overall", "false": "The reviewer disliked the film overall"}),
        Spec("amazon", "stars", "score", lambda: tx.word_clip(F.col("text"), 220), say("How many stars did this product reviewer give?"), numbered("label"), AMAZON),
    )
}


def intents(names: Sequence[str]) -> Spec:
    """Customer messages by intent, the names that come with the data: descriptions in one of several wordings, half left out."""
    words = {n: n.replace("_", " ") for n in names}
    return Spec("banking77", "intent", "choice", _COL("text"), say("Which banking intent best describes this customer message?"), nth(names, "label"), words, True, "customer_message", say("What does the customer want help with?"), dict.fromkeys(reversed(names)), drawn=DRAWN_INTENTS, focused=True, worded=INTENT_WORDS)


def categories(names: Sequence[str]) -> Spec:
    """Encyclopedia texts, their first 200 words, by category: ids in lower case with underscores, no descriptions."""
    ids = [n.lower().replace(" ", "_") for n in names]
    return Spec("dbpedia14", "category", "choice", lambda: tx.word_clip(F.col("content"), 200), say("Which category does the subject of this encyclopedia text belong to?"), nth(ids, "label"), dict.fromkeys(ids))


def _about_topics(key: Column, seed: int) -> Column:
    """Two yes/no questions about a news row, on two of the four topics drawn by the row's key."""
    topics = shuffled(literal(list(AGNEWS)), key.cast("string"), seed)
    about = F.create_map(*(F.lit(x) for k, v in AGNEWS.items() for x in (k, v.split(":")[0].lower())))
    gold = nth(list(AGNEWS), "label")()
    one = lambda t: question(F.concat(F.lit("is_"), t), F.lit("noul"), F.concat(F.lit("Is this article about "), about[t], F.lit("?")), literal(["false", "true"]), literal([None, None]), F.when(t == gold, "true").otherwise("false"), F.lit("agnews_yn"))
    return F.transform(F.slice(topics, 1, 2), one)


def question(qid: Column, kind: Column, ask: Column, keys: Column, descriptions: Column, gold: Column, task: Column) -> Column:
    """A labelled question of a record."""
    return F.struct(qid.alias("qid"), kind.alias("type"), ask.alias("instructions"), keys.alias("keys"), descriptions.alias("descriptions"), gold.alias("gold"), task.alias("task"))


def topic_questions(rows: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """The two yes/no questions of each news row, over the same wrapped state as its topic question."""
    rows = records(rows, SPECS["agnews"], key, seed=seed).select("row_key", "state", "schema_family", F.explode(F.slice("questions", 2, 2)).alias("q"))
    return rows.select("row_key", "state", *(F.col(f"q.{c}").alias(c) for c in ("qid", "type", "instructions", "keys", "descriptions", "gold")), "schema_family", F.lit(True).alias("valid"))


def records(rows: DataFrame, spec: Spec, key: Column, variant: bool = False, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Labelled rows as records, one each: row_key, state, schema_family, questions (as of question()), valid and the columns in keep; a news row has three questions over one state."""
    several = spec.name == "agnews" and not variant
    own = convert(rows.withColumn("__more", _about_topics(key, seed)) if several else rows, spec, key, variant, seed, (*keep, "__more") if several else keep)
    one = F.array(question(F.col("qid"), F.col("type"), F.col("instructions"), F.col("keys"), F.col("descriptions"), F.col("gold"), F.lit(spec.name)))
    return own.select("row_key", "state", "schema_family", (F.concat(one, "__more") if several else one).alias("questions"), "valid", *keep)


def convert(rows: DataFrame, spec: Spec, key: Column, variant: bool = False, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Labelled questions of rows that have a label (-1: none; it is dropped). A gold that is no key fails the valid column.

    variant: the changed schema, other wording, descriptions and order, with the text in a named field. keep: columns of rows that stay.
    """
    if variant and spec.variant_field is None:
        raise ValueError(f"{spec.name} has no changed schema")
    if "label" in rows.columns:
        rows = rows.where(F.coalesce(F.expr("try_cast(label as int)"), F.lit(0)) != -1)
    u = lambda what: tx.uniform(F.concat(F.lit(f"{seed}:{spec.name}:{what}:"), key.cast("string")))
    text, options = spec.text(), spec.variant_options if variant else spec.options
    state = _json(**{spec.variant_field: text}) if variant else wrapped_state(text, u("wrap"), u("channel")) if spec.wrap else text
    if spec.keys:
        keys, descriptions, gold = spec.keys(key.cast("string"))
    elif spec.kind == "score":
        keys, descriptions, gold = qs.question_keys(F.lit("score"), literal(options)), literal(options), spec.gold()
    else:
        ids, said = list(options), list(options.values())
        if spec.kind == "noul":
            ids, said = ["false", "true"], [options.get("false"), options.get("true")]
        keys, gold = literal(ids), spec.gold()
        worded = F.floor(u("words") * len(spec.worded)).cast("int")
        put = lambda d: F.get(F.array(*(F.lit(w.format(d)) for w in spec.worded)), worded) if spec.worded and d else F.lit(d).cast("string")
        if spec.drawn and not variant:
            descriptions = F.array(*(described(put(d), u(f"desc{i}"), *spec.drawn) for i, d in enumerate(said)))
        else:
            descriptions = literal(said)
        if spec.criteria and not variant:
            descriptions = F.when(u("criteria") < CRITERIA_SHARE, literal([spec.criteria["false"], spec.criteria["true"]])).otherwise(descriptions)
    ask = (spec.variant_ask if variant else spec.ask)()
    if spec.focused and not variant:
        ask = F.when(u("focused") < FOCUSED, _json(question=ask, focus=F.get(literal(FOCUS), F.floor(u("focus") * len(FOCUS)).cast("int")))).otherwise(ask)
    out = rows.select(key.cast("string").alias("row_key"), state.alias("state"), F.lit(spec.qid).alias("qid"), F.lit(spec.kind).alias("type"), ask.alias("instructions"), keys.alias("keys"), descriptions.alias("descriptions"), gold.alias("gold"), F.lit(f"{spec.name}.variant" if variant else spec.family).alias("schema_family"), *keep)
    return out.withColumn("valid", F.coalesce(F.array_contains("keys", F.col("gold")), F.lit(False)))

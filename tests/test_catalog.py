import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators import scoring
from verdigris.sources import catalog

TEXT = "label int, text string"
CASES = {
    "agnews": ("label int, text string", (1, "a b"), "sports"),
    "trec": ("coarse_label int, text string", (5, "how many"), "number"),
    "boolq": ("question string, passage string, answer boolean", ("is it so??", "p", False), "false"),
    "mnli": ("premise string, hypothesis string, label int", ("p", "h", 2), "contradiction"),
    "sst5": (TEXT, (4, "good"), "4"),
    "emotion": (TEXT, (3, "grr"), "anger"),
    "qnli": ("sentence string, question string, label int", ("s", "q", 0), "true"),
    "paws": ("sentence1 string, sentence2 string, label int", ("a", "b", 0), "false"),
    "mmlu": ("subject string, question string, choices array<string>, answer int", ("high_school", "q", ["w", "x", "y", "z"], 2), "c"),
    "tweet_offensive": (TEXT, (1, "x"), "true"),
    "imdb": (TEXT, (0, "a<br />b"), "false"),
    "amazon": (TEXT, (0, "bad"), "0"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_gold_is_a_key(spark, name):
    schema, row, gold = CASES[name]
    df = spark.createDataFrame([row], schema)
    spec = catalog.SPECS[name]
    for variant in (False, True) if spec.variant_field else (False,):
        out = catalog.convert(df, spec, F.lit(1), variant).first()
        assert out["gold"] == gold and out["valid"] and len(out["keys"]) == len(out["descriptions"])
    if spec.variant_field is None:
        with pytest.raises(ValueError):
            catalog.convert(df, spec, F.lit(1), variant=True)


def test_shuffled_options_keep_their_answer(spark):
    arc = spark.createDataFrame([(i, "q", (["A", "B", "C"], ["one", "two", "three"]), "B") for i in range(30)], "i int, question string, choices struct<label:array<string>,text:array<string>>, answerKey string")
    sciq = spark.createDataFrame([(i, "" if i % 2 else "s", "q", "right", "w1", "w2", "w3") for i in range(30)], "i int, support string, question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string")
    for name, df, right in (("arc", arc, "two"), ("sciq", sciq, "right")):
        rows = catalog.convert(df, catalog.SPECS[name], F.col("i")).collect()
        assert all(r["descriptions"][r["keys"].index(r["gold"])] == right for r in rows) and len({r["gold"] for r in rows}) > 1
    assert ["passage" in json.loads(r["state"]) for r in rows] == [r["row_key"] in map(str, range(0, 30, 2)) for r in rows]


def test_unlabelled_rows_go_and_names_are_ids(spark):
    spec = catalog.intents(["card_arrival", "pin_blocked"])
    df = spark.createDataFrame([(0, "x"), (-1, "y"), (1, "z")], TEXT)
    rows = catalog.convert(df, spec, F.col("text"), variant=True).collect()
    assert [r["gold"] for r in rows] == ["card_arrival", "pin_blocked"] and rows[0]["keys"] == ["pin_blocked", "card_arrival"] and rows[0]["descriptions"] == [None, None]
    row = catalog.convert(spark.createDataFrame([(1, "w " * 300)], "label int, content string"), catalog.categories(["Company", "Natural Place"]), F.lit(1)).first()
    assert row["gold"] == "natural_place" and row["keys"] == ["company", "natural_place"] and row["state"].count("w") == 200


def test_draws(spark):
    """Shares of what is drawn, and that what isn't drawn stays whole."""
    n = 3000
    df = spark.range(n).selectExpr("id", "cast(id % 4 AS int) AS label", "cast(id % 6 AS int) AS coarse_label", "concat('text ', id) AS text", "'is it' AS question", "concat('p ', id) AS passage", "id % 2 = 0 AS answer")
    trec = catalog.convert(df, catalog.SPECS["trec"], F.col("id")).collect()
    assert {tuple(r["descriptions"]) for r in trec} == {tuple(catalog.TREC.values())} and {r["instructions"] for r in trec} == {"What kind of answer does this question ask for?"}
    news = catalog.convert(df, catalog.SPECS["agnews"], F.col("id")).collect()
    said = [d for r in news for d in r["descriptions"]]
    assert abs(said.count(None) / len(said) - 0.3) < 0.03 and abs(sum(d is not None and d.startswith("{") for d in said) / len(said) - 0.1) < 0.02
    asked = [r["instructions"] for r in news]
    assert abs(sum(a.startswith("{") for a in asked) / n - 0.15) < 0.03 and {json.loads(a)["focus"] for a in asked if a.startswith("{")} == set(catalog.FOCUS)
    assert {json.loads(a)["question"] if a.startswith("{") else a for a in asked} == {"What is the topic of this article?"}
    boolq = catalog.convert(df, catalog.SPECS["boolq"], F.col("id")).collect()
    given = [tuple(r["descriptions"]) for r in boolq]
    assert set(given) == {(None, None), (catalog.PASSAGE["false"], catalog.PASSAGE["true"])} and abs(given.count((None, None)) / n - 0.6) < 0.04
    bank = catalog.convert(df, catalog.intents(["card_arrival", "a_b", "c", "d"]), F.col("id")).collect()
    words = {r["descriptions"][0] for r in bank} - {None}
    assert words == {w.format("card arrival") for w in catalog.INTENT_WORDS} and all(len({d.split(" card")[0] for d in r["descriptions"][:1] if d}) < 2 for r in bank)
    topics = catalog.topic_questions(df, F.col("id")).collect()
    assert len(topics) == 2 * n and len({(r["row_key"], r["qid"]) for r in topics}) == 2 * n
    assert all((r["gold"] == "true") == (r["qid"] == "is_" + list(catalog.AGNEWS)[int(r["row_key"]) % 4]) for r in topics)
    assert {r["instructions"] for r in topics} == {f"Is this article about {x}?" for x in ("world news", "sports", "business", "science and technology")}


def test_origins():
    assert catalog.TRAINABLE == ("agnews", "trec", "banking77", "boolq", "mnli", "sst5") and len(catalog.EXTENDED) == 7
    assert catalog.source_path("trec", "test", "/data/") == "/data/CogComp/trec/default/refs/convert/parquet/test"
    assert catalog.source_path("qnli", "validation", "s3://b", "abc") == "s3://b/nyu-mll/glue/qnli/abc/validation"
    with pytest.raises(ValueError):
        catalog.source_path("qnli", "train", "/")


def test_scorers(spark):
    inner = scoring.MarkerScorer({"de": "ä"}, 10.0, 1.0)
    df = spark.createDataFrame([("ää", ["de", "en"]), (None, ["en"])], "state string, keys array<string>")
    found = {r["state"]: r["logits"] for r in scoring.score(df, scoring.PositionBiased(inner, [0.5, 0.0])).collect()}
    assert found == {"ää": [10.5, 1.0], None: [1.5]}


def test_scan_numbers_rows_by_file(spark, tmp_path):
    path = catalog.source_path("trec", "train", str(tmp_path))
    for k in range(3):
        spark.range(10 * k, 10 * k + 4 + k).selectExpr("id", "concat('t', id) AS text").coalesce(1).write.mode("append").parquet(path)
    import os

    for n, f in enumerate(sorted((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{path}/{f}").agg(F.min("id")).first()[0])):
        os.rename(f"{path}/{f}", f"{path}/part-{n}.parquet")
    rows = catalog.scan(spark, "trec", "train", str(tmp_path)).collect()
    assert sorted((r["row"], r["id"]) for r in rows) == list(enumerate([*range(4), *range(10, 15), *range(20, 26)]))
    with pytest.raises(ValueError):
        catalog.scan(spark, "trec", "validation", str(tmp_path))

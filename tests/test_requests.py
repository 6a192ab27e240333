"""Encoding, teacher side and request files against plain versions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.operators import encoding, teacher
from verdigris.sources import readers
from verdigris.sources import requests as rq

IDS = {"state": 1, "question": 2, "option": 3, "end_option": 4, "decide": 5}
QUESTIONS = "record_id string, ordinal int, state string, qid string, type string, instructions string, keys array<string>, descriptions array<string>, gold string"
ROWS = [
    ("r1", 0, '{"a": "x <|fim_prefix|>", "b": [1, 2]}', "team", "choice", "Who?", ["ops", "dev"], ["Runs it", None], "dev"),
    ("r1", 1, '{"a": "x <|fim_prefix|>", "b": [1, 2]}', "ok", "noul", '{"question": "Fine?", "focus": "All"}', ["false", "true"], [None, "It is\nso"], "true"),
    ("r1", 2, '{"a": "x <|fim_prefix|>", "b": [1, 2]}', "level", "score", None, ["0", "1", "2"], ["low", '{"what": "mid"}', "high"], "2"),
    ("r2", 0, "", "team", "choice", "Who?", ["only"], [None], "only"),
]


def characters(text):
    """A tokenizer for tests: one id a character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) + 100)


def plain_encode(state, questions):
    token = lambda text: [100 + ord(c) if ord(c) < 128 else 100 + ord(c) for c in text]
    ids = [1, *token(state)]
    n = len(ids)
    seg, pos, opt, decide, ends = [0] * n, list(range(n)), [-1] * n, [], []
    for k, (ask, options) in enumerate(questions, 1):
        branch, marks, own = [2, *token(ask)], [-1] * (1 + len(ask)), []
        for j, o in enumerate(options):
            branch += [3, *token(o), 4]
            marks += [j] * (len(o) + 2)
            own.append(len(ids) + len(branch) - 1)
        branch.append(5)
        marks.append(-2)
        seg += [k] * len(branch)
        pos += range(n, n + len(branch))
        opt += marks
        ids += branch
        decide.append(len(ids) - 1)
        ends.append(own)
    return {"ids": ids, "seg": seg, "pos": pos, "opt": opt, "n_state": n, "decide_idx": decide, "opt_idx": ends}


@pytest.fixture(scope="module")
def asked(spark):
    rows = encoding.rendered(spark.createDataFrame(ROWS, QUESTIONS))
    return rows.withColumn("state", py.render_content("state"))


@pytest.fixture(scope="module")
def records(asked):
    one = F.struct("ordinal", "instructions", "options")
    return asked.groupBy("record_id").agg(F.first("state").alias("state"), F.array_sort(F.collect_list(one)).alias("questions"))


STATE = "a: x <¦fim_prefix¦>\nb:\n  - 1\n  - 2"
ASKED = [("Who?", ["ops: Runs it", "dev"]), ("question: Fine?\nfocus: All", ["no", "yes: It is\nso"]), ("", ["low", "what: mid", "high"])]


def test_layouts_and_rows(records):
    found = {r["record_id"]: r.asDict() for r in encoding.encoded(records, characters, IDS).collect()}
    want = plain_encode(STATE, ASKED)
    assert {k: found["r1"][k] for k in want} == want and found["r1"]["status"] == "ok"
    want = plain_encode("", [("Who?", ["only"])])
    assert {k: found["r2"][k] for k in want} == want
    full = found["r1"]
    for r in encoding.rows_of(encoding.encoded(records, characters, IDS)).where("record_id = 'r1'").collect():
        k = r["question"] - 1
        start = full["n_state"] if k == 0 else full["decide_idx"][k - 1] + 1
        assert r["ids"] == full["ids"][start : full["decide_idx"][k] + 1] and r["pos"] == full["pos"][start : full["decide_idx"][k] + 1]
        assert r["state_ids"] == full["ids"][: full["n_state"]] and r["ids"][r["decide"]] == 5 and all(r["ids"][o] == 4 for o in r["opts"])
    limits = lambda **x: {r["record_id"]: (r["status"], r["ids"] is None) for r in encoding.encoded(records, characters, IDS, **x).collect()}
    assert limits(max_state=10) == {"r1": ("state_over_limit", True), "r2": ("ok", False)}
    assert limits(max_row=60)["r1"] == ("row_over_limit", True) and limits(max_packed=100)["r1"] == ("packed_over_limit", True)
    assert encoding.delimiter_ids({t: i for i, t in enumerate(encoding.DELIMITERS.values())})["decide"] == 4
    with pytest.raises(ValueError, match="lacks"):
        encoding.delimiter_ids({"a": 1})


def test_answers(spark):
    rows = [("choice", ["refund", "cancel"], [0.25, 0.75]), ("noul", ["false", "true"], [0.1, 0.9]), ("score", ["0", "1", "2"], [0.2, 0.5, 0.3]), ("noul", ["false", "true"], [0.5, 0.5])]
    df = spark.createDataFrame(rows, "type string, keys array<string>, probs array<double>")
    a, b, c, d = (r["a"] for r in df.select(encoding.answers(F.col("type"), F.col("keys"), F.col("probs")).alias("a")).collect())
    assert (a["choice"], a["top_probability"], a["decision"]) == ("cancel", 0.75, None) and a["probabilities"] == {"refund": 0.25, "cancel": 0.75}
    assert (b["p_true"], b["decision"], b["top_probability"]) == (0.9, True, None) and d["decision"]
    assert (c["level"], round(c["expected_level"], 12), c["top_probability"]) == (1, 1.1, 0.5)
    with pytest.raises(Exception, match="differ in number"):
        df.select(encoding.answers(F.col("type"), F.col("keys"), F.array(F.lit(1.0))).alias("a")).collect()


def test_prompts(asked):
    rows = {r["qid"] + r["record_id"]: r for r in encoding.described(asked).collect()}
    assert rows["teamr1"]["lines"] == 'Question "team" (choice)\n  instructions: Who?\n  answer: exactly one option id from this list, as a JSON string\n    "ops": Runs it\n    "dev"'
    assert rows["okr1"]["lines"] == 'Question "ok" (noul)\n  instructions: question: Fine?\n    focus: All\n  answer: true or false, as a JSON boolean\n    true: It is so'
    assert rows["levelr1"]["lines"] == 'Question "level" (score)\n  answer: one level index from 0 to 2, as a JSON integer\n    0: low\n    1: what: mid\n    2: high'
    assert rows["levelr1"]["legend"] == {"0": "low", "1": "what: mid", "2": "high"} and rows["okr1"]["legend"] is None
    whole = encoding.described(asked).where("record_id = 'r2'").select(encoding.prompt_text(F.col("state"), F.array("lines"), F.array("qid", F.lit('a"b'))).alias("p")).first()["p"]
    assert whole.startswith("Read the state and answer every question.\n\nState:\n\n\nQuestions:\nQuestion ") and whole.endswith('the question ids ("team", "a\\"b") and whose values are the answers. No other text.')


def test_teacher_prompts(asked):
    turned = F.reverse(qs.indices(F.size("options")))
    rows = {r["qid"] + r["record_id"]: r["u"] for r in asked.select("record_id", "qid", teacher.user_text(F.col("state"), F.col("type"), F.col("instructions"), F.col("options"), F.col("descriptions"), turned).alias("u")).collect()}
    assert rows["teamr1"] == f"State:\n{STATE}\n\nQuestion: Who?\nOptions:\nA. dev\nB. ops: Runs it\nAnswer with the letter only."
    assert rows["okr1"] == f"State:\n{STATE}\n\nQuestion: question: Fine?\nfocus: All\nYes means: It is\nso\nAnswer No or Yes."
    assert rows["levelr1"] == f"State:\n{STATE}\n\nQuestion: \nPick the level that applies (the levels are ordered):\n0. high\n1. what: mid\n2. low\nAnswer with the number only."
    assert rows["teamr2"].startswith("State:\n(empty)\n")
    chat = asked.limit(1).select(teacher.chat_text(F.lit("hi")).alias("c")).first()["c"]
    assert chat.count("<|im_start|>") == 3 and teacher.SYSTEM in chat and chat.index("hi<|im_end|>") > 0


def test_label_tokens():
    vocabulary = {"A": [1], " B": [2], "Yes": [3], " Yes": [3], "No": [3]}
    tokenise = lambda text: vocabulary.get(text, [9, 9])
    assert teacher.map_label_tokens(["A", "B"], tokenise) == ([1, 2], ["A", " B"])
    for bad in (["C"], ["Yes", "No"]):
        with pytest.raises(teacher.LabelTokenError):
            teacher.map_label_tokens(bad, tokenise)


def test_training_vectors(spark, asked):
    targets = [(1, "r1", "team", True, {"dev": 0.2, "ops": 0.8}, None), (2, "r1", "team", True, {"dev": 0.4, "ops": 0.6}, None), (3, "r1", "ok", False, {"true": 1.0, "false": 0.0}, "why"), (4, "r1", "level", True, None, None)]
    df = spark.createDataFrame(targets, "at long, record_id string, qid string, eligible boolean, cyclic map<string,double>, reason string")
    good = teacher.usable(df, "at")
    rows = {(r["record_id"], r["qid"]): r for r in teacher.with_teacher(asked, good).collect()}
    assert rows["r1", "team"]["target"] == [0.3, 0.7] and rows["r1", "ok"]["target"] == [0.0, 1.0] and rows["r2", "team"]["target"] == [1.0]
    assert teacher.coverage(asked, good).first().asDict() == {"taught": 1, "questions": 4}
    assert [tuple(r) for r in teacher.reasons(df).collect()] == [("why", 1)]
    wrong = spark.createDataFrame([("r1", "team", {"dev": 1.0})], "record_id string, qid string, cyclic map<string,double>")
    with pytest.raises(Exception, match="teacher keys differ"):
        teacher.with_teacher(asked, wrong).collect()
    assert spark.range(1).select(teacher.mean_mass(F.array(F.lit(0.5), F.lit(1.0))).alias("m")).first()["m"] == 0.75


def test_parsed_answers(spark):
    cases = [
        ('ok {"a": " \\"ops\\" ", "b": "TRUE", "c": "2"} {}', (True, ["ops", "true", "2"])),
        ('{bad {"a": "none", "b": 1, "c": 2}', (True, [None, None, "2"])),
        ('{"a": 3, "b": false, "c": true}', (True, [None, "false", None])),
        ('{"c": 7}', (True, [None, None, None])),
        ("nothing", (False, [None, None, None])),
        (None, (False, [None, None, None])),
    ]
    keys = [["ops", "dev"], ["false", "true"], ["0", "1", "2"]]
    df = spark.createDataFrame([(i, t, ["a", "b", "c"], ["choice", "noul", "score"], keys) for i, (t, _) in enumerate(cases)], "i int, t string, qids array<string>, kinds array<string>, keys array<array<string>>")
    rows = df.select("i", py.parsed_answers("t", "qids", "kinds", "keys").alias("p")).orderBy("i").collect()
    assert [(r["p"]["parse_ok"], r["p"]["answers"]) for r in rows] == [w for _, w in cases]


def test_custom_corpus(spark, tmp_path):
    lines = [
        {"state": {"b": "Some words", "a": 1}, "questions": {"z": {"type": "choice", "instructions": "Which?", "criteria": {"y": "why", "x": None}, "label": "x"}, "a": {"type": "noul", "criteria": {"true": "Is"}, "label": True}}, "schema_family": "s"},
        {"state": "plain", "questions": {"s": {"type": "score", "criteria": ["low", "high"], "label": "high"}, "t": {"type": "score", "criteria": ["low", "high"], "label": 0}, "bad": {"type": "choice", "criteria": {"k": None}, "label": "q"}}},
    ]
    (tmp_path / "c.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    rows = rq.labelled_lines(spark, str(tmp_path / "c.jsonl"))
    found = {(r["line"], r["qid"]): (r["keys"], r["descriptions"], r["gold"], r["valid"]) for r in rows.collect()}
    assert found == {
        (0, "z"): (["y", "x"], ["why", None], "x", True), (0, "a"): (["false", "true"], [None, "Is"], "true", True),
        (2, "s"): (["0", "1"], ["low", "high"], "1", True), (2, "t"): (["0", "1"], ["low", "high"], "0", True), (2, "bad"): (["k"], [None], None, False),
    }
    forbidden = spark.createDataFrame([(hashlib.sha256(b"plain").hexdigest(),)], "hash string")
    kept = rq.custom_records(rows, "own", 3, forbidden).where("not excluded").collect()
    assert {r["record_id"] for r in kept} == {"own/0"} and all(r["text_sha256"] == hashlib.sha256(b"b: some words a: 1").hexdigest() for r in kept)
    with pytest.raises(ValueError, match="splits"):
        rq.custom_records(rows, "own", 3, forbidden, {"train": 100})
    panels = rq.panel_files(spark, {"p": str(tmp_path / "c.jsonl")}).collect()
    assert len(panels) == 4 and {(r["panel"], len(r["digest"])) for r in panels} == {("p", 64)}
    assert rq.whole_requests(spark, str(tmp_path / "c.jsonl")).first()["file"] == "c.jsonl"
    sizes = rq.folder_sizes(spark, str(tmp_path)).first()
    assert (sizes["ending"], sizes["bytes"], sizes["files"]) == ("jsonl", (tmp_path / "c.jsonl").stat().st_size, 1)


def test_records_and_panels(spark, asked):
    assert rq.source_seed(20260924, "agnews") == 6350119125570970205 and rq.recipe('{"a": 1}') == {"a": 1}
    back = {r["record_id"]: r for r in rq.request_of(spark.createDataFrame(ROWS, QUESTIONS)).withColumn("choice", rq.has_choice(F.col("questions"))).collect()}
    assert [q["qid"] for q in back["r1"]["questions"]] == ["team", "ok", "level"] and "gold" not in back["r1"]["questions"][0].asDict()
    assert back["r1"]["choice"] and not back["r2"]["choice"]
    show = rq.support_showcase(spark).collect()
    assert len(show) == 24 and all(r["gold"] in r["keys"] for r in show)
    rows = spark.createDataFrame([(s, f"{s}/{i}", i % 5 - 1) for s in "pq" for i in range(50)], "source_family string, record_id string, label int")
    ranked = rq.evaluation_order(rows, 4)
    plain = {s: [r for _, r in sorted((hashlib.sha256(f"4:order:{s}/{i}".encode()).hexdigest(), f"{s}/{i}") for i in range(50) if i % 5)] for s in "pq"}
    assert {s: [r["record_id"] for r in sorted(ranked.collect(), key=lambda r: r["rank"]) if r["source_family"] == s] for s in "pq"} == plain
    fits = F.substring_index("record_id", "/", -1).cast("int") % 2 == 0
    taken = rq.admitted(ranked, fits, 6)
    for s in "pq":
        assert [r["record_id"] for r in sorted(taken.collect(), key=lambda r: r["rank"]) if r["source_family"] == s] == [x for x in plain[s][:12] if int(x.split("/")[1]) % 2 == 0][:6]
    assert [r["record_id"] for r in rq.first_requests(rows, "record_id", 2).collect()] == ["p/0", "p/1"]
    work = rq.workload(spark, ["one two three.", "four five."], 9, 3).collect()
    assert [len(r["state"].split()) for r in work] == [9] * 3 and len({r["state"] for r in work}) == 3 and work[1]["state"].startswith("Ticket 1001. four five. one")


def test_hashes_and_texts(spark):
    df = spark.createDataFrame([("t", 1), (None, 2)], "text string, b int")
    raw = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows = df.select(rq.row_text(df, "text").alias("x"), rq.row_text(df, "b").alias("y"), rq.provenance("r", None, "v", "train", F.col("b"), F.col("text"), raw).alias("p")).collect()
    assert rows[0]["x"] == "t" and rows[1]["x"] == '{"b": 2, "text": null}' and rows[0]["y"] == '{"b": 1, "text": "t"}'
    own = json.loads(rows[0]["p"])
    assert own["config"] is None and own["text_sha256"] == hashlib.sha256(b"t").hexdigest() and own["row_sha256"] == hashlib.sha256(b'{"b": 1, "text": "t"}').hexdigest()
    value = spark.createDataFrame([(True, 2.5e9, 0.126), (False, 3e6, None), (None, None, 1.0)], "b boolean, n double, p double")
    assert [tuple(r) for r in value.select(rq.yes_no(F.col("b")), rq.size_text(F.col("n")), rq.percent_text(F.col("p"))).collect()] == [("yes", "2.50 GB", "12.6%"), ("no", "3.00 MB", "not measured"), (None, "not measured", "100.0%")]
    report = rq.admission_report(spark.createDataFrame([("train", "ok", 5), ("train", "ok", 9), ("train", "state_over_limit", 99), ("dev", "row_over_limit", 7)], "split string, status string, packed_tokens int"))
    assert {r["split"]: (r["kept"], r["dropped"], r["longest"]) for r in report.collect()} == {"train": (2, 1, 9), "dev": (0, 1, None)}
    seen = spark.createDataFrame([("p", "p/1", True), ("p", "p/2", False), ("q", "q/1", True)], "source_family string, record_id string, excluded boolean")
    kept = spark.createDataFrame([("p", "p/2"), ("p", "p/2")], "source_family string, record_id string")
    assert {r["source_family"]: (r["candidates"], r["excluded"], r["records"], r["questions"]) for r in rq.panel_manifest(seen, kept).collect()} == {"p": (2, 1, 1, 2), "q": (1, 1, 0, 0)}


def test_forbidden_texts_in_a_field_and_typed_values(spark, tmp_path):
    secret = "A forbidden text of more than five words"
    asks = lambda label, kind="noul", criteria=None: {"q": {"type": kind, "instructions": 1.50, "criteria": criteria, "label": label}}
    lines = [
        {"state": {"a": secret.upper()}, "questions": asks("True")}, {"state": {"a": [{"b": f"  {secret} "}], "c": 1}, "questions": asks(True)}, {"state": {"a": "too short"}, "questions": asks("FALSE")},
        {"state": "true", "questions": asks(False)}, {"state": "1e5", "questions": asks("1", "score", ["l", "m"])}, {"state": 1e5, "questions": asks(2, "score", ["l", "m"])},
        {"state": "null", "questions": asks("x", "choice", {"x": True, "y": "1.50"})}, {"state": None, "questions": asks("maybe")}, {"state": '{"a": 1}', "questions": {}}, {"state": "1.50", "questions": asks(" 1 ", "score", [1, 2.0])},
    ]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, lines), "no json", "[]"]))
    forbidden = spark.createDataFrame([(hashlib.sha256(secret.lower().encode()).hexdigest(),)], "hash string")
    rows = rq.custom_records(rq.labelled_lines(spark, str(tmp_path)), "own", 3, forbidden, several=True)
    found = {r["line"]: r for r in rows.collect()}
    assert {k for k, r in found.items() if r["excluded"]} == {0, 1} and found[0]["record_id"] == "own/c.jsonl/0"
    assert [found[k]["text"] for k in (3, 4, 5, 6, 7, 8, 9)] == ["true", "1e5", "100000.0", "null", "", '{"a": 1}', "1.50"]
    assert [found[k]["gold"] for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)] == ["true", "true", "false", "false", "1", None, "x", None, "1"]
    assert found[3]["instructions"] == "1.5" and found[6]["descriptions"] == ["True", "1.50"] and found[9]["descriptions"] == ["1", "2.0"]
    assert [found[k]["qid"] for k in (8, 10, 11)] == [None] * 3
    assert rq.custom_report(rows).collect()[0].asDict() == {"source_family": "own", "read": 12, "excluded_text_collision": 2, "no_question": 3, "invalid_labels": 2}


@pytest.mark.parametrize("size", ["7b", "64b", "128m"])
def test_line_numbers_equal_splitlines(spark, tmp_path, size):
    """Files cut in many ranges, with every kind of line end, blank lines, and none at the end."""
    texts = {"a.txt": "one\n\ntwo\r\nthree\rfour\n" * 40 + "last", "b.txt": "x\n" * 333, "c.txt": "", "d.txt": "\n\n", "e.txt": "only"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        lines = readers.text_lines(spark, str(tmp_path))
        found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == sorted((name, k, line) for name, text in texts.items() for k, line in enumerate(text.splitlines()))

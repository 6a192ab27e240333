import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from verdigris.llm import chat_format, decontaminate, language_id, pieces, token_counts, toxicity, url_reputation

NASTY = ["", " ", "  two  spaces ", "a\nb\n\n c", "\n", "日本語 テキスト ñandú ﬁ①", "x" * 300, "tab\tand  if x:\n        y = 1", "</s> <s>[INST] hi", "abc" + " " * 40 + "d", "été — naïve… 1234567", "\u2581marks \u2581"]


def test_pieces_equal_the_library(spark, small):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = NASTY + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    encoder = pieces.Encoder(pieces.model_path())
    found = encoder.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == model.encode(texts)
    assert [encoder.decode(np.frombuffer(x, np.int32)) for x in found] == [t.replace("\u2581", " ") for t in texts]


def test_pieces_edges(spark, edge_docs, no_docs):
    rows = pieces.encode(edge_docs, keep=(F.col("doc_id"),), round_trip=True)
    found = rows.collect()
    assert len(found) == edge_docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4)} == {0}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, keep=(F.col("doc_id"),)).collect()}
    assert back[5] == "one" and back[4] == ""
    assert pieces.encode(no_docs, keep=(F.col("doc_id"),)).count() == 0


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_token_counts(spark, edge_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    monkeypatch.setattr(token_counts, "GROUP", 2)
    docs = edge_docs.where("coalesce(doc_id, 0) not in (7, 8)")
    path = token_counts.public_tokenizers.path(token_counts.VOCABULARY)
    own = token_counts.encoding(path)
    want = sorted((r["doc_id"] or -1, len(own.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(docs).collect()) == want
    if block == 7:
        assert token_counts.count_tokens(no_docs).count() == 0


def test_scan_of_a_foreign_file(spark):
    """Empty documents, documents over several blocks, and an end without a separator."""
    rng = random.Random(1)
    counts = [0, 0, 5, 40, 1, 0, 23, 8, 0, 100, 3]
    ids = [x for n in counts for x in [*(rng.randrange(9) for _ in range(n)), 9]] + [1, 2]
    for size in (4, 16, 500):
        blocks = [(1, k, np.array(ids[k * size : (k + 1) * size], np.uint16).tobytes()) for k in range((len(ids) + size - 1) // size)]
        rows = token_counts.stitch(token_counts.scan_blocks(spark.createDataFrame(blocks, "file long, block long, data binary"), 9)).orderBy("ordinal").collect()
        assert [r["n_tokens"] for r in rows] == [*counts, 2] and [r["closed"] for r in rows] == [True] * len(counts) + [False]
        assert [r["ordinal"] for r in rows] == list(range(len(counts) + 1))


def plain_chat(turns):
    heads = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}
    return "<s>" + "".join(heads[r][0] + chat_format.escape(t) + heads[r][1] for r, t in turns)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = [*chat_format.CONTROLS, "<\\s>", "[\\\\/INST]", "\\", " ", "\n", "é", "日", "ok", "[", "<", "</", "/s>"]
    convs = {}
    for c in range(60):
        convs[c] = [(rng.choice(("user", "assistant", "system")), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randint(1, 6))]
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert all(formatted[c] == plain_chat(t) and chat_format.parse(formatted[c]) == t for c, t in convs.items())
    for r in chat_format.read_back(chats).collect():
        turns = convs[r["conv_id"]]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted[r["conv_id"]]))


def test_chat_edges(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "STEP_BYTES", 7)
    rows = [(1, 1, "user", None), (1, None, "tool\nx", "[/ROLE] é"), (None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (2, 0, None, "z" * 100_000), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text as formatted", "turn as n_turns")
    found = {r["conv_id"]: chat_format.parse(r["formatted"]) for r in chat_format.format_chats(df).collect()}
    assert found == {1: [("tool\nx", "[/ROLE] é"), ("user", "")], None: [("assistant", "a"), ("assistant", "a")], 2: [("", "z" * 100_000), ("assistant", "")]}
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_language_held_out(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.col("doc_id") % 3 == 1
    model = language_id.fit(docs.where(~held))
    rows = language_id.predict(docs.where(held), model, keep=(F.col("doc_id"), F.col("lang"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_codewords_part_languages():
    for n in (2, 3, 4, 6, 9, 20):
        code = language_id.codewords(n)
        distance = (code[:, None] != code[None]).sum(axis=2) + 99 * np.eye(n)
        assert len(code) == n and distance.min() >= (1 if n == 2 else 2)


def test_ngrams_of_pieces_and_batches():
    texts = ["Hello world", "", "é" * 50, "x y z", "12 ab"]
    together = language_id.ngram_shares(texts)
    assert np.allclose(together, np.vstack([language_id.ngram_shares([t]) for t in texts])) and np.allclose(together.sum(axis=1), [1, 0, 1, 1, 1])


def test_language_edges(spark, edge_docs, no_docs):
    model = language_id.fit(edge_docs)
    rows = language_id.predict(edge_docs, model, keep=(F.col("doc_id"), F.col("lang"))).collect()
    assert len(rows) == edge_docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (3, 4, 6, 9))
    empty = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(edge_docs, empty).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("Ідіо7 IDI0T!! ｓｃｕｍ") .split() [-2:] == ["idiot", "scum"]
    machine = toxicity.automaton({"idiot ": 2.0, "trash": 1.5, "trashy": 3.0})
    assert toxicity.matched("An 1D1OT and trashy things", machine) == (5.0, 2, 5)
    assert toxicity.matched("the trash can", machine) == (0, 0, 3) and toxicity.matched("123 !!!", machine) == (0.0, 0, 0)
    assert toxicity.matched("idiotic", machine)[1] == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, "doc_id", "text", labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model, keep=(F.col("toxic"),)).collect()
    right = sum((r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in rows)
    assert right / len(rows) > 0.93 and sum(r["toxic_score"] >= 0.5 for r in rows if r["toxic"] == 0) <= 2


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 0), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(edge_docs, "doc_id", "text", labels), toxicity.fit(no_docs, "doc_id", "text", labels), toxicity.fit(edge_docs, "doc_id", "text", labels.where("false"))):
        rows = toxicity.score(edge_docs, model, keep=(F.col("doc_id"), F.col("score"))).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert toxicity.score(no_docs, model).count() == 0


WORDS = [f"token{i}" for i in range(500)]


def overlap(words, item):
    """Brute force: the best alignment with a window of 13 words (or the item) of which 80 in 100 are equal."""
    best = None
    for shift in range(-len(item), len(words)):
        equal = [0 <= shift + j < len(words) and words[shift + j] == t for j, t in enumerate(item)]
        size = min(13, len(item))
        if any(sum(equal[s : s + size]) * 100 >= 80 * size for s in range(len(item) - size + 1)) and (best is None or sum(equal) > best):
            best = sum(equal)
    return best


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    rng = random.Random(4)
    items = {i: [rng.choice(WORDS) for _ in range(rng.choice((13, 15, 30)))] for i in range(8)}
    docs = {}
    for d in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if d % 2:
            part = list(items[d % 8])
            part = part[: rng.choice((8, 12, 13, len(part)))]
            for k in rng.sample(range(len(part)), rng.choice((0, 1, 2, 3, 4))):
                part[k] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs[d] = words
    want = {(d, i): m for d, w in docs.items() for i, t in items.items() if (m := overlap(w, t)) is not None}
    rows = decontaminate.contaminated(
        spark.createDataFrame([(d, ". ".join(w).upper() + "!") for d, w in docs.items()], "doc_id long, text string").withColumn("seed", F.lit("x")).withColumn("at", F.lit(1)),
        spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string").withColumn("own", F.lit(1)),
    ).collect()
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in rows} == want and len(want) > 10


def test_masks_cover_two_substitutions():
    import itertools

    for bad in itertools.combinations(range(13), 2):
        assert any(not {o + p for p in m} & set(bad) for m in decontaminate.MASKS for o in range(13 - m[-1]))


def test_seeds_cover_two_substitutions(spark):
    """Every 13 words of which two differ share a seed at one alignment, and every such copy at a document's end is found."""
    import itertools

    item = WORDS[:13]
    bad = {d: [f"changed{k}" if k in pair else t for k, t in enumerate(item)] for d, pair in enumerate(itertools.combinations(range(13), 2))}
    seeds = lambda rows: decontaminate._seeds(spark.createDataFrame(list(rows.items()), "doc long, words array<string>"), ["doc"]).collect()
    own = {(r["at"], r["seed"]) for r in seeds({0: item})}
    assert {r["doc"] for r in seeds(bad) if (r["at"], r["seed"]) in own} == set(bad)
    docs = spark.createDataFrame([(d, " ".join(["before"] * (d % 4) + w)) for d, w in bad.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r["doc_id"], r["matched"], r["start"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(d, 11, d % 4) for d in bad}


def test_short_masks_cover_what_may_differ():
    import itertools

    for n in range(1, 13):
        masks = next(m for k, m in decontaminate.SHORT.items() if n >= k)
        for bad in itertools.combinations(range(n), n * 20 // 100):
            assert any(not {o + p for p in m} & set(bad) for m in masks for o in range(n - m[-1]))


@pytest.mark.parametrize("broadcast", [True, False])
def test_short_items_equal_brute_force(spark, monkeypatch, broadcast):
    """Items of 1 to 13 words, copied whole, with words changed, and cut off at a document's begin or end."""
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    rng = random.Random(5)
    items = {n: [f"item{n}word{k}" for k in range(n)] for n in range(1, 14)} | {20 + n: [rng.choice(WORDS[:6]) for _ in range(n)] for n in range(2, 13)}
    docs = {}
    for n, item in items.items():
        for changed in range(4):
            for _ in range(3):
                part = list(item)
                for k in rng.sample(range(len(part)), min(changed, len(part))):
                    part[k] = "changed"
                docs[len(docs)] = [rng.choice(WORDS[:9]) for _ in range(rng.randrange(4))] + part + [rng.choice(WORDS) for _ in range(rng.randrange(4))]
        docs[len(docs)] = item[1:] + ["after"]
        docs[len(docs)] = ["before"] + item[:-2]
    want = {(d, i): m for d, w in docs.items() for i, t in items.items() if (m := overlap(w, t)) is not None}
    rows = decontaminate.contaminated(
        spark.createDataFrame([(d, ", ".join(w)) for d, w in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in rows} == want and {i for _, i in want} == set(items)


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, "too short an item"), (None, "word1 and word2 and word3 and word4 and word5 and")], "item_id long, text string")
    rows = decontaminate.contaminated(edge_docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in rows) == [(-1, 1), (1, 1), (2, 1), (7, -1), (8, -1)]
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(edge_docs, bench.where("false")).count() == 0


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.net/es/q", "http://net/fr/", "http://b.example.com/en/", "http://x.www.example.com/en/z", "http://a.com", "http://a.com?x=/en/", "x\n://h.org/p#f", "http://é.Ñ.net/fr/a://b"]
    rows = url_reputation.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash")), spark.createDataFrame([], "host string, outcome long")).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert found == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 4: ("a.net", "/es/q", "net/es/", "block"),
        5: ("net", "/fr/", "net/fr/", "block"), 6: ("b.example.com", "/en/", "example.com/en/", "block"), 7: ("x.www.example.com", "/en/z", "www.example.com/en/", "allow"), 8: ("a.com", "", None, "allow"),
        9: ("a.com", "", None, "allow"), 10: ("h.org", "/p", None, "allow"), 11: ("é.Ñ.net", "/fr/a://b", "net/fr/", "block"),
    }


def test_reputation_shrinks(spark):
    seen = [("good.x.org", 0)] * 300 + [("bad.y.org", 1)] * 60 + [("new.x.org", 1)] * 2 + [("ok.y.org", 0)] * 5 + [("z.co.uk", 0)] * 40 + [(None, 1), ("unlabelled.org", None)]
    rows = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(seen, "host string, outcome long")).collect()}
    assert rows["bad.y.org"]["bound"] > url_reputation.BAD_RATE > rows["new.x.org"]["bound"] and rows["new.x.org"]["host_mean"] < 1 and "unlabelled.org" not in rows
    assert url_reputation.host_reputation(spark.createDataFrame([], "host string, outcome long")).count() == 0

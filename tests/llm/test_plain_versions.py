"""Operators against plain versions that share no code with them but constants and the text's folding."""

import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, embeddings, hilbert, language_id, pieces, token_counts, toxicity, url_reputation


def plain_shares(text):
    """Shares of 1- to 3-grams by bucket, one character at a time."""
    codes = [ord(c) if c.isalpha() else 32 for c in text.lower() + "  "]
    found = {}
    for at in range(len(codes)):
        h = None
        for n in (1, 2, 3):
            if at + n > len(codes):
                break
            c = codes[at + n - 1]
            h = c * 2654435761 % 2**32 if n == 1 else ((h ^ h >> 15) * 2246822519 + c * 3266489917) % 2**32
            if n == 1 and c == 32 or n > 1 and c == 32 == codes[at + n - 2] or codes[at] == 32:
                break
            mixed = (h ^ h >> 13) * (668265263 + n) % 2**32
            found[mixed >> 20] = found.get(mixed >> 20, 0) + 1
    total = sum(found.values())
    return {b: x / total for b, x in found.items()}


def test_language_equals_a_plain_version(spark):
    rng = random.Random(4)
    syllables = {"aa": ["la", "mo", "ne"], "bb": ["sch", "ung", "er"], "cc": ["eau", "que", "ion"], "dd": ["ción", "los", "ñu"]}
    rows = [(lang, " ".join("".join(rng.choices(own + ["ta"], k=3)) for _ in range(12))) for lang, own in syllables.items() for _ in range(6)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    langs = sorted(syllables)
    shares = [(lang, plain_shares(t)) for lang, t in rows]
    profile = {x: [0.0] * language_id.BUCKETS for x in langs}
    for lang, s in shares:
        for b, v in s.items():
            profile[lang][b] += v / 6
    assert np.allclose(language_id.ngram_shares([t for _, t in rows]), [[s.get(b, 0.0) for b in range(language_id.BUCKETS)] for _, s in shares])
    code = language_id.codewords(4)
    bits = []
    for k in range(code.shape[1]):
        one, zero = [x for x, c in zip(langs, code, strict=True) if c[k] > 0], [x for x, c in zip(langs, code, strict=True) if c[k] < 0]
        if not one or not zero:
            bits.append(([0.0] * language_id.BUCKETS, 0.0, 1.0))
            continue
        weight = [math.log(sum(profile[x][b] for x in one) / len(one) + 1e-6) - math.log(sum(profile[x][b] for x in zero) / len(zero) + 1e-6) for b in range(language_id.BUCKETS)]
        reach = {x: sum(p * w for p, w in zip(profile[x], weight, strict=True)) for x in langs}
        least, most = min(reach[x] for x in one), max(reach[x] for x in zero)
        bits.append((weight, (least + most) / 2, max(1e-3, (least - most) / 2)))
    tests = [t for _, t in rows[::5]] + ["la que ungción", "taeau"]
    out = {r["text"]: r for r in language_id.predict(spark.createDataFrame([(t,) for t in tests], "text string"), model, keep=(F.col("text"),)).collect()}
    for t in tests:
        s = plain_shares(t)
        margins = [(sum(v * w[b] for b, v in s.items()) - middle) / half for w, middle, half in bits]
        trust = [half / sum(h for _, _, h in bits) for _, _, half in bits]
        loss = [sum(math.exp(-max(-3, min(3, m * c))) * q for m, c, q in zip(margins, own, trust, strict=True)) for own in code]
        odds = [math.exp(-4 * (x - min(loss))) for x in loss]
        assert out[t]["lang_pred"] == langs[loss.index(min(loss))] and math.isclose(out[t]["score"], max(odds) / sum(odds), rel_tol=1e-6)
        first, second = sorted(loss)[:2]
        assert out[t]["ambiguous"] == (second - first < 0.1 * second)


def test_signs_are_no_letters(spark):
    model = language_id.fit(spark.createDataFrame([("en", "the cat"), ("de", "der Hund")], "lang string, text string"))
    rows = language_id.predict(spark.createDataFrame([("½ ² ① 12",), ("٣ 😀",), ("日本",)], "text string"), model, keep=(F.col("text"),)).collect()
    assert [(r["lang_pred"] == "und", r["score"] == 0) for r in rows] == [(True, True), (True, True), (False, False)]
    with pytest.raises(Exception, match="languages"):
        language_id.fit(spark.range(1100).select(F.col("id").cast("string").alias("lang"), F.lit("a").alias("text")))


def plain_hits(text, lexicon, exceptions):
    """Weights of lexicon words, by looking at every word with every entry."""
    words = toxicity.fold(text).split()
    spared = {k for k in range(len(words)) for p in exceptions for n in [len(p.split())] for s in range(max(0, k - n + 1), k + 1) if words[s : s + n] == p.split()}
    hits = []
    for k, w in enumerate(words):
        own = [x for e, x in lexicon.items() if (w == e[:-1] if e.endswith(" ") else w.startswith(e)) and x > 0]
        if own and k not in spared:
            hits.append(max(own))
    return sum(hits), len(hits), len(words)


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(8)
    mild = ["river", "stone", "a", "of", "trash", "can", "walk", "idea", "idle"]
    bad = ["idiot", "id1otic", "trash", "sc\u0443m", "x"]
    docs, labels = [], []
    for k in range(240):
        y = int(k % 3 == 0)
        docs.append((k, " ".join(rng.choices(mild[:4] + mild[6:], k=30) + (["trash can"] if rng.random() < 0.5 else []) + (rng.choices(bad, k=3) if y else []))))
        labels.append((k, y))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(labels, "doc_id long, toxic int"))
    n_toxic, n_other = 80, 160
    counts = {}
    for (_, t), (_, y) in zip(docs, labels, strict=True):
        words = set(toxicity.fold(t).split())
        entries = {w + " " for w in words} | {w[:n] for w in words for n in range(toxicity.SHORTEST, min(toxicity.LONGEST, len(w) - 1) + 1)}
        for e in entries:
            counts.setdefault(e, [0, 0])[1 - y] += 1
    found = []
    for e, (t, o) in counts.items():
        odds = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((o + 0.5) / (n_other - o + 0.5))
        sure = odds - 1.5 * math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
        if t >= max(3, min(toxicity.SUPPORT, n_toxic // 20)) and sure > toxicity.LEAST_ODDS:
            found.append((-sure * math.sqrt(t), e, odds))
    want = {}
    for _, e, odds in sorted(found):
        if not any(p != e and e.startswith(p) and odds < x + 1 for p, x in want.items() if not p.endswith(" ") and len(p) >= toxicity.SHORTEST):
            want[e] = odds
    assert model["lexicon"].keys() == want.keys() and all(math.isclose(model["lexicon"][e], x) for e, x in want.items()) and "x " in want
    tests = [t for _, t in docs[:20]] + ["trash can idiot", "TRASH", "", "x" * 50, "1d10t"]
    rows = {r["text"]: r for r in toxicity.score(spark.createDataFrame([(t,) for t in tests], "text string"), model, keep=(F.col("text"),)).collect()}
    for t in tests:
        weight, hits, words = plain_hits(t, want, model["exceptions"])
        z = sum(c * x for c, x in zip(model["coefficients"], (math.log1p(100 * weight / (words + 20)) if words else 0.0, float(hits > 0), math.log1p(weight) - math.log1p(words / 50), 1.0), strict=True))
        assert (rows[t]["toxic_hits"], rows[t]["toxic_words"]) == (hits, words) and math.isclose(rows[t]["toxic_score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_strings_are_cut_whole(spark):
    """Values with a common beginning get codes of their own, which follow the values' order and counts."""
    names = [f"https://{c}.org/" for c in "abc"]
    df = spark.createDataFrame([(n,) for n in names * 50] + [(None,)], "url string")
    coded, (code,), splitters = hilbert.quantised(df, ["url"], 4)
    found = {r["url"]: r[code] for r in coded.distinct().collect()}
    assert len({found[n] for n in names}) == 3 and [found[n] for n in names] == sorted(found[n] for n in names) and found[None] == 0
    many = sorted(f"{zlib.crc32(str(k).encode()):08x}" for k in range(1000))
    cuts = hilbert.string_splitters(spark.createDataFrame([(v,) for v in many], "v string").repartition(7), 16)
    assert cuts == [many[math.ceil(k * 1000 / 16) - 1] for k in range(1, 16)]
    assert hilbert.string_splitters(df.where("false"), 16) == []


def unigram_copy(path):
    """The installed byte-pair model, its kind changed to unigram: same pieces and scores, encoded by the largest sum."""
    data = bytearray(sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()).serialized_model_proto())
    for number, _, start, end in pieces.message_fields(bytes(data)):
        if number == 2:
            for inner, _, at, _ in pieces.message_fields(bytes(data[start:end])):
                if inner == 3:
                    data[start + at] = pieces.UNIGRAM
    path.write_bytes(data)
    return str(path)


def test_unigram_sums_are_the_largest(spark, small, tmp_path):
    path = unigram_copy(tmp_path / "unigram.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  two  spaces ", "naïve \u2581 marks", "日本語 ﬁ", "x" * 80, "a\n b", *(s for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() for s in r["text"].split(". ") if len(s) < 300)]
    encoder = pieces.Encoder(path)
    assert encoder.vocabulary.kind == pieces.UNIGRAM
    found = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]
    assert [encoder.decode(np.array(ids, np.int32)) for ids in found] == [t.replace(pieces.MARK, " ") for t in texts]
    # The library returns lesser sums in some places of this model, whose scores were made for merging; never larger ones.
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    both = [(sum(scores[i] for i in a), sum(scores[i] for i in b)) for a, b in zip(found, model.encode(texts), strict=True)]
    assert all(a >= b for a, b in both) and sum(a == b for a, b in both) > len(both) / 2
    # Against all segmentations of short words, by their sums.
    v = encoder.vocabulary

    def best(word):
        if not word:
            return 0.0
        return max(v.scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in v.scores)

    for word, ids in v.best(sorted({"\u2581these", "\u2581thereof", "\u2581xylo", "\u2581cat"})):
        names = {i: p for p, i in v.ids.items()}
        assert math.isclose(sum(v.scores[names[i]] for i in np.frombuffer(ids, np.int32)), best(word))


def test_other_kinds_are_refused(tmp_path):
    path = unigram_copy(tmp_path / "other.model")
    data = bytearray(open(path, "rb").read())
    for number, _, start, end in pieces.message_fields(bytes(data)):
        if number == 2:
            for inner, _, at, _ in pieces.message_fields(bytes(data[start:end])):
                if inner == 3:
                    data[start + at] = 4
    (tmp_path / "other.model").write_bytes(data)
    with pytest.raises(ValueError, match="vocabulary"):
        pieces.Vocabulary(path)


def test_flat_files_are_read_by_ranges(spark, tmp_path):
    counts = {"a.bin": [3, 0, 70, 1], "b.bin": [0, 5], "empty.bin": []}
    rng = random.Random(2)
    for name, own in counts.items():
        ids = [x for n in own for x in [*(rng.randrange(9) for _ in range(n)), 9]]
        (tmp_path / name).write_bytes(np.array(ids, np.uint16).tobytes())
    for block in (1, 8, 1 << 16):
        rows = token_counts.stitch(token_counts.scan_blocks(token_counts.flat_blocks(spark, str(tmp_path), 2, block), 9)).collect()
        found = {}
        for r in sorted(rows, key=lambda r: r["ordinal"]):
            found.setdefault(r["file"], []).append(r["n_tokens"])
        assert sorted(found.values()) == sorted(c for c in counts.values() if c)
    (tmp_path / "cut.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="cut within an id"):
        token_counts.flat_blocks(spark, str(tmp_path), 2).count()


def test_large_and_tiny_vectors(spark):
    rows = [("a", [1e200, 1e200]), ("b", [2e200, 2.1e200]), ("c", [1e-200, -1e-200]), ("d", [3e-310, -3e-310]), ("e", [1e-200, 1e200])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert found == {"a": (1, "a"), "b": (1, "a"), "c": (1, "c"), "d": (1, "c"), "e": (0, "e")}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_texts_of_one_id_are_told_apart(spark, monkeypatch, bound):
    """By broadcast and by shuffle: a hit is held against the text that it came from."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
    item = [f"w{k}" for k in range(20)]
    docs = [(1, " ".join(item[:6])), (1, " ".join(["x"] * 3 + item[2:])), (2, " ".join(item)), (2, None), (None, " ".join(item))]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["matched"], r["start"]) for r in rows) == [(-1, 20, 0), (1, 18, 1), (2, 20, 0)]


LIST = """// a comment
com
uk
co.uk
*.ck
!www.ck

gov.uk // more
blogspot.com
"""


def test_public_suffix_list(spark):
    lines = spark.createDataFrame([(x,) for x in LIST.split("\n")], "value string")
    want = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "dep.x.gov.uk": ("x.gov.uk", "gov.uk"), "my.blogspot.com": ("my.blogspot.com", "blogspot.com"), "a.b.c.ck": ("b.c.ck", "c.ck"), "sub.www.ck": ("www.ck", "ck"), "host.unlisted": ("host.unlisted", "unlisted"), "com": ("com", "com"), "": ("", "")}
    rows = url_reputation.registered(spark.createDataFrame([(h,) for h in want], "host string"), url_reputation.public_suffixes(lines)).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in rows} == want


def test_planted_bad_hosts_are_blocked(spark):
    pages = [(k, f"http://h{k % 5}.site{k % 2}.org/p{k}") for k in range(200)] + [(1000 + k, f"http://spam.bad.org/{k}") for k in range(80)] + [(2000, "http://spam.bad.org/" + "x" * 50_000), (2001, None), (2001, None)]
    labelled = spark.createDataFrame([(f"h{k % 5}.site{k % 2}.org", 0) for k in range(200)] + [("spam.bad.org", 1)] * 80, "host string, outcome long")
    rows = url_reputation.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labelled).collect()
    assert {r["page_id"] for r in rows if r["verdict"] == "block"} == {*range(1000, 1080), 2000} and len(rows) == len(pages)
    assert url_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string"), labelled).count() == 0


def test_too_many_entries_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "river stone" if k % 2 else "awful dreadful nasty") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)], "doc_id long, toxic int")
    assert "awful " in toxicity.fit(docs, "doc_id", "text", labels)["lexicon"]
    monkeypatch.setattr(toxicity, "ENTRIES", 2)
    with pytest.raises(ValueError, match="lexicon entries"):
        toxicity.fit(docs, "doc_id", "text", labels)

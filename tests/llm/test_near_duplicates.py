import itertools
import random

import numpy as np
import pytest

from verdigris.llm import embeddings, minhash
from verdigris.llm.components import components
from verdigris.llm.shingles import shingle_set


def smallest_reachable(ids, edges):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = smallest_reachable({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert found == want


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 6, 7, 40, 160)))]
        for _ in range(rng.randint(1, 9)):
            copy = [rng.choice(vocabulary) if rng.random() < 0.03 else w for w in base]
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 2)]))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.choice((4, 8, 12, 60))))]) for _ in range(60)]
    docs = list(enumerate(texts))
    sets = {i: shingles(t, size) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=size).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_long_lists_go_through_tiles(spark, monkeypatch):
    """Lists over the light bound: tiles of a few documents give the same components."""
    monkeypatch.setattr(minhash, "LIGHT", 2)
    monkeypatch.setattr(minhash, "TILE", 400)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.05 else w for w in base) for _ in range(60)]
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == smallest_reachable(sets, links)


def test_tile_links_are_exact():
    sets = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 6], 3: [1, 2, 3, 4], 4: [9, 10]}
    rows = [(2, i, i, np.array(s)) for i, s in sets.items()]
    assert {frozenset(p) for p in minhash._tile_links(rows, 80)} == {frozenset((1, 3)), frozenset((2, 3))}


def test_words_and_short_texts():
    assert len(shingle_set("A b\x0bC", 2)) == 2 and len(shingle_set("a b", 2)) == 1
    assert (shingle_set("ONE two", 5) == shingle_set("one TWO", 5)).all() and len(shingle_set(" \t", 2)) == 0
    assert (shingle_set("É x", 2) != shingle_set("é x", 2)).all()


def test_edges(spark, edge_docs, no_docs):
    rows = minhash.near_duplicates(edge_docs, size=2).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[8]["component_id"] == 7
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i for i in (3, 4, 6)) and by[5]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(no_docs, size=5).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "STRIP", 40)
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([centres + rng.normal(size=centres.shape) * s for s in (0, 0.2, 0.33, 0.45, 0.45)]).astype(np.float32)
    x[7] = x[8] = x[9]
    x[11] = 3 * x[12]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = smallest_reachable(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    rows = embeddings.linked_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in rows} == dict(enumerate(near.sum(axis=1)))
    assert {r["vec_id"]: r["component_id"] for r in rows} == want


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as id", "vec_id as weight", "vec_id as links")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked_vectors(df).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[10] == (2, 1, False)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)) and found[None] == (0, None, True)
    assert embeddings.linked_vectors(df.where("false")).count() == 0


def test_longer_sketches_leave_none_to_tiles(spark, monkeypatch):
    """Texts that have a passage in common, under the similarity, and a copy each: the passage's long lists need no tile."""
    monkeypatch.setattr(minhash, "LIGHT", 4)
    met, tiled, widened = [], [], minhash._widened
    monkeypatch.setattr(minhash, "_widened", lambda heavy, *more: (met.append(heavy.select("id").distinct().count()), widened(heavy, *more))[1])
    monkeypatch.setattr(minhash, "_tiled", lambda *all: tiled.append(all))
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(30):
        own = [f"t{k}w{j}" for j in range(90)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *(rng.choice(("x", w)) if j % 9 == 0 else w for j, w in enumerate(own))])]
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == smallest_reachable(sets, links)
    assert met and met[0] > 30 and not tiled


def test_tiles_in_rounds(spark, monkeypatch):
    """No set is sure of its short lists, and a round may hold next to nothing: the tiles give the same components."""
    for name, value in (("LIGHT", 2), ("MET", 10**6), ("SURE", 10**6), ("TILE", 400), ("ROUND", 1), ("REPEATS", 2)):
        monkeypatch.setattr(minhash, name, value)
    rounds, kept, tiled = [], minhash.checkpoint, minhash._tiled

    def counted(*all):
        monkeypatch.setattr(minhash, "checkpoint", lambda df: (rounds.append(df.columns), kept(df))[1])
        return tiled(*all)

    monkeypatch.setattr(minhash, "_tiled", counted)
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(70)]
    texts = [" ".join(f"w{rng.randrange(3000)}" if rng.random() < 0.05 else w for w in base) for _ in range(60)]
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == smallest_reachable(sets, links)
    assert len(rounds) > 1

"""Near-duplicate texts and vectors, components and contamination against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from loglake.llm import components as components_module
from loglake.llm import decontaminate, neardup, vectors
from loglake.llm.components import components
from loglake.llm.shared import stored

DOCS = "doc_id long, text string, n long, items string"


def smallest(nodes, links):
    label = {v: v for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            for v in (a, b):
                if label[v] != low:
                    label[v], changed = low, True
    return label


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (400, 401), (401, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = smallest({v for e in links for v in e}, links)
    assert got == {v: r for v, r in wanted.items() if v != 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows, k):
    sets = {i: set(neardup.shingle_set(t or "", k).tolist()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, smallest(sets, links)


def test_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 12)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(neardup, "BLOCK_OUTSIDERS", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(140):
        text = list(base) if i < 90 else [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(0, 12) if i < 90 else 0):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(200, "one two"), (201, "ONE\ttwo"), (202, "solo"), (203, "Solo"), (204, ""), (205, None)]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], DOCS)
    sets, wanted = brute_groups(rows, 2)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, 2).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == wanted[i]) for i, r in got.items())


def test_near_copies_of_odd_rows(spark):
    rows = [(5, "q", 0, ""), (5, "q", 0, ""), (7, "Q", 0, ""), (None, "q", 0, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    rows = np.concatenate([rng.normal(size=(600, 32)), *(c + 0.25 * rng.normal(size=(20, 32)) for c in centres)])
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.link_vectors(df).collect()}
    assert sum(got.values()) >= 0.9 * close.sum() > 0
    assert all(got[i] <= close[i].sum() for i in got)


def test_vectors_that_cannot_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i for i, (n, _) in got.items() if n} == {1, 2, 3, 9, None} and got[9] == (4, 1)
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_contamination_of_odd_rows(spark, monkeypatch):
    docs = [(1, "a b c d e f g h i j k"), (2, None), (3, "x y, X-y z"), (4, ""), (5, "the b A c"), (5, "the b A c"), (None, "a")]
    items = [(1, "b c d e f g h i j k zz"), (2, "X y"), (3, None), (4, "!!"), (5, "a"), (9, "a " * 12), (1, "q")]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = [(0, 1, [0], [1], ["5"]), (1, 11, [0], [11], ["1", "5"]), (2, 0, [], [], []), (3, 5, [0], [4], ["2"]), (4, 0, [], [], []), *[(5, 4, [2], [3], ["5"])] * 2]
    for limit in (decontaminate.BLOCK_CHARS, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", limit)
        got = decontaminate.find_contamination(df, bench).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.starts, r.ends, r["items"]) for r in got) == wanted
    kept = decontaminate.drop_contaminated(df, bench, min_item_words=2)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 5]
    assert decontaminate.find_contamination(df, bench.limit(0)).filter(F.size("items") > 0).count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


LONG = " ".join(f"w{i}" for i in range(40))


def test_an_id_with_two_texts_is_one_node(spark):
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(3, LONG, "x"), (5, LONG + " end", "x"), (5, other, "x"), (8, other, "x"), (9, other + " " + LONG, "x"), (5, other, "x")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp1 string"))
    assert sorted({(r.doc_id, r.component_id, r.kept) for r in got.collect()}) == [
        (3, 3, True), (5, 3, False), (8, 3, False), (9, 9, True)
    ]
    assert got.count() == len(rows)


def test_rows_are_dropped_not_ids(spark):
    schema = "id string, doc_id long, text string, node int, seen int"
    rows = [(3, LONG), (5, LONG), (5, "a text of its own with more words than five"), (7, LONG), (7, LONG), (8, None), (8, None), (8, ""), (None, LONG), (None, LONG)]
    docs = spark.createDataFrame([(str(i), d, t, i, 0) for i, (d, t) in enumerate(rows)], schema)
    got = neardup.keep_one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or -1, (r.text or "")[:6]) for r in got.collect())
    assert kept == [(-1, "w0 w1 "), (-1, "w0 w1 "), (3, "w0 w1 "), (5, "a text"), (8, "")]
    assert neardup.keep_one_of_each(docs.limit(0)).count() == 0


def test_settled_links_take_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components_module, "stored", lambda df, label: made.append(label) or stored(df, label))
    stars = [(1, i) for i in range(2, 40)] + [(50, 51), (52, 50)]
    links = spark.createDataFrame(stars, "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == smallest({v for e in stars for v in e}, stars)
    assert len(made) == 1
    made.clear()
    chain = [(3, 2), (2, 1), (9, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and 2 <= len(made) <= 3


def test_near_copies_that_pivots_link_take_one_search_for_components(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(neardup, "components", lambda edges: calls.append(1) or components(edges))
    copies = [(i, "one two three four " * 3 + ("five" if i % 2 else "FIVE"), 0, "") for i in range(6)]
    got = neardup.near_duplicates(spark.createDataFrame([*copies, (9, "other words here", 0, "")], DOCS), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 9} and len(calls) == 1
    # An id with two texts links their classes: that takes a second search.
    calls.clear()
    rows = [(1, "a b c", 0, ""), (5, "a b c", 0, ""), (5, "x y z", 0, ""), (7, "x y z", 0, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 4 and len(calls) == 2

"""Chat formatting, URL rules, toxicity and the pipeline."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglake.llm import chat, toxicity, urls
from loglake.llm.shared import stored

SF_DIR = "/root/testdata/sf0.001"
EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, block string"


def test_events_fold_into_messages(spark):
    rows = [
        (1, 1, 0, "delta", "user", "He"), (1, 2, 0, "delta", None, "llo"), (1, 3, 1, "delta", "assistant", "x"),
        (1, 4, 1, "regenerate", "assistant", ""), (1, 5, 1, "delta", "assistant", "good"), (1, 6, 2, "message", "user", "later"),
        (1, 7, 1, "regenerate", "assistant", "A"), (1, 8, 1, "delta", "assistant", "B"), (1, 9, 0, "edit", "user", "Hi"),
        (2, 1, None, "message", None, None), (2, 1, None, "message", None, None), (None, 1, 0, "message", "user", "n"),
    ]
    log = spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)
    chats = chat.format_chats(log).withColumn("turns", chat.parsed_turns(F.col("formatted")))
    chats = chats.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in chats.collect()}
    assert got == {1: ([("user", "Hi"), ("assistant", "AB")], "AB"), 2: ([("", "")] * 2, ""), None: ([("user", "n")], "")}
    assert chat.format_chats(log.limit(0)).count() == 0


def test_a_recorded_log_folds_back(spark):
    rng = random.Random(8)
    words = ["", "a", "é😀", "### </turn> \\", "some longer words " * 20, "x\ny"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*words, None]), "k", 1) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(100, 3, "user", "same", "k", 1)] * 2 + [(100, 3, "assistant", "same", "k", 1), (100, 5, "assistant", "alone", "k", 1)]
    rows += [(101, None, "user", "no turn", "k", 1), (101, 0, "assistant", "w" * 100_000, "k", 1), (None, 1, "assistant", "no conversation", "k", 1), (102, -(2**62), "user", "far", "k", 1)]
    rows += [(103, 1, "assistant", "then two", "k", 1), (103, 2, "user", "x", "k", 1), (103, 2, "user", "x", "k", 1), (103, 2**62, "assistant", "far", "k", 1)]
    rows += [(104, -(2**63), "assistant", "first", "k", 1), (104, 2**63 - 1, "assistant", "last", "k", 1), (104, 2**58, "assistant", "edge", "k", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, n int")
    log = chat.recorded_events(table)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("delta", "edit", "regenerate", "message")) > 3
    got = chat.fold_events(log.repartition(7)).select("conv_id", "turn", F.explode("messages").alias("m")).select("conv_id", "turn", "m.*").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((c, t, r or "", x or "") for c, t, r, x, *_ in rows), key=key)
    assert chat.fold_events(chat.recorded_events(table.limit(0))).count() == 0


def test_long_and_hostile_chats_come_back(spark):
    rng = random.Random(2)
    parts = ["\\", "###", "</turn>", "\n", ": ", "#", "\\e", "\\b", "x", "😀", "### user: "]
    rows = [(7, i, i, "message", rng.choice(["user", "assistant", "a: b"]), "".join(rng.choice(parts) for _ in range(6)), "") for i in range(700)]
    got = chat.format_chats(spark.createDataFrame(rows, EVENTS).repartition(5))
    got = got.select(chat.parsed_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(t) for t in got.turns] == [(r[4], r[5]) for r in rows]
    assert got.loss == "".join(r[5] for r in rows if r[4] == "assistant")


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_fixed_rules_equal_brute_force(spark):
    cases = [None, "", "nope", "x://", "HTTP://A.Net/es/q?x", "x://net/es/", "a://com", "a://com/", "s://www.Example.com/en/1#t", "s://example.com/en/",
             "s://notexample.com/en/", "s://b.example.com/en/2", "s://x.net/fr/?u=://com/", "s://É.COM/a", "s://h?x/y", "s://h#x/y"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)] + [(0, None, "")], "page_id long, url string, items string")
    for r in urls.judge_urls(df).collect():
        host, path, rule, verdict = plain_rule(cases[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), cases[r.page_id]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).count() == 0


def best_by_counting(rows, items, support, confidence):
    """The verdict of the best rule over all subsets of a token set, rows counted one by one."""
    found = []
    for size in range(1, len(items) + 1):
        for some in itertools.combinations(sorted(items), size):
            labels = [label for held, label in rows if set(some) <= set(held)]
            for kind in set(labels):
                n = labels.count(kind)
                if n >= math.ceil(support * len(rows)) and n / len(labels) >= confidence:
                    found.append((n / len(labels), size, n / len(rows), kind))
    return max(found)[3] if found else None


@pytest.mark.parametrize("run", [urls.RUN_ROWS, 7])
def test_mined_verdicts_equal_counting(spark, monkeypatch, run):
    monkeypatch.setattr(urls, "RUN_ROWS", run)
    rng = random.Random(8)
    # x and y always occur together, as do u, v and w; z is too rare.
    sets = [sorted({*rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)), *rng.choice([[], ["x", "y"], ["u", "v", "w"], ["z"] if rng.random() < 0.1 else []])}) for _ in range(300)]
    rows = [(items, "block" if {"a", "b"} <= set(items) or ("x" in items and "c" not in items) or rng.random() < 0.1 else "allow") for items in sets]
    known = spark.createDataFrame(rows, "items array<string>, label string").groupBy("items", "label").agg(F.count("*").alias("n"))
    classes = urls.token_classes(known, 0.05)
    named = {r.token: r["class"] for r in classes.collect()}
    assert named["x"] == named["y"] == "x" and named["v"] == named["w"] == "u" and "z" not in named and named["a"] == "a"
    rules = urls.mine_rules(known, classes, 0.05, 0.8)
    asked = sorted({tuple(s) for s in sets} | {("u",), ("v", "w"), ("a", "y"), ("q",), ("a", "b", "x", "u", "v")})
    got = {tuple(r["items"]): r.mined for r in urls.match_rules(spark.createDataFrame([(list(s),) for s in asked], "items array<string>"), classes, rules).collect()}
    wanted = {s: best_by_counting(rows, s, 0.05, 0.8) for s in asked}
    assert got == {s: kind for s, kind in wanted.items() if kind} and {"allow", "block"} <= set(got.values())


def test_long_urls_that_many_pages_share(spark):
    words = "/".join("".join(chr(97 + (i * 7 + j) % 26) for j in range(5)) for i in range(40))
    rows = [(i, f"http://a.example.com/en/{words}") for i in range(120)] + [(1000 + i, f"http://b.org/{words}/{'xyz'[i % 3]}") for i in range(60)]
    rows += [(2000 + i, f"http://www.example.com/en/{i}") for i in range(60)] + [(3000, None), (3001, "http://b.org/" + "long" * 50_000)]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and all(got[i] == "block" for i in range(120)) and all(got[1000 + i] == "block" for i in range(60))
    assert got[2000] == "allow" and got[3000] == urls.DEFAULT_VERDICT


@pytest.fixture(scope="module")
def machine(spark):
    rng = random.Random(6)
    parts = ["th", "er", "on", "an", "re", "st", "in", "ea", "ti", "ou"]
    rows, labels = [], []
    for i in range(900):
        text = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["grumpf", "blockwit", "zounder"])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, marks, toxicity.train(docs, marks)


def test_toxicity_on_rows_never_learnt_from(machine):
    docs, marks, model = machine
    scored = toxicity.score_toxicity(docs, model).join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in scored)
    assert len(scored) > 150 and right >= 0.97 * len(scored)


def test_toxicity_tolerates_gaps(machine):
    _, _, model = machine
    for word in ("b.l.o.c.k.w.i.t", "block*wit", "blocxkwit", "b l o c k w i t", "BLOCKWIT!", "xx" * 40 + "blockwit"):
        assert model.worst([f"then {word} there"])[0] > model.worst(["then there"])[0] + 1, word


def test_toxicity_of_odd_rows(spark, machine):
    docs, marks, model = machine
    odd = spark.createDataFrame([(1, None, ""), (1, None, ""), (None, "", ""), (3, "a " * 200_000, "")], "doc_id long, text string, score string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.keep_mild(odd, model).columns == odd.columns
    nothing = toxicity.train(docs.limit(0), marks.limit(0))
    assert toxicity.score_toxicity(docs.limit(3), nothing).filter("score < 0.3").count() == 3


def test_each_stage_keeps_the_columns_and_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long")))
    columns, kept = docs.columns, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept <= before and -1 in kept and len(kept) > 0.5 * len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept

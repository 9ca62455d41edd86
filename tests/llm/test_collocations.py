"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loglake.llm import collocations as c

DOCS = "doc_id long, text string, lang string, rank int, phrase string"


def plain(rows, top=c.TOP, least=c.MIN_COUNT, percent=50):
    """The definition, phrase by phrase."""
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in rows:
        lang, f = lang or "und", counts.setdefault(lang or "und", Counter())
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for n in (1, 2, 3):
                f.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in chosen.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= percent * f[q]}
        kept = []
        for p, a in chosen.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "Ωx", "x\x1cy", "a-b", "\x85", "zz", "😀", "A\x00b"]
    weights = [40, 20, 9, 9, 5, 3, 3, 2, 2, 2, 2, 1, 1]
    texts = []
    for _ in range(n):
        picked = rng.choices(words, weights, k=rng.randint(0, 60))
        texts.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " \r\n"]) for w in picked))
    return [(i, t, rng.choice(["en", "en", "de", None]), i, "p") for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counts(spark, monkeypatch, small):
    rows = [*corpus(300, 4), (1, None, "en", 0, ""), (2, "", None, 0, ""), (2, "the of " * 4000, "en", 0, ""), (2, "the of", "en", 0, "")]
    if small:  # many shards and ranges, borders inside one first word, shards closed within a text
        for name, value in {"SHARD_WORDS": 500, "ROW_STATES": 64, "RANGE_STATES": 50, "SAMPLED": 4}.items():
            monkeypatch.setattr(c, name, value)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = rows_of(c.collocations(docs))
    assert got == plain(rows) and len(got) > 50
    assert rows_of(c.collocations(docs, top=3, least=2)) == plain(rows, top=3, least=2)


def test_ranges_cut_inside_a_frequent_word(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(f"the w{rng.randint(0, 30)} w{rng.randint(0, 30)}." for _ in range(200)), "en", 0, "") for i in range(60)]
    for name, value in {"RANGE_STATES": 200, "SAMPLED": 16}.items():
        monkeypatch.setattr(c, name, value)
    made = c.shards(spark.createDataFrame(rows, DOCS).repartition(4))
    starts = c.borders(made)
    assert sum(b[1][0] == b"the" for b in starts) >= 3
    assert rows_of(c.collocations(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_no_rows(spark):
    assert c.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert c.collocations(spark.createDataFrame([(1, None, None, 0, "")], DOCS)).collect() == []


def test_products_pass_64_bits():
    a, f = 3 * 10**12, {(b"x",): 4 * 10**12, (b"y",): 5 * 10**12}
    assert c.best_cut((b"x", b"y"), a, f) == (10**6 * a * a // (20 * 10**24), 4 * 10**12, 5 * 10**12)


def test_equal_cuts_take_the_first():
    f = {(b"x",): 10, (b"y", b"z"): 20, (b"x", b"y"): 20, (b"z",): 10}
    assert c.best_cut((b"x", b"y", b"z"), 10, f) == (500_000, 10, 20)


def test_transducers_keep_their_counts():
    rng = random.Random(3)
    made = []
    for _ in range(6):
        phrases = {tuple(rng.choice([b"a", b"b", b"ab", b"c\xc3\xa9"]) for _ in range(rng.randint(1, 3))) for _ in range(30)}
        made.append({p: rng.randint(1, 1 << 40) for p in phrases})
    automata = [c.Transducer.from_phrases(list(m), list(m.values())) for m in made]
    total = Counter()
    for m in made:
        total.update(m)
    whole = c.Transducer.from_bytes(c.Transducer.union(automata).to_bytes())
    got = {whole.phrase(int(s)): int(w) for s, w in zip(whole.states, whole.weights, strict=True) if w}
    assert got == dict(total)
    assert np.all(np.diff(whole.states) > 0)
    cut = whole.lower_bound((b"ab", b"b"))
    assert all(p < (b"ab", b"b") for p in map(whole.phrase, whole.states[:cut].tolist()))
    assert all(p >= (b"ab", b"b") for p in map(whole.phrase, whole.states[cut:].tolist()))
    asked = c.Transducer.from_phrases([(b"a",), (b"unknown",), (b"b", b"ab")], [0, 0, 0])
    answer = whole.compose(asked)
    for s, w in zip(answer.states.tolist(), answer.weights.tolist(), strict=True):
        assert w == total.get(answer.phrase(s), 0)

"""Alignment against both libraries, text by text and pair by pair."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from loglake.llm import alignment
from loglake.llm.tokens import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, key string, salt int, n_a string"
PARTS = [
    "a", "B", "é", "Σ", "'s", " ", " ", "  ", "   ", "\n", "\t", "\x1c", "\x85", "\xa0", "１", "½", "中", "文字", "<|endoftext|>", "<s>", "</s>",
    "<unk>", "<0x41>", "😀", "ſ", "İ", "ß", "aaaa", "　", "​", "᠎", "_", "--", "123", "hello", "World", "ing", ",", ".",
    "\r\n", "﻿", "é",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        with open(PATHS[0], encoding="utf-8") as f:
            self.entry = {i: e for e, i in json.load(f)["model"]["vocab"].items()}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {chr(x): x for x in plain}
        self.letters.update({chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)})

    def raw_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        """Groups of (ids of A, ids of B), None without tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a, raw_b = [bytes(self.letters[c] for c in self.entry[i]) for i in a], [self.raw_b(i) for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        ends = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for r in raw:
                at += len(r)
                out.append(at)
            ends.append(out)
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to_i, to_j = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            out.append((a[i:to_i], b[j:to_j]))
            i, j = to_i, to_j
        return out


def plain(rows):
    """The definition: all occurrence pairs of every document."""
    one = Plain()
    docs = [(row[0], one.groups(row[1])) for row in rows]
    counts, highest = Counter(), Counter()
    links = [[(x, y) for a, b in groups or [] for x in a for y in b] for _, groups in docs]
    for found in links:
        counts.update(set(found))
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, groups), found in zip(docs, links, strict=True):
        digest = ""
        if groups is not None:
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            digest = hashlib.sha256(text.encode()).hexdigest()
        groups = groups or []
        out.append((
            -1 if doc is None else doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(found),
            sum(counts[p] == highest[p[0]] for p in found), sum(counts[p] for p in found), digest,
        ))
    return sorted(out)


def got(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    rows = [(i, t, "x", i, None) for i, t in enumerate(texts)]
    rows += [(n + i, texts[i % 7], "x", 1, None) for i in range(40)]  # copies
    rows += [(1, texts[1], "x", 1, None), (1, texts[1], "x", 1, None), (1, "another text", "x", 1, None)]  # repeated ids and rows
    rows += [(None, "no id", None, None, None), (9001, None, None, None, None), (9002, "", None, None, None), (9003, "  ", None, None, None)]
    rows += [(9004, "a▁b", "x", 1, None), (9005, "▁", "x", 1, None), (9006, "word " * 30_000 + "x" * 5000 + " " * 300 + "\n" * 50, "", 0, "")]
    return rows


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 100, 0])
def test_equals_all_occurrence_pairs(spark, frequent):
    rows = corpus(250, frequent + 1)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(alignment.align(docs, *PATHS, frequent=frequent)) == plain(rows)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    known, one = alignment.Aligner(*PATHS), Plain()
    for _, text, *_ in corpus(400, 11):
        (places,) = known.read([text or ""])
        groups = one.groups(text)
        assert (places is None) == (groups is None)
        if groups is not None:
            found = Counter((x, y) for a, b in groups for x in a for y in b)
            assert known.numbers[places].sum(axis=0).tolist() == [
                sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values())
            ]
            _, pairs, times = alignment._links_of(known, [places])
            assert {(p >> 20, p & 0xFFFFF): n for p, n in zip(pairs.tolist(), times.tolist(), strict=True)} == found


def test_stretches_join_to_the_text():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert "".join(" " + x for x in alignment.stretches(text)) == " " + text


def test_ranks_say_what_the_tokenizer_file_says():
    one, known = Plain(), alignment.Aligner(*PATHS)
    texts = [" " + (row[1] or "") for row in corpus(1500, 5)]
    assert known.encode_a(texts) == [e.ids for e in one.a.encode_batch(texts, add_special_tokens=False)]


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), *PATHS).count() == 0


def test_a_text_with_very_many_copies_is_spread(spark):
    docs = spark.createDataFrame([(i, "same text", "", 0, "") for i in range(500)] + [(1000, "other", "", 0, "")], DOCS)
    classes = {r["text"]: r for r in alignment.text_classes(docs).collect()}
    assert classes["same text"]["copies"] == 500 and len(classes["same text"]["salts"]) > 50
    assert len(classes["other"]["salts"]) == 1

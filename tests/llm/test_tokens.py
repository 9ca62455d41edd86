"""Token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loglake.llm import bpe, decontaminate, neardup, tokens, toxicity
from loglake.llm.bpe import RaggedBpe, TextEncoder

PARTS = [
    "a", "B", "é", "Σ", "ΑΣ ", "'s", "'S", "'re", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "１", "²", "½", "Ⅷ", "中", "<|endoftext|>",
    "<|startoftext|>", "<|", "😀", "ſ", "K", "İ", "ß", "aaaa", "　", "​", "᠎", "_", "--", "123", "\x00", "ǆ", "ΐ", "ͅ", "լ",
]
DOCS = "doc_id long, text string, ids string, n int"


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    path = tokens.tokenizer_path(name)
    library, ours = Tokenizer.from_file(path), TextEncoder(path)
    cases = [*fuzz(1500, 5), "", "a" * 3000, "ab" * 2000, "x y " * 2000, "word " * 300_000]
    wanted = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(r, "<u4").tolist() for r in ours.encode(cases)] == wanted
    assert ours.count(cases) == [len(w) for w in wanted]


def merged(piece, vocab, merges):
    """Byte-pair merging by the book: the earliest merge there is, everywhere, from the left."""
    from loglake.llm.bpe import _byte_letters

    parts = [_byte_letters()[b] for b in piece]
    for _ in piece:
        ranks = {tuple(m.split(" ")): i for i, m in enumerate(merges)}
        found = [ranks[p] for p in zip(parts, parts[1:]) if p in ranks]
        if not found:
            break
        left, right = merges[min(found)].split(" ")
        out, i = [], 0
        while i < len(parts):
            both = parts[i : i + 2] == [left, right]
            out.append(left + right if both else parts[i])
            i += 2 if both else 1
        parts = out
    return [vocab[p] for p in parts]


def test_one_merge_a_round_gives_the_same():
    vocab = {c: i for i, c in enumerate(__import__("loglake.llm.bpe", fromlist=["x"])._byte_letters())}
    merges = ["a b", "ab a", "b a", "a a"]
    for i, m in enumerate(("ab", "aba", "ba", "aa"), start=256):
        vocab[m] = i
    bpe = RaggedBpe(vocab, merges)
    pieces = [b"abababa", b"aaaa", b"", b"baab", b"aaaaa"]
    together = bpe.encode(pieces)
    bpe.ordered = False
    apart = bpe.encode(pieces)
    wanted = [merged(piece, vocab, merges) for piece in pieces]
    for ids, counts in (together, apart):
        assert ids.tolist() == sum(wanted, []) and counts.tolist() == [len(w) for w in wanted]


def test_counts_of_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", None, 2), (3, "Hello wörld", "y", None), (3, "Hello wörld", "y", None), (None, "a", "z", 0)]
    path = tokens.tokenizer_path("word_bpe_49k.json")
    got = tokens.count_tokens(spark.createDataFrame(rows, DOCS), path, limit=1).collect()
    library = Tokenizer.from_file(path)
    sizes = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert max(sizes) > 1
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (r[0] or 0, len((r[1] or "").encode()), n, n > 1) for r, n in zip(rows, sizes, strict=True)
    )
    empty = spark.createDataFrame([], DOCS)
    assert tokens.count_tokens(empty, tokens.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_is_gapless(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t, "", 0) for i, t in enumerate(fuzz(300, 9))] + [(1000, None, "", 0), (1001, "long text " * 2000, "", 0)]
    wanted = {i: e.ids + [0] for (i, *_), e in zip(rows, Tokenizer.from_file(path).encode_batch([r[1] or "" for r in rows]), strict=True)}
    pieces = tokens.pieces_digest(tokens.pack(spark.createDataFrame(rows, DOCS).repartition(7), path, window=64)).collect()
    docs, filled = {}, {}
    for p in sorted(pieces, key=lambda p: p.start):
        ids = np.array(wanted[p.doc_id][p.start : p.start + p.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and p.doc_tokens == len(wanted[p.doc_id])
        assert docs.get(p.doc_id, 0) == p.start
        docs[p.doc_id] = p.start + p.length
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert docs == {i: len(v) for i, v in wanted.items()}
    for sequence, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or sequence == max(filled)
    assert sorted(filled) == list(range(len(filled)))
    assert tokens.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_sequences_are_padded(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "one two three " * 30, "", 0), (2, "x", "", 0)], DOCS)
    rows = sorted(tokens.sequences(tokens.pack(docs, path, window=64), window=64).collect())
    sizes = [len(r["ids"]) // 4 for r in rows]
    assert sizes[:-1] == [64] * (len(rows) - 1) and sizes[-1] in (1, 2, 4, 8, 16, 32, 64) and sizes[-1] >= rows[-1]["length"]


def test_tasks_that_do_not_encode_free_the_encoder(spark, monkeypatch):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "one two three", "", 0), (2, "one two three", "", 0)], DOCS)
    benchmark = spark.createDataFrame([("a", "four five")], "item_id string, text string")
    tasks, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, *a, **b: tasks.append(task) or plain(self, task, *a, **b))
    bpe.encoder.cache_clear()
    assert tokens.pack(docs, path).count() == 2
    assert bpe.encoder.cache_info().currsize == 0  # the driver builds none
    machine = toxicity.fit([], [], [])
    neardup.near_duplicates(docs, 2)
    toxicity.keep_mild(docs, machine)
    toxicity.score_toxicity(docs, machine)
    decontaminate.drop_contaminated(docs, benchmark)
    decontaminate.find_contamination(docs, benchmark)
    encode, *others = tasks
    assert len(others) >= 9
    for task in others:
        bpe.encoder(path)
        list(task(iter([])))
        assert bpe.encoder.cache_info().currsize == 0


def test_size_of_a_vocabulary():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokens.tokenizer_path(name)
        assert bpe.vocabulary_size(path) == TextEncoder(path).bpe.size

"""Byte-pair encoding of many pre-tokens at once, over ragged numpy arrays.

All pre-tokens of a batch lie in one flat array of symbol ids with a sequence number each. A round finds
every sequence's lowest-ranked pair and applies it in all sequences at the same time; sequences without a
pair left drop out. The merged vocabulary and the merge order come from a tokenizer file.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

from loglake.llm.shared import give_back

#: Texts inside this range are split as they are; in others, the library says what each character is.
_SIMPLE = re.compile("[^\x00-\u024f]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\t-\r \x85\xa0"
#: How the two files split texts into pre-tokens.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_BLANK}{_LETTER}{_DIGIT}]+")
_BYTES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+"
    f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_SPACES = re.compile(f"[{_BLANK}]+")
#: Pre-tokens handled together; and how many a worker remembers.
PIECES = 400_000
CACHE_ENTRIES = 400_000


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class RaggedBpe:
    """The merges of a tokenizer file; ``encode`` takes pre-tokens as UTF-8."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        letters = _byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # A pair listed twice keeps its last rank, as in a map filled in order.
        _, back = np.unique(keys[::-1], return_index=True)
        keep = np.sort(len(keys) - 1 - back)
        order = keep[np.argsort(keys[keep])]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # All occurrences of a pair may merge in one round if what they make joins no earlier pair.
        rank_of = {}
        for r, c in zip(self.ranks.tolist(), self.made.tolist(), strict=True):
            rank_of[c] = max(r, rank_of.get(c, -1))
        left, right = self.keys // self.size, self.keys % self.size
        self.ordered = all(
            rank_of.get(a, -1) < r and rank_of.get(b, -1) < r
            for a, b, r in zip(left.tolist(), right.tolist(), self.ranks.tolist(), strict=True)
        )
        # Pairs are looked up in an open table: one gather for nearly all of them.
        self.bits = 21
        table = np.full(1 << self.bits, -1, np.int64)
        self.slots = self._slot(self.keys)
        table[self.slots[::-1]] = np.arange(len(self.keys))[::-1]
        self.table = table
        clash = table[self.slots] != np.arange(len(self.keys))
        self.rest = np.flatnonzero(clash)
        self.rest_keys = self.keys[self.rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        keys = left * self.size + right
        at = self.table[self._slot(keys)]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, at, -1)
        miss = np.flatnonzero(~hit)
        if len(self.rest_keys) and len(miss):
            pos = np.minimum(np.searchsorted(self.rest_keys, keys[miss]), len(self.rest_keys) - 1)
            same = self.rest_keys[pos] == keys[miss]
            out[miss[same]] = self.rest[pos[same]]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all pieces in order, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.first[flat]
        ends = np.cumsum(lengths) - 1
        some = lengths > 0
        ids[ends[some]] = self.last[flat[ends[some]]]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        done_ids, done_seq, done_at = [], [], []
        at = np.arange(len(ids))
        while len(ids):
            joint = seq[:-1] == seq[1:]
            pair = np.full(len(ids), -1, np.int64)
            where = np.flatnonzero(joint)
            pair[where] = self._pair(ids[where], ids[where + 1])
            rank = np.where(pair >= 0, self.ranks[pair], np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.r_[True, ~joint])
            sizes = np.diff(np.r_[starts, len(ids)])
            low = np.minimum.reduceat(rank, starts)
            alive = np.repeat(low < np.iinfo(np.int64).max, sizes)
            merge = (rank == np.repeat(low, sizes)) & (pair >= 0)
            hits = np.flatnonzero(merge)
            if self.ordered:
                # Of overlapping occurrences (aaa), every second one merges, from the left.
                fresh = np.r_[True, np.diff(hits) != 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            else:
                _, leftmost = np.unique(seq[hits], return_index=True)
                hits = hits[leftmost]
            ids = ids.copy()
            ids[hits] = self.made[pair[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            finished = ~alive
            done_ids.append(ids[finished])
            done_seq.append(seq[finished])
            done_at.append(at[finished])
            keep &= alive
            ids, seq, at = ids[keep], seq[keep], at[keep]
        all_at = np.concatenate(done_at) if done_at else np.empty(0, np.int64)
        order = np.argsort(all_at, kind="stable")
        all_ids = np.concatenate(done_ids)[order] if done_ids else np.empty(0, np.int64)
        all_seq = np.concatenate(done_seq) if done_seq else np.empty(0, np.int64)
        return all_ids, np.bincount(all_seq, minlength=len(pieces))


class _Shadow(dict):
    """Character classes as the library's pre-tokenizer sees them, asked once per character."""

    def __init__(self, split, words: bool):
        self.pieces = lambda text: len(split.pre_tokenize_str(text))
        self.words = words

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code <= 0x24F:
            kind = c
        elif self.pieces(f"a{c}a") == 1:
            kind = "a"
        elif self.pieces(f"!{c}!") == 1:
            kind = "!"
        elif self.words:
            kind = "\x0b" if self.pieces(f"!{c}!") == 2 else "1"
        else:
            kind = "1" if self.pieces(f"1{c}1") == 1 else "\x0b"
        self[code] = kind
        return kind


class TextEncoder:
    """Whole texts through a tokenizer file's splitting, with a bounded memory of pre-tokens.

    Special strings inside texts are single tokens, as the library takes them by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.words = bool(self.end)
        self.library = Tokenizer.from_file(path)
        self.shadow = _Shadow(self.library.pre_tokenizer, self.words)
        self.pattern = _WORDS if self.words else _BYTES
        self.bpe = RaggedBpe(model["vocab"], model["merges"], self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.caches: dict[bool, dict] = {True: {}, False: {}}

    def _split(self, text: str):
        """The pre-tokens of a text without special strings, one after the other or as a list."""
        simple = _SIMPLE.search(text) is None
        if self.words:
            text = _SPACES.sub(" ", text).lower() if simple else self.library.normalizer.normalize_str(text)
            simple = _SIMPLE.search(text) is None
        if simple and len(text) < 1_000_000:
            return self.pattern.findall(text)
        shape = text if simple else text.translate(self.shadow)
        return (text[m.start() : m.end()] for m in self.pattern.finditer(shape))

    def _segments(self, text: str):
        """Pre-tokens of a text in bounded lists; a special string is its id."""
        parts = self.splitter.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                found = self._split(part)
                if isinstance(found, list):
                    yield found
                    continue
                while some := list(islice(found, PIECES)):
                    yield some

    def _learn(self, words: set[str], counts_only: bool) -> None:
        cache = self.caches[counts_only]
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache = self.caches[counts_only] = {w: cache[w] for w in words if w in cache}
        for i in range(0, len(new), PIECES):
            some = new[i : i + PIECES]
            ids, counts = self.bpe.encode([w.encode() for w in some])
            if counts_only:
                cache.update(zip(some, counts.tolist(), strict=True))
            else:
                raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                starts = [0, *ends[:-1]]
                cache.update((w, raw[a:b]) for w, a, b in zip(some, starts, ends, strict=True))

    def _batches(self, texts: list[str], counts_only: bool):
        """Texts in groups of about a megabyte, with their segments, once the memory knows all words."""
        group, size = [], 0
        for i, text in enumerate(texts):
            for segment in self._segments(text):
                group.append((i, segment))
                size += 1 if isinstance(segment, int) else len(segment)
                if size >= PIECES:
                    yield self._known(group, counts_only)
                    group, size = [], 0
        if group:
            yield self._known(group, counts_only)

    def _known(self, group: list, counts_only: bool) -> list:
        words: set[str] = set()
        for _, segment in group:
            if not isinstance(segment, int):
                words.update(segment)
        self._learn(words, counts_only)
        return group

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = [0] * len(texts)
        for group in self._batches(texts, True):
            known = self.caches[True].__getitem__
            for i, segment in group:
                totals[i] += 1 if isinstance(segment, int) else sum(map(known, segment))
        return totals

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in self._batches(texts, False):
            known = self.caches[False].__getitem__
            for i, segment in group:
                raw = segment.to_bytes(4, "little") if isinstance(segment, int) else b"".join(map(known, segment))
                out[i].append(raw)
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """The encoder of a file, kept per Python worker."""
    return TextEncoder(path)


def forget() -> None:
    """Free the encoders this worker remembers; tasks that follow encoding, or encode nothing, need none."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a file, without building its encoder."""
    with open(path, encoding="utf-8") as f:
        return max(json.load(f)["model"]["vocab"].values()) + 1

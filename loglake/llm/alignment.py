"""Alignment of two tokenizers over exact-text classes.

Documents are shuffled by their full text, so each distinct text is tokenised and aligned once. How often a pair of ids
is held by documents is counted over distinct texts, weighted by how many documents have the text; measures of a
text then go back to the documents that have it. The ids of the first tokenizer (byte-level, A) and of the second
(pieces, B) are linked within groups: stretches between byte offsets where tokens of both end.

Counts are looked up in two ways that together hold every pair. The ``FREQUENT_PAIRS`` most frequent pairs go to all
tasks (a fixed number of rows); occurrences of all others are joined with their counts by a shuffle, in which no
pair is frequent.

Null and empty texts, and texts that either tokenizer does not give back byte by byte (B takes U+2581 for a space), have
no tokens: zeros and an empty digest. Texts of any length are taken whole, a bounded stretch at a time. A pair's count
counts a document once; equal counts of an A id are all best. Rows that repeat a ``doc_id`` or a whole document are
documents of their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglake.llm.shared import stored, table
from loglake.llm.tokens import chunks, tokenizer_path

#: Pairs whose counts every task holds, 16 bytes each.
FREQUENT_PAIRS = 1 << 20
#: Stretches of running text remembered per task, and pairs of ids summed up before they leave it.
REMEMBERED = 400_000
HELD_PAIRS = 1 << 21
#: Texts whose pairs are looked up together.
MEASURED_ROWS = 1000
#: Shares a text that very many documents have is divided into when its measures go back to them.
SALTS = 64
#: Links of a group of tokens that are listed one by one; larger groups are counted by distinct ids.
LISTED_LINKS = 64

_ID_BITS = 20
_PAIR = (1 << 2 * _ID_BITS) - 1
#: What keeps a blank from beginning a new stretch: white space or nothing before it, or the text's end after it.
_ODD = re.compile(r"\s |^ |\s\Z")
_STRETCH = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*")


def stretches(text: str) -> list[str]:
    """Blank and ``text`` cut into stretches both tokenizers treat alone, each without the blank it begins with.

    A stretch ends where a blank follows a character that is no white space: A's splitting ends there, and no piece of B
    holds a blank after another character. White space at the end belongs to the last stretch.
    """
    if not _ODD.search(text):
        return text.split(" ")
    text = " " + text
    found = _STRETCH.findall(text)
    rest = len(text) - sum(map(len, found))
    if rest:
        tail = text[len(text) - rest :]
        if found:
            found[-1] += tail
        else:
            found = [tail]
    return [x[1:] for x in found]


class Aligner:
    """Tokens, groups and links of stretches, each worked out once while it is remembered."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_of_letter()
        plain = {bytes(letters[c] for c in entry): i for entry, i in vocab.items() if all(c in letters for c in entry)}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for raw, i in plain.items():
            self.bytes_a[i] = raw
        self.encode_a = _byte_level(path_a, spec, plain)
        self.library_b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of the second tokenizer hold a blank after another character")
        self.lengths_a, self.lengths_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.sizes_a, self.sizes_b = np.array(self.lengths_a, np.int64), np.array(self.lengths_b, np.int64)
        self.digits = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Of each stretch: groups as text (None if bytes differ); n_a, n_b, n_groups, n_links; id pairs with occurrences.
        self.shown: list[str | None] = []
        self.numbers = np.empty((0, 4), np.int64)
        self.offsets, self.pairs, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.joined: dict[int, tuple[bytes, bytes]] = {}

    def learn(self, parts: set[str]) -> None:
        """Make sure the stretches are known; forget all others if there are too many."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(parts - self.known.keys())
        if new:
            # The second library puts a blank in front itself.
            self._align(new, self.encode_a([" " + p for p in new]), self.library_b.encode(new, num_threads=1))

    def _align(self, new: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        """Align stretches together: their bytes are one line, on which both tokenizers' ends are marked."""
        base = len(self.shown)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        good = self._exact(new, ids_a, ids_b, base)
        if len(good) < len(new):
            ids_a, ids_b = [ids_a[i] for i in good], [ids_b[i] for i in good]
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        from_a, from_b = np.r_[0, to_a[:-1]][: len(to_a)], np.r_[0, to_b[:-1]][: len(to_b)]
        size_a, size_b = to_a - from_a, to_b - from_b
        stretch = np.searchsorted(ends_a[np.cumsum(n_a) - 1], cuts) if len(good) else cuts
        owner = np.array(good, np.int64)[stretch]

        links = size_a * size_b
        listed = links <= LISTED_LINKS
        n = links[listed]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(size_b[listed], n)
        pair = a[np.repeat(from_a[listed], n) + at // wide] << _ID_BITS | b[np.repeat(from_b[listed], n) + at % wide]
        keys, times = [np.repeat(owner[listed], n) << 2 * _ID_BITS | pair], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(~listed).tolist():
            # Links of a large group by distinct ids and how often they occur: never all occurrences one by one.
            x, often_x = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
            y, often_y = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
            keys.append((owner[g] << 2 * _ID_BITS | x[:, None] << _ID_BITS | y[None, :]).ravel())
            times.append(np.outer(often_x, often_y).ravel())
        keys, times = _summed(np.concatenate(keys), np.concatenate(times))
        ends = np.searchsorted(keys, np.arange(1, len(new) + 1) << 2 * _ID_BITS)
        numbers = np.zeros((len(new), 4), np.int64)
        numbers[good, 0], numbers[good, 1] = n_a, n_b
        numbers[:, 2] = np.bincount(owner, minlength=len(new))
        np.add.at(numbers[:, 3], owner, links)

        digits = self.digits
        shown_a, shown_b = [digits[x] for x in a.tolist()], [digits[x] for x in b.tolist()]
        groups = [
            ",".join(shown_a[i:j]) + "|" + ",".join(shown_b[k:m])
            for i, j, k, m in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True)
        ]
        shown: list[str | None] = [None] * len(new)
        first = 0
        for i, last in zip(good, np.cumsum(numbers[good, 2]).tolist(), strict=True):
            shown[i] = ";".join(groups[first:last])
            first = last
        self.shown += shown
        self.numbers = np.concatenate([self.numbers, numbers])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + ends])
        self.pairs = np.concatenate([self.pairs, keys & _PAIR])
        self.times = np.concatenate([self.times, times])

    def _exact(self, new: list[str], ids_a: list[list[int]], ids_b: list[list[int]], base: int) -> list[int]:
        """Which stretches both tokenizers give back byte by byte."""
        whole = (" " + " ".join(new)).encode()
        ends = np.cumsum([1 + len(part.encode()) for part in new])
        if all(
            b"".join(map(known.__getitem__, chain.from_iterable(ids))) == whole
            and np.array_equal(np.cumsum([sum(map(sizes.__getitem__, x)) for x in ids]), ends)
            for ids, known, sizes in ((ids_a, self.bytes_a, self.lengths_a), (ids_b, self.bytes_b, self.lengths_b))
        ):
            return list(range(len(new)))
        good = []
        for i, part in enumerate(new):
            whole = b" " + part.encode()
            whole_b = b"".join(map(self.bytes_b.__getitem__, ids_b[i]))
            whole_a = b"".join(map(self.bytes_a.__getitem__, ids_a[i]))
            if whole_a == whole == whole_b:
                good.append(i)
            else:
                self.joined[base + i] = (whole_a, whole_b)
        return good

    def read(self, texts: list[str]) -> list[list[int] | None]:
        """Places of the stretches of blank and text, None where a text has no tokens."""
        split = [stretches(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [self._places(parts) if parts else None for parts in split]

    def _places(self, parts: list[str]) -> list[int] | None:
        places = list(map(self.known.__getitem__, parts))
        if not self.joined or self.joined.keys().isdisjoint(places):
            return places
        whole = "".join(" " + p for p in parts)
        for side in (0, 1):
            made = (self.joined[x][side] if x in self.joined else b" " + p.encode() for x, p in zip(places, parts, strict=True))
            if b"".join(made) != whole.encode():
                return None
        # Stretches that differ, and yet their sum does not: the text is one stretch.
        if whole[1:] not in self.known:
            self._align([whole[1:]], self.encode_a([whole]), [self.library_b.encode(whole[1:])])
        return [self.known[whole[1:]]]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n[order], first)


def _byte_level(path: str, spec: dict, plain: dict[bytes, int]):
    """An encoder of many strings by a byte-level tokenizer file, special strings taken as text.

    Where ids are in the order of merges, the ranks alone say all, and a library that knows nothing else is several
    times faster on short strings.
    """
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab[m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)] for m in merges]
    splits = spec.get("pre_tokenizer") or {}
    usual = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and spec.get("normalizer") is None
    if usual and made == sorted(set(made)) and all(bytes([x]) in plain for x in range(256)):
        special = {token["content"].encode() for token in spec["added_tokens"]}
        ranks = {raw: i for raw, i in plain.items() if raw not in special}
        # The pattern of this pre-tokenizer: a fixed value.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        known = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: list(map(known.encode_ordinary, texts))
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def _byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters.update((chr(0x100 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return letters


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, kept per Python worker."""
    return Aligner(path_a, path_b)


def text_classes(documents: DataFrame) -> DataFrame:
    """``(key, text, copies, salts)`` per distinct text, written to the shared folder.

    The shuffle is by the text itself; equal texts of a task become one row before it. ``salts`` names the shares in
    which documents with this text will look for its measures.
    """
    read = documents.select(_text(documents), _salt(documents).alias("salt"))
    grouped = read.groupBy("text").agg(F.count("*").alias("copies"), F.collect_set("salt").alias("salts"))
    return stored(grouped.select(F.sha2("text", 256).alias("key"), "text", "copies", "salts"), "align-texts", "zstd")


def _text(documents: DataFrame):
    return F.coalesce(documents["text"], F.lit("")).alias("text")


def _salt(documents: DataFrame):
    return F.pmod(F.xxhash64(documents["doc_id"]), F.lit(SALTS)).cast("int")


_READ = [
    ("key", pa.string()), ("copies", pa.int64()), ("salts", pa.list_(pa.int32())), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())),
    ("times", pa.list_(pa.int64())),
]
_READ_SCHEMA = (
    "key string, copies bigint, salts array<int>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<bigint>"
)


def _links_of(known: Aligner, texts: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, pairs, times)``: distinct id pairs of every text and how often they are linked in it."""
    sizes = np.array([len(t or ()) for t in texts])
    places = np.fromiter(chain.from_iterable(t or () for t in texts), np.int64, int(sizes.sum()))
    begins, sizes_of = known.offsets[places], np.diff(known.offsets)[places]
    ends = np.cumsum(sizes_of)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(begins - (ends - sizes_of), sizes_of)
    owner = np.repeat(np.repeat(np.arange(len(texts)), sizes), sizes_of)
    keys, times = owner << 2 * _ID_BITS | known.pairs[at], known.times[at]
    distinct, counts = np.unique(keys, return_counts=True)
    several = np.flatnonzero(times > 1)
    np.add.at(counts, np.searchsorted(distinct, keys[several]), times[several] - 1)
    offsets = np.searchsorted(distinct, np.arange(len(texts) + 1) << 2 * _ID_BITS)
    return offsets, distinct & _PAIR, counts


def aligned(classes: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every distinct text tokenised and aligned, once: its sizes, and its id pairs; written to the shared folder."""

    def read(batches):
        known = aligner(path_a, path_b)
        for batch in batches:
            for first, run in chunks(batch):
                texts = known.read(run)
                shown = known.shown.__getitem__
                numbers = np.array([known.numbers[t].sum(axis=0) if t else (0, 0, 0, 0) for t in texts], np.int64).reshape(-1, 4)
                digests = ["" if t is None else hashlib.sha256(";".join(map(shown, t)).encode()).hexdigest() for t in texts]
                offsets, pairs, times = _links_of(known, texts)
                offsets = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, len(run)) for c in ("key", "copies", "salts")],
                        *[pa.array(numbers[:, i]) for i in range(4)], pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times)),
                    ],
                    [name for name, _ in _READ],
                )

    rows = classes.select("key", "text", "copies", "salts").mapInArrow(read, _READ_SCHEMA)
    return stored(rows, "align-links", "zstd")


def _spread(column: pa.Array, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column, and for each the value of its row."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(per_row, np.diff(offsets))


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, n)``: documents that hold a pair of ids linked, summed in each task before the shuffle."""

    def count(batches):
        held, size = [], 0

        def summed():
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def rows():
            keys, n = summed()
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (keys, n)], ["pair", "n"])

        for batch in batches:
            pairs, copies = _spread(batch.column("pairs"), batch.column("copies").to_numpy())
            if not len(pairs):
                continue
            held.append((pairs, copies))
            size += len(pairs)
            if size > 2 * HELD_PAIRS:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_PAIRS:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    counted = links.select("pairs", "copies").mapInArrow(count, "pair bigint, n bigint")
    return stored(counted.groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")


def _with_best(counts: DataFrame) -> DataFrame:
    """``(pair, n, best)``: whether a pair's count is the highest of its A id."""
    first = F.shiftright("pair", _ID_BITS)
    # One row per A id, so no more than the vocabulary.
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("highest"))
    joined = counts.withColumn("a", first).join(F.broadcast(highest), "a")
    return joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


class Frequent:
    """The most frequent pairs, sorted, with their counts (negative for best ones)."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.counts = pairs[order], counts[order]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, 0 where a pair is not among the frequent ones, and whether it is best."""
        if not len(self.pairs):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        found = np.where(self.pairs[at] == pairs, self.counts[at], 0)
        return np.abs(found), found < 0


def measures(links: DataFrame, counts: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """All measures of every distinct text."""
    known_best = stored(_with_best(counts), "align-best")
    top = known_best.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()
    signed = np.where(top.column("best").to_numpy(), -1, 1) * top.column("n").to_numpy()
    shared = links.sparkSession.sparkContext.broadcast(Frequent(top.column("pair").to_numpy().copy(), signed))
    kept = ["key", "salts", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def measure(batches):
        # What this worker remembers from aligning is not needed any more.
        aligner.cache_clear()
        often = shared.value
        for batch in (whole.slice(i, MEASURED_ROWS) for whole in batches for i in range(0, whole.num_rows, MEASURED_ROWS)):
            n = batch.num_rows
            pairs, row = _spread(batch.column("pairs"), np.arange(n))
            times, _ = _spread(batch.column("times"), np.arange(n))
            found, best = often.look_up(pairs)
            n_best = np.bincount(row[best], times[best], n).astype(np.int64)
            count_sum = np.zeros(n, np.int64)
            np.add.at(count_sum, row, found * times)
            missing = found == 0
            offsets = pa.array(np.searchsorted(row[missing], np.arange(n + 1)), pa.int32())
            rare = [pa.ListArray.from_arrays(offsets, pa.array(x[missing])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(n_best), pa.array(count_sum), *rare], [*kept, "n_best", "count_sum", "rare", "times"]
            )

    schema = (
        "key string, salts array<int>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "n_best bigint, count_sum bigint, rare array<bigint>, times array<bigint>"
    )
    found = stored(links.select(*kept, "pairs", "times").mapInArrow(measure, schema), "align-measures", "zstd")
    rare = found.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", "x.rare", "x.times")
    # No pair left here is more frequent than any of the frequent ones.
    late = rare.join(known_best, rare["rare"] == known_best["pair"]).groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("late_best"),
        F.sum(F.col("times") * F.col("n")).alias("late_sum"),
    )
    whole = found.join(late, "key", "left")
    return whole.select(
        "key", "salts", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def align(documents: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every document."""
    links = aligned(text_classes(documents), path_a, path_b)
    found = measures(links, pair_counts(links), frequent)
    shares = found.withColumn("salt", F.explode("salts")).drop("salts")
    keys = documents.select("doc_id", F.sha2(_text(documents), 256).alias("key"), _salt(documents).alias("salt"))
    return keys.join(shares, ["key", "salt"]).drop("key", "salt")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align both vocabularies over every document."""
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))

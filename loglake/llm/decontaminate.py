"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of ``window`` words (an item of fewer, but not none, is one window). A window is
contained in a document if all its shingles follow each other there. Shingles are ordered by rarity in the
whole corpus; since all shingles of a window must occur, its necessary prefix is its rarest shingle alone.
Documents meet windows on that shingle, length and position bounds drop those that cannot fit, and the rest
is verified word by word.

Benchmarks are taken in blocks of bounded size, each broadcast and met with all documents, so any number of
items is handled exactly. Null texts have no words: such a document is clean, such an item has no window.
Repeated documents are judged each on its own, items with the same text are all reported. Empty tables: no
rows, or all documents clean. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.bpe import forget
from loglake.llm.shared import stored, table, texts, tidy
from loglake.llm.tokens import chunks

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Benchmark text in one broadcast block.
BLOCK_CHARS = 32_000_000
#: A-Z in lower case; every other ASCII character that is no word character becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lowered, as UTF-8."""
    return text.encode().translate(_FOLD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key of each run of ``k`` word ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = np.full(n, k, np.uint64)
    for j in range(k):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1))
    return key


@dataclass
class Block:
    """Some items, with their words numbered and their windows posted under a shingle each."""

    vocabulary: dict[bytes, int]
    sizes: list[int]
    #: per size of shingle: sorted distinct keys
    shingles: dict[int, np.ndarray]
    #: per window: word ids, item ids, and key and position of every shingle
    windows: list[tuple[tuple[int, ...], list]]
    posted: dict[int, dict[int, list[tuple[int, int]]]]

    @classmethod
    def of(cls, items: list[tuple], window: int, shingle: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], dict] = {}
        for item_id, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text or "")]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[start : start + window]), {})[item_id] = None
        keys: dict[int, set] = {}
        for run in windows:
            k = min(shingle, len(run))
            keys.setdefault(k, set()).update(_shingle_keys(np.array(run), k).tolist())
        sorted_keys = {k: np.array(sorted(v), np.uint64) for k, v in keys.items()}
        return cls(vocabulary, sorted(keys), sorted_keys, [(w, list(v)) for w, v in windows.items()], {})

    def occurrences(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known shingles in a document, and their indices."""
        keys, known = _shingle_keys(ids, k), self.shingles[k]
        # A shingle with a word no item has cannot be known; most documents end here.
        strange = np.r_[0, np.cumsum(ids < 0)]
        at = np.flatnonzero(strange[k:] == strange[: len(strange) - k]) if len(keys) else np.empty(0, np.int64)
        pos = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
        same = known[pos] == keys[at]
        return at[same], pos[same]

    def post(self, frequency: dict[int, np.ndarray], shingle: int) -> Block:
        """Post every window under its rarest shingle (ties: the smallest key)."""
        posted: dict[int, dict[int, list[tuple[int, int]]]] = {k: {} for k in self.sizes}
        for number, (run, _) in enumerate(self.windows):
            k = min(shingle, len(run))
            index = np.searchsorted(self.shingles[k], _shingle_keys(np.array(run), k))
            best = min(range(len(index)), key=lambda i: (frequency[k][index[i]], index[i]))
            posted[k].setdefault(int(index[best]), []).append((number, best))
        self.posted = posted
        return self

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """The runs of words inside windows, and the items those belong to."""
        runs, items, n = {}, set(), len(ids)
        for k in self.sizes:
            at, index = self.occurrences(ids, k)
            posted = self.posted[k]
            for where, shingle in zip(at.tolist(), index.tolist(), strict=True):
                for number, offset in posted.get(shingle, ()):
                    run, owners = self.windows[number]
                    start = where - offset
                    # Position and length bounds first, then every word.
                    if start < 0 or start + len(run) > n or tuple(ids[start : start + len(run)].tolist()) != run:
                        continue
                    items.update(owners)
                    runs[start] = max(runs.get(start, 0), start + len(run))
        return list(runs.items()), items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _rarity(documents: DataFrame, shared, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """How often each of a block's shingles occurs in all documents: partial counts per task, then sums."""

    def count(batches):
        forget()
        block = shared.value
        totals = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
        for batch in batches:
            for _, run in chunks(batch):
                for text in run:
                    ids = block.numbers(words(text))
                    for k in block.sizes:
                        np.add.at(totals[k], block.occurrences(ids, k)[1], 1)
        for k, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), k, np.int64)), pa.array(seen), pa.array(total[seen])], ["k", "shingle", "n"]
            )

    counted = documents.mapInArrow(tidy(count), "k bigint, shingle bigint, n bigint").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
    frequency = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    # Bounded by the shingles of one block of the benchmark.
    for row in counted.toLocalIterator():
        frequency[row["k"]][row["shingle"]] = row["n"]
    return frequency


def _joined(documents: DataFrame, shared) -> DataFrame:
    """Add one block's findings to ``runs`` (disjoint hit runs of words) and ``items``; set ``n_words``."""

    def join(batches):
        forget()
        block = shared.value if shared is not None else None
        for batch in batches:
            for first, run in chunks(batch):
                part = batch.slice(first, len(run))
                n_words, starts, ends, items = [], [], [], []
                old = zip(*(part.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True)
                for text, (was_starts, was_ends, was_items) in zip(run, old, strict=True):
                    found = words(text)
                    n_words.append(len(found))
                    runs, owners = block.hits(block.numbers(found)) if block is not None and found else ([], set())
                    runs = _merged([*runs, *zip(was_starts, was_ends, strict=True)])
                    starts.append([s for s, _ in runs])
                    ends.append([e for _, e in runs])
                    items.append(sorted({*was_items, *("null" if i is None else str(i) for i in owners)}))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text"), pa.array(n_words, pa.int64()),
                        pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["doc_id", "text", "n_words", "starts", "ends", "items"],
                )

    return documents.mapInArrow(tidy(join), _JOINED)


_JOINED = "doc_id bigint, text string, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _posting_blocks(benchmark: DataFrame, window: int, shingle: int, min_item_words: int):
    """Blocks that have windows, and how many shingles of each size they hold."""
    for items in _blocks(benchmark):
        block = Block.of([(i, t) for i, t in items if t is not None and len(words(t)) >= min_item_words], window, shingle)
        if block.windows:
            yield block, {k: len(v) for k, v in block.shingles.items()}


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS,
    min_item_words: int = 1,
) -> DataFrame:
    """``(doc_id, text, n_words, starts, ends, items)``: what of the benchmark each document holds.

    ``starts`` and ``ends`` are disjoint runs of hit words (ends exclusive), ``items`` the ids as sorted strings.
    Items of fewer than ``min_item_words`` words are left out.
    """
    context = documents.sparkSession.sparkContext
    source = texts(documents)
    none = F.array()
    found = source.select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), none.cast("array<bigint>").alias("starts"),
        none.cast("array<bigint>").alias("ends"), none.cast("array<string>").alias("items"),
    )
    joined = None
    for block, sizes in _posting_blocks(benchmark, window, shingle, min_item_words):
        frequency = _rarity(source, context.broadcast(block), sizes)
        posted = context.broadcast(block.post(frequency, shingle))
        joined = _joined(found if joined is None else stored(joined, "decontaminated"), posted)
    return _joined(found, None) if joined is None else joined


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS,
    min_item_words: int = 1,
) -> DataFrame:
    """The rows of ``documents`` that hold no window of any item, with all their columns."""
    context, at = documents.sparkSession.sparkContext, documents.columns.index("text")
    # Columns go by position, so their names cannot clash.
    kept = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    source = kept.select(F.coalesce(f"c{at}", F.lit("")).alias("text"))
    first = True
    for block, sizes in _posting_blocks(benchmark, window, shingle, min_item_words):
        frequency = _rarity(source, context.broadcast(block), sizes)
        posted = context.broadcast(block.post(frequency, shingle))
        kept = (kept if first else stored(kept, "decontaminated")).mapInArrow(_without_hits(posted, at), kept.schema)
        first = False
    return kept.toDF(*documents.columns)


def _without_hits(shared, at: int):
    def keep(batches):
        forget()
        block = shared.value
        for batch in batches:
            for first, run in chunks(batch, at):
                clean = [not block.hits(block.numbers(words(text)))[1] for text in run]
                yield batch.slice(first, len(run)).filter(pa.array(clean, pa.bool_()))

    return tidy(keep)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``benchmark`` each of ``documents`` holds."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(
        F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda total, n: total + n
    )
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:least(i + 9, len(w))], ' ') AS run, least(10, len(w)) AS size
  FROM item, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), runs AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)
), found AS (SELECT doc_id, i, runs.size, item_id FROM runs JOIN windows USING (run, size)
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

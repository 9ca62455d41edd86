"""Phrase collocations by weighted acyclic automata.

Every task counts the 1- to 3-grams of the texts it reads and turns them, sorted, into count transducers: acyclic
automata that read a phrase word by word and return its count (:class:`Transducer`). Transducers of all shards are
cut at common prefix ranges; those of one range are united, their weights summed, and states below the smallest
count dropped, which loses nothing: a part of a phrase is never rarer than the phrase. Counts of a phrase's parts
live in other ranges. A range sends an automaton of the parts it needs to each range that holds some; there it is
composed with the counts, and the result sent back. Ranges cut inside a first word where that word is frequent, so no
task holds more than its share, whatever the words.

Null texts are empty and have no words; a null ``lang`` is ``und``; rows that repeat a document count again. Words of
any length and texts of any length are counted whole: a shard closes when it has read enough words, also within a
text. Equal scores are ordered by count, then phrase in byte order, so no tie is left open. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglake.llm.shared import stored, table

WORDS = 3
MIN_COUNT = 10
TOP = 2000
#: A candidate goes if a longer one around it has at least this share of its count, in percent.
ABSORBED_PERCENT = 50
SCALE = 1_000_000
#: Words a shard holds before it is closed, and n-grams in one row of a shard or in one range (on average).
SHARD_WORDS = 3_000_000
ROW_STATES = 1 << 19
RANGE_STATES = 1 << 20
#: One n-gram in so many is looked at to place the ranges' borders; this decides balance alone.
SAMPLED = 1 << 15

_BITS = 21
_MASK = (1 << _BITS) - 1
_SHIFTS = (2 * _BITS, _BITS, 0)
#: Lower case A-Z, marks that end a piece as one of them, tabs as spaces: fixed values of the contract.
_BREAK = b"."
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b",;:!?\n\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9 + b" "
)


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, with a lone full stop wherever a piece ends."""
    return text.encode().translate(_TABLE).replace(_BREAK, b" . ").split()


def _planes(values: np.ndarray) -> bytes:
    """Numbers with their bytes of one significance together, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Transducer:
    """Counts of phrases: states in the order of their phrases, each reached from the state of its prefix.

    ``words`` is sorted. A state is one number, its words' places (from 1) with the first word in the highest bits, so
    the states sort as the phrases do and a prefix comes right before what continues it.
    """

    def __init__(self, words: list[bytes], states: np.ndarray, weights: np.ndarray):
        self.words, self.states, self.weights = words, states, weights

    @classmethod
    def from_tokens(cls, words: list[bytes], tokens: np.ndarray, silent: np.ndarray) -> Transducer:
        """Of running text: places of words, 0 between pieces; no phrase starts at a ``silent`` position."""
        states, weights = [], []
        starts = np.flatnonzero((tokens > 0) & ~silent)
        key = tokens[starts] << _SHIFTS[0]
        padded = np.r_[tokens, np.zeros(WORDS, tokens.dtype)]
        for n in range(WORDS):
            if n:
                following = padded[starts + n]
                alive = following > 0
                starts, key = starts[alive], key[alive] | (following[alive] << _SHIFTS[n])
            found, counts = np.unique(key, return_counts=True)
            states.append(found)
            weights.append(counts.astype(np.int64))
        return cls(words, *_summed(states, weights))

    @classmethod
    def from_phrases(cls, phrases: Sequence[tuple[bytes, ...]], weights: Sequence[int]) -> Transducer:
        """Of distinct phrases."""
        words = sorted({w for phrase in phrases for w in phrase})
        place = {w: i for i, w in enumerate(words, start=1)}
        states = np.array([sum(place[w] << s for w, s in zip(p, _SHIFTS, strict=False)) for p in phrases], np.int64)
        order = np.argsort(states)
        return cls(words, states[order], np.array(weights, np.int64)[order])

    @classmethod
    def union(cls, parts: Sequence[Transducer]) -> Transducer:
        """One transducer of all phrases; weights of equal phrases are added."""
        words = sorted(set().union(*(p.words for p in parts)))
        if len(words) > _MASK:
            raise ValueError("too many words in one range; lower RANGE_STATES")
        place = {w: i for i, w in enumerate(words, start=1)}
        moved = []
        for part in parts:
            to = np.array([0, *(place[w] for w in part.words)], np.int64)
            moved.append(sum(to[(part.states >> s) & _MASK] << s for s in _SHIFTS))
        return cls(words, *_summed(moved, [p.weights for p in parts]))

    def depths(self) -> np.ndarray:
        """Words of each state's phrase."""
        return 1 + ((self.states >> _SHIFTS[1]) & _MASK > 0) + (self.states & _MASK > 0)

    def phrase(self, state: int) -> tuple[bytes, ...]:
        places = [(state >> s) & _MASK for s in _SHIFTS]
        return tuple(self.words[p - 1] for p in places if p)

    def lower_bound(self, phrase: Sequence[bytes]) -> int:
        """How many states come before a phrase, whether or not its words are known here."""
        key = 0
        for word, shift in zip(phrase, _SHIFTS, strict=False):
            at = bisect.bisect_left(self.words, word)
            key |= (at + 1) << shift
            if at == len(self.words) or self.words[at] != word:
                break
        return int(np.searchsorted(self.states, key))

    def part(self, first: int, last: int) -> Transducer:
        """The states of a prefix range, with only the words they need."""
        return self._of(self.states[first:last], self.weights[first:last])

    def at_least(self, least: int) -> Transducer:
        keep = self.weights >= least
        return self._of(self.states[keep], self.weights[keep])

    def _of(self, states: np.ndarray, weights: np.ndarray) -> Transducer:
        places = [(states >> s) & _MASK for s in _SHIFTS]
        used = np.zeros(len(self.words) + 1, bool)
        for p in places:
            used[p] = True
        used[0] = False
        to = np.cumsum(used)
        to[0] = 0
        words = [self.words[i - 1] for i in np.flatnonzero(used)]
        return Transducer(words, sum(to[p] << s for p, s in zip(places, _SHIFTS, strict=True)), weights)

    def compose(self, asked: Transducer) -> Transducer:
        """The phrases of ``asked`` with the weights they have here (0 if absent)."""
        place = {w: i for i, w in enumerate(self.words, start=1)}
        to = np.array([0, *(place.get(w, 0) for w in asked.words)], np.int64)
        moved, known = np.zeros(len(asked.states), np.int64), np.ones(len(asked.states), bool)
        for s in _SHIFTS:
            old = (asked.states >> s) & _MASK
            moved |= to[old] << s
            known &= (old == 0) | (to[old] > 0)
        return Transducer(asked.words, asked.states, np.where(known, self.weights_of(moved), 0))

    def weights_of(self, states: np.ndarray) -> np.ndarray:
        if not len(self.states):
            return np.zeros(len(states), np.int64)
        at = np.minimum(np.searchsorted(self.states, states), len(self.states) - 1)
        return np.where(self.states[at] == states, self.weights[at], 0)

    def to_bytes(self) -> bytes:
        """Depth, last word and weight of every state in order; states on the way that are missing are put in."""
        masks = [_MASK << _SHIFTS[0], (_MASK << _SHIFTS[0]) | (_MASK << _SHIFTS[1])]
        prefixes = [np.unique(self.states & m) for m in masks]
        states, weights = _summed([self.states, *prefixes], [self.weights, *(np.zeros(len(p), np.int64) for p in prefixes)])
        whole = Transducer(self.words, states, weights)
        depths = whole.depths().astype(np.uint8)
        last = np.choose(depths - 1, [(states >> s) & _MASK for s in _SHIFTS]).astype("<u4")
        press = zstandard.ZstdCompressor(level=3).compress
        parts = [press(x) for x in (b"\n".join(self.words), depths.tobytes(), _planes(last), _planes(weights.astype("<i8")))]
        return struct.pack("<4I", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        sizes, at, parts = struct.unpack_from("<4I", raw), 16, []
        for size in sizes:
            parts.append(zstandard.ZstdDecompressor().decompress(raw[at : at + size]))
            at += size
        words = parts[0].split(b"\n") if parts[0] else []
        depths = np.frombuffer(parts[1], np.uint8)
        last, weights = _unplanes(parts[2], "<u4").astype(np.int64), _unplanes(parts[3], "<i8")
        states, index = np.zeros(len(depths), np.int64), np.arange(len(depths))
        for n, shift in enumerate(_SHIFTS, start=1):
            on_path = np.maximum.accumulate(np.where(depths == n, index, 0))
            states |= np.where(depths >= n, last[on_path], 0) << shift
        return cls(words, states, weights)


def _summed(states: Sequence[np.ndarray], weights: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of states merged into one, weights of equal states added."""
    all_states = np.concatenate(states)
    if not len(all_states):
        return all_states, np.concatenate(weights)
    order = np.argsort(all_states, kind="stable")
    all_states = all_states[order]
    first = np.flatnonzero(np.r_[True, all_states[1:] != all_states[:-1]])
    return all_states[first], np.add.reduceat(np.concatenate(weights)[order], first)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


class ShardBuilder:
    """Collects the words of one language; ``close`` makes the transducer of what it has read."""

    def __init__(self, limit: int):
        self.limit = min(limit, _MASK - WORDS)
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.numbers[_BREAK] = 0
        self.runs: list[np.ndarray] = []
        self.silent: list[int] = []
        self.size = 0

    def add(self, words: list[bytes]) -> Iterator[Transducer]:
        """Take a text; give a transducer whenever enough words are read."""
        at = 0
        while at < len(words):
            until = min(len(words), at + self.limit - self.size)
            # The next words are read along so that phrases across the cut are counted once, by their start.
            ahead = words[until : until + WORDS - 1]
            run = np.fromiter(map(self.numbers.__getitem__, words[at:until] + ahead + [_BREAK]), np.int64)
            self.silent.extend(range(self.size + until - at, self.size + until - at + len(ahead)))
            self.runs.append(run)
            self.size += len(run)
            at = until
            if self.size >= self.limit:
                yield self.close()

    def close(self) -> Transducer:
        del self.numbers[_BREAK]
        words = sorted(self.numbers)
        to = np.zeros(len(words) + 2, np.int64)
        to[np.fromiter((self.numbers[w] for w in words), np.int64, len(words))] = np.arange(1, len(words) + 1)
        tokens = to[np.concatenate(self.runs)] if self.runs else np.empty(0, np.int64)
        silent = np.zeros(len(tokens), bool)
        silent[self.silent] = True
        self._clear()
        return Transducer.from_tokens(words, tokens, silent)


# --- shards -----------------------------------------------------------------------------


def _shard_rows(lang: str, shard: Transducer, size: int, sampled: int) -> Iterator[dict]:
    offset = zlib.crc32(b"\n".join(shard.words[:100]) + lang.encode()) % sampled
    words = int(shard.weights[shard.depths() == 1].sum())
    for first in range(0, len(shard.states), size):
        piece = shard.part(first, first + size)
        sample = [b" ".join(piece.phrase(int(s))).decode() for s in piece.states[(offset - first) % sampled :: sampled]]
        yield {"lang": lang, "states": len(piece.states), "words": words, "sample": sample, "automaton": piece.to_bytes()}
        words = 0


SHARDS = "lang string, states bigint, words bigint, sample array<string>, automaton binary"
_SHARD_TYPES = pa.schema(
    [("lang", pa.string()), ("states", pa.int64()), ("words", pa.int64()), ("sample", pa.list_(pa.string())), ("automaton", pa.binary())]
)


def shards(documents: DataFrame) -> DataFrame:
    """Count transducers of what each task reads, in rows of bounded size, written to the shared folder."""

    def build(batches):
        builders: dict[str, ShardBuilder] = {}

        def rows(made):
            for lang, shard in made:
                for row in _shard_rows(lang, shard, ROW_STATES, SAMPLED):
                    yield pa.RecordBatch.from_pylist([row], _SHARD_TYPES)

        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for i in range(batch.num_rows):
                lang, text = langs[i].as_py(), texts[i].as_py()
                if lang not in builders:
                    builders[lang] = ShardBuilder(SHARD_WORDS)
                yield from rows((lang, shard) for shard in builders[lang].add(words_of(text)))
                if sum(b.size for b in builders.values()) > SHARD_WORDS:
                    largest = max(builders, key=lambda k: builders[k].size)
                    yield from rows([(largest, builders.pop(largest).close())])
        while builders:
            lang, builder = builders.popitem()
            yield from rows([(lang, builder.close())])

    read = documents.select(
        F.coalesce(documents["lang"], F.lit("und")).alias("lang"), F.coalesce(documents["text"], F.lit("")).alias("text")
    )
    return stored(read.mapInArrow(build, SHARDS), "collocation-shards")


# --- ranges -----------------------------------------------------------------------------

Border = tuple[str, tuple[bytes, ...]]


def borders(made: DataFrame) -> list[Border]:
    """Where ranges of about equal size begin, but for the first: one short phrase per ``RANGE_STATES`` n-grams."""
    total = made.agg(F.sum("states")).first()[0] or 0
    ranges = -(-total // RANGE_STATES)
    if ranges < 2:
        return []
    seen = made.select("lang", F.explode("sample").alias("phrase")).collect()
    found = sorted({(r.lang, tuple(r.phrase.encode().split(b" "))) for r in seen})
    return found[:: max(1, len(found) // ranges)][1:]


def _home(starts: list[Border], lang: str, phrase: tuple[bytes, ...]) -> int:
    return bisect.bisect_right(starts, (lang, phrase))


def _cuts(starts: list[Border], lang: str, automaton: Transducer) -> Iterator[tuple[int, Transducer]]:
    """An automaton cut at the ranges' borders."""
    first = 0
    for home in range(_home(starts, lang, ()), len(starts) + 1):
        inside = home < len(starts) and starts[home][0] == lang
        last = automaton.lower_bound(starts[home][1]) if inside else len(automaton.states)
        if last > first:
            yield home, automaton.part(first, last)
        first = last
        if not inside:
            return


_ROUTED = "home int, lang string, kind int, sender int, automaton binary"
_ROUTED_NAMES = ["home", "lang", "kind", "sender", "automaton"]
#: Kinds of rows: counts of a range, a request for counts, an answer.
COUNTS, REQUEST, ANSWER = 0, 1, 2


def _routed(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], _ROUTED_NAMES)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c) for c in _ROUTED_NAMES]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, Iterator[tuple]]]:
    """Rows of one range and language after the other; they come sorted."""
    for (home, lang), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        yield home, lang, rows


def _by_range(rows: DataFrame, ranges: int) -> DataFrame:
    return rows.repartition(ranges, "home").sortWithinPartitions("home", "lang", "kind", "sender")


def unite(made: DataFrame, starts: list[Border], least: int) -> DataFrame:
    """Per range and language the counts of all shards together, from ``least`` on, written to the shared folder."""

    def cut(batches):
        for batch in batches:
            for lang, raw in zip(batch.column("lang"), batch.column("automaton"), strict=True):
                lang = lang.as_py()
                pieces = _cuts(starts, lang, Transducer.from_bytes(raw.as_py()))
                yield from _routed((home, lang, COUNTS, -1, piece.to_bytes()) for home, piece in pieces)

    def merge(batches):
        for home, lang, rows in _ranges(batches):
            whole = Transducer.union([Transducer.from_bytes(r[4]) for r in rows]).at_least(least)
            if len(whole.states):
                yield from _routed([(home, lang, COUNTS, -1, whole.to_bytes())])

    pieces = made.select("lang", "automaton").mapInArrow(cut, _ROUTED)
    return stored(_by_range(pieces, len(starts) + 1).mapInArrow(merge, _ROUTED), "collocation-counts")


def _parts(phrase: tuple[bytes, ...]) -> list[tuple[tuple[bytes, ...], tuple[bytes, ...]]]:
    return [(phrase[:k], phrase[k:]) for k in range(1, len(phrase))]


def _candidates(counts: Transducer, least: int) -> list[tuple[tuple[bytes, ...], int]]:
    chosen = np.flatnonzero((counts.depths() > 1) & (counts.weights >= least))
    return [(counts.phrase(s), w) for s, w in zip(counts.states[chosen].tolist(), counts.weights[chosen].tolist(), strict=True)]


def part_counts(counts: DataFrame, starts: list[Border], least: int) -> DataFrame:
    """Answers per range: automata of the parts its candidates have, with their counts."""

    def ask(batches):
        for home, lang, _, _, raw in _rows(batches):
            needed = {part for phrase, _ in _candidates(Transducer.from_bytes(raw), least) for cut in _parts(phrase) for part in cut}
            if needed:
                asked = Transducer.from_phrases(list(needed), [0] * len(needed))
                yield from _routed((to, lang, REQUEST, home, piece.to_bytes()) for to, piece in _cuts(starts, lang, asked))

    def answer(batches):
        for home, lang, rows in _ranges(batches):
            known = None
            for _, _, kind, sender, raw in rows:
                automaton = Transducer.from_bytes(raw)
                if kind == COUNTS:
                    known = automaton
                elif known is not None:
                    yield from _routed([(sender, lang, ANSWER, home, known.compose(automaton).to_bytes())])

    asked = counts.mapInArrow(ask, _ROUTED)
    return _by_range(counts.unionByName(asked), len(starts) + 1).mapInArrow(answer, _ROUTED)


def best_cut(phrase: tuple[bytes, ...], a: int, f: dict[tuple[bytes, ...], int]) -> tuple[int, int, int]:
    """``(score, l, r)`` of the cut that scores lowest, the first of equals. Exact: numbers of any size."""
    scored = [(SCALE * a * a // (f[x] * f[y]), k, f[x], f[y]) for k, (x, y) in enumerate(_parts(phrase))]
    score, _, left, right = min(scored)
    return score, left, right


_SCORED = "lang string, phrase string, absorbed boolean, a bigint, l bigint, r bigint, score bigint"


def scored(counts: DataFrame, starts: list[Border], least: int, percent: int) -> DataFrame:
    """Candidates with their scores, and (``absorbed``) phrases a longer candidate stands for."""

    def score(batches):
        for _, lang, rows in _ranges(batches):
            candidates, f = [], {}
            for _, _, kind, _, raw in rows:
                automaton = Transducer.from_bytes(raw)
                if kind == COUNTS:
                    candidates = _candidates(automaton, least)
                else:
                    some = np.flatnonzero(automaton.weights)
                    f.update(zip(map(automaton.phrase, automaton.states[some].tolist()), automaton.weights[some].tolist(), strict=True))
            out, absorbed = [], set()
            for phrase, a in candidates:
                value, left, right = best_cut(phrase, a, f)
                out.append((lang, b" ".join(phrase).decode(), False, a, left, right, value))
                if len(phrase) > 2:
                    absorbed.update(p for p in (phrase[:-1], phrase[1:]) if 100 * a >= percent * f[p])
            out += [(lang, b" ".join(p).decode(), True, 0, 0, 0, 0) for p in absorbed]
            kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4]
            names = ["lang", "phrase", "absorbed", "a", "l", "r", "score"]
            for i in range(0, len(out), 10_000):
                columns = zip(*out[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = counts.unionByName(part_counts(counts, starts, least))
    return stored(_by_range(rows, len(starts) + 1).mapInArrow(score, _SCORED), "collocation-scores")


def collocations(
    documents: DataFrame, top: int = TOP, least: int = MIN_COUNT, percent: int = ABSORBED_PERCENT
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    made = shards(documents)
    starts = borders(made)
    found = scored(unite(made, starts, least), starts, least, percent)
    absorbed = found.filter("absorbed").select("lang", "phrase").distinct()
    left = found.filter("NOT absorbed").drop("absorbed").join(absorbed, ["lang", "phrase"], "left_anti")
    # Spark keeps only the first rows of each task before it brings those of a language together.
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = made.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
    SELECT lang, unnest([w[i:i], w[i:i + 1], w[i:i + 2]]) AS g, unnest([1, 2, 3]) AS size, len(w) - i + 1 AS room FROM places
), counts AS (
    SELECT lang, g, size, count(*) AS f FROM grams WHERE size <= room GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, g, size, f AS a FROM counts WHERE size >= 2 AND f >= 10
), cuts AS (
    SELECT c.lang, c.g, c.size, c.a, k, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k]
    JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:c.size]
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), absorbed AS (
    SELECT DISTINCT s.lang, s.g FROM candidates s
    JOIN (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS g FROM candidates WHERE size = 3) t ON s.lang = t.lang AND s.g = t.g
    WHERE 100 * t.a >= 50 * s.a
), kept AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM lowest ANTI JOIN absorbed USING (lang, g)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

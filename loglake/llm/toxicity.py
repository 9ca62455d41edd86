"""Toxicity by a gap-weighted subsequence kernel, a support vector machine and Nyström landmarks.

Strings are compared by the three-letter subsequences they share, each weighted by ``DECAY`` per letter it skips,
so insults with gaps, inserted characters or unseen endings stay close to those learnt. The kernel is approximated
by its values at landmark strings; a linear machine with squared hinge loss is trained there. As a
landmark's kernel value is linear in the subsequences, the trained machine folds into one weight per subsequence,
and scoring a word is a sum of table entries. A text's score is that of its worst word, calibrated on texts.

Training data is a bounded sample of labelled documents, near copies left out: words that occur almost only in
toxic texts against other words, with variants that hold inserted characters, and words of clean texts that
an earlier round scored highest.

Null and empty texts get the score of a text without words. Labels that are null, or contradict each other
(then toxic counts), repeated rows, empty tables (every text gets the same low score) and extra columns are all
accepted. Long words are scored in overlapping windows, so whole texts count.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.bpe import forget
from loglake.llm.neardup import keep_one_of_each
from loglake.llm.shared import give_back, stored, table, texts, tidy
from loglake.llm.tokens import chunks

#: Labelled documents used: those with the smallest hashed ids; and strings per class.
SAMPLE_DOCUMENTS = 16_000
MAX_TOXIC_WORDS = 400
#: A word counts as toxic if so many toxic texts hold it, in number and as a share.
MIN_SUPPORT_TEXTS = 4
MIN_SUPPORT_SHARE = 0.02
MAX_OTHER_WORDS = 5_000
MAX_HARD_WORDS = 3_000
LANDMARKS = 192
DECAY = 0.7
#: Letters a subsequence may span, and letters of a window.
SPAN = 7
WIDTH = 24
THRESHOLD = 0.3
NO_WORDS = -3.0
CACHE_ENTRIES = 300_000
_SIZE = 40
_LEET = dict(zip("013457@$", "oieastas", strict=True))
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_EDGES = " \t\r\n.,;:!?\"'()[]{}<>|/\\*#&%$~`+=_-"


def _code(c: str) -> int:
    """1 and 2 mark a word's ends, 3-28 are letters, 29-39 all other letters and digits, 0 a gap."""
    c = _LEET.get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 94
    return 29 + ord(c) % 11 if c.isalnum() else 0


class _Codes(dict):
    def __missing__(self, c: str) -> int:
        self[c] = _code(c)
        return self[c]


_CODES = _Codes()


def windows(word: str) -> list[str]:
    """A word, or the overlapping windows of a long one."""
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def text_words(text: str) -> Iterable[str]:
    """The words of a text as they are scored: lowered, without marks around them; spelt-out words joined."""
    low = text.lower()
    found = {w.strip(_EDGES) for w in low.split()}
    found.update(re.sub(r"\s", "", m.group()) for m in _SPACED.finditer(low))
    found.discard("")
    return found


def _matrix(words: list[str]) -> np.ndarray:
    width = max(SPAN, max(map(len, words), default=0) + 2)
    rows = np.zeros((len(words), min(width, WIDTH + 2)), np.int32)
    for i, w in enumerate(words):
        codes = [1, *(_CODES[c] for c in w[:WIDTH]), 2]
        rows[i, : len(codes)] = codes
    return rows


def _triples(codes: np.ndarray):
    """Table indices of all subsequences, with their weight, one spacing at a time."""
    n = codes.shape[1]
    for far in range(2, SPAN):
        for near in range(1, far):
            first, second, third = codes[:, : n - far], codes[:, near : n - far + near], codes[:, far:]
            yield (first * _SIZE + second) * _SIZE + third, DECAY ** (far - 2)


_VALID = np.ones((_SIZE, _SIZE, _SIZE), np.float32)
_VALID[0] = _VALID[:, 0] = _VALID[:, :, 0] = 0
_VALID = _VALID.reshape(-1)


def _norms(codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for first in range(0, len(codes), 4000):
        for index, weight in _triples(codes[first : first + 4000]):
            total[first : first + 4000] += weight**2 * _VALID[index].sum(axis=1)
    return np.sqrt(np.maximum(total, 1e-9))


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table indices of the subsequences a few strings have, and their normed weights (subsequences by strings)."""
    used = np.unique(np.concatenate([index[_VALID[index] > 0] for index, _ in _triples(codes)]))
    place = np.full(_SIZE**3, len(used), np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(used) + 1, len(codes)), np.float32)
    owner = np.arange(len(codes))[:, None]
    for index, weight in _triples(codes):
        np.add.at(out, (place[index], np.broadcast_to(owner, index.shape)), weight)
    return used, out[:-1] / _norms(codes).astype(np.float32)


def _against(codes: np.ndarray, used: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Kernel values before norming, strings by landmarks; a few strings at a time, to bound memory."""
    place = np.full(_SIZE**3, -1, np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(codes), columns.shape[1]), np.float32)
    for first in range(0, len(codes), 250):
        rows, cols, weights = [], [], []
        for index, weight in _triples(codes[first : first + 250]):
            at = place[index]
            row, where = np.nonzero(at >= 0)
            rows.append(row)
            cols.append(at[row, where])
            weights.append(np.full(len(row), weight, np.float32))
        row, col, weight = map(np.concatenate, (rows, cols, weights))
        order = np.argsort(row, kind="stable")
        row, col, weight = row[order], col[order], weight[order]
        if len(row):
            starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
            out[first + row[starts]] = np.add.reduceat(columns[col] * weight[:, None], starts, axis=0)
    return out


class Machine:
    """Weights per subsequence, an offset, and the calibration of a text's worst margin."""

    def __init__(self, table: np.ndarray, offset: float):
        self.table, self.offset = (table * _VALID).astype(np.float32), offset
        self.slope, self.shift = 2.0, -2.0
        self.cache: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for first in range(0, len(order), 10_000):
            block = order[first : first + 10_000]
            parts = [windows(words[i]) for i in block]
            flat = [p for some in parts for p in some]
            values = np.empty(len(flat))
            for i in range(0, len(flat), 20_000):
                codes = _matrix(flat[i : i + 20_000])
                sums = np.zeros(len(codes))
                for index, weight in _triples(codes):
                    sums += weight * self.table[index].sum(axis=1)
                values[i : i + 20_000] = sums / _norms(codes) + self.offset
            starts = np.cumsum([0, *map(len, parts[:-1])])
            out[block] = np.maximum.reduceat(values, starts)
        return out

    def worst(self, texts_: list[str]) -> list[float]:
        """The largest margin of each text's words."""
        split = [text_words(t) for t in texts_]
        new = sorted({w for some in split for w in some if w not in self.cache})
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            wanted = {w for some in split for w in some}
            self.cache = {w: m for w, m in self.cache.items() if w in wanted}
        self.cache.update(zip(new, self.margins(new).tolist(), strict=True))
        get = self.cache.__getitem__
        return [max(map(get, some), default=NO_WORDS) for some in split]

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(worst) + self.shift, -30, 30)))


def _squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of a linear machine, by Newton steps on the points inside the margin; the last column of ``z`` is one, for the offset."""
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    before = None
    for _ in range(50):
        active = y * (z @ w) < 1
        if before is not None and (active == before).all():
            break
        # At first all points are inside; then none is copied.
        a = z if active.all() else z[active]
        weighted = a * cost[active][:, None]
        new = np.linalg.solve(ridge + weighted.T @ a, weighted.T @ y[active])
        del a, weighted
        w, before = (new if before is None else 0.5 * (w + new)), active
    return w


def _varied(words: list[str], rng: random.Random) -> list[str]:
    """Words with characters put in: marks between all letters, or one letter or mark somewhere."""
    out = []
    for w in words:
        at = rng.randint(1, max(1, len(w) - 1))
        out += [rng.choice(".-*_").join(w), w[:at] + rng.choice("*.-x") + w[at:], w[:at] + rng.choice("aeiours") + w[at:]]
    return out


def fit(toxic: list[str], other: list[str], hard: list[str]) -> Machine:
    """A machine from words of either class; the landmarks are spread over both."""
    if not toxic:
        return Machine(np.zeros(_SIZE**3), NO_WORDS)
    rng = random.Random(11)
    base = [*toxic, *_varied(toxic, rng)]
    rest = [*hard, *other, *_varied(other[: len(toxic)], rng), *_varied(hard[: len(toxic)], rng)]
    landmarks = toxic[: LANDMARKS * 2 // 3] + rest[: LANDMARKS - min(len(toxic), LANDMARKS * 2 // 3)]
    used, columns = _features(_matrix(landmarks))
    gram = (columns.T @ columns).astype(np.float64)
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    codes = _matrix([*base, *rest])
    # The driver holds this: each step's array goes before the next but one is made.
    z = _against(codes, used, columns) / _norms(codes)[:, None]
    z = z @ whiten
    z = np.c_[z, np.ones(len(z))]
    y = np.r_[np.ones(len(base)), -np.ones(len(rest))]
    cost = np.where(y > 0, 10.0 * len(y) / len(base), 10.0 * len(y) / len(rest))
    w = _squared_hinge(z, y, cost)
    table = np.zeros(_SIZE**3)
    table[used] = columns @ (whiten @ w[:-1])
    return Machine(table, float(w[-1]))


def held_out(doc_id) -> F.Column:
    """Rows no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, toxic, text)`` of a bounded number of labelled documents, copies within a label left out."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    # One row per id, so the sample is bounded in rows, too; equal texts of a label count once.
    some = texts(documents).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    some = some.groupBy("toxic", F.sha2("text", 256).alias("same")).agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("one"))
    some = stored(some.select("one.doc_id", "toxic", "one.text"), "toxic-sample")
    # Of toxic texts, near-duplicates of each other, too: words that copies share would otherwise speak for the label.
    apart = keep_one_of_each(some.filter("toxic = 1"), k=2)
    return stored(some.filter("toxic <> 1").unionByName(apart), "toxic-apart")


def _word_counts(sample: DataFrame) -> DataFrame:
    """``(word, toxic, clean)``: texts of either label that hold a word; partial counts per task."""

    def count(batches):
        forget()
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in {p for word in text_words(text) for p in windows(word)}:
                    counts.setdefault(w, [0, 0])[0 if label == 1 else 1] += 1
            if len(counts) > 200_000:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ],
            ["word", "toxic", "clean"],
        )

    counted = sample.select("toxic", "text").mapInArrow(tidy(count), "word string, toxic bigint, clean bigint")
    return stored(counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-words")


def _scored(frame: DataFrame, column: str, machine: Machine, schema: str, of) -> DataFrame:
    """Append ``of(machine, strings)`` to each batch of a frame."""
    shared = frame.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        forget()
        known = shared.value
        for batch in batches:
            for first, run in chunks(batch, column):
                part = batch.slice(first, len(run))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(of(known, run), pa.float64())], [*part.schema.names, "margin"]
                )

    return frame.mapInArrow(tidy(score), schema)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Machine:
    """Words, two rounds of machines, and the calibration; the driver holds bounded lists of words."""
    apart = labelled_sample(documents, labels, sample)
    counted = _word_counts(apart)
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean") + 0.5)
    n_toxic = apart.filter(F.col("toxic") == 1).count()
    support = max(MIN_SUPPORT_TEXTS, int(MIN_SUPPORT_SHARE * n_toxic))
    toxic = (
        counted.filter((F.length("word") >= 3) & (F.col("toxic") >= support) & (rate >= 0.75))
        .orderBy(F.desc("toxic"), "clean", "word").limit(MAX_TOXIC_WORDS)
    )
    toxic_words = [r["word"] for r in toxic.collect()]
    clean = counted.filter((F.col("clean") > 0) & (rate < 0.5))
    often = [r["word"] for r in clean.orderBy(F.desc("clean"), "word").limit(MAX_OTHER_WORDS // 2).collect()]
    any_ = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(MAX_OTHER_WORDS // 2).collect()]
    other = list(dict.fromkeys(often + any_))
    machine, hard = fit(toxic_words, other, []), []
    for _ in range(2 if toxic_words else 0):
        rated = _scored(clean.select("word"), "word", machine, "word string, margin double", lambda m, w: m.margins(w))
        worst = rated.filter(F.col("margin") > -0.8).orderBy(F.desc("margin"), "word").limit(MAX_HARD_WORDS)
        hard = list(dict.fromkeys([*hard, *(r["word"] for r in worst.collect())]))
        machine = fit(toxic_words, other, hard)
    if toxic_words:
        worst = _scored(
            apart.select("toxic", "text"), "text", machine, "toxic int, text string, margin double", lambda m, t: m.worst(t)
        )
        rows = worst.select("toxic", "margin").collect()
        machine.slope, machine.shift = _platt(
            np.array([r["margin"] for r in rows]), np.array([r["toxic"] == 1 for r in rows], float)
        )
    give_back()
    return machine


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, a little drawn to moderate values."""
    w, data = np.array([1.0, 0.0]), np.c_[x, np.ones(len(x))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        hessian = (data * (p * (1 - p))[:, None]).T @ data + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, data.T @ (y - p) - 0.05 * (w - [2.0, 0.0]))
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score_toxicity(documents: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, margin, score)`` for every document, in one pass without a shuffle."""
    source = texts(documents)
    shared = source.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        forget()
        known = shared.value
        for batch in batches:
            for first, run in chunks(batch):
                worst = np.array(known.worst(run))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(run)), pa.array(worst), pa.array(known.probability(worst))],
                    ["doc_id", "margin", "score"],
                )

    return source.mapInArrow(tidy(score), "doc_id bigint, margin double, score double")


def keep_mild(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    at = documents.columns.index("text")

    def keep(batches):
        forget()
        known = shared.value
        for batch in batches:
            for first, run in chunks(batch, at):
                mild = known.probability(np.array(known.worst(run))) < threshold
                yield batch.slice(first, len(run)).filter(pa.array(mild))

    # Columns go by position, so their names cannot clash.
    numbered = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    return numbered.mapInArrow(tidy(keep), numbered.schema).toDF(*documents.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train(documents, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    return score_toxicity(documents, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )

"""Secret scan: fixed patterns, and random strings told from identifiers by two character Markov models.

One first-order model is trained on random strings (values of fixed matches in a bounded sample of documents,
and generated keys), the other on ordinary tokens of the same documents and identifiers joined from them. A
token that holds letters and digits is reported if the log-likelihood ratio per character, random over ordinary,
exceeds a cut. The cut is set on strings neither model was trained on: generated keys, and identifiers joined from words
of documents kept apart. A fixed list of words stands in for documents where there are few.
Fixed matches always stay; tokens that touch one are not reported again.

Null texts are empty and have no spans; repeated rows are each searched; an empty table gives an empty result;
extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.shared import table, texts
from loglake.llm.tokens import chunks

KINDS = ("assign", "access", "hex", "random")
#: Documents whose tokens train the models: those with the smallest hashed ids.
SAMPLE_DOCUMENTS = 4000
GENERATED = 2000
MIN_LENGTH = 20
#: One sampled document in so many is kept from training; it gives up to so many identifiers to set the cut on.
HELD_OUT = 8
HELD_STRINGS = 16
#: Random strings the cut may miss, and identifiers it may report.
MAX_MISSED, MAX_FALSE = 0.01, 0.002
#: Words of names in programs, as a prior for the ordinary model.
_PRIOR = (
    "get set add new old user name value index list table update create delete request response handler parser config file path "
    "data time date type count number string object error message service client server session cache queue event state "
    "status result input output version default option process thread buffer image button layout account order product"
).split()
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_CHARS) + 1

#: Fixed patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_HINTS = ("pass", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
_ORDINARY = re.compile(r"[A-Za-z0-9_]{4,}")

Span = tuple[int, int, int]


def fixed_spans(text: str) -> list[Span]:
    """Matches of the fixed kinds as (start, kind, end), sorted."""
    found: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _codes(token: str) -> list[int]:
    return [_CHARS.find(c) + 1 for c in token]


def _generated(seed: int = 7, n: int = GENERATED) -> list[str]:
    """Random strings as keys and tokens have them."""
    rng = random.Random(seed)
    alphabets = (_CHARS[:62], _CHARS[52:62] + "abcdef", _CHARS[:26] + _CHARS[52:62], _CHARS[:62] + "-_", _CHARS[:62] + "+/")
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 44))) for i in range(n)]


class Ratio:
    """Two first-order models over the same characters, compared per character."""

    def __init__(self, random_pairs: np.ndarray, ordinary_pairs: np.ndarray, min_ratio: float = 0.0):
        self.table = self._log(random_pairs) - self._log(ordinary_pairs)
        self.min_ratio = min_ratio

    def calibrate(self, keys: list[str], identifiers: list[str]) -> None:
        """Put the cut between both kinds; where they overlap, rather miss no key."""
        low = float(np.quantile([self.score(k) for k in keys], MAX_MISSED))
        high = float(np.quantile([self.score(i) for i in identifiers], 1 - MAX_FALSE))
        self.min_ratio = (low + high) / 2 if high < low else low

    @staticmethod
    def _log(pairs: np.ndarray) -> np.ndarray:
        smooth = pairs + 0.5
        return np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def score(self, token: str) -> float:
        codes = [0, *_codes(token)]
        return float(self.table[codes[:-1], codes[1:]].mean())

    def spans(self, text: str, known: list[Span]) -> list[Span]:
        """Random tokens that no known span touches."""
        found, at = [], 0
        for m in _TOKEN.finditer(text):
            token, start, end = m.group(), m.start(), m.end()
            if token.isalpha() or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
                continue
            while at < len(known) and known[at][2] <= start:
                at += 1
            if any(s < end and start < e for s, _, e in known[at : at + 8]) or self.score(token) <= self.min_ratio:
                continue
            found.append((start, 3, end))
        return found


def _identifiers(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Names joined from words, as programs have them: two to five words, some with a number, long enough to be looked at."""
    out = []
    while words and len(out) < n:
        some = [rng.choice(words) for _ in range(rng.randint(2, 5))]
        name = rng.choice(["_", "-"]).join(some).lower() if rng.random() < 0.5 else some[0].lower() + "".join(w.title() for w in some[1:])
        while len(name) < MIN_LENGTH:
            name += rng.choice(["_", ""]) + rng.choice(words)
        at = rng.choice([len(name), rng.randrange(len(name))])
        out.append(name[:at] + str(rng.choice([1, 2, 3, 64, 2024, rng.randint(0, 999)])) + name[at:])
    return out


def _held_words(batches):
    """Some words of every document, one row each."""
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            words = list(dict.fromkeys(w for w in _ORDINARY.findall(text) if w.isalpha()))
            found += random.Random(len(text)).sample(words, min(HELD_STRINGS, len(words)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])


def _pairs(tokens, into: Counter) -> None:
    for token in tokens:
        codes = [0, *_codes(token)]
        into.update(zip(codes, codes[1:], strict=False))


def _count_pairs(batches):
    """Character pairs of secret values and of ordinary tokens, one partial count per task."""
    counts = {True: Counter(), False: Counter()}
    for batch in batches:
        for _, run in chunks(batch):
            for text in run:
                spans = fixed_spans(text)
                values = []
                for start, kind, end in spans:
                    value = text[start:end]
                    values.append(re.split(r"[:= \"']", value)[-1] if kind == 0 else value)
                _pairs((v for v in values if v), counts[True])
                inside, at, plain = spans, 0, []
                for m in _ORDINARY.finditer(text):
                    while at < len(inside) and inside[at][2] <= m.start():
                        at += 1
                    if at == len(inside) or m.end() <= inside[at][0]:
                        plain.append(m.group())
                _pairs(plain, counts[False])
                joined = zip(plain[::3], plain[1::3], plain[2::3], strict=False)
                _pairs(("_".join(x).lower() if i % 2 else x[0].lower() + x[1].title() + x[2].title() for i, x in enumerate(joined)), counts[False])
    rows = [(label, a, b, n) for label, c in counts.items() for (a, b), n in c.items()]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["secret", "a", "b", "n"])


def train(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Ratio:
    """Models from a bounded sample; the driver gets sums per pair of characters only."""
    ids = documents.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # One row per id: an id that many rows repeat must not make the sample larger.
    some = texts(documents).join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    counted = some.filter(~held).mapInArrow(_count_pairs, "secret boolean, a int, b int, n bigint").groupBy("secret", "a", "b").agg(F.sum("n").alias("n"))
    tables = {True: np.zeros((_SIZE, _SIZE)), False: np.zeros((_SIZE, _SIZE))}
    for row in counted.collect():
        tables[row["secret"]][row["a"], row["b"]] = row["n"]
    rng = random.Random(3)
    for label, strings in ((True, _generated()), (False, _identifiers(_PRIOR, GENERATED, rng))):
        more: Counter = Counter()
        _pairs(strings, more)
        for (a, b), n in more.items():
            tables[label][a, b] += n
    model = Ratio(tables[True], tables[False])
    words = sorted({r["word"] for r in some.filter(held).select("text").mapInArrow(_held_words, "word string").collect()})
    model.calibrate(_generated(11), _identifiers(words, GENERATED, rng) + _identifiers(_PRIOR, GENERATED, rng))
    return model


def listed(spans: list[Span]) -> str:
    """Spans as ``kind:start:end``, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(documents: DataFrame, model: Ratio) -> DataFrame:
    """``(doc_id, base, spans)``: fixed matches, and all spans, each as arrays of (start, kind, end)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def scan(batches):
        ratio = shared.value
        as_rows = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]
        for batch in batches:
            for first, run in chunks(batch):
                base = [fixed_spans(t) for t in run]
                full = [sorted(b + ratio.spans(t, b)) for t, b in zip(run, base, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(run)),
                        pa.array([as_rows(b) for b in base], span), pa.array([as_rows(b) for b in full], span),
                    ],
                    ["doc_id", "base", "spans"],
                )

    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    return texts(documents).mapInArrow(scan, f"doc_id bigint, base {kind}, spans {kind}")


def _count(index: int):
    return F.size(F.filter("base", lambda s: s["kind"] == index)).cast("long")


def _joined(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    documents = table(spark, sf_dir, "documents")
    found = find_secrets(documents, train(documents))
    return found.select(
        "doc_id", *[_count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )

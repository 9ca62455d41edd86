"""Personal data: fixed patterns, and identifiers found by bootstrapped context, with DataFrame functions only.

Four fixed kinds are matched in whole texts. Their matches are seeds: the words around them become lexical
patterns, and a bipartite graph of patterns and instances (seeds and other tokens that hold digits or ``@``)
is scored in rounds. A pattern's confidence in a kind is the score its instances give to that kind over the
number of its instances; an instance's score is the noisy-or of its patterns. Tokens that end above the
threshold are reported beside the fixed matches, which always stay.

Null texts are empty and have no spans; repeated rows are each searched on their own; an empty table gives an
empty result; extra columns are ignored. Offsets are code points, ends exclusive. Only distinct
(pattern, instance) edges are joined, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.shared import stored, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The fixed kinds. Possessive and anchored at the start of a run, so that time stays linear in the text;
#: the matches are those of the plain patterns.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be searched at all.
_HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "ip": lambda t: F.rlike(t, F.lit(PATTERNS["ip"])),
    "card": lambda t: F.rlike(t, F.lit(PATTERNS["card"])),
}
#: Tokens that may be identifiers of an unseen form.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.8
ROUNDS = 2
#: Lengths summed together; longer lists are summed in pieces of this size.
_PIECE = 256
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_HIT = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def _running(lengths: Column) -> Column:
    """Prefix sums before each element, in pieces, so that work stays near linear."""
    zero = F.lit(0).cast("bigint")
    nothing = F.expr("array()").cast("array<bigint>")

    def listed(values: Column, start: Column) -> Column:
        done = F.aggregate(
            values,
            F.struct(start.alias("at"), nothing.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )
        return done["out"]

    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _PIECE).cast("int")),
        lambda i: F.slice(lengths, i * _PIECE + 1, F.lit(_PIECE)),
    )
    starts = listed(F.transform(pieces, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.zip_with(pieces, starts, listed))


def with_hits(df: DataFrame, name: str, pattern: str, hint: Column) -> DataFrame:
    """Add ``name``: all leftmost non-overlapping matches of a pattern in ``text``, with what stands around.

    Matches and gaps are columns of their own, and lambdas see only elements, so nothing is evaluated per
    element that belongs to the row.
    """
    found, gaps, starts = f"{name}_found", f"{name}_gaps", f"{name}_starts"
    text, some = F.col("text"), F.size(found) > 0
    long = lambda x: F.length(x).cast("bigint")
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: long(g) + long(h))
    rows = F.arrays_zip(
        F.col(starts).alias("at"), F.col(found).alias("hit"),
        F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"),
    )

    def made(row: Column) -> Column:
        start = row["at"] + F.length(row["gap"])
        return F.struct(
            start.alias("start"), (start + F.length(row["hit"])).alias("end"), row["hit"].alias("value"),
            F.right(row["gap"], F.lit(80)).alias("before"), F.left(row["next"], F.lit(80)).alias("after"),
        )

    return (
        df.withColumn(found, F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_none("array<string>")))
        .withColumn(gaps, F.when(some, F.split(text, pattern, -1)).otherwise(_none("array<string>")))
        .withColumn(starts, F.when(some, _running(steps)).otherwise(_none("array<bigint>")))
        .withColumn(name, F.when(some, F.transform(rows, made)).otherwise(_none(_HIT)))
        .drop(found, gaps, starts)
    )


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.call_function("luhn_check", F.translate(value, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda h: _valid(kind, h["value"])


def _as_span(index: int):
    return lambda h: F.struct(h["start"].alias("start"), F.lit(index).alias("kind"), h["end"].alias("end"))


def _of_kind(index: int):
    return lambda s: s["kind"] == index


def _contexts(before: Column, after: Column) -> Column:
    """Lexical patterns of a mention: the word before, the two words before, the word after."""
    words = F.regexp_extract_all(F.lower(before), F.lit(r"[\p{L}]+"), F.lit(0))
    near = F.get(words, F.size(words) - 1)
    pair = F.concat_ws(" ", F.get(words, F.size(words) - 2), near)
    follows = F.regexp_extract(F.lower(after), r"\A\W*([\p{L}]+)", 1)
    made = F.array(
        F.when(near.isNotNull(), F.concat(F.lit("<1 "), near)),
        F.when(F.size(words) > 1, F.concat(F.lit("<2 "), pair)),
        F.when(follows != "", F.concat(F.lit("> "), follows)),
    )
    return F.array_compact(made)


def scan(documents: DataFrame, whole: bool = False) -> DataFrame:
    """One pass over the texts: ``(row, doc_id, base, mentions)``, written to the shared folder.

    ``whole`` adds ``doc``, the document's own row.

    ``mentions`` holds the fixed matches (with their kind) and the candidates (kind null).
    """
    d = documents.select("doc_id", F.coalesce(documents["text"], F.lit("")).alias("text"), *_packed(documents, whole))
    for kind in KINDS:
        d = with_hits(d, kind, PATTERNS[kind], _HINT[kind](F.col("text")))
        d = d.withColumn(kind, F.filter(kind, _check(kind)))
    d = with_hits(d, "other", CANDIDATE, F.rlike("text", F.lit("[0-9@]")))
    base = F.concat(*[F.transform(k, _as_span(i)) for i, k in enumerate(KINDS)])

    def trimmed(h: Column) -> Column:
        lead = F.length(F.regexp_extract(h["value"], r"""\A["'(\[{<]*""", 0))
        core = F.regexp_replace(F.substr(h["value"], lead + 1), r"""[.,;:!?"')\]}>]+\z""", "")
        return F.struct(
            (h["start"] + lead).alias("start"), (h["start"] + lead + F.length(core)).alias("end"), core.alias("value"),
            h["before"].alias("before"), h["after"].alias("after"),
        )

    def free(h: Column) -> Column:
        digits = F.length(F.regexp_replace(h["value"], "[^0-9]", ""))
        apart = ~F.exists("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"]))
        return (F.length(h["value"]) >= 6) & ((digits >= 4) | F.contains(h["value"], F.lit("@"))) & apart

    def mention(kind: int | None):
        return lambda h: F.struct(
            h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value"),
            _contexts(h["before"], h["after"]).alias("patterns"), F.lit(kind).cast("int").alias("kind"),
        )

    seeds = [F.transform(k, mention(i)) for i, k in enumerate(KINDS)]
    candidates = F.transform("other", mention(None))
    found = (
        d.withColumn("base", F.array_sort(base.cast(_SPAN)))
        .withColumn("other", F.filter(F.transform("other", trimmed), free))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "base",
            F.concat(*seeds, candidates).alias("mentions"), *(["doc"] if whole else []),
        )
    )
    return stored(found, "pii-scan", compression="zstd")


def _packed(documents: DataFrame, whole: bool) -> list[Column]:
    """A document's columns by position, so that their names cannot clash with others."""
    if not whole:
        return []
    return [F.struct(*[documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("doc")]


def discover(mentions: DataFrame) -> DataFrame:
    """``(value, kind)`` of the identifiers the bootstrapped patterns accept.

    ``mentions``: ``(value, patterns, kind)``, kind null for candidates.
    """
    edges = stored(
        mentions.select("value", "kind", F.explode("patterns").alias("pattern")).distinct(), "pii-edges"
    )
    seeds = edges.filter(F.col("kind").isNotNull())
    support = (
        edges.groupBy("pattern")
        .agg(F.count("*").alias("n"), F.count("kind").alias("seeds"))
        .filter(F.col("seeds") >= MIN_SEEDS)
    )
    # Seeds count for their own kind in every round; only candidates are scored anew.
    fixed = seeds.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("score"))
    open_edges = edges.filter(F.col("kind").isNull()).select("pattern", "value")
    scores = None
    for _ in range(ROUNDS):
        votes = fixed
        if scores is not None:
            learned = open_edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
            votes = fixed.unionByName(learned).groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        confident = (
            votes.join(support, "pattern")
            .select("pattern", "kind", F.round(F.col("score") / (F.col("n") + 1), 6).alias("confidence"))
            .filter(F.col("confidence") >= MIN_CONFIDENCE)
        )
        missed = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        scores = (
            open_edges.join(confident, "pattern")
            .groupBy("value", "kind")
            .agg(F.round(1 - F.exp(missed), 6).alias("score"))
        )
        scores = stored(scores, "pii-scores")
    return (
        scores.filter(F.col("score") >= MIN_SCORE)
        .groupBy("value")
        .agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("best"))
        .select("value", (-F.col("best.order")).alias("kind"))
    )


def find_pii(documents: DataFrame, whole: bool = False) -> DataFrame:
    """``(row, doc_id, base, spans)``: fixed matches, and all spans, as arrays of (start, kind, end).

    ``whole`` adds ``doc``, the document's own row with columns ``c0``, ``c1`` and so on.
    """
    scanned, carried = scan(documents, whole), (["doc"] if whole else [])
    open_mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    accepted = discover(open_mentions.select("value", "patterns", "kind"))
    extra = (
        open_mentions.filter(F.col("kind").isNull())
        .select("row", "start", "end", "value")
        .join(accepted, "value")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).cast(_SPAN).alias("extra"))
    )
    nothing = F.expr("array()").cast(_SPAN)
    return (
        scanned.select("row", "doc_id", "base", *carried)
        .join(extra, "row", "left")
        .select(
            "row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", nothing))).alias("spans"), *carried
        )
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans merge into the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        later = s["start"] >= done["at"]
        kept = F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(later, F.concat(done["out"], F.array(kept, F.get(names, s["kind"])))).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("array()").cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step)
    rest = F.substr(text, (done["at"] + 1).cast("int"))
    return F.when(F.size(spans) > 0, F.concat(F.concat_ws("", done["out"]), rest)).otherwise(text)


def mask_documents(documents: DataFrame) -> DataFrame:
    """All rows with personal data masked; a column ``n_chars`` is counted anew, others stay as they are."""
    found = find_pii(documents, whole=True)
    columns = {c: F.col(f"doc.c{i}") for i, c in enumerate(documents.columns)}
    text = F.when(columns["text"].isNotNull(), masked(columns["text"], F.col("spans")))
    columns["text"] = text
    if "n_chars" in columns:
        kind = dict(documents.dtypes)["n_chars"]
        columns["n_chars"] = F.coalesce(F.length(text).cast(kind), columns["n_chars"])
    return found.select(*[column.alias(c) for c, column in columns.items()])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )

"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and its maximum, so half the hash
evaluations make a signature of the same length. Bands of signature values propose pairs; every proposed pair
that matters is confirmed on full shingle sets.

Documents with equal shingle sets are one class, represented by their smallest id. Inside a band's bucket all
members are compared with one pivot first, and confirmed links join components. What is left of a bucket
outside its largest component is then compared with all its members: pair by pair in small buckets, in a
grid of blocks in large ones, where a task counts shared shingles through an inverted index and returns one link per
component. So a bucket of very many copies costs one comparison each, no link between components is
given up, and pairs of a large bucket are never rows.

A document without words (also null text) has an empty set and is linked with nothing. Fewer words than a
shingle: the whole sequence is the one shingle. Rows that repeat a ``doc_id`` are one node with several texts.
Rows with a null id are never linked; their component is null and they are kept. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.bpe import forget
from loglake.llm.components import components
from loglake.llm.decontaminate import _mix, _shingle_keys
from loglake.llm.shared import stored, table, texts, tidy
from loglake.llm.tokens import chunks

SHINGLE_WORDS = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 80
#: 96 permutations give 192 values: 32 bands of 6, which miss a pair at 0.8 once in 16,000.
PERMUTATIONS = 96
BAND_ROWS = 6
#: Buckets up to this size are compared pair by pair; larger ones in blocks of so many members and outsiders.
SMALL_BUCKET = 48
BLOCK_MEMBERS = 1024
BLOCK_OUTSIDERS = 512
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of a text's shingles of ``k`` words (A-Z lowered, cut at ASCII white space)."""
    found = text.encode().translate(_UPPER).split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.unique(_shingle_keys(hashes, min(k, len(found))))


def _multipliers(permutations: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(keys: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    """Band keys of a set: each band takes minima and maxima of ``rows / 2`` permutations."""
    low = np.full(len(multipliers), 2**64 - 1, np.uint64)
    high = np.zeros(len(multipliers), np.uint64)
    for i in range(0, len(keys), 4096):
        hashed = keys[i : i + 4096, None] * multipliers[None, :]
        np.minimum(low, hashed.min(axis=0), out=low)
        np.maximum(high, hashed.max(axis=0), out=high)
    values = np.concatenate([low.reshape(-1, rows // 2), high.reshape(-1, rows // 2)], axis=1)
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    for column in values.T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, fp1, fp2, bands)`` per document, written to the shared folder."""
    multipliers = _multipliers(PERMUTATIONS)

    def sign(batches):
        forget()
        for batch in batches:
            for first, run in chunks(batch):
                n, fp1, fp2, out = [], [], [], []
                for text in run:
                    keys = shingle_set(text, k)
                    n.append(len(keys))
                    fp1.append(int(_mix(keys).sum(dtype=np.uint64).view(np.int64)))
                    fp2.append(int(_mix(keys ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    out.append(bands(keys, multipliers, BAND_ROWS) if len(keys) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(run)), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()),
                        pa.array(fp2, pa.int64()), pa.array(out, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "fp1", "fp2", "bands"],
                )

    made = texts(documents).mapInArrow(tidy(sign), "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>")
    return stored(made, "signatures")


def _fits(a: str, b: str):
    """Sizes of two sets that can still be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def confirm(pairs: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough."""

    def check(batches):
        forget()
        last, keys = None, None
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                left = batch.column("text_a")[i].as_py()
                if left != last:
                    last, keys = left, shingle_set(left, k)
                other = shingle_set(batch.column("text_b")[i].as_py(), k)
                if len(keys) and len(other):
                    at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
                    common = int((keys[at] == other).sum())
                    keep[i] = 100 * common >= PERCENT * (len(keys) + len(other) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    right = bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(check), "a bigint, b bigint")


def _small_buckets(unsettled: DataFrame, checked: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """Links of small buckets: pairs between an outsider and a member of another component, each once."""
    small = unsettled.filter(F.col("size") <= SMALL_BUCKET)
    outsiders = small.filter(F.col("root") != F.col("main")).select(
        "key", F.col("doc_id").alias("o_id"), F.col("n").alias("o_n"), F.col("root").alias("o_root")
    )
    pairs = (
        small.join(outsiders, "key")
        .filter((F.col("root") != F.col("o_root")) & _fits("n", "o_n"))
        .select(F.least("doc_id", "o_id").alias("a"), F.greatest("doc_id", "o_id").alias("b"))
        .distinct()
        .join(checked, ["a", "b"], "left_anti")
    )
    return confirm(pairs, bodies, k)


def _large_buckets(unsettled: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """Links of large buckets: blocks of outsiders against blocks of members, one link per component found."""
    large = unsettled.filter(F.col("size") > SMALL_BUCKET)
    down, across = F.ceil(F.col("out") / BLOCK_OUTSIDERS), F.ceil(F.col("size") / BLOCK_MEMBERS)
    spot = F.xxhash64("doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    members = large.select("key", "doc_id", "root", F.pmod(spot, across).alias("col"), every(down).alias("row"), F.lit(False).alias("asks"))
    outsiders = large.filter(F.col("root") != F.col("main")).select(
        "key", "doc_id", "root", F.pmod(spot, down).alias("row"), every(across).alias("col"), F.lit(True).alias("asks")
    )
    cells = members.unionByName(outsiders).join(bodies, "doc_id")

    def compare(cell: pa.Table) -> pa.Table:
        ids, roots = cell.column("doc_id").to_numpy(), cell.column("root").to_numpy()
        asks = np.array(cell.column("asks").to_pylist(), bool)
        sets = [shingle_set(t, k) for t in cell.column("text").to_pylist()]
        data, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        a, b = [], []
        if len(data) and len(queries):
            sizes = np.array([len(sets[i]) for i in data])
            postings, owners = np.concatenate([sets[i] for i in data]), np.repeat(np.arange(len(data)), sizes)
            order = np.argsort(postings, kind="stable")
            postings, owners = postings[order], owners[order]
            for q in queries:
                first, last = np.searchsorted(postings, sets[q], "left"), np.searchsorted(postings, sets[q], "right")
                lengths = last - first
                at = np.arange(lengths.sum()) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)
                common = np.bincount(owners[at], minlength=len(data))
                linked = (100 * common >= PERCENT * (sizes + len(sets[q]) - common)) & (roots[data] != roots[q])
                _, one = np.unique(roots[data[linked]], return_index=True)
                partners = ids[data[linked]][one].tolist()
                a += [int(ids[q])] * len(partners)
                b += partners
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("key", "row", "col").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents``."""
    signed = signatures(documents, k)
    linked = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stored(linked.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = linked.join(classes.select("fp1", "fp2", F.col("rep").alias("doc_id")), ["fp1", "fp2", "doc_id"], "left_semi")
    members = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    shared_keys = members.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size"))
    buckets = stored(members.join(shared_keys.filter(F.col("size") > 1), "key").select("key", "doc_id", "n", "pivot"), "buckets")
    candidates = buckets.select("doc_id").distinct()
    bodies = stored(texts(documents).join(candidates, "doc_id", "left_semi"), "bodies", compression="zstd")

    # Texts of a repeated id: classes with the same representative id are joined by that id.
    sizes = buckets.select(F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n")).distinct()
    pairs = (
        buckets.filter(F.col("doc_id") != F.col("pivot"))
        .select("pivot", "doc_id", "n").distinct()
        .join(sizes, "pivot").filter(_fits("n", "pivot_n"))
        .select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    )
    checked = stored(pairs, "pairs")
    groups = components(confirm(checked, bodies, k))
    named = buckets.select("key", "doc_id", "n").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("key", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    mixed = (
        named.groupBy("key", "root").agg(F.count("*").alias("c"))
        .groupBy("key").agg(F.max(F.struct("c", (-F.col("root")).alias("root"))).alias("most"), F.sum("c").alias("size"))
        # In a bucket of two, the pivot has met the other already.
        .filter((F.col("most.c") < F.col("size")) & (F.col("size") > 2))
        .select("key", "size", (F.col("size") - F.col("most.c")).alias("out"), (-F.col("most.root")).alias("main"))
    )
    unsettled = stored(named.join(mixed, "key"), "unsettled")
    further = []
    if not unsettled.isEmpty():
        further += [_small_buckets(unsettled, checked, bodies, k), _large_buckets(unsettled, bodies, k)]
    # An id with several texts is one node: it links the classes of its texts.
    print_ = F.struct("fp1", "fp2")
    several = linked.groupBy("doc_id").agg(F.min(print_).alias("x"), F.max(print_).alias("y")).filter("x != y").select("doc_id")
    several = stored(several, "ids-of-several")
    if not several.isEmpty():
        of_ids = linked.join(several, "doc_id", "left_semi").join(classes, ["fp1", "fp2", "n"])
        further.append(of_ids.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a != b").distinct())
    # Without anything to link, no stage is planned for it.
    if further:
        edges = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
        groups = components(reduce(DataFrame.unionByName, further, edges))
    roots = (
        classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("fp1", "fp2", F.coalesce("root", "rep").alias("root"))
    )
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), "fp1", "fp2")
        .join(roots, ["fp1", "fp2"], "left")
        .select(
            "doc_id", "n_shingles",
            F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
            .otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one_of_each(documents: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``documents`` with one text of each group of near-duplicates, all columns as they are.

    Rows are dropped, not ids: where an id has several texts, each is a node of its own, so a text without
    near-duplicates stays whatever other rows its id has. Of rows that repeat an id and its text, one stays. Rows with a null
    id all stay.
    """
    columns = documents.columns
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(
        *[documents[c].alias(f"c{i}") for i, c in enumerate(columns)], documents["doc_id"].alias("id"), F.xxhash64(text).alias("seen")
    ).filter(F.col("id").isNotNull())
    # Narrow rows; usually no id is left here.
    repeated = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("seen").alias("a"), F.max("seen").alias("b")).filter("n > 1")
    repeated = stored(repeated.select(F.col("id").alias("of"), (F.col("a") != F.col("b")).alias("texts")), "repeated-ids")
    # Above the ids in use, so the smallest id of a group is still one of those that have one text.
    of_text = F.shiftrightunsigned(F.xxhash64("id", "seen", F.lit("a text of its own")), 2).bitwiseOR(F.lit(1 << 61))
    node = F.when(F.col("texts"), of_text).otherwise(F.col("id"))
    several = rows.join(repeated, F.col("id") == F.col("of")).withColumn("node", node).drop("of", "texts").dropDuplicates(["id", "seen"])
    marked = rows.join(repeated, F.col("id") == F.col("of"), "left_anti").withColumn("node", F.col("id")).unionByName(several)
    body = f"c{columns.index('text')}"
    groups = near_duplicates(marked.select(F.col("node").alias("doc_id"), F.col(body).alias("text")), k)
    others = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("other")).distinct()
    once = marked.join(others, F.col("node") == F.col("other"), "left_anti")
    shown = once.select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)
    return shown.unionAll(documents.filter(documents["doc_id"].isNull()))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


OP9_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM doc, unnest(range(1, greatest(2, len(w)))) AS r(i) WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION SELECT y, r FROM reach JOIN both_ways ON x = v
), root AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN root ON v = doc_id
"""

"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots (reference vectors from a bounded sample), nearest first. Each
pivot has an inverted list of the vectors it is near to. Two vectors are candidates if they share at least
``MIN_SHARED`` pivots; candidates are verified by cosine in double precision.

Equal vectors are one class. Long lists are cut into blocks by a hash of the class, and every task compares
two blocks of one list; a pair is counted in the list of its first shared pivot alone, and a task returns
counts per vector and a spanning forest, never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of
different lengths are never compared; lengths too rare to have pivots share one list. Rows that repeat a
``vec_id`` are one node. Rows with a null id are vectors others can link to, but name no component. Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.components import components
from loglake.llm.shared import stored, table

MIN_COSINE = 0.9
#: Nearest pivots that describe a vector, and how many of them candidates share.
PREFIX = 10
MIN_SHARED = 2
#: Pivots are a sample of the vectors: 4 times the root of their number, between these bounds.
PIVOTS_AT_LEAST = 64
PIVOTS_AT_MOST = 8192
#: Cosine from which a sampled vector is too close to a pivot to be one.
PIVOTS_APART = 0.7
#: Vectors of a list in one block.
BLOCK = 512


def _usable(vector) -> bool:
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return False
    v = np.asarray(vector, np.float64)
    return bool(np.isfinite(v).all() and v.any())


def _directions(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length one, or None if it cannot be linked."""
    out = []
    for value in column.to_pylist():
        if not _usable(value):
            out.append(None)
            continue
        v = np.asarray(value, np.float64)
        v = v / np.abs(v).max()
        out.append(v / np.sqrt((v * v).sum()))
    return out


def _cleaned(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, direction, key)``: unit vectors as bytes of doubles, and a key of equal vectors."""

    def clean(batches):
        for batch in batches:
            units = _directions(batch.column("embedding"))
            raw = pa.array([None if u is None else u.astype("<f8").tobytes() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw], ["vec_id", "direction"])

    return (
        embeddings.select("vec_id", "embedding")
        .mapInArrow(clean, "vec_id bigint, direction binary")
        .withColumn("key", F.when(F.col("direction").isNotNull(), F.sha2("direction", 256)))
    )


def _pivots(classes: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Pivots per vector length, from a bounded sample in the order of the key; and the number of vectors."""
    total = classes.count()
    wanted = int(min(PIVOTS_AT_MOST, max(PIVOTS_AT_LEAST, 4 * total**0.5)))
    sample = classes.select("key", "direction").orderBy("key").limit(wanted).collect()
    by_length: dict[int, list] = {}
    for row in sample:
        v = np.frombuffer(row["direction"], "<f8")
        by_length.setdefault(len(v), []).append(v)
    chosen = {n: _apart(np.array(vs)) for n, vs in by_length.items()}
    return {n: vs for n, vs in chosen.items() if len(vs) > PREFIX}, total


def _apart(vectors: np.ndarray) -> np.ndarray:
    """Those vectors that are not close to one kept before: a dense group must not own many pivots, or the
    order of its nearly equal distances would be chance."""
    kept: list[int] = []
    blocked = np.zeros(len(vectors), bool)
    for i in range(len(vectors)):
        if not blocked[i]:
            kept.append(i)
            blocked |= vectors @ vectors[i] >= PIVOTS_APART
    return vectors[kept]


def _described(classes: DataFrame, pivots) -> DataFrame:
    """Add ``prefix``: the nearest pivots, nearest first; a list of its own for lengths without pivots."""

    def describe(batches):
        known, ranks = pivots.value, {}
        first = 0
        for n in sorted(known):
            ranks[n], first = first, first + len(known[n])
        for batch in batches:
            units = [np.frombuffer(x, "<f8") for x in batch.column("direction").to_pylist()]
            prefix: list = [None] * len(units)
            lengths = np.array([len(u) for u in units])
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                if n not in known:
                    for r in rows:
                        prefix[r] = [-int(n)]
                    continue
                near = np.array([units[r] for r in rows]) @ known[n].T
                top = np.argsort(-near, axis=1, kind="stable")[:, :PREFIX] + ranks[n]
                for r, t in zip(rows, top.tolist(), strict=True):
                    prefix[r] = t
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prefix, pa.list_(pa.int32()))], [*batch.schema.names, "prefix"]
            )

    schema = "key string, rep bigint, copies bigint, direction binary, prefix array<int>"
    return classes.select("key", "rep", "copies", "direction").mapInArrow(describe, schema)


def _compared(frame, min_cosine: float):
    """One list's pair of blocks: rows (key, rep, root, links) for its vectors that have links."""
    import pandas as pd

    pivot, left_block, right_block = (int(frame[c].iloc[0]) for c in ("pivot", "low", "high"))
    mine = frame["block"].to_numpy()
    vectors = np.array([np.frombuffer(x, "<f8") for x in frame["direction"]])
    prefixes = [np.asarray(p) for p in frame["prefix"]]
    copies, n = frame["copies"].to_numpy(), len(frame)
    names, columns = np.unique(np.concatenate(prefixes), return_inverse=True)
    hot = np.zeros((n, len(names)), np.float32)
    hot[np.repeat(np.arange(n), [len(p) for p in prefixes]), columns] = 1
    a = np.flatnonzero(mine == left_block)
    b = np.flatnonzero(mine == right_block)
    if not len(a) or not len(b):
        return pd.DataFrame({"key": [], "root": [], "links": []})
    needed = np.minimum(MIN_SHARED, np.minimum.outer(hot[a].sum(1), hot[b].sum(1)))
    earlier = names < pivot
    candidate = (hot[a] @ hot[b].T >= needed) & (hot[a][:, earlier] @ hot[b][:, earlier].T == 0)
    linked = candidate & (vectors[a] @ vectors[b].T >= min_cosine)
    if left_block == right_block:
        np.fill_diagonal(linked, False)
    links = np.zeros(n, np.int64)
    links[a] += linked @ copies[b]
    if left_block != right_block:
        links[b] += linked.T @ copies[a]
    # Local components: every vector's label becomes its smallest neighbour's until nothing changes.
    label = np.arange(n)
    while True:
        new = label.copy()
        best = np.where(linked, label[b][None, :], n).min(axis=1, initial=n)
        new[a] = np.minimum(new[a], best)
        best = np.where(linked, label[a][:, None], n).min(axis=0, initial=n)
        new[b] = np.minimum(new[b], best)
        if (new == label).all():
            break
        label = new[new]
    some = np.flatnonzero(links)
    keys = frame["key"].to_numpy()
    return pd.DataFrame({"key": keys[some], "root": keys[label[some]], "links": links[some]})


def link_vectors(embeddings: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings``."""
    context = embeddings.sparkSession.sparkContext
    cleaned = stored(_cleaned(embeddings), "vectors")
    usable = cleaned.filter(F.col("key").isNotNull())
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("direction").alias("direction"))
    classes = stored(classes, "vector-classes")
    pivots, _ = _pivots(classes)
    described = _described(classes, context.broadcast(pivots))
    entries = stored(described.select("*", F.explode("prefix").alias("pivot")), "pivot-lists")
    # One row per pivot; at most PIVOTS_AT_MOST and the rare lengths.
    sizes = entries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = entries.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")).select(
        "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key",
        "copies", "direction", "prefix",
    )
    found = stored(
        met.groupBy("pivot", "low", "high").applyInPandas(
            lambda frame: _compared(frame, min_cosine), "key string, root string, links bigint"
        ),
        "vector-links",
    )
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    names = classes.select("key", "rep")
    edges = (
        found.filter(F.col("key") != F.col("root")).select("key", "root").distinct()
        .join(names.select("key", F.col("rep").alias("a")), "key")
        .join(names.select(F.col("key").alias("root"), F.col("rep").alias("b")), "root")
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select("a", "b")
    )
    groups = components(edges)
    per_class = (
        classes.select("key", "rep", "copies").join(links, "key", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    return (
        cleaned.select("vec_id", "key").join(per_class, "key", "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("root", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all ``embeddings``."""
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), degree AS (SELECT x, count(*) AS n FROM link GROUP BY x
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM v UNION SELECT y, r FROM reach JOIN link ON x = v
), root AS (SELECT v AS id, min(r) AS component_id FROM reach GROUP BY v)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN root ON id = vec_id LEFT JOIN degree ON x = vec_id
"""

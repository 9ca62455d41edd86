"""Token counts by rank-synchronous array merging, and packing by global prefix sums.

Null texts are empty: no tokens (packing adds the document's end id). Repeated rows are counted and packed each on
its own. Empty tables give empty results. Columns other than ``doc_id`` and ``text`` are not read. Very long
texts are split into bounded lists of pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglake.llm.bpe import encoder, forget, vocabulary_size
from loglake.llm.shared import stored, table, texts, tidy

COUNT_LIMIT = 2048
SEQUENCE_TOKENS = 1024
END_ID = 0
#: Texts encoded together, in characters.
CHUNK_CHARS = 2_000_000
#: Partitions whose 16-byte offsets may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_PARTITIONS = 500_000


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(batch: pa.RecordBatch, column: str | int = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in runs of bounded size, with the row each run starts at."""
    run, first, size = [], 0, 0
    values = batch.column(column)
    for i in range(len(values)):
        text = values[i].as_py() or ""
        run.append(text)
        size += len(text)
        if size >= limit:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def count_tokens(documents: DataFrame, path: str, limit: int = COUNT_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every document, in one pass without a shuffle."""

    def count(batches):
        known = encoder(path)
        for batch in batches:
            for first, run in chunks(batch):
                tokens = pa.array(known.count(run), pa.int64())
                n_bytes = pa.array([len(t.encode()) for t in run], pa.int64())
                over = pa.array(np.asarray(tokens) > limit, pa.bool_())
                ids = batch.column("doc_id").slice(first, len(run))
                yield pa.RecordBatch.from_arrays([ids, n_bytes, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(documents).mapInArrow(tidy(count), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def encoded(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """First pass, written to the shared folder: ``(part, before, doc_id, ids, n)``.

    ``before`` counts the tokens that precede the document in its partition. Ids below 65536 take two bytes.
    """

    def encode(batches):
        from pyspark import TaskContext

        part, before, known = TaskContext.get().partitionId(), 0, encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, run in chunks(batch):
                rows = [raw + end for raw in known.encode(run)]
                n = np.array([len(r) // 4 for r in rows], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                narrow = pa.array([np.frombuffer(r, "<u4").astype("<u2").tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), part, np.int64)), pa.array(starts),
                        batch.column("doc_id").slice(first, len(run)), narrow, pa.array(n),
                    ],
                    ["part", "before", "doc_id", "ids", "n"],
                )

    if vocabulary_size(path) > 65536 or end_id > 65535:
        raise ValueError("ids of this vocabulary do not fit two bytes")
    made = texts(documents).mapInArrow(tidy(encode), "part bigint, before bigint, doc_id bigint, ids binary, n bigint")
    return stored(made, "pack-ids", compression="zstd")


def pack(documents: DataFrame, path: str, window: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Concatenate and cut: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` per piece.

    Totals of the partitions are summed up to each partition's global offset; with that every document knows
    its place in the concatenation, and windows are cut without moving a token. ``ids`` are little-endian
    unsigned 32-bit integers. Documents that cross a window's end give a piece on either side.
    """
    docs = encoded(documents, path, end_id)
    totals = docs.groupBy(F.col("part").alias("of")).agg(F.sum("n").alias("total"))
    # One row per partition of the scan, so this window stays small.
    running = W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(totals.select("of", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("base")), "pack-offsets")
    if offsets.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = docs.join(offsets, docs["part"] == offsets["of"]).select(
        "doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("at")
    )

    def cut(batches):
        # All documents are encoded by now; the encoder takes more memory than all that follows.
        forget()
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            size = 0
            columns = [batch.column(c) for c in ("doc_id", "ids", "n", "at")]
            for i in range(batch.num_rows):
                doc, raw, n, at = (c[i].as_py() for c in columns)
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = wide[start : start + length].tobytes()
                    for k, v in zip(rows, (doc, start, length, piece, n, sequence, offset), strict=True):
                        rows[k].append(v)
                    start += length
                    size += len(piece)
                if size > 8_000_000:
                    yield _pieces(rows)
                    rows, size = {k: [] for k in rows}, 0
            yield _pieces(rows)

    def _pieces(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], list(rows)
        )

    return placed.mapInArrow(
        tidy(cut),
        "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def sequences(pieces: DataFrame, window: int = SEQUENCE_TOKENS, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, length, ids)``: whole sequences, padded to the window; the last one to a power of two."""
    joined = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    grouped = (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
        .withColumn("hex", joined)
    )
    padded = F.least(F.lit(window), F.pow(F.lit(2), F.ceil(F.log2("length"))).cast("int"))
    pad = F.hex(F.unhex(F.lit(np.array([pad_id], "<u4").tobytes().hex())))
    return grouped.select(
        "sequence_id", "length",
        F.unhex(F.concat("hex", F.repeat(pad, (padded - F.col("length")).cast("int")))).alias("ids"),
    )


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids' checksum instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document."""
    return pieces_digest(pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))

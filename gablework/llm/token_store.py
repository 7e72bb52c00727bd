"""Token ids of documents as a binary store: adaptive range-coded segments in ascending id order.

Documents are range-partitioned and sorted by id, encoded, and gathered into segments of whole documents. A row of the
store is a segment: part (the place of its partition in the order), seq (its place in the part), n_ids, the ids and
lengths of its documents, and the packed ids (range_codec). Spark's own writer commits the rows, so a lost executor's
segments are written again and none twice. Reading needs nothing but the store; where a document starts comes from
running sums of n_ids by part and by segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gablework.llm.bpe import codec
from gablework.llm.common import batches, column_of, scratch_path, small_batches, text_batches, texts_of
from gablework.llm.range_codec import pack, unpack

#: Ids after which a segment is closed.
SEGMENT_IDS = 4_000_000
#: Pieces of text that wait to be looked up together, four bytes each.
WAITING_PIECES = 1_000_000
STORE_SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, packed binary"


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each text's followed by end_id, in ascending order of the id column (nulls first; equal ids by a hash of the text).

    A null text counts as empty: its end id alone. An empty table makes a store of no segments.
    """

    def segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = codec(tokenizer), TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, seq = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, ids, held, seq
            columns = [pa.array([part], type=pa.int32()), pa.array([seq], type=pa.int32()), pa.array([held], type=pa.int64()), pa.array([doc_ids], type=pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], type=pa.list_(pa.int64())), pa.array([pack(np.concatenate(ids))], type=pa.binary())]
            doc_ids, lengths, ids, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_ids", "doc_ids", "lengths", "packed"])

        def encoded(waiting: list) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for (own, _), (flat, counts) in zip(waiting, bpe.encode_cut([x for _, x in waiting]), strict=True):
                flat, counts = np.insert(flat, np.cumsum(counts), end_id), counts + 1
                while len(counts):
                    n = int(np.searchsorted(held + np.cumsum(counts), SEGMENT_IDS)) + 1
                    size = int(counts[:n].sum())
                    doc_ids.extend(own[:n])
                    lengths.append(counts[:n])
                    ids.append(flat[:size])
                    held += size
                    own, counts, flat = own[n:], counts[n:], flat[size:]
                    if held >= SEGMENT_IDS:
                        yield closed()

        waiting, size = [], 0
        for batch in text_batches(rows):
            pieces = bpe.cut(texts_of(batch))
            waiting.append((column_of(batch, "doc_id").to_pylist(), pieces))
            size += len(pieces[0])
            if size >= WAITING_PIECES:
                yield from encoded(waiting)
                waiting, size = [], 0
        if waiting:
            yield from encoded(waiting)
        if doc_ids:
            yield closed()

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(segments, STORE_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the store alone: where a document's ids start, how many they are with the end id, and their CRC-32 as little-endian unsigned 32-bit integers. A damaged block is an error."""

    def opened(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for part, seq, doc_ids, lengths, packed in zip(*(column_of(batch, c).to_pylist() for c in ("part", "seq", "doc_ids", "lengths", "packed")), strict=True):
                plain = unpack(packed).tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(plain[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                count = len(doc_ids)
                columns = [pa.array(np.full(count, part, dtype=np.int32)), pa.array(np.full(count, seq, dtype=np.int32)), pa.array(doc_ids, type=pa.int64()), pa.array(ends - lengths, type=pa.int64()), pa.array(lengths, type=pa.int64()), pa.array(crcs, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    docs = store.mapInArrow(opened, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = store.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("n", Window.orderBy("part")).alias("part_start"))
    offsets = sizes.withColumn("seq_start", before("n_ids", Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("offset"))
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, seq, doc_id, ids array<int>): the documents' ids with their end ids, as trainers read them."""

    def opened(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for part, seq, doc_ids, lengths, packed in zip(*(column_of(batch, c).to_pylist() for c in ("part", "seq", "doc_ids", "lengths", "packed")), strict=True):
                ids = unpack(packed).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), type=pa.int32()), pa.array(ids))
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, type=pa.int32()), pa.array([seq] * n, type=pa.int32()), pa.array(doc_ids, type=pa.int64()), lists], names=["part", "seq", "doc_id", "ids"])

    return spark.read.schema(STORE_SCHEMA).parquet(path).mapInArrow(opened, "part int, seq int, doc_id long, ids array<int>")


def stored_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the store into the shared folder and reads the documents' rows back from it."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)

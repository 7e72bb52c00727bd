"""Bounded samples of labelled documents for the trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import small_batches, written

_PARTS = 1_000_000


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, by the modulus; of a null id: null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """Rows (doc_id, text, y) of the documents whose label is 0 or 1 and usable, as a table: bound at most, picked by a hash of the id.

    The label with fewer rows gets half of the bound if it has as many. The picked ids are broadcast: they number bound
    at most whatever the size of the tables. An id with several documents gives one row, of the least text; one with
    both labels a row for each.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = min(bound // 2, min(counts.get(0, 0), counts.get(1, 0)))
    share = {y: min(1.0, (few if counts.get(y, 0) <= counts.get(1 - y, 0) else bound - few) / max(1, counts.get(y, 0))) for y in (0, 1)}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS))
    picked = rows.withColumn("part", part).where(F.col("part") < F.when(F.col("y") == 1, int(share[1] * _PARTS)).otherwise(int(share[0] * _PARTS)))
    picked = picked.distinct().orderBy("part", "doc_id", "y").limit(bound).select("doc_id", "y")
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), f"sample-{label}")

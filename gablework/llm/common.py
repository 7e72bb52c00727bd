"""Helpers that the corpus operators share: word rules, Arrow batches, joins with small sides; and the library's scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.scratch import scratch_path, written

__all__ = ["column_of", "batches", "scratch_path", "sized", "small_batches", "text_batches", "text_of", "texts_of", "written"]

#: White space that parts words: the space and U+0009 to U+000D; bytes.split() of UTF-8 parts at the same six.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


#: Bytes of an Arrow batch that Spark hands to Python, at most, and the setting that says so.
ARROW_BYTES = 4 << 20
_ARROW, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are a few MB: Spark's own bound of 64 MB stands several times over in an executor and its workers. A session that has set another bound keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_ARROW, _SPARKS_OWN) == _SPARKS_OWN:
        conf.set(_ARROW, str(ARROW_BYTES))
    return df


#: Rows of a table that is broadcast, at most; beyond, it is joined by shuffles.
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame) -> DataFrame:
    """A written table of ids as the small side of a join: broadcast if a count shows that it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in column_of(batch, name).to_pylist()]


#: Texts that a worker holds as Python strings at once, besides the Arrow batch that they came in.
TEXT_ROWS = 512


def text_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for start in range(0, batch.num_rows, TEXT_ROWS):
            yield batch.slice(start, TEXT_ROWS)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if batch.num_rows:
            yield batch

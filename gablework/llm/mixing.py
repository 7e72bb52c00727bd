"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Each source has a token target (shares of the budget by weight, filled up to a cap) and a weight schedule over the
training time t in 0..1. The schedule's integral is the source's cumulative demand; a document's place in its source's
token stream, inverted through that demand, is its training position. Positions of all sources are on one axis, so a
range sort by position interleaves them as the schedules ask.

A source's stream is its documents in the order of an MD5 of their ids and texts (so rows of one id, or of none, don't
share a bucket), repeated until the target is met to the word: whole passes first, then a part of one more, whose last
document is cut at a word. Running sums come from sums by (source, hash bucket), so no task holds a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gablework.llm.common import WORD_PATTERN, text_of, written


@dataclass(frozen=True)
class Mix:
    """weights: of the sources by code point (null last), repeating. budget: of all words. cap: times its size that a source is taken at most. slopes: a source's weight schedule is 1 + slope * (2 t - 1), repeating like the weights. bucket_rows: documents of a source that one window task sums, about. broadcast_sources: above so many sources their table is joined, not broadcast."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    cap: int = 2
    slopes: tuple[float, ...] = (0.5, -0.5, 0.0)
    bucket_rows: int = 4000
    broadcast_sources: int = 10_000


def words_of(column: Column) -> Column:
    """The number of words; of null: 0."""
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _cycled(values: tuple, rank: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(rank, F.lit(len(values))).cast("int"))


def with_running(rows: DataFrame, order: tuple[str, ...], sums: dict[str, str], name: str) -> DataFrame:
    """rows with the sum of each column over all rows before, in an order without ties: {column: name of its sum}.

    Rows are dealt by ranges of the order and summed within them; the ranges' own sums, as many as there are
    partitions, are what one task adds up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("piece", F.spark_partition_id()), name)
    totals = dealt.groupBy("piece").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("piece", *[before(f"all_{c}", Window.orderBy("piece")).alias(f"start_{c}") for c in sums])
    within = Window.partitionBy("piece").orderBy(*order)
    dealt = dealt.join(F.broadcast(starts), "piece").select(*rows.columns, *[(F.col(f"start_{c}") + before(c, within)).alias(out) for c, out in sums.items()])
    return dealt


def source_targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rows (source, rank, source_size, earlier, target, slope), one for each source of rows (source, size). earlier: words of the sources before.

    The caps are filled in the order of cap over weight: of all levels (budget left) / (weight left), the highest is
    the one at which no source is above its cap. A source of no words has target 0. However many sources there are, no
    task holds them all.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    named = with_running(totals, ("none", "source"), {"one": "rank", "source_size": "earlier"}, "named")
    named = named.withColumn("weight", _cycled(mix.weights, F.col("rank"), "double")).withColumn("slope", _cycled(mix.slopes, F.col("rank"), "double"))
    named = named.withColumn("most", (mix.cap * F.col("source_size")).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    filled = written(with_running(named, ("ratio", "rank"), {"most": "used", "weight": "used_weight"}, "rated"), "filled")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (mix.budget * F.lit(whole["size"]).cast("long") - F.col("used")) / (F.lit(whole["weight"]).cast("double") - F.col("used_weight"))
    highest = F.lit(filled.agg(F.max(level).alias("level")).first()["level"]).cast("double")
    target = F.when(F.col("ratio") <= highest, F.col("most")).otherwise(highest * F.col("weight"))
    return filled.select("source", "rank", "source_size", "earlier", target.alias("target"), "slope")


def _demand_inverse(share: Column, slope: Column) -> Column:
    """The t at which the integral of 1 + slope * (2 t - 1) from 0 reaches the share."""
    flat = 1 - slope
    root = (F.sqrt(flat * flat + 4 * slope * share) - flat) / (2 * slope)
    return F.when(slope == 0, share).otherwise(root)


def curriculum(docs: DataFrame, mix: Mix = Mix(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, position), then the carried columns of docs; one for each row.

    taken: words that the mix takes, repeats counted. position: where in training the document first comes, 0 to 1;
    null if it isn't taken. Rows of null ids or texts take part (a null text has 0 words); a null source is a source,
    the last. Rows that repeat an id are rows of their own. An empty table gives no rows.
    Carried columns come under the names they have in docs, prefixed by "in_".
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()).cast("binary"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_of(F.col("text")).alias("size"), key.alias("key"), *[F.col(c).alias(f"in_{c}") for c in carry])
    narrow = written(sized.select("doc_id", "source", "size", "key"), "sized")  # targets and offsets come from it, so texts are read once more at most
    sized = sized if carry else narrow
    sources = written(source_targets(narrow, mix), "sources")
    few = sources.count() <= mix.broadcast_sources
    sources = F.broadcast(sources) if few else sources.hint("merge")
    rows, digits = narrow.count(), 2
    while rows > mix.bucket_rows * 16**digits:
        digits += 1
    ranked = lambda t: t.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source").withColumn("bucket", F.substring("key", 1, digits))
    sized = ranked(sized)
    sums = ranked(narrow).groupBy("rank", "bucket").agg(F.sum("size").alias("sum"))
    offsets = written(with_running(sums, ("rank", "bucket"), {"sum": "before"}, "sums").select("rank", "bucket", "before"), "offsets")
    ordered = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size")
    within = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = sized.withColumn("within", within).join(offsets, ["rank", "bucket"]).withColumn("start", F.col("before") - F.col("earlier") + F.col("within"))
    demand = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(0).cast("long")
    rest = demand - passes * F.col("source_size")
    placed = placed.withColumn("demand", demand).withColumn("passes", passes).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))))
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + F.col("more"))
    position = F.when(F.col("taken") > 0, _demand_inverse(F.col("start") / F.col("demand"), F.col("slope")))
    return placed.withColumn("position", position)


def taken_by_document(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The curriculum's decisions, in training order; documents that it doesn't take come last."""
    placed = curriculum(docs, mix)
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as training takes them, in that order and with the columns of docs: each as often as it is taken.

    Documents of no words come once, at their place in the stream. The one document of a source at which the target is
    met is cut after the word that meets it (n_chars, if there is one, follows); all others are whole.
    """
    names = docs.columns
    placed = curriculum(docs, mix, tuple(names))
    whole = F.when(F.col("size") == 0, 1).otherwise(F.col("passes")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), whole), lambda i: F.struct(i.alias("n"), F.when(i < whole, F.col("size")).otherwise(F.col("more")).alias("words")))
    parts = F.filter(parts, lambda p: (p["words"] > 0) | ((F.col("size") == 0) & (p["n"] == 0)))
    rows = placed.withColumn("part", F.explode(parts))
    share = F.when(F.col("demand") > 0, (F.col("part.n") * F.col("source_size") + F.col("start")) / F.col("demand")).otherwise(F.lit(0.0))
    rows = rows.withColumn("at", _demand_inverse(share, F.col("slope")))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("in_text"), F.lit(rf"[\x20\x09-\x0D]*{WORD_PATTERN}"), F.lit(0)), 1, F.col("part.words").cast("int")), "")
    is_cut = F.col("part.words") < F.col("size")
    out = {c: F.col(f"in_{c}") for c in names} | {"text": F.when(is_cut, cut).otherwise(F.col("in_text"))}
    kinds = dict(docs.dtypes)
    if "n_chars" in names:
        out["n_chars"] = F.when(is_cut, F.length(cut)).otherwise(F.col("in_n_chars")).cast(kinds["n_chars"])
    return rows.orderBy("at", "key", "part.n").select(*[out[c].alias(c) for c in names])


#: The same mix in DuckDB SQL over documents.
MIX_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
named as (select *, row_number() over (order by source is null, source) - 1 as rank from totals),
weighed as (select *, ([3.0e0, 1.0e0, 2.0e0])[(rank % 3 + 1)::int] as weight, ([0.5e0, -0.5e0, 0.0e0])[(rank % 3 + 1)::int] as slope,
  (2 * source_size)::double as most from named),
rated as (select *, most / weight as ratio from weighed),
levels as (select *, (1.5e0 * (sum(source_size) over ())::double
    - coalesce(sum(most) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0.0e0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0.0e0)) as level0
  from rated),
targets as (select source, source_size, slope, case when ratio <= max(level0) over () then most else max(level0) over () * weight end as target from levels),
placed as (select doc_id, size, t.source_size, t.target, t.slope, floor(t.target + 0.5e0)::bigint as demand,
  (sum(size) over (partition by t.source order by key, doc_id, size rows between unbounded preceding and current row))::bigint - size as start
  from sized s join targets t on s.source is not distinct from t.source),
counted as (select *, case when source_size > 0 then demand // source_size else 0 end as passes from placed),
decided as (select *, passes * size + greatest(0, least(size, demand - passes * source_size - start)) as taken from counted)
select doc_id, size, source_size, target, taken::bigint as taken,
  case when taken > 0 then case when slope = 0 then start / demand
    else (sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / demand)) - (1 - slope)) / (2 * slope) end end as position
from decided
"""

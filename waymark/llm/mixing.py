"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, here from its weight at the start to the flat weight at the
end; the integral of the schedule, scaled to the source's target, is the source's cumulative demand for words. A
source's documents, in the order of a hash, supply that demand one after the other (twice where the target asks for
it); inverting the demand at a document's middle gives its training position, and rows are range-sorted by position.
Each pass has positions of its own: pass k begins where k times the source's words have been used.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; none is above
twice its source's words, and what is above goes to the others by weight (water filling, one row for each source).

Prefix sums are taken in two levels, over (source, bucket of the hash) and over the buckets' sums, so that a source
with a third of all rows is spread over 4096 groups. Text is read once, to measure it.

Defined cases: a null or empty text has size 0 and takes 0; repeated rows are each of their own (those of one key and
one text share a bucket); a null source is a source of its own; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
SHARE, MOST_REPEATS = 1.5, 2
#: Hexadecimal digits of the hash that name a bucket: the rows of one source are spread over 16 to this power.
BUCKET_DIGITS = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """source, source_size, weight, target: one row for each source, by water filling.

    A source is full exactly if level x weight reaches its bound, so in the order of bound / weight the full ones come
    first; the level is what is left for the others over their weights.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    each = sizes.groupBy(source).agg(F.sum("size").alias("source_size")).withColumn("_weight", weight).withColumn("_most", MOST_REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("_most") / F.col("_weight"), F.col(source).asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(before), F.lit(0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    )
    each = each.withColumn("_level", level)
    # the first source that its level does not fill sets the level of all after it
    each = each.withColumn("_open", F.min(F.when(F.col("_level") * F.col("_weight") < F.col("_most"), F.struct(F.col("_most") / F.col("_weight"), "_level"))).over(every)["_level"])
    target = F.when(F.col("_open").isNull(), F.col("_most")).otherwise(F.least(F.col("_most").cast("double"), F.col("_open") * F.col("_weight")))
    return each.select(source, "source_size", F.col("_weight").alias("weight"), target.cast("double").alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, taken, copies, position, positions, sorted by position."""
    return plan_rows(df, key, text, source).orderBy("position", key)


def plan_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, taken, copies, position, positions of every row, in any order.

    taken sums to the source's target, to a word: whole passes first, then the documents at the head of the order once
    more, the last of them in part. copies is the same in whole documents; positions has one for each copy, position is
    the first use's, also where there is none.
    """
    mark = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    narrow = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(text).alias("size"), mark.alias("_hash"))
    narrow = written(narrow.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS)), "mix")
    plan = targets(narrow, "_source")
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over_buckets = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over_buckets), F.lit(0)))
    # one row for each source and bucket, with the source's plan
    sums = sums.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    sums = sums.withColumnsRenamed({"_source": "_s", "_bucket": "_b"})
    rows = narrow.withColumn("_in", F.sum("size").over(in_bucket) - F.col("size"))
    rows = rows.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    start = F.col("_before") + F.col("_in")
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.round(F.col("target")).cast("long") - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    rows = rows.withColumn("taken", F.least(taken, MOST_REPEATS * F.col("size")).cast("long"))
    again = (start + F.col("size") / 2 <= rest) & (rest > 0)
    rows = rows.withColumn("copies", F.least(passes + again.cast("long"), F.lit(MOST_REPEATS)).cast("long"))
    at = [
        training_time(F.least(F.lit(1.0), (k * F.col("source_size") + start + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))), F.col("weight"))
        for k in range(MOST_REPEATS)
    ]
    rows = rows.withColumn("position", at[0]).withColumn("positions", F.slice(F.array(*at), F.lit(1), F.col("copies").cast("int")))
    return rows.select(F.col("_key").alias(key), "size", "source_size", "target", "taken", "copies", "position", "positions")


def training_time(share: Column, weight: Column) -> Column:
    """The time at which a source has had `share` of its words, by inverting the integral of its schedule.

    The schedule runs in a line from w to the mean weight m: its integral w t + (m - w) t^2 / 2, over its value at 1, is
    the cumulative share.
    """
    w, m = weight.cast("double"), F.lit(sum(WEIGHTS) / len(WEIGHTS))
    a, c = (m - w) / 2, share * (w + m) / 2
    root = (F.sqrt(F.greatest(F.lit(0.0), w * w + 4 * a * c)) - w) / (2 * a)
    return F.when(F.abs(a) < 1e-9, share).otherwise(root)


#: DuckDB SQL for the rows of queries.op6_mixing.
SQL = """
with narrow as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
        md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as mark
    from documents
), sized as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nth from narrow group by source
), weighed as (
    select *, case (nth - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from sized
), levels as (
    select *, 2 * source_size / weight as fills,
        (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
    from weighed
    window before as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), opened as (
    select *, (select arg_min(level, fills) from levels where level * weight < 2 * source_size) as open_level from levels
), plan as (
    select source, source_size, weight,
        (case when open_level is null then 2 * source_size else least(2 * source_size, open_level * weight) end)::double as target
    from opened
), placed as (
    select n.doc_id, n.size, p.source_size, p.weight, p.target,
        sum(n.size) over (partition by n.source order by n.mark rows between unbounded preceding and current row) - n.size as start,
        floor(p.target / greatest(p.source_size, 1)) as passes
    from narrow n join plan p on n.source is not distinct from p.source
), rest as (
    select *, round(target) - passes * source_size as rest from placed
), used as (
    select *, least(passes * size + greatest(0, least(size, rest - start)), 2 * size)::bigint as taken,
        least(passes + case when start + size / 2 <= rest and rest > 0 then 1 else 0 end, 2)::bigint as copies,
        least(1.0, (start + size / 2) / greatest(target, 1.0))::double as share_1,
        least(1.0, (source_size + start + size / 2) / greatest(target, 1.0))::double as share_2,
        weight::double as w, 8.0::double / 3 as m
    from rest
), timed as (
    select *,
        case when abs((m - w) / 2) < 1e-9 then share_1 else (sqrt(greatest(0, w * w + (m - w) * share_1 * (w + m))) - w) / (m - w) end as t_1,
        case when abs((m - w) / 2) < 1e-9 then share_2 else (sqrt(greatest(0, w * w + (m - w) * share_2 * (w + m))) - w) / (m - w) end as t_2
    from used
)
select doc_id, size::bigint as size, source_size, target, taken, copies, round(t_1, 9) as position,
    case when copies > 1 then round(t_2, 9) end as position_again
from timed
"""

"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import passing, written  # noqa: F401  (the operators take them from here)

#: Bytes of text that one step inside a task handles together.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_side(df: DataFrame, most: int = 1 << 17) -> DataFrame:
    """A written table of narrow rows as one side of a join: broadcast if it has at most `most` rows, else shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def numbered_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_own, which tells rows apart (key, hash of the text, number), _text, and _row, the other columns; written down."""
    own = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    others = F.struct(F.lit(0).alias("_"), *[df[_quoted(c)].alias(f"c{i}") for i, c in enumerate(df.columns) if c != text])
    return written(df.select(own.alias("_own"), F.col(text).alias("_text"), others.alias("_row")), "numbered")


def plain_rows(numbered: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The rows that numbered_rows was given, with the same columns."""
    return numbered.select(*[(F.col("_text") if c == text else F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(columns)])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def joined_by_hot_key(rows: DataFrame, named: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of named (one row for each key, `count` of them in rows) but its count.

    A key with a thousandth of all rows or more would fill one task of a shuffle: there are at most 1000 such keys, so
    they are broadcast. The other keys are shuffled.
    """
    hot = F.col(count) * 1000 >= total
    often = F.broadcast(named.where(hot).drop(count))  # at most 1000 rows
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(named.where(~hot).drop(count), key))


#: Bytes of an Arrow batch. Spark's own bound is 64 MB, held by the executor and by the worker several times each.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send texts to Python in batches of BATCH_BYTES, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":  # Spark's own
        spark.conf.set(name, f"{BATCH_BYTES}b")


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes; a longer row makes a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame,
    function: Callable[[list[bytes]], list[tuple]],
    fields: str,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply function to the UTF-8 bytes of texts (null: empty), in bounded chunks inside tasks.

    Gives key, the `keep` columns and the tuples that function returns, named by the DDL string `fields`. done is called
    at the end of each partition.
    """
    bound_batches(df.sparkSession)
    names = [key, *keep]
    source = df.select(*names, F.col(text).cast("binary").alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(names)])
    out_schema = f"{head}, {fields}"
    arrow = _arrow_schema(df.sparkSession, out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(len(names))
            for lo, hi in chunks(_lengths(data)):
                rows = function([t or b"" for t in data.slice(lo, hi - lo).to_pylist()])
                made = list(zip(*rows, strict=True)) or [[] for _ in range(len(arrow) - len(names))]
                columns = [batch.column(i).slice(lo, hi - lo).cast(arrow.field(i).type) for i in range(len(names))]
                columns += [pa.array(c, arrow.field(len(names) + i).type) for i, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        if done:
            done()
        _released()

    return source.mapInArrow(run, out_schema)


def filter_texts(df: DataFrame, function: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of df, unchanged, for which function keeps the text (null: empty); in bounded chunks inside tasks."""
    bound_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(at).cast(pa.binary())
            keep: list[bool] = []
            for lo, hi in chunks(_lengths(data)):
                keep += function([t or b"" for t in data.slice(lo, hi - lo).to_pylist()])
            yield batch.filter(pa.array(keep, pa.bool_()))
        _released()

    return df.mapInArrow(run, df.schema)


def _released() -> None:
    """Give what Arrow's allocator holds back to the system: a worker goes on to other partitions and stages."""
    pa.default_memory_pool().release_unused()


def _lengths(data: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(data), 0).to_pylist()


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))

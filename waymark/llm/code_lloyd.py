"""Compressing vectors to codes: product quantisation whose codebooks are fitted by Lloyd rounds maintained by deltas.

Vectors become integers and are cut into equal parts. Each part position has a codebook. A round assigns every part to
the nearest entry and then moves each entry to the floor of its parts' mean. The assignments of a round are written
beside the vectors, and the entries' sums and counts are kept as integers: a round reads the last assignments and
shuffles plus and minus contributions of those parts only whose assignment has changed, summed inside each task before
(at most parts x entries rows leave a task). Sums of integers do not depend on their order, so reruns agree to the bit.

Only codebooks (parts x entries vectors) and their sums pass the driver; both are of fixed size.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped; of vectors of different
lengths those of the length of the smallest vec_id's are kept; a length that the number of parts does not divide raises
an error, and so does a component of 2**19 or more, whose squares would not fit long; rows with equal vec_id are
rows of their own (the first entries then go by vec_id and vector); fewer rows than entries give as many entries as
rows; an empty table gives no rows; a null vec_id comes last for the first entries; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_hot_key, passing, small_side, written

SCALE, MOST = 256, 2**19
#: Rows that one step inside a task handles together.
ROWS = 2048


def integer_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, with its integer components as `v`."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(whole).withColumn("v", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of every part; ties go to the lower index.

    vectors: (rows, parts, size), books: (parts, entries, size). Scores |c|^2 - 2 x.c stand for the distances; they
    are exact in doubles below 2**53 and in longs beyond.
    """
    small = max(np.abs(vectors).max(initial=0), np.abs(books).max(initial=0)) < 2**20
    kind = np.float64 if small else np.int64
    x, c = vectors.astype(kind), books.astype(kind)
    code = np.empty(vectors.shape[:2], np.int64)
    for part in range(books.shape[0]):
        scores = (c[part] * c[part]).sum(1) - 2 * (x[:, part] @ c[part].T)
        code[:, part] = scores.argmin(1)
    apart = vectors - books[np.arange(books.shape[0]), code]
    return code, (apart * apart).sum(2)


def _changes(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts to add for each (part, entry): plus for the new entry and minus for the old one where they differ."""
    parts, size = vectors.shape[1:]
    changed = np.ones(new.shape, bool) if old is None else old != new
    row, part = np.nonzero(changed)
    sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
    for code, sign in ((new, 1), (old, -1)):
        if code is not None and len(row):
            at = part * entries + code[row, part]
            counts += sign * np.bincount(at, minlength=parts * entries)
            order = np.argsort(at, kind="stable")
            begins = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums[at[order][begins]] += sign * np.add.reduceat(vectors[row, part][order], begins, axis=0)
    return sums, counts


class Codebooks:
    """Entries of every part position with the running sums and counts of their parts."""

    def __init__(self, first: np.ndarray):
        self.entries = first  # (parts, entries, size)
        self.sums, self.counts = np.zeros_like(first), np.zeros(first.shape[:2], np.int64)

    def update(self, changes: list) -> None:
        for r in changes:
            self.sums[r["part"], r["entry"]] += r["sums"]
            self.counts[r["part"], r["entry"]] += r["n"]
        used = self.counts > 0
        self.entries = self.entries.copy()
        self.entries[used] = self.sums[used] // self.counts[used][:, None]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with `code` (a byte for each part), the one before it as `before`, and `error` by the codebooks."""
    parts, _, size = books.shape
    fields = [f for f in rows.schema.fieldNames() if f not in ("code", "before", "error")]
    has_code = "code" in rows.columns
    source = rows.select(*fields, (F.col("code") if has_code else F.lit(None).cast("binary")).alias("before"))
    width, at = parts * size, source.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                code, error = nearest(_matrix(some.column(at), width).reshape(-1, parts, size), books)
                codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, codes, pa.array(error.sum(1))], names=[*some.schema.names, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{kinds}, code binary, error long")


def changes(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, sums, n) of the parts of rows (v, code, before) whose assignment changed; null `before`: all of them."""
    parts, entries, size = shape
    moved = rows.where("before is null or before <> code").select("v", "code", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        touched = np.zeros(parts * entries, bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                new = _codes(some.column(1), parts)
                old = None if some.column(2).null_count else _codes(some.column(2), parts)
                s, n = _changes(_matrix(some.column(0), parts * size).reshape(-1, parts, size), old, new, entries)
                sums, counts = sums + s, counts + n
                touched |= (n != 0) | s.any(1)
        at = np.flatnonzero(touched)
        yield pa.RecordBatch.from_pydict({"part": at // entries, "entry": at % entries, "each": pa.array(list(sums[at]), pa.list_(pa.int64())), "n": counts[at]})

    each = moved.mapInArrow(run, "part long, entry long, each array<long>, n long")
    sums = F.array(*[F.sum(F.col("each")[i]) for i in range(size)])
    return each.groupBy("part", "entry").agg(sums.alias("sums"), F.sum("n").alias("n"))


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def fit_codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code, error) of every whole vector, written, and the codebooks after the last round (entries: 256 at most)."""
    spark = df.sparkSession
    kept = integer_vectors(df.select(F.col(key), F.col(label), F.col(vector)), vector).drop(vector)
    least = kept.orderBy(F.col(key).asc_nulls_last(), "v").select("v")
    first = [r["v"] for r in least.limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], kept.drop("v").schema.add("code", "binary").add("error", "long")), None
    width = len(first[0])
    if width == 0 or width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    if any(len(v) != width for v in first):
        first = [r["v"] for r in least.where(F.size("v") == width).limit(entries).collect()]
    fits = lambda x: F.when(F.abs(x) < MOST * SCALE, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component of {MOST} or more")).cast("int"))
    kept = kept.where(F.size("v") == width).withColumn("v", F.transform("v", fits))
    books = Codebooks(np.array(first, np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2))
    with passing(spark):
        state = kept
        for _ in range(rounds):
            state = written(assigned(state, books.entries), "assignments")
            books.update(changes(state, books.entries.shape).collect())  # parts x entries rows at most
            state = state.drop("before", "error")
        last = written(assigned(state, books.entries).drop("v", "before"), "codes", kept=True)
    return last, books


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code (two hex digits for each part), error, label_error, codebooks_sha256."""
    codes, books = fit_codes(df, parts, entries, rounds, key, vector, label)
    sums = written(codes.groupBy(F.struct(label).alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "labels")
    total = codes.count()
    named = codes.withColumn("_label", F.struct(label))
    few = sums.count() <= 1 << 17
    both = named.join(small_side(sums), "_label") if few else joined_by_hot_key(named, sums, "_label", "_n", total)
    digest = F.lit(books.digest() if books else None).cast("string")
    return both.select(key, F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


SQL = """WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * len(v) // 16 + 1, (part + 1) * len(v) // 16) AS x FROM kept, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64),
{rounds}
a AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 a GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM a, s""".replace("{rounds}", "\n".join(
    f"""a{i} AS MATERIALIZED (SELECT vec_id, label, part, x, unnest(b) FROM (SELECT vec_id, any_value(label) AS label, p.part, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS b FROM p JOIN c{i} ON p.part = c{i}.part GROUP BY vec_id, p.part)),"""
    + (f"""
m{i} AS (SELECT part, e, list(m ORDER BY j) AS m FROM (SELECT part, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 100000) g(j) WHERE j <= len(x) GROUP BY part, e, j) GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (part, e)),""" if i < 2 else "") for i in range(3)))  # fmt: skip

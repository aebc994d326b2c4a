"""Mining hard negatives by sorting each anchor's scores.

A score is the inner product of integer vectors. Anchors are a stated set of rows (ids divisible by `one_in`) that is
held against all rows, in blocks: at most BLOCK anchors go to the tasks at once, and a task handles ROWS rows at once.
Within a block an anchor's scores are sorted by falling score and rising id. Its positives are the first rows of its own
label. For each positive the upper limit is searched by bisection in the sorted scores, and the first `most` entries of
other labels from there, above the lower limit, are read. What each task has found first is merged across tasks, by
(anchor) for positives and by (anchor, positive) for negatives: an anchor's whole order never comes together in one
place, and the rows that meet for a key are `most` for each task at most.

The work grows with anchors x rows, as the set of anchors is stated as a share of the rows. A pass over the rows takes
BLOCK anchors; the rows themselves are not shuffled.

Defined cases: rows with a null label or id, a null vector, or any null or non-finite component take no part; of
vectors of different lengths those of the most common length do (of equally common ones the longer); a component of
2**19 or more raises an error; rows with equal id are rows of their own and tie in an order of their label and vector;
zero vectors score 0; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code_lloyd import MOST, SCALE, _matrix, integer_vectors
from .common import passing, written
from .sharding import numbered

#: Anchors of a block and rows of a step.
BLOCK, ROWS = 8192, 4096


def relabelled(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", seventh: Column | None = None) -> DataFrame:
    """(id, label, v) of the rows that take part; where `seventh` holds the label moves on by one, modulo ten."""
    named = F.col(label).cast("long")
    moved = named if seventh is None else F.when(seventh, (named + 1) % 10).otherwise(named)
    rows = integer_vectors(df.select(F.col(key), F.col(label), F.col(vector)).where(F.col(key).isNotNull() & F.col(label).isNotNull()), vector)
    rows = rows.select(F.col(key).cast("long").alias("id"), moved.alias("label"), "v")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("_often")).where("n > 0").orderBy(F.desc("_often"), F.desc("n")).first()
    width = sizes["n"] if sizes else 1
    fits = lambda x: F.when(F.abs(x) < MOST * SCALE, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component of {MOST} or more")).cast("int"))
    return rows.where(F.size("v") == width).withColumn("v", F.transform("v", fits))


class Anchors:
    """A block of anchors as arrays: id, row (their own), label, vectors, and later the positives of each."""

    def __init__(self, rows: list):
        self.id, self.row, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("id", "_row", "label"))
        self.v = np.array([r["v"] for r in rows], np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: in doubles where all sums stay under 2**53."""
    most = int(np.abs(a).max(initial=1)) * int(np.abs(b).max(initial=1)) * b.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def sorted_rows(scores: np.ndarray) -> np.ndarray:
    """Rows by falling score, rising id, rising row for each anchor: the rows come in the order of id and row."""
    return np.argsort(-scores, axis=1, kind="stable")


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """id, row, label and vectors of a batch, sorted by id and row."""
    id_, row, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "_row", "label"))
    by = np.lexsort((row, id_))
    return id_[by], row[by], label[by], _matrix(batch.column(batch.schema.get_field_index("v")), width)[by]


def _steps(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


class _First:
    """For each key the first `most` rows (score falling, id, row), merged step by step; keys are 0 .. n-1."""

    def __init__(self, most: int):
        self.most = most
        self.found = [np.zeros(0, np.int64)] * 4  # key, score, id, row

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        all_ = [np.concatenate(p) for p in zip(self.found, (key, score, id_, row), strict=True)]
        by = np.lexsort((all_[3], all_[2], -all_[1], all_[0]))
        key = all_[0][by]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        self.found = [c[by][nth < self.most] for c in all_]


def positives(rows: DataFrame, anchors: Anchors, most: int) -> DataFrame:
    """(anchor, id, score, _row, nth): the first `most` other rows of each anchor's label; anchor is its place in the block."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)
    width = anchors.v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, first = shared.value, _First(most)
        for batch in _steps(batches, ROWS):
            id_, row, label, v = _arrays(batch, width)
            for value in np.unique(label):  # an anchor meets the rows of its own label only
                mine, theirs = np.flatnonzero(a.label == value), np.flatnonzero(label == value)
                for lo in range(0, len(mine), 1024):
                    some = mine[lo : lo + 1024]
                    scores = inner(a.v[some], v[theirs])
                    scores = np.where(row[theirs] == a.row[some][:, None], np.iinfo(np.int64).min + 1, scores)
                    best = sorted_rows(scores)[:, :most]
                    got = np.take_along_axis(scores, best, 1)
                    key = np.broadcast_to(some[:, None], best.shape)
                    real = (row[theirs][best] != a.row[some][:, None]).ravel()
                    first.add(key.ravel()[real], got.ravel()[real], id_[theirs][best].ravel()[real], row[theirs][best].ravel()[real])
        yield _table(first)

    found = rows.mapInArrow(run, "anchor long, score long, id long, _row long")
    return _firsts(found, ["anchor"], most)


def negatives(rows: DataFrame, anchors: Anchors, wanted: np.ndarray, most: int, low: int, high: int) -> DataFrame:
    """(pair, id, score, _row, nth): for each wanted pair (anchor, positive's score) its first `most` rows of other labels."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, wanted))
    width = anchors.v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, pairs), first = shared.value, _First(most)
        begins = np.searchsorted(pairs[:, 0], np.arange(len(a.id) + 1))
        upper, lower = high * pairs[:, 1] // 100, -(-low * pairs[:, 1] // 100)  # scores between these, both included
        for batch in _steps(batches, ROWS):
            id_, row, label, v = _arrays(batch, width)
            for lo in range(0, len(a.id), 1024):
                scores = inner(a.v[lo : lo + 1024], v)
                keys, at = [], []
                for i, by in enumerate(sorted_rows(scores), lo):
                    by = by[label[by] != a.label[i]]
                    falling = -scores[i - lo][by]
                    for pair in range(begins[i], begins[i + 1]):
                        start = np.searchsorted(falling, -upper[pair])
                        read = by[start : start + most]
                        read = read[scores[i - lo][read] >= lower[pair]]
                        keys += [(pair, i - lo)] * len(read)
                        at.append(read)
                if keys:
                    pair, i = np.array(keys).T
                    at = np.concatenate(at)
                    first.add(pair, scores[i, at], id_[at], row[at])
        yield _table(first)

    found = rows.mapInArrow(run, "pair long, score long, id long, _row long")
    return _firsts(found, ["pair"], most)


def _table(first: _First) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in first.found], names=["pair", "score", "id", "_row"])


def _firsts(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key across tasks."""
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "_row")
    return found.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= most)


def mine(rows: DataFrame, one_in: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (id, label, v).

    A negative's score is at least `low` and at most `high` hundredths of the positive's.
    """
    spark = rows.sparkSession
    fields = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = spark.createDataFrame([], fields)
    with passing(spark):
        rows = numbered(rows, ["id", "label", "v"]).withColumnRenamed("row_number", "_row")
        rows = written(rows, "rows")
        asked = written(numbered(rows.where(F.col("id") % one_in == 0), ["_row"]), "anchors")
        blocks = -(-asked.count() // block)
        for nth in range(blocks):
            some = asked.where((F.col("row_number") >= nth * block) & (F.col("row_number") < (nth + 1) * block)).orderBy("row_number")
            anchors = Anchors(some.select("id", "_row", "label", "v").collect())  # `block` rows at most
            good = positives(rows, anchors, n_positives).orderBy("anchor", "nth").select("anchor", "score", "id").collect()  # n_positives for each
            if not good:
                continue
            wanted = np.array([(r["anchor"], r["score"]) for r in good], np.int64)
            named = [(i, int(anchors.id[r["anchor"]]), r["id"], r["score"]) for i, r in enumerate(good)]
            pairs = F.broadcast(spark.createDataFrame(named, "pair long, anchor_id long, positive_id long, positive_score long"))  # block x n_positives rows
            got = negatives(rows, anchors, wanted, n_negatives, low, high).join(pairs, "pair")
            got = got.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            found = found.unionByName(written(got, "negatives", kept=True))
    return found


SQL = """WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score FROM kept a JOIN kept o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM d WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, d.id AS negative_id, d.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY d.score DESC, d.id) AS rank FROM p JOIN d ON d.anchor_id = p.anchor_id AND NOT d.same AND 30 * positive_score <= 100 * d.score AND 100 * d.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

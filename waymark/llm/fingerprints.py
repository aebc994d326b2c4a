"""Document fingerprints by consistent weighted sampling.

A document is a bag of word pairs, weighted by how often each occurs. For each of SAMPLES samples and each term, fixed
draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) give, at weight w, t = floor(ln w / r + b) and ln a = ln c - r (t + 1 - b);
the sample is the (term, t) of least a. Two documents agree in a sample with a probability equal to the generalised
Jaccard similarity (sum of the lesser weights over the sum of the greater), so the share of equal samples estimates it.
The draws are computed from the 64-bit hash of the term and the sample's key, so terms are told apart by all 64 bits in
texts of any length. Terms go through in blocks. A worker keeps ln a at weight 1 of CACHED terms, checked by their
whole hash; that saves time and changes nothing.

The neighbour in doc_id order is found without a global task: rows go to ranges of ids, and the first row of every
range goes to the range before it too.

Defined cases: a null text is empty; a document without words has the fingerprint zero and likeness 1 to another such
and 0 to any other; one word makes one term; rows with equal ids follow each other by the text's hash; the only row of a table is
its own next; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import _arrow_schema, map_texts

SAMPLES = 64
SEED = 20240607
#: Terms whose draws a worker keeps (a power of two), and terms that are drawn for together.
CACHED, BLOCK = 1 << 15, 1024

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F)]
_FIELD = np.uint64((1 << 21) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


class Sampler:
    """Draws of terms, and the samples of a bag of terms."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        keys = mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _MIX[0] + np.uint64(seed))
        self.keys, self.columns = keys.reshape(2, samples), np.arange(samples)
        self.known = np.zeros(CACHED, np.uint64)
        self.once = np.zeros((CACHED, samples), np.float32)

    def draws(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b of each term and sample: five numbers of 21 bits out of two hashes."""
        first, second = (mixed(terms[:, None] ^ k) for k in self.keys)
        u = lambda x, k: ((x >> np.uint64(21 * k)) & _FIELD).astype(np.float32) * np.float32(2**-21) + np.float32(2**-22)
        r = -np.log(u(first, 0) * u(first, 1))
        log_c = np.log(-np.log(np.minimum(u(second, 0) * u(second, 1), np.float32(1 - 2**-22))))
        return r, log_c, u(first, 2)

    def log_a_once(self, terms: np.ndarray) -> np.ndarray:
        """ln a at weight 1, where t is 0."""
        at = (terms >> np.uint64(40)).astype(np.int64) & (CACHED - 1)
        fresh = np.flatnonzero(self.known[at] != terms)
        a = self.once[at]
        if len(fresh):
            r, log_c, b = self.draws(terms[fresh])
            a[fresh] = made = log_c - r * (1 - b)
            self.known[at[fresh]], self.once[at[fresh]] = terms[fresh], made
        return a

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and weights of the word pairs of a text (of its word, if it has one)."""
        words = text.lower().split()
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        if len(h) > 1:
            h = mixed(h[:-1] * _MIX[0] + mixed(h[1:]))
        return np.unique(h, return_counts=True)

    def samples(self, text: bytes) -> np.ndarray:
        """32 bits of the hash of (term, t) for each sample; 0 stands for no terms."""
        terms, weights = self.terms(text)
        best = np.full(len(self.columns), np.inf, np.float32)
        of = np.zeros(len(self.columns), np.uint64)
        step = np.zeros(len(self.columns), np.int64)
        once, more = terms[weights == 1], np.flatnonzero(weights > 1)
        for lo in range(0, len(once), BLOCK):
            block = once[lo : lo + BLOCK]
            a = self.log_a_once(block)
            row = a.argmin(axis=0)
            least = a[row, self.columns]
            less = least < best
            best[less], of[less] = least[less], block[row[less]]
        for lo in range(0, len(more), BLOCK):
            block, weight = terms[more[lo : lo + BLOCK]], weights[more[lo : lo + BLOCK]]
            r, log_c, b = self.draws(block)
            t = np.floor(np.log(weight).astype(np.float32)[:, None] / r + b)
            a = log_c - r * (t + 1 - b)
            row = a.argmin(axis=0)
            least = a[row, self.columns]
            less = least < best
            best[less], of[less], step[less] = least[less], block[row[less]], t[row, self.columns][less].astype(np.int64)
        if not len(terms):
            return np.zeros(len(self.columns), np.uint32)
        return np.maximum(mixed(of + step.astype(np.uint64) * _MIX[3]) >> np.uint64(32), 1).astype(np.uint32)


@functools.lru_cache(1)
def sampler() -> Sampler:
    return Sampler()


def as_text(samples: np.ndarray) -> str:
    return samples.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the fingerprint of every whole text."""
    return map_texts(df, lambda texts: [(as_text(sampler().samples(t)),) for t in texts], "fingerprint string", key, text)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to each other and the next text's."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null ids have no place in the order: they come first, as if they were the least number
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.col(key), place.alias("_id"), F.xxhash64(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # ranges only deal out the work: eight to a partition, so that hashing them to partitions is even
    ranges = 8 * parts
    cuts = np.array(rows.approxQuantile("_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        # an id that fills several ranges is spread over them in the order of the texts' hashes
        low, high = (np.searchsorted(cuts, ids.to_numpy(np.int64), side) for side in ("left", "right"))
        u = hashes.to_numpy(np.int64) / 2.0**64 + 0.5
        return pd.Series((low + np.where(high > low, 1 + np.minimum((u * (high - low)).astype(np.int64), high - low - 1), 0)).astype(np.int32))

    firsts = rows.groupBy(range_of("_id", "_hash").alias("_range")).agg(F.min(F.struct("_id", "_hash")).alias("_first")).orderBy("_range").collect()
    numbers = {r["_range"]: k for k, r in enumerate(firsts)}  # one entry for each range
    starts = [(r["_first"]["_id"], r["_first"]["_hash"]) for r in firsts]

    @F.pandas_udf("array<struct<range:int,copy:boolean>>")
    def dealt(ids: pd.Series, hashes: pd.Series, of: pd.Series) -> pd.Series:
        out = []
        for i, h, r in zip(ids, hashes, of, strict=True):
            k = numbers[r]
            first = starts[k] == (i, h)
            out.append([{"range": k, "copy": False}] + [{"range": (k - 1) % len(starts), "copy": True}] * first)
        return pd.Series(out)

    sent = rows.withColumn("_to", F.explode(dealt("_id", "_hash", range_of("_id", "_hash")))).select(key, "_id", "_text", "_to.range", "_to.copy", "_hash")
    sent = sent.repartition(parts, "range").sortWithinPartitions("range", "copy", "_id", "_hash", "_text")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, out = sampler().samples, []
        waiting = None  # the row whose next row has not come yet
        for batch in batches:
            columns = [batch.column(i) for i in (0, 2, 3, 4)]
            for i in range(batch.num_rows):
                ident, content, part, copy = (c[i].as_py() for c in columns)
                if copy and waiting is None:
                    continue  # a further row that ties with the next range's first
                own = samples(content.encode())
                if waiting is not None:
                    was, its, had = waiting
                    new = edited(its, content)
                    changed = samples(new.encode())
                    out.append((was, len(its), hashlib.sha256(new.encode()).hexdigest(), as_text(had), as_text(changed), likeness(had, changed), likeness(had, own)))
                waiting = None if copy else (ident, content, own)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

    return sent.mapInArrow(run, schema)

"""SimHash near-duplicates by BK-trees.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of all shingles. Equal fingerprints are
one (pre-aggregated) node. For links within a radius, the bits are cut into blocks; fingerprints that differ in at most
`radius` bits agree in at least blocks - radius of them, so each node goes to one shard for each choice of that many
blocks. In a shard a BK-tree keeps children by their integer Hamming distance to the parent, and a query follows only
the edges within the radius of its own distance. A shard gives each node's link to the least node of its local
component, not all pairs; components over all shards follow from these.

A shard of more than SHARD nodes is dealt to tasks by pairs of its slices (one slice's tree, the other's queries), so
no task holds more than two slices and no link is lost.

Defined cases: a null or empty text has the fingerprint zero and links like any other; fewer words than a shingle make
one shingle; rows with a null key take part, and null is never a component's least key unless all of its keys are null;
repeated rows stay; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import passing
from .common import joined_by_hot_key, map_texts, numbered_rows, small_side, written

RADIUS, BLOCKS, SHINGLE = 3, 5, 3
#: Nodes of a slice of a large shard.
SHARD = 4096
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as a signed number; bit i is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        hashes = digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big", signed=True)


class BKTree:
    """Nodes keyed by the integer Hamming distance to their parent."""

    def __init__(self, radius: int):
        self.radius = radius
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        at = self.root
        while True:
            d = (at[0] ^ value).bit_count()
            below = at[1].get(d)
            if below is None:
                at[1][d] = [value, {}]
                return
            at = below

    def within(self, value: int) -> list[int]:
        found, radius, stack = [], self.radius, [self.root] if self.root else []
        while stack:
            other, below = stack.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                found.append(other)
            if below:
                if len(below) <= 2 * radius + 1:
                    stack += [node for k, node in below.items() if -radius <= k - d <= radius]
                else:
                    stack += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


def local_links(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links of each value to the least value of its component, by the tree of one slice.

    Without query_side, the values of tree_side query the tree as it grows; else query_side's values query all of it.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    tree, mask = BKTree(radius), (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for raw in tree_side:
        value = raw & mask
        if query_side is None:
            for other in tree.within(value):
                a, b = find(value), find(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        tree.add(value)
    for raw in query_side or []:
        value = raw & mask
        for other in tree.within(value):
            a, b = find(value), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(signed(x), signed(r)) for x in list(parent) if (r := find(x)) != x]


def _masks(radius: int, blocks: int) -> list[int]:
    """Signed 64-bit masks of every choice of blocks - radius blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cut[k + 1] - cut[k])) - 1) << cut[k] for k in choice)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _slices(keyed: DataFrame, *keep: str) -> DataFrame:
    """Rows of a shard (choice, bits) together and in order; a large shard once for each pair of its slices (s, t)."""
    large = written(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD), "large")
    if large.isEmpty():  # no shard needs slices, so none is joined with its size
        return keyed.select("choice", "bits", *[F.lit(0).alias(c) for c in ("s", "t", "own")], "fp", *keep).repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    slices = F.ceil(F.col("n") / SHARD).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7), *keep), slices).cast("int")
    dealt = keyed.join(large, ["choice", "bits"], "left").withColumn("own", F.when(F.col("n").isNotNull(), own).otherwise(0))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("n").isNotNull(), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.lit(0)))))
    dealt = dealt.select("choice", "bits", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", "fp", *keep)
    return dealt.repartition("choice", "bits", "s", "t").sortWithinPartitions("choice", "bits", "s", "t", "own", "fp")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[int]]]:
    """The columns of each run of equal (choice, bits, s, t) that has two rows or more."""
    held: list[list[int]] | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), n], strict=True):
            if held is not None and all(held[k][0] == columns[k][lo] for k in range(4)):
                held = [h + c[lo:hi].tolist() for h, c in zip(held, columns, strict=True)]
                continue
            if held is not None and len(held[0]) > 1:
                yield held
            held = [c[lo:hi].tolist() for c in columns] if hi - lo > 1 or hi == n else None
    if held is not None and len(held[0]) > 1:
        yield held


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links that connect just the fingerprints `fp` of nodes (distinct) within the radius."""
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(radius, blocks))])).alias("k")).select("fp", "k.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s, t, own, fp in _runs(batches):
            if s[0] == t[0]:
                found = local_links(fp, None, radius)
            else:
                split = bisect_left(own, t[0])
                found = local_links(fp[:split], fp[split:], radius)
            if found:
                yield _pairs(found)

    return _slices(keyed).mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """key, fingerprint (hex) and component_id: the least key that links lead to."""
    with passing(df.sparkSession):
        return written(_near_duplicates(df, key, text, shingle, radius, blocks), "groups", kept=True)


def _near_duplicates(df: DataFrame, key: str, text: str, shingle: int, radius: int, blocks: int) -> DataFrame:
    rows = written(map_texts(df, lambda texts: [(fingerprint(t, shingle),) for t in texts], "fp long", key, text), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n_rows")), "nodes")
    linked = written(components(links(nodes.select("fp"), radius, blocks)).withColumnRenamed("node", "fp"), "linked")
    groups = linked.join(nodes, "fp")
    reached = linked.join(groups.groupBy("root").agg(F.min("least").alias("reach")), "root").select("fp", "reach")
    named = nodes.join(reached, "fp", "left").select("fp", "n_rows", F.coalesce("reach", "least").alias("component_id"))
    joined = joined_by_hot_key(rows, written(named, "named"), "fp", "n_rows", rows.count())
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicate documents: SimHash candidates, checked on word shingles.

#: Words of a shingle. Pairs at 4/5 or more are near-duplicates.
CHECK_SHINGLE = 5
CANDIDATE_RADIUS, CANDIDATE_BLOCKS = 4, 6
#: Texts that the order of shingles is taken from, shingles of that order, and how often a frequent one is in it.
SAMPLE_TEXTS, COMMON, FREQUENT = 4_000, 1 << 17, 8
#: Numbers of 64 bits that hold the parities of shingles, and how many of them a row of a bucket carries.
PARITY, FOLDED = tuple(f"p{i}" for i in range(16)), 8
PORTRAIT = f"same long, fp1 long, fp2 long, n int, {', '.join(f'{p} long' for p in PARITY)}, rare array<long>, frequent array<long>"


def portrait(text: bytes, known: np.ndarray, counts: np.ndarray) -> tuple:
    """Hash of the words, two independent fingerprints, number and parity of the shingles, and the prefix of the rarest.

    Fingerprints are of single words, each weighed by the square root of its count: they stay within a few bits where a
    few words have changed, which fingerprints of longer shingles do not. Bit i of the parity says whether an odd number
    of shingles have the hash i of 1024: texts differ in at least as many shingles as parities in bits. The prefix is the
    first n // 5 + 1 of the n shingles, rarest first: texts at 4/5 or more share at least 4/5 of either's shingles, so
    one of them is in both prefixes. The prefix is given in two parts, its frequent shingles (by the sample) last.
    """
    words = text.lower().split()
    same = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    packed = bytes(16)
    weighed = Counter(words)
    if weighed:
        bits = np.unpackbits(np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, SEED) for w in weighed]), np.uint8).reshape(-1, 16), axis=1)
        weights = np.sqrt(np.fromiter(weighed.values(), np.float32, len(weighed)))
        packed = np.packbits(weights @ bits * 2 > weights.sum()).tobytes()
    h = shingle_hashes(words)
    odd = np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    count = np.zeros(len(h), np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        count = np.where(known[at] == h, counts[at], 0)
    first = np.lexsort((h, count))[: len(h) // 5 + 1 if len(h) else 0]
    rare = int((count[first] < FREQUENT).sum())
    prefix = h[first].view(np.int64)
    longs = np.frombuffer(packed + np.packbits(odd).tobytes(), ">i8").tolist()
    return (same - (1 << 64) if same >> 63 else same, *longs[:2], len(h), *longs[2:], prefix[:rare], prefix[rare:])


def hub_links(values: dict[int, list[int]], radius: int) -> list[tuple[int, int]]:
    """Links of nodes to hubs: fingerprints with most nodes around them first, each that no hub reaches becomes one.

    Hubs are further apart than the radius, so few of them reach one node: links grow with the nodes, not their square.
    """
    if len(values) == 1:
        nodes = next(iter(values.values()))
        return [(n, nodes[0]) for n in nodes[1:]]
    tree = BKTree(radius)
    for v in values:
        tree.add(v)
    near = {v: tree.within(v) for v in values}
    weight = {v: sum(len(values[u]) for u in near[v]) for v in values}
    reached: set[int] = set()
    out = []
    for v in sorted(values, key=lambda v: (-weight[v], v)):
        if v in reached:
            continue
        hub = values[v][0]
        for u in near[v]:
            reached.add(u)
            out += [(n, hub) for n in values[u] if n != hub]
    return out


def candidates(nodes: DataFrame, radius: int = CANDIDATE_RADIUS, blocks: int = CANDIDATE_BLOCKS) -> DataFrame:
    """(a, b): nodes to compare, from either fingerprint. nodes: node, fp1, fp2."""
    keyed = nodes.select("node", F.posexplode(F.array("fp1", "fp2")).alias("which", "fp"))
    masks = _masks(radius, blocks)
    keyed = keyed.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("k"), "which")
    keyed = keyed.select("node", "fp", (F.col("k.choice") * 2 + F.col("which")).alias("choice"), "k.bits")
    dealt = _slices(keyed, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            values: dict[int, list[int]] = {}
            mask = (1 << 64) - 1
            for fp, node in zip(group[5], group[6], strict=True):
                values.setdefault(fp & mask, []).append(node)
            found = hub_links({v: sorted(n) for v, n in sorted(values.items())}, radius)
            if found:
                yield _pairs(found)

    return dealt.mapInArrow(run, "a long, b long")


def shingle_set(text: bytes) -> set[tuple[bytes, ...]]:
    """The whole set of word shingles; fewer words than a shingle make one, no words none."""
    words = text.lower().split()
    return set(zip(*[words[k:] for k in range(CHECK_SHINGLE)])) if len(words) >= CHECK_SHINGLE else {tuple(words)} if words else set()


def similar(a: set, b: set) -> bool:
    """Whether the Jaccard similarity is 4/5 or more, in whole numbers."""
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def packed(text: Column) -> Column:
    """Bytes by zstandard: each pair of nodes moves both of its texts."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(zstandard.ZstdCompressor(level=3, write_content_size=True).compress)

    return pack(text)


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar on their whole sets of shingles. texts: same, body."""
    return alike_packed(pairs, texts.select("same", packed(F.col("body")).alias("body")))


def alike_packed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """alike for bodies that are packed already."""
    compared = pairs.join(texts.select(F.col("same").alias("a"), F.col("body").alias("body_a")), "a").join(texts.select(F.col("same").alias("b"), F.col("body").alias("body_b")), "b")

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, of, text = [], None, set(), zstandard.ZstdDecompressor().decompress
        for a, b in zip(x, y, strict=True):
            if b != last:  # rows come in the order of b
                last, of = b, shingle_set(text(b))
            out.append(similar(shingle_set(text(a)), of))
        return pd.Series(out, dtype=bool)

    return compared.where(check("body_a", "body_b")).select("a", "b")


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(max(1, len(words) - CHECK_SHINGLE + 1), np.uint64)
    for k in range(min(CHECK_SHINGLE, len(words))):
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)]
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ mixed >> np.uint64(29))


def common_shingles(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of at most COMMON shingles that several texts of a sample hold.

    They only order shingles, so the sample bears on the cost and not on the result.
    """
    part = max(1, docs.count() // SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes((body or b"").lower().split()).view(np.int64))], names=["h"])

    hashed = docs.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(part)) == 0).select(F.col(text).cast("binary")).mapInArrow(run, "h long")
    most = hashed.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, n = np.array([r["h"] for r in most], np.int64).view(np.uint64), np.array([r["count"] for r in most], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def portraits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and the columns of PORTRAIT of every row."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, key, text))  # at most COMMON shingles
    return map_texts(docs, lambda texts: [portrait(t, *common.value) for t in texts], PORTRAIT, key, text)


def buckets(rows: DataFrame) -> DataFrame:
    """Rows (h, node, n, pos) of shingles that are in the prefixes of two nodes or more, with the least node as hub.

    Rare shingles move once: their groups and their rows come from the same exchange. A frequent one may be in a third
    of all prefixes, so these are grouped by partial sums and joined by broadcast: there are at most COMMON.
    """
    rare = rows.select(F.col("same").alias("node"), "n", F.posexplode("rare").alias("pos", "h")).repartition("h")
    frequent = rows.select("same", "n", "frequent", F.size("rare").alias("_from")).select(F.col("same").alias("node"), "n", "_from", F.posexplode("frequent").alias("pos", "h"))
    frequent = frequent.withColumn("pos", F.col("pos") + F.col("_from")).drop("_from")

    def hubs(of: DataFrame) -> DataFrame:
        # n and pos are looked at too, so that the groups need all columns of the exchange and share it with the rows
        found = of.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("_last"), F.min("n").alias("_n"), F.min("pos").alias("_pos"))
        return found.where("hub <> _last and _n > 0 and _pos >= 0").select("h", "hub")

    shared = rare.join(hubs(rare), "h").unionByName(frequent.join(F.broadcast(hubs(frequent)), "h"))
    return written(shared.select("h", "node", "n", "pos", "hub").distinct(), "buckets")


def differing(parities: int) -> Column:
    """In how many bits the parities of two nodes a and b differ."""
    return sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(parities)), F.lit(0))


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities allow to be similar: at 4/5, texts differ in a ninth of their shingles."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("same")).union(pairs.select(F.col("b").alias("same"))).distinct(), "ids")
    nodes = written(nodes.join(small_side(ids), "same", "left_semi").select("same", "n", *PARITY), "needed")  # so that only these move
    of = lambda side: nodes.select(F.col("same").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *PARITY)])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where("5L * least(n_a, n_b) >= 4L * greatest(n_a, n_b)").where(9 * differing(len(PARITY)) <= F.col("n_a") + F.col("n_b")).select("a", "b")


def across(shared: DataFrame, linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): all pairs of a bucket in different components that can be similar by sizes, places and parities.

    At their first common shingle in the order, what is left of the shorter rest bounds their overlap. Parities are
    folded to FOLDED numbers, which are parities again. A bucket of more than SHARD nodes is dealt by slices. Pairs inside
    a component are settled, whatever their similarity.
    """
    rows = shared.join(linked, "node", "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    folded = [reduce(Column.bitwiseXOR, [F.col(p) for p in PARITY[i::FOLDED]]).alias(f"p{i}") for i in range(FOLDED)]
    rows = rows.join(mixed.select("h", F.ceil(F.col("m") / SHARD).cast("int").alias("slices")), "h").join(nodes.select(F.col("same").alias("node"), *folded), "node")
    rows = written(rows, "mixed")
    columns = ["node", "n", "pos", "root", *PARITY[:FOLDED]]
    left = rows.select("h", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("s"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = rows.select("h", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), *[F.col(c).alias(f"{c}_b") for c in columns])
    possible_ = F.expr("node_a > node_b and root_a <> root_b and 9L * least(n_a - pos_a, n_b - pos_b) >= 4L * (n_a + n_b)") & (9 * differing(FOLDED) <= F.col("n_a") + F.col("n_b"))
    both = left.join(right, (left["h"] == right["h"]) & (left["s"] == right["s"]) & possible_)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicate_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and group, the least key of the group; rows without a key are left out."""
    named = near_duplicate_groups(numbered_rows(df.where(F.col(key).isNotNull()), key, text), "_own", "_text")
    return named.select(F.col("_own.key").alias(key), F.col("group.key").alias("group"))


def near_duplicate_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and group: the least key among documents of the same words and those similar at 4/5 or more, step by step.

    A node is the hash of a text's words. Fingerprints and hubs of rare shingles propose the pairs of a first round; in
    a second, all pairs that share a prefix shingle and are not yet in one component are compared, so no link is lost.
    Pairs that the number and the parity of shingles rule out are dropped, which loses none; each other pair is checked
    on both whole texts, and only those are read again for it. Keys must be distinct. Tables written on the way are
    deleted at the end.
    """
    with passing(docs.sparkSession):
        return written(_near_duplicate_groups(docs, key, text), "groups", kept=True)


def _near_duplicate_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = written(portraits(docs, key, text), "portraits")
    numbers = [F.max(c).alias(c) for c in ("fp1", "fp2", "n", *PARITY)]
    nodes = written(rows.groupBy("same").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n_rows"), *numbers), "nodes")

    def checked(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.col("a").alias("same")).union(pairs.select(F.col("b").alias("same"))).distinct()
        used = written(nodes.join(used, "same", "left_semi").select("same", F.col("least").alias(key)), "used")
        bodies = docs.join(small_side(used), key).select("same", packed(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("body"))
        return alike_packed(pairs, written(bodies, "bodies"))

    shared = buckets(rows)
    hubs = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    proposed = candidates(nodes.select(F.col("same").alias("node"), "fp1", "fp2")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").union(hubs)
    proposed = written(possible(proposed.distinct(), nodes), "proposed")
    first = written(checked(proposed), "first")
    linked = written(components(first), "linked")
    rest = written(possible(across(shared, linked, nodes).join(proposed, ["a", "b"], "left_anti"), nodes), "rest")
    found = components(first.union(checked(rest)))
    rooted = nodes.select("same", "least", "n_rows").join(found.select(F.col("node").alias("same"), "root"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("group")), "root").select("same", "n_rows", "group")
    return joined_by_hot_key(rows.select(key, "same"), written(named, "named"), "same", "n_rows", rows.count()).select(key, "group")

"""Packing, vector codes and hard negatives: against SQL, plain loops and the tokenizers library, with odd rows."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from waymark.llm import code_lloyd, hard_negatives, packing, queries

FOLDER = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(rows, texts):
    """All ids once, in order, with the right CRCs; sequences without gaps and within the capacity. Gives the padded share."""
    library = Tokenizer.from_file(JSON)
    of, ends = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.Counter()
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = collections.Counter()
    for key in {k for k, _ in texts}:
        mine = [(text, [*library.encode(text or "", add_special_tokens=False).ids, 1]) for k, text in texts if k == key]
        left = collections.Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in of[key])
        for text, ids in mine:
            at = 0
            while at < len(ids):
                fits = [p for p in left if p[0] == at and p[3] == len(ids) and zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()) == p[2]]
                assert fits, (key, at)
                left[fits[0]] -= 1
                left += collections.Counter()
                at += fits[0][1]
            assert at == len(ids)
            got[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert not left
    assert got == want
    padding = total = 0
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, total)


def test_op11(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    rows = queries.op11_packing(spark, FOLDER).collect()
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in docs]) < 0.02


def test_packing_odd_rows(spark):
    long = "word and word " * 9000 + " " * 5000 + "x"
    rows = [(1, None), (2, ""), (3, long), (4, "a<|endoftext|>b"), (5, "same"), (5, "same"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _row", "2 as _group", "3 as length")
    found = packing.pack(df, JSON, public_tokenizers.PATTERN).collect()
    assert check_packing(found, rows) < 0.2
    assert packing.pack(df.where("false"), JSON, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("windows", [1, 2, 7, 40])
def test_differencing(windows):
    """Near-equal sums: beside the greedy rule on many pieces, and exactly as merging whole tuples by hand."""
    rng = random.Random(windows)
    for n in (0, 1, 5, 60, 300):
        sizes = [rng.randint(1, 300) for _ in range(n)]
        window = packing.differencing(np.array(sizes, np.int64), windows)
        assert len(window) == n and all(0 <= w < windows for w in window)
        sums = [sum(s for s, w in zip(sizes, window) if w == k) for k in range(windows)]
        # the tuples of the rule itself
        parts = [([s] + [0] * (windows - 1), i) for i, s in enumerate(sizes)]
        while len(parts) > 1:
            parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
            (a, i), (b, _), *rest = parts
            merged = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
            parts = [*rest, ([x - merged[-1] for x in merged], n + i)]
        if parts:
            assert max(sums) - min(sums) == parts[0][0][0] - parts[0][0][-1]
        if n == 300 and windows <= 7:
            assert max(sums) - min(sums) <= 3


def test_windows_rise():
    window, windows = packing.fill(np.array([1100] * 10), 2048)
    assert windows == 10 and sorted(window) == list(range(10))
    assert sum(packing.halves(1500)) == 1500 and packing.halves(0) == [] and max(packing.halves(9)) <= 8


def duck(rows, sql):
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    if rows:
        con.executemany("insert into embeddings values (?, ?, ?)", rows)
    got = con.sql(sql)
    return got.columns, sorted(got.fetchall(), key=repr)


def vectors(n, seed, width=32):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, width)).astype(np.float32)
    v[n // 3 : 2 * n // 3] = v[0]  # a third of all rows are copies
    v[5] = np.round(v[5], 1)
    rows = [(int(i), x.tolist(), int(i * i % 5)) for i, x in enumerate(v)]
    odd = [(n, None, 1), (n + 1, [0.1] * (width - 1) + [None], 1), (n + 2, [math.nan] * width, 2), (n + 3, [math.inf] + [0.0] * (width - 1), 2), (n + 4, [0.0] * width, None)]
    return rows + odd


@pytest.mark.parametrize("n", [3, 70, 400])
def test_codes_equal_sql(spark, n):
    rows = vectors(max(n, 6), n)[-n - 5 :] if n > 6 else vectors(6, 1)[3:]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as code", "3 as error", "4 as part").repartition(3)
    columns, want = duck(rows, code_lloyd.SQL)
    assert sorted(map(tuple, code_lloyd.compress(df).select(*columns).collect()), key=repr) == want


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert code_lloyd.compress(spark.createDataFrame([], kind)).collect() == []
    mixed = spark.createDataFrame([(2, [0.5] * 16, 1), (1, [1.0] * 32, 1), (1, [1.0] * 32, 1), (3, [2.0] * 32, None)], kind)
    got = code_lloyd.compress(mixed).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == [(1, "00" * 16, 0), (1, "00" * 16, 0), (3, "02" * 16, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        code_lloyd.compress(spark.createDataFrame([(1, [0.5] * 15, 1)], kind))
    with pytest.raises(Exception, match="or more"):
        code_lloyd.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], kind)).collect()


def test_deltas_are_the_changed_parts_only(spark):
    """Rows whose code stays give nothing; the running sums equal sums made anew."""
    rng = np.random.default_rng(2)
    v, old, new = rng.integers(-99, 99, (50, 32)), rng.integers(0, 4, (50, 16)), rng.integers(0, 4, (50, 16))
    new[:30] = old[:30]
    new[40, 1:] = old[40, 1:]
    rows = [(v[i].tolist(), bytearray(new[i].astype(np.uint8)), bytearray(old[i].astype(np.uint8))) for i in range(50)]
    got = code_lloyd.changes(spark.createDataFrame(rows, "v array<int>, code binary, before binary"), (16, 4, 2)).collect()
    sums = np.zeros((2, 16, 4, 2), np.int64)
    for i in range(50):
        for p in range(16):
            sums[0, p, old[i, p]] += v[i, 2 * p : 2 * p + 2]
            sums[1, p, new[i, p]] += v[i, 2 * p : 2 * p + 2]
    for r in got:
        sums[0, r["part"], r["entry"]] += r["sums"]
    assert (sums[0] == sums[1]).all()


def same_negatives(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as id", "3 as _row", "4 as score").repartition(3)
    got = hard_negatives.mine(hard_negatives.relabelled(df, seventh=df["vec_id"] % 7 == 0), **options)
    columns, want = duck(rows, hard_negatives.SQL)
    found = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert found == want
    return want


def test_negatives_equal_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i * 5), (rng.normal(0, 0.2, 16) + (i % 4 == np.arange(16) % 4)).astype(np.float32).tolist(), i % 4) for i in range(400)]
    assert len(same_negatives(spark, rows, block=7)) > 100
    same_negatives(spark, vectors(300, 4, 16))
    same_negatives(spark, [])


def test_negatives_of_repeated_rows(spark):
    """Copies are rows of their own, a row is never its own positive, and other labels never among an anchor's positives."""
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [0.9, 0.0], 2), (3, [0.9, 0.0], 2), (4, [0.2, 9.0], 2), (5, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.relabelled(df)).collect()]
    want = [(100, p, k + 1, 3, s, 230 * 256) for p, s in ((5, 512 * 256), (100, 256 * 256)) for k in range(2)] * 2
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["op12_code_lloyd", "op13_hard_negatives"])
def test_queries_equal_sql(spark, name):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()]
    columns, want = duck(rows, queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns) and sorted(map(tuple, got.select(*columns).collect()), key=repr) == want and want


def test_license_spans_of_a_megabyte_in_seconds():
    """Time grows in proportion to the text: chains that are kept are looked up and not compared one by one."""
    import time

    from waymark.llm import license_scan

    notice = b"Licensed under CC BY 4.0 by the authors of this page . All rights reserved where not stated . "
    license_scan.scan(notice * 100)
    began = time.process_time()
    small = license_scan.scan(notice * 2500)
    middle = time.process_time()
    large = license_scan.scan(notice * 10_000)
    assert len(large[-1]) == 4 * len(small[-1]) > 5000
    assert time.process_time() - middle < 8 * (middle - began) + 0.5
    spans = sorted((s["label"], s["first_word"], s["last_word"]) for s in small[-1])
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_words_share_the_table_of_their_beginnings():
    import public_tokenizers
    from waymark.llm import token_counts

    of = token_counts.TextCounts(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    words = ["unverzeihlich" + "abcdefgh"[i % 8] * (1 + i // 8) for i in range(64)]
    plain = [of.dp.merge(f" {w}".encode()) for w in words]
    first = of.dp.prefixes(f" {words[0]}".encode())
    assert [len(of.dp.merge(f" {words[0]}".encode()[:n])) for n in range(1, len(first[1]))] == first[1][1:]
    of.forget()
    assert [of.dp.prefixes(f" {w}".encode())[1][-1] for w in words] == [len(m) for m in plain]
    assert token_counts.HEAD > 1 and len(of.dp.heads) == 1  # one beginning for all


def test_pairs_hold_as_merging_says():
    import random

    import public_tokenizers
    from waymark.llm import byte_bpe

    ranks = byte_bpe.MergeRanks(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    any_, ids = random.Random(5), sorted(ranks.bytes_of)
    merge, looked = ranks.merge, []
    near = [ranks.ranks[piece[:n]] << 20 | ranks.ranks[piece[n:]] for piece in (ranks.bytes_of[i] for i in ids[::9]) for n in range(1, len(piece)) if piece[:n] in ranks.ranks and piece[n:] in ranks.ranks]
    pairs = near[:4000] + [any_.choice(ids) << 20 | any_.choice(ids[: 256 if k % 3 else None]) for k in range(12_000)]
    wanted = [merge(ranks.bytes_of[k >> 20] + ranks.bytes_of[k & 0xFFFFF]) == (k >> 20, k & 0xFFFFF) for k in pairs]
    ranks.merge = ranks.windows.function = lambda piece: looked.append(piece) or merge(piece)
    assert [ranks.pairs[k] for k in pairs] == wanted and 0 < sum(wanted) < len(wanted)
    assert not looked  # a pair is told by undoing its merges, without merging its bytes anew

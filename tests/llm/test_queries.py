"""The registered queries over a whole small table, against plain loops and the tokenizers' own libraries."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from waymark.llm import byte_bpe, fingerprints, media_jpeg, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def of(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, documents):
    got = of(queries.op1_media_columns(spark, FOLDER))
    assert set(got) == set(documents)
    for key, text in documents.items():
        data, r = text.encode(), got[key]
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        (media,) = media_jpeg.encode([data])
        ((pictures, _),) = media_jpeg.thumbnails([media])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert b"".join(p.tobytes() for p in pictures) == payload
        # the thumbnail's hash again, cell by cell, where eight rows or more fill the cells
        rows = len(payload) // 64
        if rows % 8 == 0 and rows <= media_jpeg.MOST_ROWS:
            cells = [sum(payload[y * 64 + x] for y in range(i * rows // 8, (i + 1) * rows // 8) for x in range(8 * j, 8 * j + 8)) / (rows // 8) / 8 for i in range(8) for j in range(8)]
            bits = "".join("1" if c > sum(cells) / 64 else "0" for c in cells)
            differ = int(r["feature"].split(":")[1], 16) ^ int(bits, 2)
            assert r["feature"].startswith(f"64x{rows}:") and differ.bit_count() <= 1  # a cell just at the mean


def test_op2(spark, documents):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = of(queries.op2_license_scan(spark, FOLDER))
    for key, text in documents.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[key]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({p[1] for p in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op3_and_op4(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of, counts = of(queries.op3_byte_bpe(spark, FOLDER)), of(queries.op4_token_counts(spark, FOLDER))
    for key, text in documents.items():
        ids = want.encode_ordinary(text)
        r = ids_of[key]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        n = len(library.encode(text, add_special_tokens=False).ids)
        r = counts[key]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512) and (r["bytes_in_limit"] == r["n_bytes"]) == (n <= 512)


def test_op5(spark, documents):
    got, order = of(queries.op5_fingerprints(spark, FOLDER)), sorted(documents)
    sampler = fingerprints.Sampler()
    for i, key in enumerate(order):
        text, after = documents[key], documents[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        # every term on its own, in plain loops over terms, for the first sample
        prints = [fingerprints.as_text(sampler.samples(t.encode())) for t in (text, edited, after)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(prints[:2])
        parts = [[p[k : k + 8] for k in range(0, len(p), 8)] for p in prints]
        for name, other in (("near_edited", 1), ("near_next", 2)):
            assert r[name] == sum(a == b for a, b in zip(parts[0], parts[other])) / 64


def test_op8(spark, documents):
    got = of(queries.op8_sharding(spark, FOLDER))
    slots = {}
    for key, text in documents.items():
        r = got[key]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op9(spark, documents):
    prints = {}
    for key, text in documents.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 3]), seed=42) for j in range(max(1, len(words) - 2))] if words else []
        prints[key] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    up = {k: k for k in prints}
    for a in sorted(prints):
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and up[a] != up[b]:
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    got = of(queries.op9_simhash(spark, FOLDER))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{v:016x}", up[k]) for k, v in prints.items()}


def test_pipeline_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that the stages use themselves."""
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, long, "en", "a", len(long)), (4, "a short text", "en", "b", 12), (4, "a short text", "en", "b", 12), (None, "no id here", "en", "b", 10), (None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.selectExpr("*", "1 as _own", "2 as _row", "3 as _text", "4 as _position", "5 as size", "7 as _nth", "8 as copies", "9 as key")
    for df in (docs, odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, FOLDER)
            found = out.collect()
            assert out.columns == df.columns, name
            assert set(found) <= set(df.collect()), name
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "None", "None"]  # 1 and 2 have no words, 4 is there twice
    assert corpus_pipeline.encode(spark, odd, FOLDER).count() == 7

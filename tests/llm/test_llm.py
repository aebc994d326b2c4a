"""Corpus operators: brute force, round trips, held-out accuracy, and the defined cases of odd rows."""

import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import byte_bpe, fingerprints, learning, license_scan, media_jpeg, mixing, quality, queries, sharding, simhash, token_counts, toxicity
from waymark.operators.graph import components

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "the quick brown fox jumps " * 8000
#: Nulls, empty and very long texts, ties and repeated rows, and columns named like the operators' own.
ODD = [
    (1, None, "en", None, 0, 1.0), (2, "", "en", "", 0, 2.0), (3, LONG, "en", "a", len(LONG), 3.0), (4, "same text here twice", None, "a", 20, 4.0),
    (5, "same text here twice", "en", "b", 20, 4.0), (5, "same text here twice", "en", "b", 20, 4.0), (None, "no id at all 中文 é", "en", "b", 18, None), (7, "x", "en", None, 1, 0.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as size", "2 as fp", "'m' as media", "3 as position", "4 as _text")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql("select doc_id, text, source from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()


def of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# op1


def test_jpeg_round_trip(texts):
    draw = np.random.default_rng(0)
    some = [b"", b"a" * 64, b"b" * 65, bytes(range(256)) * 3, b"\xff" * 200, draw.bytes(64 * 8191 + 100), *[t.encode() for t in texts]]
    for text, (pictures, note) in zip(some, media_jpeg.thumbnails(media_jpeg.encode(some)), strict=True):
        assert b"".join(p.tobytes() for p in pictures) == media_jpeg.padded(text)
        assert note == b"bytes=%d" % len(text)


def test_jpeg_decodes_other_blocks():
    """A hand-made picture with AC coefficients and no restart markers takes the block-by-block way."""
    media = media_jpeg.encode([bytes(range(64))])[0]
    p = media_jpeg.parse(media)[0]
    ac = bytes([0, 2, 1] + [0] * 13) + bytes([0x00, 0x01, 0xF0])  # end of block 00, one coefficient of one bit 01
    bits = "".join(f"{3:04b}" + "101" + "01" + "1" + "00" for _ in range(64))  # DC +5, AC 1, end
    scan = bytes(int(bits[i : i + 8].ljust(8, "1"), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    got = media_jpeg._decode([scan], [p | {"restart": 0}], p["dc"], ac)[0]
    assert got.tolist() == [5 * (i + 1) for i in range(64)]


def test_media_odd_rows(odd, empty):
    rows = media_jpeg.read_media(media_jpeg.store_media(odd)).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["payload_bytes"] == 64 and got[1]["media_sha256"] == got[2]["media_sha256"]
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    assert got[3]["payload_sha256"] == hashlib.sha256(media_jpeg.padded(LONG.encode())).hexdigest()
    assert media_jpeg.read_media(media_jpeg.store_media(empty)).count() == 0


# op2


def test_license_base_places(texts):
    extra = ["All Rights Reserved. all rights RESERVED cc-by", "GNU General Public License general public license", "rights reserved all rights", "cc by cc by"]
    for text in [*texts, *extra]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, p) for p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = license_scan.scan(text.encode())
        assert got[:2] == (len(words), len(places))
        assert got[2:4] == ((min(i for i, _ in places), max(i for i, _ in places)) if places else (None, None))
        assert got[4] == ",".join(sorted({license_scan.BASE[p] for _, p in places}))


def test_license_matching_statistics():
    machine = license_scan.automaton()
    draw = np.random.default_rng(2)
    pool = sorted(machine.ids)
    for _ in range(30):
        text = [pool[i] for i in draw.integers(len(pool), size=12)]
        k = int(draw.integers(len(license_scan.TEMPLATES)))
        text += license_scan.words(license_scan.TEMPLATES[k][1].encode())[1:7] + [pool[0]]
        _, matches = machine.stream(text)
        runs = [[machine.ids[w] for w in license_scan.words(t.encode())] for _, t in license_scan.TEMPLATES] + machine.phrases
        for end, length, _ in matches:
            piece = [machine.ids[w] for w in text[end - length + 1 : end + 1]]
            assert any(piece == r[i : i + length] for r in runs for i in range(len(r)))


def test_license_spans_and_score():
    """Spans, labels and score of whole and damaged licence texts, told apart from text that only shares words."""
    by_label = {}
    for label, text in license_scan.TEMPLATES:
        by_label.setdefault(label, []).append(license_scan.words(text.encode()))
    for label, templates in by_label.items():
        for words in templates:
            if len(words) < 20:
                continue
            noise = [b"zz%d" % i for i in range(30)]
            got = license_scan.scan(b" ".join(noise + words + noise))
            own = [s for s in got[7] if s["label"] == label]
            assert label in got[5].split(",") and got[6] == 1.0
            assert (30, 29 + len(words), len(words)) in [(s["first_word"], s["last_word"], s["covered"]) for s in own]
            damaged = list(words)
            damaged[len(words) // 3] = b"qq"
            damaged[2 * len(words) // 3 : 2 * len(words) // 3 + 2] = []
            got = license_scan.scan(b" ".join(noise + damaged))
            own = max((s for s in got[7] if s["label"] == label), key=lambda s: s["covered"])
            assert label in got[5].split(",") and 0.85 * len(words) <= own["covered"] < len(words) and own["first_word"] == 30
    # a short template inside a run that a longer one has too
    assert license_scan.scan(b"Licensed under the Apache License, Version 2.0. The end")[5:7] == ("apache-2.0", 1.0)
    shuffled = sorted(by_label["mit"][1])
    assert "mit" not in license_scan.scan(b" ".join(shuffled))[5]


def test_chains_use_every_place_of_a_run():
    """A run that a template has twice continues the chain at its second place too."""
    template = b"a b c one two three four five six a b c seven eight nine ten".split()
    machine = license_scan.Automaton([template], [])
    text = b"four five six x a b c y seven eight nine ten".split()
    (span,) = machine.spans(machine.stream(text)[1])
    assert span == (0, 0, len(text) - 1, 10)


def test_license_templates_and_odd_rows(odd, empty):
    assert "mit" in license_scan.scan(b"Released under the MIT license.")[5]
    assert license_scan.scan(b"nothing of that kind") [4:7] == ("", "", 0.0)
    rows = license_scan.scan_licenses(odd).collect()
    assert len(rows) == len(ODD) and license_scan.scan_licenses(empty).count() == 0


# op3, op4


def hard_texts():
    draw = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", "THE", "'s", "'", "12", "é", "中文", "!", "...", "\x1c", "\x85", "​", " ", "᠎", "😀", "́", "\r\n", "ab" * 30, "　"]
    return ["".join(parts[i] for i in draw.integers(len(parts), size=int(draw.integers(12)))) for _ in range(3000)]


def test_bpe_as_the_library(texts):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for text in [*texts, *hard_texts(), "", "<|endoftext|>", "aehinrst" * 60]:
        ids = want.encode_ordinary(text)
        assert codec.encode(text) == ids and codec.decode(ids) == text.encode()
        assert codec.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_counts_as_the_library_and_at_every_prefix(texts):
    library, counts = Tokenizer.from_file(JSON), token_counts.counter(JSON, public_tokenizers.PATTERN)
    for text in [*texts[:60], *hard_texts()[:1000], "a<|endoftext|> b<|endoftext|>"]:
        assert counts.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        table = counts.table(text)
        assert len(table) == len(text.encode()) and (not text or table[-1] == counts.count(text))
    word = "antidisestablishmentarianistically"
    assert counts.dp.prefixes(word.encode())[1] == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]


def test_budgets_at_every_limit(texts):
    """The longest prefix within a limit, against the library's counts of prefixes and against the whole table."""
    library, counts = Tokenizer.from_file(JSON), token_counts.counter(JSON, public_tokenizers.PATTERN)
    text = "hello antidisestablishmentarianistically"
    of_prefix = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    for limit in range(9):
        assert counts.budget(counts.parts(text), limit) == max(i for i, n in enumerate(of_prefix) if n <= limit)
    assert [counts.budget(counts.parts(text), k) for k in range(2, 6)] == [11, 15, 26, 31]
    for text in [*texts[:10], *hard_texts()[:300], "aGVsbG8gd29ybGQ" * 90, "中文字符" * 300, "a<|endoftext|> b"]:
        table = [0, *counts.table(text).tolist()]
        for limit in {0, 1, 2, 3, 5, 8, table[-1] // 2, table[-1] - 1, table[-1]}:
            assert counts.budget(counts.parts(text), limit) == max((i for i, n in enumerate(table) if n <= limit), default=0)


@pytest.mark.parametrize("sign", ["a", "0", "=", "-", " ", "中", "é", "😀", "abc"])
def test_long_units_take_seconds(sign):
    """Units of equal characters, of all lengths, against the libraries; a million characters within 20 seconds."""
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    library, counts = Tokenizer.from_file(JSON), token_counts.counter(JSON, public_tokenizers.PATTERN)
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for n in [*range(1, 400), 1023, 1025, 2047, 3001, 4999, 5000]:
        text = (sign * n)[:n]
        ids = want.encode_ordinary(text)
        assert codec.encode(text) == ids and counts.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    text, begin = (sign * 1_000_000)[:1_000_000], time.monotonic()
    assert codec.decode(codec.encode(text)) == text.encode() and counts.count(text) > 0
    assert time.monotonic() - begin < 20


@pytest.mark.parametrize("letters", ["ab", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "的一是了我不人在他有这"])
def test_long_units_of_mixed_characters(letters):
    draw = np.random.default_rng(2)
    text = "".join(letters[i] for i in draw.integers(len(letters), size=30_000))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    assert byte_bpe.codec(RANKS, public_tokenizers.PATTERN).encode(text) == want.encode_ordinary(text)
    ranks = byte_bpe.MergeRanks(byte_bpe.read_ranks(RANKS))
    assert ranks.merge(text[:900].encode()) == tuple(want._core_bpe.encode_single_piece(text[:900].encode()))


def test_tokens_odd_rows(odd, empty):
    got = byte_bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) and of(odd)  # repeated rows stay
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    counted = {r["doc_id"]: r for r in token_counts.count_tokens(odd, JSON, public_tokenizers.PATTERN).collect()}
    assert counted[3]["over_limit"] and counted[3]["n_tokens"] == by[3]["n_tokens"] and not counted[1]["over_limit"]
    ids = byte_bpe.encode_ids(odd.where("doc_id = 3"), RANKS, public_tokenizers.PATTERN)
    assert bytes(byte_bpe.decode_ids(ids, RANKS).first()["decoded"]) == LONG.encode()
    assert byte_bpe.encode_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# op5


def jaccard(sampler, a, b):
    x, y = (dict(zip(k.tolist(), w.tolist())) for k, w in (sampler.terms(a), sampler.terms(b)))
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)


def test_sampling_estimates_generalised_jaccard():
    draw, sampler = np.random.default_rng(5), fingerprints.Sampler(samples=512)
    words = [f"w{i}" for i in range(60)]
    for _ in range(6):
        a, b = (" ".join(words[i] for i in draw.integers(60, size=150)).encode() for _ in range(2))
        b = a[: len(a) * 2 // 3] + b[: len(b) // 3]
        assert fingerprints.likeness(sampler.samples(a), sampler.samples(b)) == pytest.approx(jaccard(sampler, a, b), abs=0.1)


def test_sampling_tells_terms_of_long_texts_apart(texts):
    """Texts of 60,000 words without a common pair are not alike, and half a text is half alike."""
    draw, sampler = np.random.default_rng(8), fingerprints.Sampler()
    a, b = ([f"{c}{k}" for k in draw.integers(0, 1 << 30, size=60_000)] for c in "ab")
    one, two, both = (" ".join(w).encode() for w in (a, b, a[:30_000] + b[:30_000]))
    assert fingerprints.likeness(sampler.samples(one), sampler.samples(two)) == 0
    assert fingerprints.likeness(sampler.samples(one), sampler.samples(both)) == pytest.approx(1 / 3, abs=0.2)
    found = [(jaccard(sampler, x, y), fingerprints.likeness(sampler.samples(x), sampler.samples(y))) for t, u in zip(texts, texts[1:]) for x, y in [(t.encode(), fingerprints.edited(t, u).encode())] if t]
    assert abs(np.mean([g - w for w, g in found])) < 0.02 and max(abs(g - w) for w, g in found) < 0.3


def test_neighbours_of_a_repeated_id(spark):
    """An id that most rows have is spread over ranges; each row's next is the one behind it by the text's hash."""
    rows = [(7, f"word{k} and more of it") for k in range(300)] + [(k, f"other{k} text") for k in (1, 2, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r["text"] for r in df.selectExpr("*", "xxhash64(text) as h").orderBy("doc_id", "h").collect()]
    want = sorted(hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest() for t, n in zip(order, order[1:] + order[:1]))
    assert sorted(r["edited_sha256"] for r in fingerprints.fingerprint_edits(df.repartition(3)).collect()) == want


def test_edited_texts(spark, documents):
    df = spark.createDataFrame([d[:2] for d in documents], "doc_id long, text string").repartition(5)
    got = of(fingerprints.fingerprint_edits(df))
    assert len(got) == len(documents)
    for k, (key, text, _) in enumerate(documents):
        nxt, half = documents[(k + 1) % len(documents)][1], len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        own, other, then = (fingerprints.sampler().samples(t.encode()) for t in (text, new, nxt))
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.as_text(own) and r["edited_fingerprint"] == fingerprints.as_text(other)
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(own, other), fingerprints.likeness(own, then))


def test_edits_odd_rows(odd, empty):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD) and {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {"0" * 512}
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(odd.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


# op6


def water_fill(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] >= 2 * sizes[n]}
        target |= {n: 2.0 * sizes[n] for n in full} if full else {n: level * weight[n] for n in open_}
        open_ = open_ - full if full else set()
    return target


def test_mix_targets_and_reruns(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes, source, taken = {}, {d[0]: d[2] for d in documents}, {}
    for key, text, name in documents:
        sizes[name] = sizes.get(name, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    want = water_fill(sizes)
    for r in got:
        name = source[r["doc_id"]]
        taken[name] = taken.get(name, 0) + r["taken"]
        assert r["source_size"] == sizes[name] and r["target"] == pytest.approx(want[name]) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[n] - want[n]) <= 1 for n in want)
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert sorted(got) == sorted(mixing.mix(df.repartition(7)).collect())


def test_mix_places_every_pass(spark):
    """A source that is used twice is spread over all of training, in both passes."""
    rows = [(k, "a b c d", "large" if k % 10 else "small") for k in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(len(r["positions"]) == r["copies"] and r["positions"][:1] in ([], [r["position"]]) for r in got)
    small = [r["positions"] for r in got if r["doc_id"] % 10 == 0]
    assert all(len(p) == 2 and p[0] < p[1] for p in small)
    assert max(p[0] for p in small) <= min(p[1] for p in small) and max(p[1] for p in small) > 0.95


def test_mix_follows_each_schedule(spark):
    """Words of every source in each tenth of training, against its schedule summed up in small steps, to 1 % of its target."""
    rows = [(k, "a b c d", "abc"[min(2, k % 7)]) for k in range(21_000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = sum(mixing.WEIGHTS) / len(mixing.WEIGHTS)
    for name, weight in zip("abc", mixing.WEIGHTS):
        own = [r for r in got if "abc"[min(2, r["doc_id"] % 7)] == name]
        at = np.array([p for r in own for p in r["positions"]])
        words, _ = np.histogram(at, bins=10, range=(0, 1), weights=np.full(len(at), 4.0))
        fine = np.array([weight + (mean - weight) * (i + 0.5) / 10_000 for i in range(10_000)]).reshape(10, 1000).sum(axis=1)
        assert np.abs(words - own[0]["target"] * fine / fine.sum()).max() <= 0.01 * own[0]["target"]
        assert at.max() > 0.99 and at.min() < 0.01


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=4)
    assert mixing.mix(empty).count() == 0


# op7, op10


def accuracy(spark, data, scored, label):
    known = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", label)
    rows = scored.join(known, "doc_id").where("held_out").collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, larger):
    scored = queries.op7_quality(spark, larger)
    rows = scored.collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert accuracy(spark, larger, scored, "quality") >= 0.95


def test_toxicity_held_out(spark, larger):
    scored = queries.op10_toxicity(spark, larger)
    rows = scored.collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert accuracy(spark, larger, scored, "toxic") >= 0.85


def check_gradient(weights, got, loss, names):
    draw = np.random.default_rng(0)
    for name in names:
        w = weights[name]
        for _ in range(4):
            at = tuple(int(draw.integers(k)) for k in w.shape)
            was, w[at] = w[at], w[at] + 1e-5
            up = loss()
            w[at] = was - 1e-5
            down, w[at] = loss(), was
            assert got[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5), name


def test_network_gradient():
    model, draw = toxicity.Model(seed=1), np.random.default_rng(4)
    x = draw.normal(size=(5, 3, toxicity.WORD_INPUTS))
    held = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    spelling = toxicity.Spelling([b"one", b"a", b"Trashy", b"trash"])
    at = np.where(held, draw.integers(4, size=held.shape), 4)
    y, got = np.array([1.0, 0.0, 1.0]), {}
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    model.step(x, held, y, np.ones(3), got.update, spelling, at)

    def loss():
        found = np.concatenate([model.character_inputs(spelling)[0], np.zeros((1, toxicity.FILTERS))])
        every = np.concatenate([x, found[at]], axis=2)
        logit = model.logits(every @ model.w["Xf"] + model.w["cf"], every @ model.w["Xb"] + model.w["cb"], held)
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    model.w["E"][:] = np.where(np.abs(got["E"]) > 0, model.w["E"], 0)  # rows of bytes that no word has stay out of it
    got.clear()
    model.step(x, held, y, np.ones(3), got.update, spelling, at)
    check_gradient(model.w, got, loss, set(model.w) - {"E"})
    row = int(np.abs(got["E"]).sum(axis=1).argmax())
    check_gradient({"E": model.w["E"][row]}, {"E": got["E"][row]}, loss, ["E"])


def test_attention_gradient():
    model, draw = quality.Model(seed=3), np.random.default_rng(6)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, starts = draw.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    got = model.gradients(x, starts, y, weight)

    def loss():
        p = model.forward(x, starts)["p"]
        return -np.sum(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))) / weight.sum()

    check_gradient(model.w, got, loss, model.w)


def plain_quality(model, text):
    """The score of one text, passage by passage, in plain Python."""
    w, sig = model.w, lambda v: 1 / (1 + np.exp(-v))
    h, e = [], []
    for row in quality.passages(text):
        h.append(np.tanh((row - model.mean) / model.scale @ w["W"] + w["b"]))
        e.append(float((np.tanh(h[-1] @ w["V"]) * sig(h[-1] @ w["U"])) @ w["a"][:, 0]))
    share = [np.exp(v - max(e)) for v in e]
    z = sum(s / sum(share) * v for s, v in zip(share, h))
    return float(sig(z @ w["o"][:, 0] + w["c"][0]))


def plain_toxicity(model, text):
    """The score of one text, window by window and word by word, in plain Python."""
    w, n, sig = model.w, toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    found, best = toxicity.words(text), -np.inf
    for start in range(0, max(1, len(found) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        rows = []
        for word in found[start : start + toxicity.WINDOW]:
            around = b" " + word.lower() + b" "
            answers = [np.concatenate([w["E"][c] for c in around[i : i + 3]]) @ w["F"] for i in range(len(word))]
            evidence = [model.evidence[k, s] for k, s in enumerate(toxicity.hashes(word))]
            rows.append(np.concatenate([evidence, toxicity.shape(word), np.tanh(np.max(answers, axis=0) + w["e"])]))
        states = np.zeros((len(rows), 2 * n))
        for i, d in enumerate("fb"):
            h = np.zeros(n)
            for t in range(len(rows)) if d == "f" else range(len(rows) - 1, -1, -1):
                gate, u = rows[t] @ w[f"X{d}"] + w[f"c{d}"], h @ w[f"H{d}"]
                z, r = np.split(sig(gate[: 2 * n] + u[: 2 * n]), 2)
                new = np.tanh(gate[2 * n :] + r * u[2 * n :])
                h = new + z * (h - new)
                states[t, i * n : (i + 1) * n] = h
        if len(rows):
            e = np.exp((np.tanh(states @ w["A"]) @ w["v"])[:, 0])
            best = max(best, float((e / e.sum()) @ states @ w["o"][:, 0] + w["k"][0]))
        else:
            best = max(best, float(w["k"][0]))
    return float(sig(best + model.shift))


def test_scores_by_brute_force(spark, texts, monkeypatch):
    """The registered queries' scores on whole tables, against plain loops over passages and windows."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    plain = {"op7_quality": (quality, plain_quality), "op10_toxicity": (toxicity, plain_toxicity)}
    for name, (module, score) in plain.items():
        model, got = module.train(docs, labels), of(getattr(queries, name)(spark, folder))
        rows = docs.collect()
        assert len(got) == len(rows)
        for r in rows[:80] + [max(rows, key=lambda r: len(r["text"]))]:
            assert got[r["doc_id"]]["score"] == pytest.approx(score(model, r["text"].encode()), abs=1e-3), name
            assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)
    long = " ".join(texts).encode()
    assert np.allclose(quality.passages(long), quality.passages(long, 4000), atol=1e-5)
    whole = toxicity.words(long)
    pieces = [tuple(p[i : i + toxicity.WINDOW]) for p in toxicity.stretches(long, 3000) for i in range(0, max(1, len(p) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)]
    assert pieces == [tuple(whole[i : i + toxicity.WINDOW]) for i in range(0, len(whole) - toxicity.WINDOW + toxicity.STEP, toxicity.STEP)]
    assert model.score([long])[0] == pytest.approx(max(model.score([b" ".join(p) for p in pieces])), abs=1e-4)


def test_sample_has_one_row_for_a_key(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    rows = learning.labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r["doc_id"], r["_label"]) for r in rows) == [(1, 1), (2, 0), (3, 0)]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_odd_rows(spark, odd, empty, module):
    label = "quality" if module is quality else "toxic"
    score = module.score_quality if module is quality else module.score_toxicity
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = score(odd, module.train(odd, none)).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {1.0 if module is quality else 0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    model = module.train(odd, some)
    rows = score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert score(empty, model).count() == 0


# op8


@pytest.mark.parametrize("rows", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(rows):
    p = sharding.Permutation(rows)
    moved = p(np.arange(rows))
    assert sorted(moved.tolist()) == list(range(rows)) and (p(moved, back=True) == np.arange(rows)).all()


def test_shards(spark, documents, odd, empty):
    df = spark.createDataFrame(documents, "doc_id long, text string, source string")
    rows = sharding.shard_rows(df).collect()
    counts = np.bincount([r["shard"] for r in rows], minlength=16)
    assert counts.max() - counts.min() <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    text = {d[0]: d[1].encode() for d in documents}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None for r in rows)
    p = sharding.Permutation(len(rows))
    assert all(p(np.array([r["row_number"]]))[0] == r["slot"] * 16 + r["shard"] for r in rows)
    got = sharding.shard_rows(odd).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] == 1} == {1}
    assert sharding.shard_rows(empty).count() == 0


# op9


def brute_components(prints, radius=3):
    keys, up = list(prints), {k: k for k in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_components(spark, documents, monkeypatch):
    near = [(1000 + i, d[1].replace(" the ", " a ", 1), d[2]) for i, d in enumerate(documents[:40])] + [(2000 + i, d[1], d[2]) for i, d in enumerate(documents[:10])]
    every = [*documents, *near]
    prints = {}
    for key, text, _ in every:
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), seed=42) for j in range(max(1, len(w) - 2))] if w else []
        prints[key] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    want = brute_components(prints)
    df = spark.createDataFrame(every, "doc_id long, text string, source string")
    for shard in (4096, 2):  # the second cuts almost every shard into slices
        monkeypatch.setattr(simhash, "SHARD", shard)
        got = of(simhash.near_duplicates(df))
        assert {k: r["component_id"] for k, r in got.items()} == want
        assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}


def test_tree_finds_what_a_scan_finds():
    draw = np.random.default_rng(6)
    values = [int(v) for v in draw.integers(0, 1 << 12, size=300)]
    tree = simhash.BKTree(3)
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v)) == sorted(u for u in values if (u ^ v).bit_count() <= 3)


def test_near_duplicates_are_checked_on_whole_texts(spark):
    """Pairs just at 0.8 and just under it."""
    rows, similar = [], set()
    for i in range(60):
        words, cut = [f"w{i}x{k}" for k in range(604)], 66 + i % 2  # of 600 shingles, 66 differ at 0.802 and 67 at 0.799
        rows += [(2 * i, " ".join(words).encode()), (2 * i + 1, " ".join(words[:-cut] + [f"y{i}x{k}" for k in range(cut)]).encode())]
        if cut == 66:
            similar.add(2 * i + 1)
    texts = spark.createDataFrame(rows, "same long, body binary")
    pairs = spark.createDataFrame([(2 * i + 1, 2 * i) for i in range(60)], "a long, b long")
    assert {r["a"] for r in simhash.alike(pairs, texts).collect()} == similar


@pytest.mark.parametrize("shard", [4096, 7])
def test_near_duplicates_lose_no_pair(spark, monkeypatch, shard):
    """Contiguous changes, chains, and a shingle that every text has: the groups are those of brute force."""
    rng, texts = np.random.default_rng(5), []
    for i in range(40):
        words = [f"w{k}" for k in rng.integers(0, 3000, rng.integers(60, 400))]
        n = len(words)
        texts += [words, words + [f"e{i}x{k}" for k in range(n // 5)], words[n // 10 :], words[: n - n // 12] + [f"r{i}x{k}" for k in range(n // 12)]]
        texts += [words[n // 6 :] + [f"c{i}x{k}" for k in range(n // 6)]]
    texts = [["one", "line", "that", "all", "hold"] + t for t in texts] + [["one", "line", "that", "all", "hold", f"s{i}"] for i in range(20)]
    sets = [simhash.shingle_set(" ".join(t).encode()) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    assert 40 < len(set(group)) < 120
    monkeypatch.setattr(simhash, "SHARD", shard)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["group"] for r in simhash.near_duplicate_documents(df).collect()} == dict(enumerate(group))


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 1 and by[5]["component_id"] == 4
    assert simhash.near_duplicates(empty).count() == 0
    named = simhash.near_duplicate_documents(odd).collect()
    assert {r["doc_id"]: r["group"] for r in named} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 7: 7}
    assert simhash.near_duplicate_documents(empty).count() == 0


def test_components_of_a_chain(spark):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[91] == 90

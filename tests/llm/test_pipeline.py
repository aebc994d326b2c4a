"""The pipeline's stages, each on its own input."""

import collections
import re

import pytest

import corpus_pipeline
from waymark.llm import mixing
from waymark.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of every stage over the smallest tables, with copies planted among the documents."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    near = docs.where("doc_id < 30").selectExpr("doc_id + 1000 as doc_id", "regexp_replace(text, '^[^ ]+ ', 'Zebra ') as text", "lang", "source", "n_chars")
    same = docs.where("doc_id < 10").selectExpr("doc_id + 2000 as doc_id", "text", "lang", "source", "n_chars")
    docs = written(docs.unionByName(near).unionByName(same).unionByName(same), "planted")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "stage")
        out.append((name, docs))
    return {name: df.toPandas() for name, df in out}, [name for name, _ in out]


def test_columns_and_order(stages):
    rows, names = stages
    assert names[1:] == [s[0] for s in corpus_pipeline.STAGES] and len(names) == 6
    assert all(list(rows[n].columns) == COLUMNS for n in names[:-1])
    assert set(rows[names[-1]].doc_id) == set(rows[names[-2]].doc_id)


def test_filters_only_drop(stages):
    rows, names = stages
    for a, b in zip(names[:3], names[1:4]):
        assert set(rows[b].doc_id) <= set(rows[a].doc_id)
    assert len(rows[names[2]]) > 0.5 * len(rows[names[0]])


def test_one_of_each_group_stays(stages):
    rows, names = stages
    before, after = rows[names[2]], rows[names[3]]
    shingles = {}
    for key, text in zip(before.doc_id, before.text):
        w = text.encode().lower().split()
        shingles[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    keys = sorted(shingles)
    kept = list(after.doc_id)
    assert len(kept) == len(set(kept))
    by_shingle = collections.defaultdict(set)
    for k in keys:
        for s in shingles[k]:
            by_shingle[s].add(k)
    alike = collections.defaultdict(set)
    for k in keys:
        for other in set().union(*(by_shingle[s] for s in shingles[k])) if shingles[k] else ():
            if other != k and len(shingles[k] & shingles[other]) >= 0.8 * len(shingles[k] | shingles[other]):
                alike[k].add(other)
    pairs = [(a, b) for a in alike for b in alike[a] if a < b]
    both = [p for p in pairs if p[0] in set(kept) and p[1] in set(kept)]
    assert len(pairs) > 20 and len(both) <= 0.02 * len(pairs)
    assert not [k for k in keys if k not in set(kept) and not any(o < k for o in alike[k]) and not alike[k]]


def test_mix_takes_whole_documents(stages):
    rows, names = stages
    before, after = rows[names[3]], rows[names[4]]
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in zip(before.doc_id, before.text)}
    copies = collections.Counter(after.doc_id)
    assert max(copies.values()) <= mixing.MOST_REPEATS
    total = sum(size.values())
    assert sum(size[k] * n for k, n in copies.items()) == pytest.approx(1.5 * total, rel=0.2)


def test_texts_of_one_id_are_told_apart(spark):
    """Two texts of one id both stay, a copy under another id goes, rows without an id stay."""
    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(5, one), (5, two), (5, two), (9, one + " more"), (None, one), (None, one)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert collections.Counter(got) == collections.Counter([(5, one), (5, two), (None, one), (None, one)])


def test_mix_keeps_the_rows_it_chose(spark):
    """Rows without an id or with one id: each is placed by its own size and source, and copies lie apart."""
    rows = [(None if k % 2 else 7, " ".join([f"w{k}"] * (1 + k % 9)), "en", "large" if k % 10 else "small", 9 - k % 9) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    names = {r[1]: r[3] for r in rows}
    copies = collections.Counter(got)
    assert all(copies[t] == 2 for t, s in names.items() if s == "small")
    assert max(copies.values()) <= 2 and not any(a == b for a, b in zip(got, got[1:]))
    words = sum(len(r[1].split()) for r in rows)
    assert sum(len(t.split()) for t in got) == pytest.approx(1.5 * words, abs=20)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

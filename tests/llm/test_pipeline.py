"""Stages of the pipeline against brute force, and registered queries against their SQL twins."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as pipeline
from graphweft.llm import mixing, registry
from tests.llm.fixtures import SCHEMA, corpus, sentence
from tests.llm.test_documents import closure, shingle_set

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_columns_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeated_strings", "mixing", "packing"]


def test_language_keeps_what_has_letters(spark, docs):
    got = pipeline.by_language(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter(r.text for r in got.collect())
    for _, text, *_ in corpus():
        has = any(c.isalpha() for c in text or "")
        assert (kept[text] > 0) == has
    assert all(r.lang for r in got.collect())


def test_near_duplicates_leave_one(spark, docs):
    got = pipeline.without_near_duplicates(spark, docs, "").collect()
    sets = {r[0]: shingle_set(r[1]) for r in corpus() if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = closure(sets, links)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({part[d] for d in sets})
    assert sum(r.doc_id is None for r in got) == 2


def test_repeats_go_and_the_rest_stays(spark, docs):
    got = {r.doc_id: r for r in pipeline.without_repeats(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]), "").collect()}
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    assert got[12].text == texts[12] and got[12].n_chars == len(texts[12])
    assert 2 not in got and 3 not in got
    assert all(0 < len(r.text) == r.n_chars for r in got.values())
    assert len(got[8].text) < len(texts[8])


def test_repeated_passages_of_fifty_short_words_go(spark):
    """Passages of 50 words and under 400 bytes, in other letters and on other lines too; 49 words stay."""
    rng = random.Random(4)
    short = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 6))) for _ in range(n)) for n in (50, 60, 49)]
    assert all(len(s) < 400 for s in short)
    around = [sentence(rng, 80) for _ in range(16)]
    forms = [short[0], short[0], short[1], short[1].upper().replace(" ", "\n", 20), short[2], short[2]]
    texts = [f"{around[2 * k]} {s} {around[2 * k + 1]}" for k, s in enumerate(forms)] + [around[12] + " é " * 30, f"{short[0]} ", " x ".join([short[0]] * 3), "ab " * 500]
    docs = spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in pipeline.without_repeats(spark, docs, "").collect()}
    want = {k: f"{around[2 * k]}  {around[2 * k + 1]}" for k in range(4)} | {k: texts[k] for k in (4, 5, 6)}
    assert {k: got.get(k) for k in want} == want and 7 not in got and 9 not in got
    # all words of all runs of 50 words that repeat, and no others, but for byte strings of 400
    words = {k: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for k, t in enumerate(texts)}
    seen = Counter(tuple(w[i : i + 50]) for w in words.values() for i in range(len(w) - 49))
    for k, w in words.items():
        gone = {j for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}
        assert [v.lower() for v in got.get(k, "").split()] == [v for j, v in enumerate(w) if j not in gone]


def test_mixing_repeats_documents(spark, docs):
    got = Counter(r.doc_id for r in pipeline.mixed(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]), "").collect())
    assert got and max(got.values()) <= 2 and set(got) <= {r[0] for r in corpus()}


def test_mixing_takes_rows_without_or_with_repeated_ids(spark):
    """Every row as often as the mix takes it, whatever its id; rows of one id may differ in source and text."""
    rows = [*corpus(), (2, "another text of two", "en", "s9", 19), (None, "no id here at all", "fr", None, 17), (None, "nor here", "fr", "s9", 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    want = Counter()
    for r in mix:
        want[r.doc_id, r.size] += r.taken
    got = Counter()
    for r in pipeline.mixed(spark, docs, "").collect():
        n = len((r.text or "").split())
        got[r.doc_id, n] += n
    assert any(k[0] is None and n for k, n in want.items())
    assert +got == +want


def test_near_duplicates_keep_all_texts_of_an_id(spark):
    rows = [(1, "one text of some five words", "en", "s1", 27), (1, "quite another text with the same id", "en", "s1", 35), (1, "one text of some five words", "fr", "s0", 27)]
    got = pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(1, rows[0][1], "en"), (1, rows[1][1], "en")]


def test_whole_pipeline(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and max(r.length + r.offset for r in rows) <= 2048


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in columns) for r in got.collect()), key=repr) == theirs


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11))

"""The registered queries over a folder of tables: odd rows, a text of a megabyte, clashing columns, and empty tables; those with SQL against it."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tarmac.llm.queries import ORACLE_SQL, QUERIES

from .test_llm import ROWS

COLUMNS = {
    "op1_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op2_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op3_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op4_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op5_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op6_bpe_codec": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8_line_dedup": {"doc_id", "n_lines", "n_removed", "kept_sha256"},
    "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op11_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op12_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


def _tables(spark, path, rows):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, `row` string, kept string"
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, "r", "k") for i, t in rows], kind)
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not (t or "").startswith("#")), 0) for i, t in rows if i is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    items = [(1, t) for _, t in rows[:2]] + [(2, None), (3, "four words and no more"), (3, "one two three four"), (None, "a b c")]
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    return _tables(spark, str(tmp_path_factory.mktemp("given")), ROWS)


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(16000))
    assert len(text.encode()) > 1_000_000
    return _tables(spark, str(tmp_path_factory.mktemp("long")), [(1, "a b"), (2, text), (3, text + " end")])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _tables(spark, str(tmp_path_factory.mktemp("empty")), [])


def _by_sql(name, path, names):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS FROM '{path}/{table}.parquet/*.parquet'")
    out = con.sql(ORACLE_SQL[name])
    return sorted(str(tuple(r[out.columns.index(c)] for c in names)) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, given, name):
    df = QUERIES[name](spark, given)
    assert set(df.columns) >= COLUMNS[name]
    names = sorted(COLUMNS[name] - {"kept"})
    got = [tuple(r) for r in df.select(*names).collect()]
    if name not in ("op9_packing", "op12_spelling_variants", "op13_collocations"):
        assert len(got) == len(ROWS)
    if name in ORACLE_SQL:
        assert sorted(map(str, got)) == _by_sql(name, given, names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_long_texts(spark, long, name):
    rows = QUERIES[name](spark, long).collect()
    if name in ("op12_spelling_variants", "op13_collocations"):
        # No phrase of random words is frequent; words are.
        names = sorted(COLUMNS[name])
        assert sorted(str(tuple(r[c] for c in names)) for r in rows) == _by_sql(name, long, names) and bool(rows) == (name == "op12_spelling_variants")
        return
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    if name == "op5_jaccard_join":
        assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert set(df.columns) >= COLUMNS[name] and df.count() == 0


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0

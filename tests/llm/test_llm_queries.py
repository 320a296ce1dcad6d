"""Registered queries: SQL twins, contract columns, the pipeline."""

import hashlib

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from rolefunnel.llm.common import fold_of
from rolefunnel.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels")
COLUMNS = {
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5": ["doc_id", "fingerprint", "component_id"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


@pytest.fixture(scope="module")
def results(spark):
    return {}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, results, name):
    frame = QUERIES[name](spark, FOLDER).toPandas()
    results[name] = frame
    short = name.split("_")[0]
    if short in COLUMNS:
        assert list(frame.columns)[: len(COLUMNS[short])] == COLUMNS[short]
        assert short == "op12" or sorted(frame.doc_id) == sorted(pd.read_parquet(f"{FOLDER}/documents.parquet").doc_id)
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
        want = con.execute(SQL[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(frame.columns)
        left, right = (x[columns].sort_values(["lang", "rank"] if short == "op12" else "doc_id").reset_index(drop=True) for x in (want, frame))
        pd.testing.assert_frame_equal(left, right, check_dtype=False)


def test_held_out_quality_and_language(spark):
    """Held-out rows of a larger table: most quality labels and languages are right."""
    folder = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    found = QUERIES["op2_quality_rules"](spark, folder).toPandas().merge(labels, on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    found = QUERIES["op7_language_crf"](spark, folder).toPandas().merge(docs, on="doc_id")
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_stages_one_by_one(spark):
    """Each stage on what the one before kept, against the rule it follows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        assert docs.columns == columns
        kept[name] = docs.toPandas().set_index("doc_id")
    first, near, cut, clean = kept.values()
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").set_index("doc_id")
    good = labels.index[labels.quality == 1]
    assert set(good) & set(pd.read_parquet(f"{FOLDER}/documents.parquet").doc_id) - set(first.index) == set()
    assert set(near.index) <= set(first.index) and not near.text.duplicated().any()
    assert list(cut.index.sort_values()) == list(near.index.sort_values())
    assert (cut.text.str.len() == cut.n_chars).all() and (cut.n_chars <= near.n_chars[cut.index]).all()
    assert set(clean.index) <= set(cut.index)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas().set_index("doc_id")
    assert set(last.index) == set(clean.index)
    assert all(last.decoded_sha256[k] == hashlib.sha256(clean.text[k].encode()).hexdigest() for k in clean.index)
    whole = corpus_pipeline.run(spark, FOLDER).toPandas().set_index("doc_id")
    assert (whole.decoded_sha256.sort_index() == last.decoded_sha256.sort_index()).all()


def test_stages_on_awkward_tables(spark):
    rows = [(1, None, "en", "s", 0, 7), (None, "no id here", None, None, 1, 7), (2, "", "en", "s", 0, 7), (3, "long " * 30_000, "en", "s", 1, 7), (3, "long " * 30_000, "en", "s", 1, 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int"
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = table.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, FOLDER).collect(), table.schema)
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", "id"]
        assert table.count() <= n
        assert n == 0 or table.where("doc_id is null").count() == 1
        corpus_pipeline.STAGES[-1][1](spark, table, FOLDER).collect()


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", fold_of("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)

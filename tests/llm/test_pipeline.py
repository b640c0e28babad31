"""The pipeline's stages against plain versions, and the registered queries against SQL."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from quillspark.llm.queries import ORACLE, QUERIES
from quillspark.llm.store import table, written
from tests.llm.test_operators import ALNUM_WORDS, classes, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    items = [words(r["text"], ALNUM_WORDS) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "token_output":
            assert out.columns == docs.columns
        if name == "language_id":
            assert all(re.search(r"[^\W\d_]", r["text"]) for r in after.values()) and len(after) >= 0.98 * len(before)
        if name == "near_duplicates":
            want = classes([(r["doc_id"], r["text"]) for r in before.values()], 5)
            assert set(after) == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            windows = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
            for r in after.values():
                w = words(r["text"], ALNUM_WORDS)
                assert r["text"] != before[r["doc_id"]]["text"] or not any(tuple(w[i : i + 13]) in windows for i in range(len(w) - 12))
        if name == "source_mixture":
            size = lambda rows: sum(len(r["text"].split()) for r in rows.values())
            assert abs(size(after) - corpus_pipeline.SHARE * size(before)) <= 2
        if name == "token_output":
            assert set(after) == set(before)
        docs, before = out, after
    run = {r["doc_id"]: tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {i: tuple(r) for i, r in before.items()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, own_1 string, key long, take int, kept_id int, lang_pred int, bench_hits int"


def odd_rows():
    text = "it was the best of times it was the worst of times and so it went on for ever"
    tail = ("x", 1, 2, 3, 4, 5)
    rows = [(1, text, "en", "src1", len(text), *tail)] * 3 + [(2, None, "en", "src1", None, *tail), (3, "", None, None, 0, *tail), (None, text + " again", "en", None, 5, *tail), (4, "äh " * 400_000, "de", "src2", 9, *tail), (5, "12 34", "de", "src2", 5, *tail)]
    return rows + [(10 + k, f"{text} number {k} with words of its own {k * 7} {k * 11} {k * 13} and some more {k * 17} {k * 19} {k * 23}", "en", f"src{k % 4}", 9, *tail) for k in range(12)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    out = stage(spark, docs, SF).collect()
    ids = sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
    if name != "token_output":
        assert all(r.asDict().keys() == set(docs.columns) and r["key"] == 1 and r["kept_id"] == 3 and r["lang_pred"] == 4 and r["bench_hits"] == 5 and r["own_1"] == "x" for r in out)
    if name == "language_id":
        assert not {2, 3, 5} & set(ids) and ids.count(1) in (0, 3)
    if name == "near_duplicates":
        assert ids.count(1) == 1 and {2, 3, 4, 5} <= set(ids) and sum(r["doc_id"] is None for r in out) == 1
    if name == "decontamination":
        assert len(out) == len(rows)
    if name == "source_mixture":
        total = sum(len((r[1] or "").split()) for r in rows if r[0] is not None)
        assert sum(len(r["text"].split()) for r in out) == int(total * corpus_pipeline.SHARE)
    if name == "token_output":
        assert ids == sorted(r[0] for r in rows if r[0] is not None)
        assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (2, 3))
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_ambiguous_documents_may_stay(spark):
    docs = table(spark, SF, "documents")
    some, every = (corpus_pipeline.language_id(spark, docs, SF, drop_ambiguous=x).count() for x in (True, False))
    assert some <= every

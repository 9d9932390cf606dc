"""The registered queries of the subpackage, the pipeline, and the entry without it."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from paritas.llm import common
from paritas.llm.oracle import ORACLE
from paritas.llm.queries import REGISTRY
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

ROOT = os.path.dirname(os.path.abspath(E.__file__))


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in REGISTRY if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in REGISTRY and set(REGISTRY) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(sp, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](sp, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]


def test_jaccard_query(sp):
    from tests.llm.test_jaccard import order, plain
    docs = [(r.doc_id, r.text) for r in common.table(sp, SF_SMALL, "documents").collect()]
    got = [(r.doc_id, r.class_id, r.copy_id, r.n_links, r.n_class_links) for r in REGISTRY["op7_ngram_jaccard"](sp, SF_SMALL).collect()]
    assert order(got) == order(plain(docs))


@pytest.mark.parametrize("name", ["op4_toxicity", "op5_personal_data", "op6_pitman_yor", "op9_sampled_pieces", "op10_token_files",
                                  "op11_token_counts"])
def test_one_row_per_document(sp, name):
    n = common.table(sp, SF_SMALL, "documents").count()
    df = REGISTRY[name](sp, SF_SMALL)
    assert df.count() == n == df.select("doc_id").distinct().count()


def test_pipeline_stages_take_effect(sp):
    docs = common.table(sp, SF_SMALL, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(sp, docs, SF_SMALL), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        seen.append(docs.count())
        if name == "personal_data":
            gone = before.join(docs, "doc_id").where(before.text != docs.text).count()
            assert gone > 0 and docs.where("n_chars <> length(text)").isEmpty()
        if name == "near_copies":
            again = common.written(stage(sp, docs, SF_SMALL), name)
            assert again.count() == docs.count()  # no near copies are left
    assert seen[0] > seen[1] > seen[2] == seen[3] > seen[4] > 0.5 * seen[0]
    last = corpus_pipeline.STAGES[-1][1](sp, docs, SF_SMALL)
    assert last.count() == seen[4] and last.where(~F.col("lossless")).isEmpty()


def test_pipeline_on_empty_and_odd_documents(sp):
    rows = [(1, None, "en", "src1", 0), (2, "", None, None, None), (3, "word " * 5, "en", "strange", 25), (3, "word " * 5, "en", "strange", 25)]
    odd = sp.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs, most in ((odd, 4), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(sp, docs, SF_SMALL), name)
        assert corpus_pipeline.STAGES[-1][1](sp, docs, SF_SMALL).count() <= most


def test_entry_without_the_subpackage(tmpdir_path):
    shutil.copytree(os.path.join(ROOT, "paritas"), f"{tmpdir_path}/paritas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmpdir_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmpdir_path, check=True, env=os.environ | {"PYTHONPATH": tmpdir_path})

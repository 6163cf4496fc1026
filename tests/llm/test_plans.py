"""Plans of the operators: no cross joins, native operators without Python, nothing left outside the shared folder."""

import os
import re

import pytest

from marlspike.llm import common, queries
from tests.llm.helpers import corpus, docs_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs_of(spark, corpus(80)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "http://a.org/x", '<a href="http://b.com/">'), (2, "http://b.com/de/", ""), (3, "http://b.com/en/", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_plan(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop|BatchEvalPython", plan)
    if name.split("_")[0] in ("op5", "op9"):
        assert not re.search("Python|Pandas|Arrow", plan)
    table = "pages" if name.startswith("op8") else "documents"
    assert df.count() == spark.read.parquet(f"{folder}/{table}.parquet").count()


def test_contract_columns(spark, folder):
    first = {
        "op1": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op2": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op3": ["doc_id", "held_out", "lang_pred", "score"],
        "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op8": ["page_id", "host", "path", "rule", "verdict"], "op9": ["doc_id", "size", "source_size", "target", "taken"],
        "op10": ["doc_id", "fingerprint", "component_id"],
    }
    for name, f in queries.queries().items():
        n = name.split("_")[0]
        assert f(spark, folder).columns[: len(first.get(n, []))] == first.get(n, []), name


def test_shared_folder(spark, monkeypatch):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = common.shared_path(spark, "x")
    assert path.startswith(common.shared_dir(spark)) and not common.path_exists(spark, path)
    spark.range(1).write.parquet(path)
    assert common.path_exists(spark, path)
    common.delete_path(spark, path)
    assert not os.path.exists(path)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, b_ int")
    assert common.fresh(df, "a", "b_", "b", "c") == ["a_", "b__", "b", "c"]

"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from specweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple("" if x is None else repr(round(x, 5)) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(key(r) for r in df.select(columns).collect()) == sorted(map(key, expected))


def equals_sql(spark, folder, name, table):
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = ", ".join(sorted(df.columns))
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    expected = con.sql(f"select {columns} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(key(r) for r in df.select(sorted(df.columns)).collect()) == sorted(map(key, expected))


def test_round_robin_ids_beyond_six_digits(spark, tmp_path):
    spark.createDataFrame([(n, "a part") for n in (7, 999_999, 1_000_000, 1_000_001, 12_345_678)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    equals_sql(spark, tmp_path, "round_robin_ids", "part")


@pytest.mark.parametrize("name", ["doc_lengths", "index_statistics", "term_df", "tokenize_terms"])
def test_tokens_of_hexadecimal_runs(spark, tmp_path, name):
    texts = ["token 9dc3ac4b", "dc1ac2dc3 ac4", "DC12V ac100dc5", "xdc5 dc\nac7", "dc5\nac6", "0cab39-8ac11dc1d1a2a11dc6572", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    equals_sql(spark, tmp_path, name, "documents")


@pytest.mark.parametrize("name", ["doc_lengths", "index_statistics", "term_df", "tokenize_terms"])
def test_tokens_of_characters_that_folding_changes(spark, tmp_path, name):
    texts = ["12 m² x³ brand™ ﬁne ½ kg", "ＤＣ１２Ｖ ｗide", "İstanbul İdc5 \u212a2 cafe\u0301 naïve ß", "电源适配器 输出5V电压", "5 °C 4°c", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    equals_sql(spark, tmp_path, name, "documents")


@pytest.mark.parametrize("name", ["doc_lengths", "index_statistics", "term_df", "tokenize_terms"])
def test_terms_of_rows_that_share_an_identifier(spark, tmp_path, name):
    rows = [(1, "dc5 the kg 5kg"), (1, "dc5 dc5 a"), (2, None), (None, "x y x"), (None, "x z"), (3, None), (3, "5kg"), (4, ""), (5, "the a an"), (6, "x 5kg x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    equals_sql(spark, tmp_path, name, "documents")


@pytest.mark.parametrize("name", ["lsh_recall", "filtered_knn_modes"])
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_lives_without_the_optional_folders(tmp_path):
    """A copy of the tree without them imports, and registers the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root, to = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "copy"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    say = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n[:2] == 'op' or n == 'pipeline' for n in q))"
    for more in ([], ["corpus_pipeline.py"]):  # the pipeline's file alone does not count either
        for name in more:
            shutil.copy(f"{root}/{name}", to) if os.path.exists(f"{root}/{name}") else None
        out = subprocess.run([sys.executable, "-c", say], cwd=to, env={**os.environ, "PYTHONPATH": str(to)}, capture_output=True, text=True, check=True).stdout
        assert out.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False"]


def test_no_local_folder_off_a_local_session(monkeypatch):
    from types import SimpleNamespace

    from specweave import workspace

    none = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="share"):
        workspace.shared_root(none)


def test_workspaces_close(spark):
    from specweave.workspace import Workspace, size_of

    with Workspace(spark, "closing") as ws:
        df = ws.stage(spark.range(5), "t")
        assert df.count() == 5 and size_of(spark, ws.path) > 0
    with pytest.raises(Exception):
        df.count()

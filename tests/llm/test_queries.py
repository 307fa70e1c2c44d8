"""The registered queries: on the smallest tables against SQL, and on empty ones."""

import os

import duckdb
import pytest

from tasklattice.llm import queries

from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(f"{folder}/{f}")
    return folder


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    # an overall figure is one row of any table
    assert queries.QUERIES[name](spark, empty).count() == (name == "p1_overall")


@pytest.mark.parametrize("name", [n for n in queries.SQL])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    cur = c.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(tuple(plain(r[names.index(k)]) for k in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()) == want


def test_found_queries_have_the_stated_columns(spark):
    stated = {"p1_found": ["candidate_id"], "p2_found": ["group_id", "task_id"], "p3_found": ["task_id", "candidate_id"], "p4_found": ["task_id_a", "task_id_b"], "p5_found": ["task_id_a", "task_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    for name, columns in stated.items():
        assert queries.QUERIES[name](spark, DATA).columns == columns

import duckdb
import pytest

from quizloom.llm.common import prepare

SF = "/root/testdata/sf0.001"
LLM_TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in LLM_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same(llm, con):
    """Holds a query against its SQL on all columns, rows in any order."""
    def check(query, sql):
        got = query(llm, SF)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
        assert rows == sorted(map(tuple, want.fetchall()), key=repr)
    return check


#: Texts of every awkward kind, with a column that clashes with inner names.
DOCS = "doc_id long, text string, lang string, source string, n_chars int, __id string, __hits string, tokens string"


@pytest.fixture()
def docs(llm):
    def make(rows):
        return llm.createDataFrame([(i, t, l, "s", None, "x", "y", "z") for i, t, l in rows], DOCS)
    return make

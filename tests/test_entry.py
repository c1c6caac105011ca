import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from termweave.plans.workload import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, con, name):
    mine, plain = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(mine.columns) == sorted(plain.columns)
    assert len(mine) > 0 and rows(mine) == rows(plain)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


WITHOUT = """
import importlib.abc, sys

class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("termweave.llm"):
            raise ModuleNotFoundError(name, name="termweave.llm")

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "label_lookup" in e.queries() and "pipeline" not in e.queries()
"""


def test_library_stands_without_the_corpus_operators():
    """Nothing but the entry module knows the llm package, and that one does without it."""
    subprocess.run([sys.executable, "-c", WITHOUT], check=True, cwd=entry.__file__.rsplit("/", 1)[0])

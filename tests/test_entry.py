import importlib
import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_text_subpackage():
    import subprocess
    import sys

    code = "import graphloom.plans.registry, sys; sys.exit(any(m.startswith('graphloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(__spark_entry__.__file__)).returncode == 0
    importlib.import_module("graphloom.containers")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry_and_references_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("outlines", "package_contents", "provenance", "course_nodes", "course_edges", "concept_registry"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in ("p3_found", "p5_found", "p5_hierarchy", "gate_nodes", "graph_components"):
        df = __spark_entry__.queries()[name](spark, SMALL)
        columns = sorted(df.columns)
        own = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
        other = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert own == sorted(tuple(str(x) for x in r) for r in other), name

"""The contract of the entry module, on the smallest tables where they are present."""

import ast
import os
import pathlib

import pytest

ROOT = pathlib.Path(__file__).parent.parent
DATA = "/root/testdata/sf0.001"


def test_the_rest_never_imports_the_llm_part():
    for path in (ROOT / "voxgraph").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) >= {"source", "target", "n_outlets"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["edges_self_removed_window", "bridges", "bin_stats", "attribution_outcomes", "p4_source_profile", "pair_decisions", "merge_evaluation", "applied_predictions"])
def test_queries_against_sql(spark, name):
    import glob

    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {pathlib.Path(p).stem} as select * from '{p}'")
    got = e.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    mine = sorted("|".join(show(r[c]) for c in cols) for r in got.collect())
    cursor = db.execute(e.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted("|".join(show(dict(zip(names, r))[c]) for c in cols) for r in cursor.fetchall())
    assert sorted(names) == cols and mine == theirs

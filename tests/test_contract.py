"""The driver contract: bench.py prints one JSON line; entry/queries/oracle agree."""

import ast
import json
import os
import re
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env, capture_output=True, text=True, timeout=900, check=True,
    ).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["value"] > 0
    assert all(isinstance(v, float) for v in d["queries"].values())


def test_queries_and_oracles_pair_up():
    """Every query of the reference's own operators has SQL; those of the llm
    subpackage (absent where it isn't installed) have it where SQL can say it."""
    q, sql = E.queries(), E.oracle_sql()
    assert all(callable(f) for f in q.values()) and set(sql) <= set(q)
    apart = {k for k in q if k == "pipeline" or re.match(r"op\d+_", k)}
    assert set(q) - apart == set(sql) - apart


def test_without_the_llm_subpackage():
    """The entry module, its queries and the SQL work where the subpackage is not installed."""
    code = """
import importlib.util, sys
found = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name == "tierwise.llm" else found(name, *a)
import __spark_entry__ as E
assert E.queries() and E.oracle_sql() and not [k for k in E.queries() if k.startswith("op") or k == "pipeline"]
assert not [m for m in sys.modules if m.startswith("tierwise.llm") or m == "corpus_pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_llm_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tierwise")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    tree = ast.parse(f.read())
                for node in ast.walk(tree):
                    imported = [x.name for x in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                    imported += [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in x.split(".") or x == "corpus_pipeline" for x in imported), (folder, name)

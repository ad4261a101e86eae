"""The registered queries against their SQL on the small test tables, and the guard of the entry point."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from check_oracles import compare, duck
from cohortry.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(duck(folder), spark, folder, QUERIES[name], ORACLES[name]) == ""


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_point.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names


def test_library_stands_without_this_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('cohortry.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, p=None: None if n.startswith(('cohortry.llm', 'corpus_pipeline')) else real(n, p)\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op1') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))\n"
    ) % str(ROOT)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 81

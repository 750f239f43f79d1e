import os
import shutil
import subprocess
import sys

import pytest

from strandmill.plans import em, model_queries  # noqa: F401
from strandmill.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, ROOT


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, same, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["em_fit", "em_fit_adm", "em_fit_pairs"])
def test_fits_are_whole(spark, monkeypatch, name):
    found, fit = [], em.fit
    monkeypatch.setattr(em, "fit", lambda *a, **b: found.append(fit(*a, **b)) or found[-1])
    rows = QUERIES[name](spark, DATA).collect()
    assert found[0].converged
    if name == "em_fit_pairs":
        assert {r["d"] for r in rows} == set(range(-3, 9))


@pytest.mark.parametrize("gone", [["strandmill/llm", "tests/llm"], ["strandmill/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    """The entry registers all other queries; an empty folder left behind is no package."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
            path.mkdir()
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.splitlines()
    assert out == [" ".join(sorted(QUERIES)), " ".join(sorted(ORACLE_SQL))]

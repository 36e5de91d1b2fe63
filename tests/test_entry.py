import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def _queries(blocked):
    code = f"import sys\nfor x in {blocked!r}: sys.modules[x] = None\nimport __spark_entry__ as e\nprint(*sorted(e.queries()))\nprint(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip().split("\n")
    return out[-2].split(), out[-1].split()


def test_missing_libraries_take_only_what_needs_them():
    names, sql = _queries(["public_tokenizers", "regex"])
    assert "recent_form" in names and "pipeline" not in names and "recent_form" in sql


def test_without_the_corpus_operators_all_else_is_there():
    names, sql = _queries(["statloom.llm", "corpus_pipeline"])
    assert not [x for x in names if x.startswith("op") and x[2].isdigit()] and "pipeline" not in names
    assert set(sql) <= set(names) and len(names) > 80

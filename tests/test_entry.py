import ast
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["byte", "n"] and df.count() == 20


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_module_knows_the_llm_package():
    for path in REPO.glob("cairn/**/*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), path

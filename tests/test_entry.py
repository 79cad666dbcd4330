"""The driver's contract, with and without the parts that may be absent."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in ("pixelmill.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and len(q) > 60 and not any(n.startswith("op") and n[2].isdigit() for n in q) and "pipeline" not in q
"""


def test_entry_works_without_the_optional_parts():
    assert subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT).returncode == 0


def test_every_text_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    if Path(entry.SF_SMALL).is_dir():
        out = entry.entry(spark)
        assert out.columns == ["expected", "strips", "exact", "found", "accuracy", "passed"] and out.count() > 0

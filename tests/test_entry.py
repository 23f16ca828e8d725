import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the small tables are not here")
def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "rec_id" and df.count() > 0


def test_imports_without_the_training_data_operators(tmp_path):
    """The rest works where the llm folders and corpus_pipeline.py are gone."""
    import shutil

    shutil.copytree(ROOT / "pulsemill", tmp_path / "pulsemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_part(tmp_path):
    """With the llm folders and corpus_pipeline.py gone, the rest imports and has its queries."""
    (tmp_path / "marlspike").mkdir()
    for p in (ROOT / "marlspike").iterdir():
        if p.name != "llm":
            (tmp_path / "marlspike" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'q_join_multi' in q and 'pipeline' not in q; print(len(q))"
    entry = (ROOT / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 60


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

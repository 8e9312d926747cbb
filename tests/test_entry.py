"""The entry point stands without the training-data operators."""

import subprocess
import sys

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('quarry.llm') or name == 'corpus_pipeline':
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and len(e.queries()) > 30 and set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') for n in e.queries())
"""


def test_imports_without_llm():
    subprocess.run([sys.executable, "-c", CODE], check=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:3] == ["query_id", "place", "chunk_id"] and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60 and all(callable(f) for f in q.values())


def test_without_the_optional_parts():
    """The entry imports and keeps the other queries where the subpackage and the pipeline are gone."""
    code = "import sys; sys.modules['quillgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'edge_upsert' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].degree >= rows[-1].degree

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['opportune.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'escalation_edges' in q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_never_imports_the_optional_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "opportune")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert "opportune.llm" not in text and "from ..llm" not in text and "from .llm" not in text

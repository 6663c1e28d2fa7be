import subprocess
import sys

from roots import ROOT

WITHOUT = """
import sys
for name in {blocked}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert {{"all_matches", "digest"}} <= names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) <= names
"""


def test_the_library_stands_without_the_training_data_part():
    for blocked in (["corpus_pipeline", "gazewatch.llm"], ["gazewatch.llm"], ["corpus_pipeline"]):
        done = subprocess.run([sys.executable, "-c", WITHOUT.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr

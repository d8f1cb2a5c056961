"""The entry loads the core queries whatever becomes of the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys, warnings
sys.path.insert(0, {root!r})
for name in {absent!r}:
    sys.modules[name] = None  # as if it were not installed
warnings.simplefilter("ignore")
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len([n for n in names if not n.startswith("op") and n != "pipeline"]), any(n.startswith("op") for n in names))
"""


@pytest.mark.parametrize("absent", [["zstandard"], ["tiktoken"], ["public_tokenizers"], ["shardloom.llm.queries"], ["shardloom.llm", "corpus_pipeline"]])
def test_core_queries_load_without_the_corpus_operators(absent):
    script = SCRIPT.format(root=str(ROOT), absent=absent)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr[-1500:]
    count, corpus = done.stdout.split()
    assert int(count) > 190 and corpus == "False"

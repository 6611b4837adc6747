"""The driver's contract where the training-data operators, or what they import, are missing."""

import subprocess
import sys

import pytest

import __spark_entry__

CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {missing!r} or name in {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "topk_l2" in q and set(o) <= set(q), set(o) - set(q)
assert not [n for n in q if n.startswith("op") or n == "pipeline"]
"""


@pytest.mark.parametrize("missing", [["vectide.llm"], ["tiktoken"], ["public_tokenizers"], ["xxhash"]])
def test_the_other_queries_work_without(missing):
    root = __spark_entry__.__file__.rpartition("/")[0]
    subprocess.run([sys.executable, "-c", CODE.format(missing=missing, root=root)], check=True, timeout=120)

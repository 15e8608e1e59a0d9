"""The driver contract without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

HERE = str(Path(__file__).resolve().parents[2])


@pytest.mark.parametrize("missing", ["gridweave.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_base_loads_alone(missing):
    code = f"import sys; sys.path.insert(0, {HERE!r}); sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert 'op1_bpe' not in q and 'pipeline' not in q and len(q) > 100 and set(o) <= set(q) and e.NOT_LOADED"
    subprocess.run([sys.executable, "-c", code], check=True)

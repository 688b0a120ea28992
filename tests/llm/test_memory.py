import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

_TASK = """
import ctypes, re, types
import numpy as np, pyarrow as pa
import public_tokenizers
from cohortframe.llm import tokenfile as T

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

T.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
vocabulary = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
task = T._tokenise(types.SimpleNamespace(value=vocabulary), 1, 1 << 18, 50_000)

def batches(n):
    r = np.random.default_rng(n)
    for k in range(n):
        names = ["".join(map(chr, r.integers(97, 123, 6))) for _ in range(3000)]
        texts = [" ".join(names[i] for i in r.integers(0, 3000, 2000)).encode() for _ in range(300)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(texts, pa.binary())], ["key", "text"])

list(map(len, task(batches(6))))
after = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(after - held())
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory of a process is read from /proc")
def test_a_worker_gives_memory_back_after_a_task():
    env = os.environ | {"PYTHONPATH": f"{Path(__file__).parents[2]}:{os.environ.get('PYTHONPATH', '')}"}
    free = float(re.findall(r"\S+", subprocess.run([sys.executable, "-c", _TASK], env=env, capture_output=True, text=True, check=True).stdout)[-1])
    assert free < 20, free


def test_tasks_of_a_worker_share_the_pieces(monkeypatch):
    import pickle
    import types

    import public_tokenizers
    import pyarrow as pa
    from pyspark import cloudpickle

    from cohortframe.llm import tokenfile as T

    made = []
    monkeypatch.setattr(T.Pieces, "__init__", lambda self, vocabulary, make=T.Pieces.__init__: made.append(1) or make(self, vocabulary))
    T._kept.clear()
    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    sent = cloudpickle.dumps(T._tokenise(types.SimpleNamespace(value=vocabulary), 1, 1 << 18, 50_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"one two", b"two three"])], ["key", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    rows = [pa.Table.from_batches(pickle.loads(sent)(iter([batch]))).to_pylist() for _ in range(2)]  # as a worker reads each task
    assert rows[0] == rows[1] and len(made) == 1

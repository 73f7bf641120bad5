"""Functions that run in Python workers must not need the package there."""

import subprocess
import sys

from pyspark import cloudpickle

from twinseek.functions.fulltext import _group_positions, _normaliser


def test_worker_functions_carry_their_code(tmp_path):
    normalise = _normaliser("english")

    def work(lists):
        return _group_positions(lists, normalise).to_pylist()

    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps(work))
    code = (
        "import pickle, pyarrow as pa; f = pickle.load(open('f.bin', 'rb'));"
        "print(f(pa.array([['the', 'cats', 'cat'], None])))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "[[{'lexeme': 'cat', 'positions': [2, 3]}], []]", done.stderr

"""Files that end the process which walks them."""

import os
import signal
import subprocess
import sys
import time

from stratalens.operators import engine, guard
from stratalens.plans.carriers import PNG_HEAD, PNG_TAIL


def awkward(kind, data):
    if b"kill" in data:
        os.kill(os.getpid(), signal.SIGKILL)
    if b"raise" in data:
        raise IndexError(kind)
    if b"hang" in data:
        time.sleep(600)
    return len(data), None


def test_one_bad_row_of_many_is_refused_and_all_others_are_kept():
    words = [b"a" * i for i in range(40)]
    words[3], words[17], words[18], words[39] = b"raise", b"kill", b"kill it", b"raise it"
    rows = [("x", w) for w in words]
    expected = [("walk-ended", "refused") if b"kill" in w else ("walk-failed", "refused") if b"raise" in w else (len(w), None) for w in words]
    assert guard.isolated(awkward, rows, lambda why: (why, "refused")) == expected
    assert guard.isolated(awkward, [], lambda why: why) == []
    assert guard.isolated(awkward, [("x", b"hang"), ("x", b"ab")], lambda why: why, seconds=1) == ["walk-unfinished", (2, None)]


SCRIPT = """
import os, signal, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from stratalens.operators import engine
from stratalens.plans.carriers import PNG_HEAD, PNG_TAIL

PNG = bytes.fromhex(PNG_HEAD + PNG_TAIL)

def deadly(kind, data):
    if b"kill" in data:
        os.kill(os.getpid(), signal.SIGKILL)
    return engine.walk_file(kind, data)

spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = [(str(i), f"{i}.png", PNG + (b"kill" if i == 57 else b"")) for i in range(200)]
files = spark.createDataFrame(rows, "file_id string, path string, content binary").repartition(4)
out = engine.parsed(files, work=deadly).selectExpr("file_id", "size(segments) AS n", "error.detail AS why").collect()
plain = {r.n for r in out if r.why is None}
print("RESULT", len(out), sorted(r.file_id for r in out if r.why), {r.why for r in out if r.why}, len(plain))
"""


def test_a_file_that_ends_the_worker_costs_its_own_results_only(tmp_path):
    """In a session whose tasks are repeated, as a cluster's are."""
    (tmp_path / "run.py").write_text(SCRIPT)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, tmp_path / "run.py", root], capture_output=True, text=True, timeout=300)
    assert "RESULT 200 ['57'] {'walk-ended'} 1" in run.stdout, run.stdout + run.stderr[-3000:]


def test_files_walked_apart_give_the_same_rows(spark):
    rows = [("a", bytes.fromhex(PNG_HEAD + PNG_TAIL)), ("b", bytes.fromhex(PNG_HEAD)), ("c", b"no format"), ("d", None), ("e", b"")]
    files = spark.createDataFrame(rows, "file_id string, content binary")
    near, apart = (engine.parsed(files, every=True, apart=x).orderBy("file_id").collect() for x in (False, True))
    assert near == apart and len(near) == 5


def test_batches_are_walked_in_lots():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"n": list(range(n))}) for n in (2_500, 0, 1_000)]
    assert [b.num_rows for b in guard.lots(batches)] == [1_000, 1_000, 500, 1_000]
    assert [n for b in guard.lots(batches[:1]) for n in b.column(0).to_pylist()] == list(range(2_500))

import subprocess
import sys

import pyarrow as pa

from streamql.llm import common

#: What a worker keeps (MB) after a task over batches of 10,000 texts of 2 KB, as Spark sends them; a process of its own, as it sets allocators.
TASK = """
import re
import pyarrow as pa
from streamql.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def work(batches):
    for b in batches:
        assert b.num_rows <= common.SLICE
        yield pa.RecordBatch.from_arrays([pa.array([t * 2 for t in b.column(0).to_pylist()])], names=["text"])

schema = pa.schema([("text", pa.string())])
sink = pa.BufferOutputStream()
batch = pa.record_batch([pa.array([f"{i:08}" * 250 for i in range(10_000)])], schema=schema)
with pa.ipc.new_stream(sink, schema) as out:
    for _ in range(3):
        out.write_batch(batch)
data = sink.getvalue().to_pybytes()
del sink, out, batch
pa.default_memory_pool().release_unused()
before = held()
read = lambda: (pa.record_batch([pa.array(b.column(0).to_pylist())], schema=schema) for b in pa.ipc.open_stream(data))
rows = sum(b.num_rows for b in common.lean(work)(read()))
print(rows, pa.default_memory_pool().backend_name, held() - before)
"""


def test_a_worker_gives_memory_back_after_a_task():
    rows, pool, kept = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, check=True).stdout.split()
    assert (rows, pool) == ("30000", "system") and float(kept) < 15


def test_lean_gives_all_rows_in_order():
    batches = [pa.record_batch([pa.array(range(n))], names=["x"]) for n in (0, 1, common.SLICE, 3 * common.SLICE + 5)]
    got = [x for b in common.lean(lambda bs: bs)(iter(batches)) for x in b.column(0).to_pylist()]
    assert got == [x for b in batches for x in b.column(0).to_pylist()]

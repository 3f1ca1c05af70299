"""Workers live on between tasks, so what a function of a group has used must go back to the system."""

import subprocess
import sys

CODE = """
import os
import numpy as np, pyarrow as pa
from meshwright.llm import katz, text

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

kept = []
def churn(table):
    held = [np.ones(8192) for _ in range(3000)]  # 64 KB each
    kept.append(held[-1])  # the end of the heap stays in use
    return table

before = resident()
text.tidy_group(churn)(pa.table({"a": [1]}))
print(resident() - before)
"""


def test_memory_goes_back_after_each_group():
    found = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True).stdout
    assert float(found) < 60

"""What a Python worker keeps once its batches are done: Spark holds workers beside the JVM in the same memory."""

import os
import subprocess
import sys

import numpy as np

from korvid.llm import hashing

# A process of its own, as a worker is; the frame only takes down the function that it would map.
WORKER = r"""
import re, random
import pyarrow as pa
from korvid.llm import bpe, near
import public_tokenizers

class Frame:
    sparkSession = sparkContext = property(lambda self: self)
    def selectExpr(self, *columns): return self
    def broadcast(self, value): self.value = value; return self
    def mapInArrow(self, run, schema): self.run = run; return self

def held():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024

r = random.Random(1)
vocabulary = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
def batches(names):
    for _ in range(3):
        texts = [" ".join(r.choices(vocabulary, k=n)) for n in r.choices(range(20, 600), k=4000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([0] * len(texts))][: len(names)], names)

sets, ids = Frame(), Frame()
near.class_table(sets, 5)
bpe.encode_table(ids, public_tokenizers.path("byte_bpe_50k.tiktoken"))
begin = held()
for f, names in ((sets, ["doc_id", "text", "key"]), (ids, ["doc_id", "text"])):
    for _ in f.run(batches(names)):
        pass
print(held() - begin)
"""


def test_workers_give_memory_back():
    got = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    # The encoder, its pieces and one table of powers.
    assert float(got.stdout) < 130


def test_one_table_of_powers():
    hashing._kept.clear()
    long = hashing.powers(1 << 18)
    assert hashing.powers(1 << 16)[0] is long[0]
    for k in (0, 1, 7, (1 << 18) - 1):
        assert int(long[0][k]) == pow(hashing.BASE, k, 1 << 64)
        assert int(long[0][k]) * int(long[1][k]) % (1 << 64) == 1
    other = hashing.powers(1 << 10, hashing.base(3))
    assert int(other[0][3]) == pow(hashing.base(3), 3, 1 << 64) and other[0].dtype == np.uint64
    assert len(hashing.powers(hashing.KEPT + 1)[0]) == hashing.KEPT + 1 and len(hashing._kept[hashing.BASE][0]) == 1 << 18

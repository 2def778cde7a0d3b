"""What a worker holds while postings are dealt out to buckets: a chunk of them, not those of as many texts as come together."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("siftmill.llm")
zstandard = pytest.importorskip("zstandard")
from siftmill.llm import bytetext, jaccard  # noqa: E402


class Broad:
    value = np.empty(0, np.uint64), np.empty(0, np.int64)


def batch(texts: int, words: int) -> pa.RecordBatch:
    rnd, z = random.Random(5), zstandard.ZstdCompressor(level=1)
    made = [z.compress(" ".join(f"w{rnd.randrange(10**8)}" for _ in range(words)).encode()) for _ in range(texts)]
    return pa.RecordBatch.from_arrays([pa.array(range(texts), pa.int64()), pa.array(made, pa.binary())], ["id", "z"])


@pytest.mark.parametrize("hot", [2, 10**9])
def test_a_chunk_ends_within_the_texts_of_a_batch(monkeypatch, hot):
    given = batch(700, 40)
    monkeypatch.setattr(jaccard, "HOT", hot)
    deal = jaccard._blocks(Broad, 100, 80, 4)
    flat = lambda rows: sorted((k, i, n, cap) for b in rows for r in b.to_pylist() for k, i, n, cap in zip(r["keys"], r["ids"], r["ns"], r["caps"], strict=True))
    whole = flat(deal([given]))
    monkeypatch.setattr(jaccard, "CHUNK_POSTINGS", 1000)
    parts = list(deal([given]))
    assert flat(parts) == whole
    one = len(jaccard.keys_of(np.arange(36, dtype=np.uint64), 100, *Broad.value))
    assert max(sum(len(x) for x in b.column("keys")) for b in parts) < 1000 + one


def test_memory_of_a_million_postings():
    given = batch(1000, 250)  # 1,378 postings a text
    deal = jaccard._blocks(Broad, 300, 80, 48)
    bytetext.span_hashes(np.zeros(4096, np.uint8), np.array([0]), np.array([4096]))
    pool = pa.total_allocated_bytes()
    tracemalloc.start()
    rows = arrow = 0
    for b in deal([given]):
        rows += sum(len(x) for x in b.column("keys"))
        arrow = max(arrow, pa.total_allocated_bytes() - pool)
        del b
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1_000_000
    assert peak + arrow < 64e6


def test_batches_end_by_bytes(spark):
    bytetext.small_batches(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = spark.range(0, 900, 1, 1).selectExpr("transform(sequence(1, 5000), x -> x + id) AS a").mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in got) == 900
    assert max(r.size for r in got) < 1.1 * bytetext.BATCH_BYTES

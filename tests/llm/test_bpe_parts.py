"""Long texts are not encoded together: ids and offsets are many times their size."""

import pyarrow as pa

from siftmill.llm import byte_bpe


def test_parts_end_by_rows_and_bytes():
    texts = ["é" * 300_000, None, "", *["x" * 10] * 300, "y" * 3_000_000, "z" * 900_000, "z" * 200_000, "end"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(byte_bpe._parts(b))
    assert pa.Table.from_batches(parts).to_pydict() == b.to_pydict()
    sizes = [[len((t or "").encode()) for t in p.column("text").to_pylist()] for p in parts]
    assert all(len(s) <= byte_bpe.PART_ROWS and (sum(s) <= byte_bpe.PART_BYTES or len(s) == 1) for s in sizes)
    assert list(byte_bpe._parts(b.slice(0, 0))) == []

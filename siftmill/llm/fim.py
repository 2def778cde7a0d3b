"""Fill-in-middle: texts rearranged so that a model learns to fill a gap, by DuckDB inside mapInArrow.

A text is cut into units, `[A-Za-z]+|[^A-Za-z]`; hashes of its id choose the two cuts and the form. Each Arrow batch is registered and
rewritten by SQL. Long texts enter it in pieces of a few kilobytes, which share the batch's buffer: a run of letters that
a cut divides counts once, so units are those of the whole text, and memory follows the pieces at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a piece. DuckDB works on 2,048 of them at a time, and a unit takes 16 bytes there.
PIECE = 4096
#: Bytes of text that are registered at a time, but for a single longer text.
GROUP = 2 << 20

SQL = f"""WITH h AS (SELECT row, text, sha256($seed || ':' || key) AS x, contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR text = '' AS taken FROM doc),
v AS (SELECT row, text, taken, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT row, text, h1, h2, CASE WHEN taken OR h3 % 100 >= $plain_from THEN 'plain' WHEN h4 % 100 < $spm_below THEN 'spm' ELSE 'psm' END AS form FROM v),
p AS (SELECT row, part, text, len(regexp_extract_all(text, '{UNIT}')) AS k, coalesce(regexp_matches(text, '^[A-Za-z]') AND lag(regexp_matches(text, '[A-Za-z]$')) OVER w, false)::BIGINT AS joined
 FROM piece WINDOW w AS (PARTITION BY row ORDER BY part)),
s AS (SELECT row, part, text, sum(k - joined) OVER (PARTITION BY row)::BIGINT AS n, sum(k - joined) OVER (PARTITION BY row ORDER BY part)::BIGINT - k AS before FROM p),
c AS (SELECT s.row, part, n, before, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN form <> 'plain' THEN regexp_extract_all(s.text, '{UNIT}') END AS u FROM s JOIN f ON f.row = s.row),
g AS (SELECT row, any_value(n) AS n, string_agg(array_to_string(list_slice(u, 1, greatest(a - before, 0)), ''), '' ORDER BY part) AS pre,
 string_agg(array_to_string(list_slice(u, greatest(a - before, 0) + 1, greatest(b - before, 0)), ''), '' ORDER BY part) AS mid,
 string_agg(array_to_string(list_slice(u, greatest(b - before, 0) + 1, len(u)), ''), '' ORDER BY part) AS suf FROM c GROUP BY row)
SELECT coalesce(n, 0)::BIGINT AS n, form, length(pre)::BIGINT AS prefix_chars, length(mid)::BIGINT AS middle_chars,
 CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END AS output
FROM f LEFT JOIN g ON g.row = f.row ORDER BY f.row"""


def pieces(text: pa.Array, size: int = PIECE) -> pa.Table:
    """(row, part, text): the non-empty texts in pieces of at most `size` bytes, cut between characters. No bytes are copied."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.diff(off)
    parts = -(-length // size)
    row = np.repeat(np.arange(len(length)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = off[:-1][row] + part * size
    # back to the first byte of a character, which is at most three bytes before
    for _ in range(3):
        inside = np.flatnonzero((part > 0) & ((buf[start] & 0xC0) == 0x80)) if len(start) else []
        start[inside] -= 1
    cuts = np.append(start, off[-1]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts), data)
    return pa.table({"row": pa.array(row, pa.int64()), "part": pa.array(part, pa.int64()), "text": whole})


def _groups(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about GROUP bytes of text each."""
    size = np.array(b.column("size"), np.int64)
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // GROUP)) + 1
    for i, j in zip([0, *cut], [*cut, len(size)], strict=True):
        yield b.slice(i, j - i)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id, n long, form string, prefix_chars long, middle_chars long, output string): one row per row.

    h1 to h4 are the first four groups of 8 hex digits of the SHA-256 of `seed`:id. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) of
    a text's n units, the middle after the larger. The form is psm, spm for h4 % 100 < spm_percent, or plain: for h3 % 100 >= fim_percent,
    an empty text, and a text that holds a marker, which could not be read back.

    Defined cases: a null text is empty; a null id hashes as an empty string; rows that repeat an id get the same hashes; chars are code points, null
    where plain. An empty table gives an empty result; other columns are not read, whatever their names.
    """
    bt.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text.alias("text"), F.octet_length(text).alias("size"))
    made = "n long, form string, prefix_chars long, middle_chars long, output string"
    given = {"seed": seed, "plain_from": fim_percent, "spm_below": spm_percent}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for b in (g for whole in batches for g in _groups(whole)):
                con.register("doc", pa.table({"row": pa.array(np.arange(b.num_rows)), "key": b.column("key"), "text": b.column("text")}))
                con.register("piece", pieces(b.column("text")))
                got = con.sql(SQL, params=given).to_arrow_table().combine_chunks()
                cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
                yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", *got.column_names])

    return src.mapInArrow(bt.tidied(run), f"id {src.schema['id'].dataType.simpleString()}, {made}").withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. No marker can arise where a part meets one, so the first of each kind is the real one."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    between = lambda mark: F.substring_index(body, mark, 1)
    rest = lambda mark: F.substr(body, F.char_length(between(mark)) + len(mark) + 1)
    second = lambda mark: F.substring_index(rest(mark), MIDDLE, 1)
    middle = lambda mark: F.substr(rest(mark), F.char_length(second(mark)) + len(MIDDLE) + 1)
    psm = F.concat(between(SUFFIX), middle(SUFFIX), second(SUFFIX))
    spm = F.concat(second(PREFIX), middle(PREFIX), between(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

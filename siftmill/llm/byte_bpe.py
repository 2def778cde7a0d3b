"""Byte-level BPE over Arrow batches with the tokenizers library, offsets, and decoding.

A text is split by the public pattern; each match is one piece, and merges never cross pieces. Each
distinct piece is encoded by the library once per worker (in a bounded cache) and texts are assembled from pieces,
which gives the same ids as encoding whole texts, at a fraction of the time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt

#: Pieces kept per worker; the cache is emptied before it grows further. Longer pieces are encoded but never kept.
CACHE_PIECES, CACHE_PIECE_CHARS = 400_000, 64
#: Texts that are encoded together, and bytes of them, but for a single longer one: ids and offsets can be many times their size.
PART_ROWS, PART_BYTES = 128, 1 << 20


def byte_chars() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in keep}
    for n, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(0x100 + n)
    return table


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, n in ranks.items():
        out[n] = token
    return out


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of two or more bytes: what merging by rank leaves just before that rank."""
    rank = {t: i for i, t in enumerate(tokens) if t}
    out = []
    for i, t in enumerate(tokens):
        if len(t) < 2:
            continue
        parts = [t[j : j + 1] for j in range(len(t))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda j: rank.get(parts[j] + parts[j + 1], i))
            if rank.get(parts[best] + parts[best + 1], i) >= i:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """One worker's encoder and decoder for a rank file (read on that worker, path is a parameter)."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark tasks are the parallelism
        import regex
        from tokenizers import Tokenizer, models

        self.tokens = load_ranks(path)
        self.table = byte_chars()
        back = {c: b for b, c in self.table.items()}
        text = lambda t: "".join(self.table[b] for b in t)
        vocab = {text(t): i for i, t in enumerate(self.tokens) if t}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=[(text(a), text(b)) for a, b in merges_of(self.tokens)]))
        #: Decoding reads characters back to bytes, so ids inside a split character still give its bytes.
        self.bytes_of = [b""] * len(self.tokens)
        for chars, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in chars)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.ids_of: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not in the cache."""
        # printable ASCII stands for itself, but for the space
        space, todo = self.table[0x20], list(pieces)
        as_chars = [p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self.table) for p in todo]
        for p, e in zip(todo, self.model.encode_batch_fast(as_chars, add_special_tokens=False), strict=True):
            self.ids_of[p] = tuple(e.ids)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, ids as text joined by spaces) of each text. The cache holds CACHE_PIECES pieces and those of the texts at hand."""
        if len(self.ids_of) > CACHE_PIECES:
            self.ids_of.clear()
        found = [self.split(t) for t in texts]
        missing = set().union(*found) - self.ids_of.keys()
        self._learn(missing)
        ids_of, name = self.ids_of.__getitem__, self.names.__getitem__
        for f in found:
            ids = list(chain.from_iterable(map(ids_of, f)))
            yield ids, " ".join(map(name, ids))
        for p in missing:
            if len(p) > CACHE_PIECE_CHARS:
                del self.ids_of[p]

    def encode(self, text: str) -> list[int]:
        return next(iter(list(self.encode_all([text]))))[0]

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """Byte span of each id in the encoded text."""
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(self.bytes_of[i])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: list[int]) -> str:
        """Text of a whole or cut id list; bytes of a character cut at an end become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of PART_ROWS texts and PART_BYTES."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
        if i > start and (i - start >= PART_ROWS or size + n > PART_BYTES):
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n
    if b.num_rows > start:
        yield b.slice(start)


def _map(docs: DataFrame, id_col: str, text_col: str, out: str, names: list[str], all_of: Callable[[list[str]], list[tuple]]) -> DataFrame:
    bt.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b):
                rows = all_of([t or "" for t in part.column("text").to_pylist()])
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                schema = run_schema[1:]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(list(c), t) for c, t in zip(cols, schema, strict=True))], ["id", *names])

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    run_schema = [None, *(kinds[x.strip().split(" ")[1]] for x in out.split(","))]
    return src.mapInArrow(bt.tidied(run), f"id {src.schema['id'].dataType.simpleString()}, {out}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(id, ids array<int>[, starts array<int>, ends array<int>]): token ids and, with `offsets`, byte offsets of every whole text.

    A null text counts as empty: no ids. Strings of special tokens are ordinary text. One row per input row,
    repeated rows included; other columns are not read; an empty table gives an empty result.
    """

    def ids_of(texts: list[str]) -> list[tuple]:
        return [(ids,) for ids, _ in codec(path, pattern).encode_all(texts)]

    def all_of(texts: list[str]) -> list[tuple]:
        c = codec(path, pattern)
        spans = [(ids, c.offsets(ids)) for ids, _ in c.encode_all(texts)]
        return [(ids, [s for s, _ in x], [e for _, e in x]) for ids, x in spans]

    if not offsets:
        return _map(docs, id_col, text_col, "ids array<int>", ["ids"], ids_of)
    return _map(docs, id_col, text_col, "ids array<int>, starts array<int>, ends array<int>", ["ids", "starts", "ends"], all_of)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text_bytes binary, text string): bytes of each id list, and its text with U+FFFD for cut characters.

    Null id lists decode to nothing. Ids out of range raise.
    """
    bt.small_batches(encoded.sparkSession)
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        for b in batches:
            c = codec(path, pattern)
            got = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary()), pa.array([g.decode("utf-8", "replace") for g in got])], ["id", "text_bytes", "text"])

    return src.mapInArrow(bt.tidied(run), f"id {src.schema['id'].dataType.simpleString()}, text_bytes binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids and digests both.

    The same encoder and decoder as `encode` and `decode`, in one pass, so that no ids are shipped between them.
    """

    def all_of(texts: list[str]) -> list[tuple]:
        c = codec(path, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return [(len(ids), digest(text.encode()), digest(c.decode(ids))) for ids, text in c.encode_all(texts)]

    return _map(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], all_of)

"""Packing by power-of-two decomposition.

Each document's ids (with the end id) are cut into pieces whose lengths are powers of two, the
largest first and none above ``max_len``.  A piece is a sequence of its own, filed under the
bucket of its length, so no sequence crosses documents and, as a sequence whose length is a
power of two takes no padding, none is padded.  A training step draws its batch from one
bucket.  The work is one narrow pass over the input: nothing is shuffled, and memory holds one
slice of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import END_ID, default_tokenizer, encoder

MAX_LEN = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"


def lengths_of(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of ``n`` ids: whole ``max_len`` first, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(
    df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, literal: bool = False
) -> DataFrame:
    """One row per piece: its document, place, ids (little-endian unsigned 32-bit), sequence and bucket.

    ``sequence_id`` holds the input partition in its upper bits and a running number below, so
    it is unique without any exchange; ``offset`` is always 0.  ``max_len`` must be a power of two.
    With ``literal`` the strings of special tokens are ordinary text.

    Null, empty and blank texts give one piece that holds the end id alone.  A null id stays
    null.  Repeated rows are packed each on their own, also under one id.  Very long texts give
    as many pieces of ``max_len`` as they need.  An empty table gives no rows, and other columns,
    whatever their names, are not read.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or default_tokenizer()

    def pack(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, next_id = encoder(path, literal), TaskContext.get().partitionId() << 40
        for part in slices(batches, 2048, 1):
            rows: list[tuple] = []
            ids, sizes = tokens.encode(part.column(1), end_id)
            data, begin = ids.astype("<u4").tobytes(), 0
            for doc, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                at = 0
                for length in lengths_of(n, max_len):
                    here = 4 * (begin + at)
                    rows.append((doc, at, length, data[here : here + 4 * length], n, next_id, 0, length.bit_length() - 1))
                    at += length
                    next_id += 1
                begin += n
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(pack, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """What the contract asks of each piece."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")

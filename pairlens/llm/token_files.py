"""Token ids in files of Simple-8b words.

A file image is a byte string: a header, the documents' ids and lengths, the place where each
block's words begin, and 64-bit words.  Ids run through the image without gaps and are cut
into blocks of ``BLOCK`` ids.  A word's top four bits select how many ids its other 60 bits
hold and how wide each is; a selector marks an escape, after which a whole word holds one id
of more than 60 bits.  Blocks do not depend on each other: the encoder takes one word of every
block at a step, the decoder takes all words of one selector at a step, both with numpy.

``write_token_files`` sorts the documents by id over range partitions and writes the images
with Spark's own writer (its commit protocol makes them safe against lost tasks, and any store
that Spark knows will do); ``read_token_files`` reads them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .tokens import END_ID, default_tokenizer, encoder

MAGIC = b"S8BWORD1"
BLOCK = 1024
#: (ids in a word, bits of each), by selector; selector 14 is the escape.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = len(PACKS)
IMAGE_IDS = 1_000_000


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    out = np.ones(len(ids), dtype=np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = (ids >> (out - np.uint8(1)).astype(np.uint64)) >> np.uint64(shift)
        out += np.where(high > 0, np.uint8(shift), np.uint8(0)).astype(np.uint8)
    return out


_COUNTS = np.array([c for c, _ in PACKS] + [1], dtype=np.int64)


def _choose(ahead: np.ndarray, room: np.ndarray, first: int) -> np.ndarray:
    """The first selector from ``first`` on that takes what stands ahead of each position."""
    if int(room.min()) < ahead.shape[1]:
        ahead = np.where(np.arange(ahead.shape[1]) < room[:, None], ahead, 0)
    widest = np.maximum.accumulate(ahead, axis=1)
    kind = np.full(len(room), ESCAPE, dtype=np.int64)
    for s in range(len(PACKS) - 1, first - 1, -1):
        count, bits = PACKS[s]
        kind[widest[:, count - 1] <= bits] = s
    return kind


_SMALL = _widths(np.arange(1 << 16, dtype=np.uint64))


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block with the end of the last."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(1, dtype="<u4")
    width = _SMALL[ids] if int(ids.max()) < 1 << 16 else _widths(ids)
    room = block - np.arange(n, dtype=np.int32) % block
    room[(blocks - 1) * block :] = n - np.arange((blocks - 1) * block, n, dtype=np.int32)
    padded = np.concatenate([width, np.zeros(PACKS[0][0], dtype=np.uint8)])
    ahead = np.lib.stride_tricks.sliding_window_view(padded, PACKS[0][0])
    starts, kinds, takes = [], [], []
    at, alive = np.arange(blocks, dtype=np.int64) * block, np.arange(blocks)
    end = np.minimum(at + block, n)
    while len(alive):
        begin, room = at[alive], end[alive] - at[alive]
        kind = _choose(ahead[begin, :12], room, 4)
        if len(few := np.flatnonzero(kind == 4)):  # ids of 5 bits at most: more may fit
            kind[few] = _choose(ahead[begin[few]], room[few], 0)
        take = np.minimum(_COUNTS[kind], room)
        starts.append(begin)
        kinds.append(kind)
        takes.append(take)
        at[alive] += take
        alive = alive[take < room]
    first = np.concatenate(starts)
    order = np.argsort(first)
    first, kind, taken = first[order], np.concatenate(kinds)[order], np.concatenate(takes)[order]
    place = np.concatenate([[0], np.cumsum(1 + (kind == ESCAPE))])
    words = np.zeros(place[-1], dtype=np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero(kind == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s << 60, dtype=np.uint64)
        begin, have = first[mine], taken[mine]
        short = np.flatnonzero(have < count)
        for j in range(count):
            value = ids[np.minimum(begin + j, n - 1)]
            value[short[have[short] <= j]] = 0
            word |= value << np.uint64(j * bits)
        words[place[mine]] = word
    escaped = np.flatnonzero(kind == ESCAPE)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = ids[first[escaped]]
    opens = np.searchsorted(first, np.arange(blocks) * block)
    return words.astype("<u8"), np.append(place[opens], place[-1]).astype("<u4")


def decode_ids(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The inverse of :func:`encode_ids`."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    kind = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is raw; only then can a word be mistaken, so they are marked in order
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(kind == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    counts = np.append([c for c, _ in PACKS], 1)[np.minimum(kind, ESCAPE)]
    counts[raw] = 0
    before = np.cumsum(counts) - counts
    blocks = len(offsets) - 1
    of = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    at = before - before[offsets[:-1].astype(np.int64)][of] + of * block
    end = np.minimum((of + 1) * block, n)
    for s, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero((kind == s) & ~raw)
        if not len(mine):
            continue
        mask, word, begin, last = np.uint64((1 << bits) - 1), words[mine], at[mine], end[mine]
        for j in range(count):
            there = begin + j < last
            out[(begin + j)[there]] = ((word >> np.uint64(j * bits)) & mask)[there]
    escaped = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[at[escaped]] = words[escaped + 1]
    return out


def build_image(docs: list[int | None], lengths, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = encode_ids(ids, block)
    head = np.array([len(docs), len(ids), block, len(words)], dtype="<i8")
    given = np.array([d is not None for d in docs], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in docs], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), given.tobytes(), np.array(lengths, dtype="<i8").tobytes(), offsets.tobytes(), words.tobytes()])


def parse_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their numbers of ids, and all ids."""
    if image[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, block, n_words = (int(x) for x in np.frombuffer(image, "<i8", 4, 8))
    at = 40
    keys = np.frombuffer(image, "<i8", docs, at)
    given = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(image, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    blocks = -(-n // block)
    offsets = np.frombuffer(image, "<u4", blocks + 1, at)
    words = np.frombuffer(image, "<u8", n_words, at + 4 * (blocks + 1))
    return [k if g else None for k, g in zip(keys.tolist(), given)], lengths, decode_ids(words, offsets, n, block)


def write_token_files(
    df: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, image_ids: int = IMAGE_IDS, literal: bool = False
) -> None:
    """Write all documents' ids as images of about ``image_ids`` ids, in ascending id order.

    Each row of the written table is one image, with its range partition (``part``), the ids
    before it there (``base``) and its number of ids (``n_ids``).  Null ids come first, null
    texts count as empty, equal ids are ordered by text, and an empty table writes no image.
    With ``literal`` the strings of special tokens in a text are ordinary text.
    """
    tok = tokenizer or default_tokenizer()

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, part = encoder(tok, literal), TaskContext.get().partitionId()
        docs: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        base = size = 0

        def image():
            ids = np.concatenate(held)
            data = build_image(docs, np.concatenate(sizes), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "base", "n_ids", "image"]
            )

        for some in slices(batches, 2048, 1):
            ids, lengths = tokens.encode(some.column(1), end_id)
            docs += some.column(0).to_pylist()
            held.append(ids)
            sizes.append(lengths)
            size += len(ids)
            if size >= image_ids:
                yield image()
                base += size
                docs, held, sizes, size = [], [], [], 0
        if held:
            yield image()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, "part int, base long, n_ids long, image binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per document in file order: id, ``start`` (ids of all documents before), length, crc32, ids."""

    def read(batches) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in slices(batches, 1):
            part, base, image = (batch.column(i)[0].as_py() for i in range(3))
            docs, lengths, ids = parse_image(image)
            data = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(lengths)
            cuts = [data[4 * int(e - n) : 4 * int(e)] for e, n in zip(ends, lengths)]
            columns = [
                pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(base + ends - lengths, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([bytes(c) for c in cuts] if keep_ids else [None] * len(docs), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.schema("part int, base long, n_ids long, image binary").parquet(path)
    rows = files.select("part", "base", "image").mapInArrow(read, "part int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    # one row per range partition: small by construction, so a single window may run over it
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")

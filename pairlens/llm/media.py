"""Media columns: AVI motion-JPEG files of byte payloads, read back as frames, shots and clips.

Writing.  A JPEG holds quantised coefficients without loss, so they are the unit that bytes are
stored in: a byte b is the coefficient b (128 and up) or b - 255 (below), all of category 8, so
each takes one code bit and its own eight bits.  An MCU is one 8x8 block of each of three
components: 192 bytes of payload.  Every MCU is followed by a restart marker, so its DC values
stand for themselves.  Quantisation is 1 throughout.  Frames are ``MCUS`` wide; the last one is
filled up with spaces, and the stream's data chunk keeps the payload's length.

Reading.  The RIFF chunks and the idx1 index give the frames.  Frames that begin with the very
tables written here are unstuffed and cut back into coefficients at once; all others are decoded
by their own Huffman and quantisation tables (baseline, one interleaved scan).  Luminance blocks go
through the inverse cosine transform to 8-bit samples; a shot ends where the histogram difference
of two frames exceeds the mean of the other differences around it by ``SIGMAS`` deviations, of
which one is ``LEAST_DEVIATION`` of the mean at least, and ``LEAST_CHANGE`` of the samples.  Shots
are clip rows with times.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

UNIT = 192
MCUS = 4
FPS = 25
BINS = 16
WINDOW = 8
SIGMAS = 2.5
LEAST_DEVIATION = 0.4
LEAST_CHANGE = 0.05
#: Order in which JPEG stores the 64 coefficients of a block (fixed by the standard): by diagonals, turning at each.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


def payload_of(text: bytes) -> bytes:
    """The text, filled up with spaces to a positive multiple of ``UNIT`` bytes."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(mcus: int = MCUS) -> bytes:
    one_code = bytes([1] + [0] * 15)  # a single code, one bit long
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * mcus, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))),
            _segment(0xC4, b"\x00" + one_code + b"\x08" + b"\x10" + one_code + b"\x08"),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\3" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\0\x3f\0"),
        ]
    )


def _to_scan(units: np.ndarray) -> np.ndarray:
    """Bytes, eight in a row, to nine: each after a zero bit."""
    out = np.zeros((len(units), 9), dtype=np.uint8)
    for i in range(8):
        out[:, i] |= units[:, i] >> (i + 1)
        out[:, i + 1] |= units[:, i] << (7 - i)
    return out


def _from_scan(coded: np.ndarray) -> np.ndarray:
    out = np.empty((len(coded), 8), dtype=np.uint8)
    for i in range(8):
        out[:, i] = (coded[:, i] << (i + 1)) | (coded[:, i + 1] >> (7 - i))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes, mcus: int = MCUS, fps: int = FPS) -> bytes:
    """An AVI file whose frames hold ``payload``, a positive multiple of ``UNIT`` bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    per_frame = UNIT * mcus
    filled = payload.ljust(-(-len(payload) // per_frame) * per_frame, b" ")
    coded = _to_scan(np.frombuffer(filled, np.uint8).reshape(-1, 8)).reshape(-1, UNIT * 9 // 8)
    head, frames = _jpeg_head(mcus), []
    for at in range(0, len(coded), mcus):
        scan = head
        for k in range(mcus):
            scan += coded[at + k].tobytes().replace(b"\xff", b"\xff\0")
            scan += bytes([0xFF, 0xD0 + k % 8]) if k < mcus - 1 else b"\xff\xd9"
        frames.append(scan)
    n, width, largest = len(frames), 8 * mcus, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 24, b"MJPG", 3 * width * 8, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        if at + 8 + size > end:
            raise ValueError("a chunk ends outside its list")
        yield name, at + 8, size
        at += 8 + size + size % 2


class Jpeg:
    """The tables and the scan of a baseline JPEG frame."""

    def __init__(self, frame: bytes):
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.parts: list[tuple[int, int, int, int]] = []
        self.tables: dict[int, tuple[int, int]] = {}
        self.restart, at, marker = 0, 2, 0
        while marker != 0xDA:
            if at + 4 > len(frame) or frame[at] != 0xFF:
                raise ValueError("no marker where one is due")
            marker, (size,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
            self._segment(marker, frame[at + 4 : at + 2 + size])
            at += 2 + size
        self.scan = frame[at:]
        if not self.parts:
            raise ValueError("a frame without components")

    def _segment(self, marker: int, body: bytes) -> None:
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, n = body[at] >> 4, body[at] & 15
                self.quantisers[n] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.float32)
                at += 65 + 64 * (wide > 0)
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts, code, k, table = body[at + 1 : at + 17], 0, at + 17, {}
                for bits, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                self.codes[body[at]], at = table, k
        elif marker == 0xC0:
            depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples of 8 bits are read")
            self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("baseline frames are read")
        elif marker == 0xDD:
            (self.restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            self.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])}
            if set(self.tables) != {p[0] for p in self.parts}:
                raise ValueError("one scan with all components is read")

    def luminance(self) -> np.ndarray:
        """Samples of the first component, rows and columns of whole blocks."""
        wide, high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            # a scan of one component goes by its blocks, whatever its factors say
            columns, rows, steps = -(-self.width // 8), -(-self.height // 8), [(self.parts[0][0], 1, 1)]
        else:
            columns, rows, steps = -(-self.width // (8 * wide)), -(-self.height // (8 * high)), [p[:3] for p in self.parts]
        _, h, v = steps[0]
        blocks = np.zeros((rows * v, columns * h, 64), dtype=np.float32)
        parts = re.split(rb"\xff[\xd0-\xd7]", self.scan) if self.restart else [self.scan]
        at = 0
        for part in parts:
            bits = _Bits(part.split(b"\xff\xd9")[0].replace(b"\xff\0", b"\xff"))
            before = dict.fromkeys(self.tables, 0)
            for at in range(at, min(at + (self.restart or rows * columns), rows * columns)):
                for k, (name, across, down) in enumerate(steps):
                    for n in range(across * down):
                        block = self._block(bits, name, before)
                        if k == 0:
                            blocks[at // columns * v + n // h, at % columns * h + n % h] = block
            at += 1
        if at < rows * columns:
            raise ValueError("a scan ends early")
        samples = np.clip(np.rint(blocks * self.quantisers[self.parts[0][3]] @ _INVERSE + 128), 0, 255).astype(np.uint8)
        return samples.reshape(rows * v, columns * h, 8, 8).transpose(0, 2, 1, 3).reshape(rows * v * 8, columns * h * 8)

    def _block(self, bits: _Bits, name: int, before: dict[int, int]) -> list[int]:
        dc, ac = (self.codes[t] for t in self.tables[name])
        out = [0] * 64
        before[name] += bits.value(bits.symbol(dc))
        out[0], k = before[name], 1
        while k < 64:
            symbol = bits.symbol(ac)
            if symbol == 0:
                break
            k += symbol >> 4
            if k > 63:
                raise ValueError("a block has too many coefficients")
            out[k] = bits.value(symbol & 15)
            k += 1
        return out


class _Bits:
    """Bits of an unstuffed scan, the highest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 4, 0, 8 * len(data)

    def take(self, n: int) -> int:
        """The next ``n`` bits, 16 at most."""
        if self.at + n > self.end:
            raise ValueError("a scan ends early")
        word = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "big")
        word >>= 32 - (self.at & 7) - n
        self.at += n
        return word & (1 << n) - 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            if (bits, code) in codes:
                return codes[bits, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        """A signed value of ``size`` bits: those below half of the range are negative."""
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _own_mcus(frames: list[bytes]) -> int:
    """MCUs of a frame if all frames begin with the head written here, else 0."""
    try:
        mcus = Jpeg(frames[0]).width // 8 if frames else 0
    except ValueError:
        return 0
    return mcus if mcus and all(f.startswith(_jpeg_head(mcus)) for f in frames) else 0


class Avi:
    """A parsed file: coefficients as bytes, ``UNIT`` for each MCU, of all frames in index order.

    Files without an index or with broken chunks, and frames that can't be decoded, are a ValueError.
    """

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        movi, index, self.payload_bytes, self.fps = None, b"", None, float(FPS)
        for name, at, size in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
            kind = data[at : at + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for n2, a2, s2 in _chunks(data, at + 4, at + size):
                    if n2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                        for n3, a3, _ in _chunks(data, a2 + 4, a2 + s2):
                            if n3 == b"strh":
                                scale, rate = struct.unpack_from("<II", data, a3 + 20)
                                self.fps = rate / scale
                            elif n3 == b"strd":
                                (self.payload_bytes,) = struct.unpack_from("<Q", data, a3)
            elif kind == b"movi":
                movi = at
            elif name == b"idx1":
                index = data[at : at + size]
        if movi is None or not index:
            raise ValueError("a list is missing")
        frames = [data[movi + offset + 8 : movi + offset + 8 + size] for name, _, offset, size in struct.iter_unpack("<4sIII", index) if name == b"00dc"]
        self.frames, self.mcus = len(frames), _own_mcus(frames)
        #: None if some frame is not of the coding written here
        self.coefficients, self.foreign = None, frames
        if self.mcus:
            scans, start = [], len(_jpeg_head(self.mcus))
            for frame in frames:
                scan = frame[start:-2]
                for k in range(min(8, self.mcus - 1)):
                    scan = scan.replace(bytes([0xFF, 0xD0 + k]), b"")
                scans.append(scan.replace(b"\xff\0", b"\xff"))
            coded = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 9)
            self.coefficients, self.foreign = _from_scan(coded).reshape(-1, UNIT), []

    def payload(self) -> bytes | None:
        """The bytes stored in the file; None if it isn't of this coding."""
        return None if self.coefficients is None or self.payload_bytes is None else self.coefficients.tobytes()[: self.payload_bytes]

    def luminance(self) -> np.ndarray:
        """Decoded 8-bit samples of each frame, by MCUs for this coding and by rows for others."""
        if self.coefficients is None:
            return np.stack([Jpeg(f).luminance() for f in self.foreign])
        stored = self.coefficients[:, :64].astype(np.int16)
        values = np.where(stored >= 128, stored, stored - 255).astype(np.float32)
        samples = values @ _INVERSE
        return np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).reshape(self.frames, self.mcus, 64)

    def shots(self) -> list[tuple[int, int]]:
        """First frame and end of each shot."""
        samples = self.luminance().reshape(self.frames, -1)
        seen = (samples >> 4).astype(np.int64)
        seen += np.arange(self.frames)[:, None] * BINS
        hist = np.bincount(seen.ravel(), minlength=self.frames * BINS).reshape(self.frames, BINS)
        diff = np.abs(np.diff(hist, axis=0)).sum(axis=1).astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(diff)])
        squares = np.concatenate([[0.0], np.cumsum(diff * diff)])
        low, high = np.maximum(np.arange(len(diff)) - WINDOW, 0), np.minimum(np.arange(len(diff)) + WINDOW + 1, len(diff))
        # the others of the window; a single difference has nothing to be compared with
        n = np.maximum(high - low - 1, 1)
        mean = (sums[high] - sums[low] - diff) / n
        deviation = np.sqrt(np.maximum((squares[high] - squares[low] - diff * diff) / n - mean * mean, 0))
        limit = np.maximum(mean + SIGMAS * np.maximum(deviation, LEAST_DEVIATION * mean), 2 * LEAST_CHANGE * samples.shape[1])
        cuts = (np.flatnonzero((diff > limit + 1e-9) & (len(diff) > 1)) + 1).tolist()
        return list(zip([0, *cuts], [*cuts, self.frames]))


def _inverse_dct() -> np.ndarray:
    """Matrix from 64 coefficients in stored order to 64 samples."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(basis, basis)[ZIGZAG].astype(np.float32)


_INVERSE = _inverse_dct()


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mcus: int = MCUS) -> DataFrame:
    """``(doc_id, n_bytes, media)``: an AVI file for every text (null reads as empty).

    Each input row gives one row, repeated rows and null ids too; an empty table gives none.
    Other columns aren't read.  A file holds less than 4 GB, RIFF's own bound.
    """

    def write(batches) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, 256, 1):
            texts = utf8(part.column(1))
            columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_avi(payload_of(t), mcus) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(write, "doc_id long, n_bytes long, media binary")


CLIPS = "array<struct<clip:int,start_s:double,end_s:double,frames:int>>"


def read_media(media: DataFrame) -> DataFrame:
    """Stored files read back: payload digests, the file's own, and timed clips.

    Files of another coding have null payload columns, null files null in all; broken files are an error.  Repeated rows
    are read each, an empty table gives no rows, other columns aren't read.
    """

    def read(batches) -> Iterator:
        import pyarrow as pa

        clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip]
        for part in slices(batches, 256, 2):
            rows = []
            for doc, n, data in zip(*(part.column(i).to_pylist() for i in range(3))):
                if data is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                avi = Avi(data)
                payload = avi.payload()
                stored = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                clips = [{"clip": i, "start_s": a / avi.fps, "end_s": b / avi.fps, "frames": b - a} for i, (a, b) in enumerate(avi.shots())]
                rows.append((doc, n, *stored, len(data), hashlib.sha256(data).hexdigest(), clips))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIPS}"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row per clip of files that :func:`read_media` has read; null and repeated ids stay, null files have none."""
    return read.select("doc_id", F.inline("clips"))


def feature() -> F.Column:
    """Frames, shots and the times of the cuts, as text; null for a null file."""
    frames = F.aggregate("clips", F.lit(0), lambda n, c: n + c["frames"])
    cuts = F.array_join(F.transform(F.slice("clips", 2, 1_000_000_000), lambda c: F.format_string("%.2f", c["start_s"])), ",")
    return F.concat(F.lit("frames="), frames, F.lit(";shots="), F.size("clips"), F.lit(";cuts="), cuts)

"""AVI motion-JPEG columns: RIFF parsing, intra-frame decoding, shots by adaptive histogram differences.

Payload bytes are stored as 8-bit samples of grey frames in lossless JPEG (ITU-T T.81, process SOF3, predictor 1, a
restart interval of one line), each frame a chunk of an AVI file with an ``idx1`` index. All lines of a batch are coded
and decoded side by side, so the work for each sample is vectorised.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc

WIDTH = HEIGHT = 64
FPS = 25
#: Bytes of texts that are read side by side; lines and frames of them that are coded at once.
TOGETHER = 1 << 20
SLICE, FRAMES = 128 * HEIGHT, 256

#: The Huffman table: symbols (bits of a difference) of 3-bit and of 4-bit codes; 1111 stays unused, as the format asks.
BY_LENGTH = {3: (3, 4, 5, 6, 7), 4: (0, 1, 2, 8)}
#: Shots: a cut is a histogram difference above FLOOR and above mean + SPREAD * deviation of the LOOK differences before it.
BINS, FLOOR, SPREAD, LOOK = 16, 0.25, 3.0, 12


def _codes(by_length: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, its bits): canonical codes as in the format's annex C."""
    out, code = {}, 0
    for n in range(1, 17):
        for s in by_length.get(n, ()):
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


def _writing_table() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255..255: the bits to write and how many."""
    value, bits = np.zeros(511, "int64"), np.zeros(511, "int64")
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _codes(BY_LENGTH)[size]
        value[d + 255] = code << size | (d if d >= 0 else d + (1 << size) - 1)
        bits[d + 255] = n + size
    return value, bits


def _reading_table(by_length: dict[int, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the difference that they begin with and its length; length 0 marks no valid code."""
    diff, bits = np.zeros(1 << 16, "int32"), np.zeros(1 << 16, "int32")
    for s, (code, n) in _codes(by_length).items():
        if n + s > 16:
            continue
        extra = np.arange(1 << s)
        for v in extra:
            d = int(v) if s and v >> (s - 1) else int(v) - (1 << s) + 1 if s else 0
            first = (code << s | int(v)) << (16 - n - s)
            diff[first : first + (1 << (16 - n - s))], bits[first : first + (1 << (16 - n - s))] = d, n + s
    return diff, bits


_WRITE = _writing_table()
_READ: dict = {}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    counts = bytes(len(BY_LENGTH.get(n, ())) for n in range(1, 17))
    symbols = bytes(s for n in sorted(BY_LENGTH) for s in BY_LENGTH[n])
    return b"".join([
        b"\xff\xd8",
        _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + counts + symbols),
        _segment(0xDD, struct.pack(">H", width)),
        _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0])),
    ])


def _scans(lines: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded lines, each followed by its restart marker, or by the end of image where ``last``; ``place`` is the
    line's number in its frame. Returns the bytes and where each line begins."""
    value, bits = _WRITE
    d = np.diff(lines.astype("int64"), axis=1, prepend=128) + 255
    v, n = value[d], bits[d]
    ends = np.cumsum(n, axis=1)
    size = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    at = (ends - n + base[:-1, None] * 8).ravel()
    w = v.ravel() << (24 - n.ravel() - (at & 7))
    k, total = at >> 3, int(base[-1])
    out = np.zeros(total + 2)
    for shift in (16, 8, 0):
        out += np.bincount(k + (2 - shift // 8), weights=(w >> shift) & 255, minlength=total + 2)[: total + 2]
    out = out[:total].astype("uint8")
    out[base[1:] - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype("uint8")  # ones fill the last byte
    full = out == 255
    before = np.concatenate([[0], np.cumsum(full)])
    line = np.repeat(np.arange(len(lines)), size)
    where = np.arange(total) + before[:-1] + 2 * line
    whole = np.zeros(total + int(before[-1]) + 2 * len(lines), "uint8")
    whole[where] = out
    stop = base[1:] + before[base[1:]] + 2 * np.arange(len(lines))
    whole[stop] = 255
    whole[stop + 1] = np.where(last, 0xD9, 0xD0 + place % 8)
    return whole, np.concatenate([[0], stop + 2])


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], n_lines: int, width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """An AVI 1.0 file of one MJPG stream; INFO/ICMT holds the number of lines that are payload."""
    most = max(map(len, frames))
    head = _chunk(b"avih", struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0))
    strh = _chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height))
    strf = _chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"lines=%d\0" % n_lines))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + head + _chunk(b"LIST", b"strl" + strh + strf)) + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; a payload's length is a positive multiple of the width."""
    rows = [len(p) // WIDTH for p in payloads]
    padded = [-(-r // HEIGHT) * HEIGHT for r in rows]  # whole frames; what is added is black
    data = np.zeros((sum(padded), WIDTH), "uint8")
    at = 0
    for p, r, h in zip(payloads, rows, padded):
        data[at : at + r] = np.frombuffer(p, "uint8").reshape(r, WIDTH)
        at += h
    place, head, frames = np.arange(len(data)) % HEIGHT, _frame_head(WIDTH, HEIGHT), []
    for a in range(0, len(data), SLICE):  # whole frames; what coding needs besides is bounded by a slice
        z = a + SLICE
        scans, begins = _scans(data[a:z], place[a:z] == HEIGHT - 1, place[a:z])
        whole = scans.tobytes()
        frames += [head + whole[begins[i] : begins[i + HEIGHT]] for i in range(0, len(begins) - 1, HEIGHT)]
    out, at = [], 0
    for r, h in zip(rows, padded):
        out.append(avi(frames[at : at + h // HEIGHT], r))
        at += h // HEIGHT
    return out


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(name, start, size)`` of the chunks in a RIFF list."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def parse(data: bytes) -> dict:
    """Frame time, payload lines (None without the comment) and each frame's place, by ``idx1`` or else by ``movi``."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"frame_us": 0, "lines": None, "frames": []}
    movi, index = None, []
    for name, at, size in chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for n, a, _ in chunks(data, at + 4, at + size):
                if n == b"avih":
                    out["frame_us"] = struct.unpack_from("<I", data, a)[0]
        elif kind == b"INFO":
            for n, a, s in chunks(data, at + 4, at + size):
                if n == b"ICMT" and data[a : a + 6] == b"lines=":
                    out["lines"] = int(data[a + 6 : a + s].rstrip(b"\0"))
        elif kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, a) for a in range(at, at + size - 15, 16)]
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index:
        base = movi[0] if data[movi[0] + index[0][2] :][:4] == index[0][0] else 0  # some writers count from the file's start
        out["frames"] = [(base + o + 8, n) for c, _, o, n in index if c[2:] in (b"dc", b"db")]
    else:
        out["frames"] = [(a, s) for n, a, s in chunks(data, movi[0] + 4, sum(movi)) if n[2:] in (b"dc", b"db")]
    return out


def _frame(data: bytes, at: int) -> tuple[int, int, tuple, int]:
    """Width, height, Huffman table and the scan's place of a lossless JPEG frame; its size is checked against the bytes there
    are, as each sample takes a bit at least."""
    width = height = interval = 0
    table: tuple = ()
    i = at + 2
    while True:
        mark, size = data[i + 1], struct.unpack_from(">H", data, i + 2)[0]
        if mark == 0xC3:
            depth, height, width, n = struct.unpack_from(">BHHB", data, i + 4)
            if depth != 8 or n != 1:
                raise ValueError("only grey 8-bit frames are read")
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless frames (SOF3) are read")
        elif mark == 0xC4:
            table = tuple(data[i + 5 : i + 2 + size])
        elif mark == 0xDD:
            interval = struct.unpack_from(">H", data, i + 4)[0]
        elif mark == 0xDA:
            if interval != width or data[i + 7] != 1:
                raise ValueError("only predictor 1 with a restart after each line is read")
            if width * height > 8 * (len(data) - i):
                raise ValueError("a frame claims more samples than its bytes can hold")
            return width, height, table, i + 2 + size
        i += 2 + size


def _reading(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The reading tables of a Huffman table as a frame holds it."""
    if table not in _READ:
        counts, symbols, by = table[:16], list(table[16:]), {}
        for n, c in enumerate(counts, 1):
            by[n], symbols = tuple(symbols[:c]), symbols[c:]
        _READ[table] = _reading_table(by)
    return _READ[table]


def decode(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """``(what parse() says, frames as an array of n x height x width samples)`` for each file; frames of one size and one
    Huffman table are decoded together, whichever files they are of."""
    parsed, scans, shapes, tables = [parse(f) for f in files], [], [], []
    for f, p in zip(files, parsed):
        for at, size in p["frames"]:
            width, height, table, scan = _frame(f, at)
            scans.append(f[scan : at + size])
            shapes.append((height, width))
            tables.append(table)
    if len(set(shapes)) != 1:
        return [x for f in files for x in decode([f])] if len(files) > 1 else _uneven(parsed[0], shapes)
    height, width = shapes[0]
    frames, out, n = np.empty((len(scans), height, width), "uint8"), [], 0
    for table in dict.fromkeys(tables):
        own = [i for i, t in enumerate(tables) if t == table]
        for a in range(0, len(own), FRAMES):
            some = own[a : a + FRAMES]
            frames[some] = _lossless([scans[i] for i in some], height, width, *_reading(table))
    for p in parsed:
        out.append((p, frames[n : n + len(p["frames"])]))
        n += len(p["frames"])
    return out


def _lossless(scans: list[bytes], height: int, width: int, diff: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The samples of some lossless frames' scans, all their lines side by side."""
    raw = np.frombuffer(b"".join(scans), "uint8")
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD9)]
    if len(marks) != height * len(scans):
        raise ValueError("a line of a frame is missing")
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    moved = np.cumsum(keep)
    data = np.concatenate([raw[keep], np.zeros(4, "uint8")]).astype("int32")
    begin = np.concatenate([[0], moved[marks[:-1]]]).astype("int64") * 8
    lines = np.empty((width, len(begin)), "uint8")
    pixel, at = np.full(len(begin), 128, "int32"), begin
    for x in range(width):
        k = at >> 3
        look = ((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) >> (8 - (at & 7))) & 0xFFFF
        pixel += diff[look]
        lines[x] = pixel & 255
        at = at + bits[look]
    return np.ascontiguousarray(lines.T).reshape(-1, height, width)


def _uneven(parsed: dict, shapes: list) -> list:
    if not shapes:
        return [(parsed, np.zeros((0, 0, 0), "uint8"))]
    raise ValueError("frames of one file differ in size")


def payload(parsed: dict, frames: np.ndarray) -> bytes:
    """The payload's bytes, without the lines that only fill the last frame."""
    data = frames.tobytes()
    return data if parsed["lines"] is None else data[: parsed["lines"] * frames.shape[2]]


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """``(first, last + 1)`` frames of each shot. The threshold adapts to the differences since the last cut."""
    if not len(frames):
        return []
    h = np.empty((len(frames), BINS))
    for a in range(0, len(frames), FRAMES):
        some = frames[a : a + FRAMES]
        bins = (some.reshape(len(some), -1) >> 4).astype("int32") + BINS * np.arange(len(some), dtype="int32")[:, None]
        h[a : a + FRAMES] = np.bincount(bins.ravel(), minlength=BINS * len(some)).reshape(-1, BINS) / (frames.shape[1] * frames.shape[2])
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for t, x in enumerate(d):
        past = d[max(since, t - LOOK) : t]
        if x > FLOOR and (len(past) == 0 or x > past.mean() + SPREAD * past.std()):
            cuts.append(t + 1)
            since = t + 1
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def feature(parsed: dict, frames: np.ndarray) -> str:
    """Frames, shots with their times in ms, and each shot's mean sample."""
    ms = parsed["frame_us"] / 1000
    clips = ",".join(f"{a * ms:.0f}-{b * ms:.0f}:{frames[a:b].mean():.3f}" for a, b in shots(frames))
    return f"frames={len(frames)};clips={clips}"


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about TOGETHER at most."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            yield first, i
            first, total = i, 0
        total += n
    if sizes:
        yield first, len(sizes)


def store_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text's UTF-8 bytes (null: none), zero-filled to a positive multiple of 64,
    as an AVI file. Equal texts give equal files; repeated rows are kept; an empty table stays empty."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _grouped([len(t) + 4096 for t in texts]):
                media = encode([t + bytes(-len(t) % WIDTH or (0 if t else WIDTH)) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def media_digest(stored: DataFrame) -> DataFrame:
    """What the stored files hold when they are read back, and their features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, media = (c.to_pylist() for c in batch.columns)
            for a, b in _grouped([len(m) for m in media]):
                rows = []
                for key, n, m, (parsed, frames) in zip(keys[a:b], sizes[a:b], media[a:b], decode(media[a:b])):
                    p = payload(parsed, frames)
                    rows.append((key, n, len(p), hashlib.sha256(p).hexdigest(), crc(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(parsed, frames)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def clips(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each shot: ``key, clip, first_frame, last_frame, start_ms, end_ms, error``.

    Null media give no rows; media that can't be read give one row whose ``error`` says why and whose other values are
    null.
    """
    schema = "doc_id long, clip int, first_frame int, last_frame int, start_ms double, end_ms double, error string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m is None:
                    continue
                try:
                    parsed, frames = decode([m])[0]
                except (ValueError, IndexError, struct.error, MemoryError) as e:
                    rows.append((k, None, None, None, None, None, str(e)))
                    continue
                ms = parsed["frame_us"] / 1000
                rows += [(k, i, a, b - 1, a * ms, b * ms, None) for i, (a, b) in enumerate(shots(frames))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(key).cast("long").alias("doc_id"), media).mapInArrow(cut, schema)

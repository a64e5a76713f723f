"""Operator 6: media columns of AVI motion-JPEG.

Reads and writes the container (RIFF 'AVI ' with header list, 'movi' list and
'idx1' index), decodes its intra frames and detects shots by adaptive histogram
differences, giving a row for each timed clip.

Frames are greyscale baseline JPEGs.  All frames of a batch of files are decoded
in step: each turn takes the next Huffman symbol of every frame at once, so the
work is a few array operations for each coefficient of a frame, however many
frames there are.  Frames with the same tables and size form one group.

Payload bytes are kept without loss in the quantised coefficients, which is the
format's own unit: each is one coefficient of category 8, whose 256 values take
a byte each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import map_batches

#: Width, height and frames a second of the frames that carry payloads: three blocks, 192 coefficients.
WIDTH, HEIGHT, FPS = 24, 8, 25
FRAME = WIDTH * HEIGHT
PAD = 192
#: Histogram bins; a shot begins where the difference exceeds the running mean of the last WINDOW ones by SIGMAS deviations and LEAST.
BINS, WINDOW, SIGMAS, LEAST = 16, 8, 3.0, 0.35
#: Frames that are encoded, or decoded in step, at once: what a worker holds beside the files themselves is bounded by these.
TOGETHER = 2_000

# The zigzag order as a rule, Huffman symbols with their code lengths.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
DC_CODES = {8: 1, **{s: 5 for s in (0, 1, 2, 3, 4, 5, 6, 7)}, **{s: 6 for s in (9, 10, 11)}}
AC_CODES = {0x08: 1, 0x00: 2, 0xF0: 3}


# --- JPEG -----------------------------------------------------------------------------------------


class Table(NamedTuple):
    """For each 16-bit look ahead: symbol and code length (0: no code)."""

    symbol: np.ndarray
    length: np.ndarray


def huffman(counts: bytes, symbols: bytes) -> Table:
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - bits)
            symbol[low : low + (1 << (16 - bits))] = symbols[at]
            length[low : low + (1 << (16 - bits))] = bits
            code, at = code + 1, at + 1
        code <<= 1
    return Table(symbol, length)


def huffman_segment(kind: int, codes: dict[int, int]) -> bytes:
    order = sorted(codes, key=lambda s: (codes[s], s))
    counts = bytes(sum(codes[s] == n for s in order) for n in range(1, 17))
    return b"\xff\xc4" + struct.pack(">HB", 3 + 16 + len(order), kind) + counts + bytes(order)


def frame_header(width: int, height: int) -> bytes:
    quantisation = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
    frame = b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    scan = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0)
    return b"\xff\xd8" + quantisation + frame + huffman_segment(0x00, DC_CODES) + huffman_segment(0x10, AC_CODES) + scan


HEADER = frame_header(WIDTH, HEIGHT)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of (n, FRAME) bytes: each byte a code bit 0 (category 8) and its own eight bits."""
    out: list[bytes] = []
    for i in range(0, len(payload), TOGETHER):
        out += _encoded(payload[i : i + TOGETHER])
    return out


def _encoded(payload: np.ndarray) -> list[bytes]:
    bits = np.zeros((len(payload), FRAME, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(payload[:, :, None], axis=2)
    packed = np.packbits(bits.reshape(len(payload), -1), axis=1)
    # Every 0xFF of entropy-coded data is followed by a zero.
    full = packed == 0xFF
    out = np.zeros(packed.size + int(full.sum()), np.uint8)
    at = np.arange(packed.size) + np.cumsum(full.ravel()) - full.ravel()
    out[at] = packed.ravel()
    ends = np.cumsum(packed.shape[1] + full.sum(axis=1)).tolist()
    raw = out.tobytes()
    return [HEADER + raw[a:b] + b"\xff\xd9" for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Parsed(NamedTuple):
    """What the segments before a scan say, and the scan's bytes without stuffing."""

    width: int
    height: int
    quantisation: bytes
    dc: tuple[bytes, bytes]
    ac: tuple[bytes, bytes]
    scan: bytes


_heads: dict[bytes, tuple] = {}


def parse_jpeg(raw: bytes) -> Parsed:
    """Raises ValueError for what isn't a greyscale baseline frame without restart intervals."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    scan_at = raw.find(b"\xff\xda")
    head = raw[: scan_at + 2]
    if head not in _heads:
        if len(_heads) > 64:
            _heads.clear()
        _heads[head] = parse_head(raw)
    begin, fields = _heads[head]
    end = raw.rfind(b"\xff\xd9")
    return Parsed(*fields, raw[begin : end if end >= begin else len(raw)].replace(b"\xff\x00", b"\xff"))


def parse_head(raw: bytes) -> tuple:
    at, size, quantisation, tables = 2, None, {}, {}
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("broken segment")
        marker, length = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + length]
        if marker == 0xC0:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit greyscale")
            size = (width, height, body[8])
        elif marker in (0xC1, 0xC2, 0xC3, 0xC9, 0xCA, 0xCB) or marker == 0xDD and body != b"\0\0":
            raise ValueError("only baseline frames without restart intervals")
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("only 8-bit quantisation")
                quantisation[body[0] & 15], body = body[1:65], body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDA:
            if size is None:
                raise ValueError("scan before frame")
            which = body[2]
            return at + 2 + length, (size[0], size[1], quantisation[size[2]], tables[which >> 4], tables[0x10 | which & 15])
        at += 2 + length


_tables: dict[tuple[bytes, bytes], Table] = {}


def table(key: tuple[bytes, bytes]) -> Table:
    if key not in _tables:
        if len(_tables) > 16:
            _tables.clear()
        _tables[key] = huffman(*key)
    return _tables[key]


def decode_scans(frames: list[Parsed]) -> np.ndarray:
    """(n, blocks, 64) coefficients in zigzag order, as stored, of frames with the same head."""
    first, n = frames[0], len(frames)
    blocks = -(-first.width // 8) * -(-first.height // 8)
    dc, ac = table(first.dc), table(first.ac)
    starts = np.cumsum([0, *[len(f.scan) + 8 for f in frames[:-1]]])
    data = np.frombuffer(b"".join(f.scan + b"\xff" * 8 for f in frames) + b"\xff" * 8, np.uint8)
    # 32 bits from each byte on: one gather shows the next 25 bits at any bit.
    wide = data.astype(np.uint32)
    ahead = (wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]).astype(np.int64)
    limit = (starts + [len(f.scan) + 4 for f in frames]) * 8
    bit = starts * 8
    out = np.zeros((n, blocks * 64), np.int32)
    place = np.zeros(n, np.int64)  # the next coefficient of each frame
    last_dc = np.zeros(n, np.int64)
    going = np.arange(n)
    while len(going):
        at, k = bit[going], place[going]
        direct = (k & 63) == 0
        look = ahead[at >> 3] << (at & 7) & 0xFFFFFFFF
        peek = look >> 16
        symbol, length = np.where(direct, dc.symbol[peek], ac.symbol[peek]), np.where(direct, dc.length[peek], ac.length[peek])
        if not length.all():
            raise ValueError("no such code")
        run, size = np.where(direct, 0, symbol >> 4), symbol & 15
        at = at + length
        more = (ahead[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - size)
        value = np.where(more < 1 << np.maximum(size - 1, 0), more - (1 << size) + 1, more)
        value[size == 0] = 0
        at = at + size
        end_of_block = ~direct & (symbol == 0)
        where = k + run
        if ((where >> 6 != k >> 6) & ~end_of_block).any() or (at > limit[going]).any():
            raise ValueError("broken scan")
        d = going[direct]
        last_dc[d] += value[direct]
        value[direct] = last_dc[d]
        keep = ~end_of_block
        out[going[keep], where[keep]] = value[keep]
        bit[going] = at
        place[going] = np.where(end_of_block, (k | 63) + 1, where + 1)
        going = going[place[going] < blocks * 64]
    return out.reshape(n, blocks, 64)


def basis() -> np.ndarray:
    """The inverse transform as integers of 13 bits: products and sums are exact in doubles, so equal frames give equal samples anywhere."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.round(both * 8192)


BASIS = basis()


def samples(coefficients: np.ndarray, quantisation: bytes, width: int, height: int) -> np.ndarray:
    """(n, height, width) samples of 8 bits from (n, blocks, 64) coefficients in zigzag order."""
    n = len(coefficients)
    plain = np.zeros((n * coefficients.shape[1], 64))
    plain[:, ZIGZAG] = coefficients.reshape(-1, 64) * np.frombuffer(quantisation, np.uint8).astype(np.int64)
    values = np.clip(np.floor((plain @ BASIS + 4096) / 8192) + 128, 0, 255).astype(np.uint8)
    down, across = -(-height // 8), -(-width // 8)
    return values.reshape(n, down, across, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, down * 8, across * 8)[:, :height, :width]


# --- AVI ------------------------------------------------------------------------------------------


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """A file with one motion-JPEG stream and its index."""
    size = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, size * fps, 0, 0x10, len(frames), 0, 1, size, width, height, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<I2H8I4h", 0, 0, 0, 0, 1, fps, 0, len(frames), size, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    body, index, at = [], [], 4
    for f in frames:
        body += [struct.pack("<4sI", b"00dc", len(f)), f, b"\0" * (len(f) & 1)]
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    entries = chunk(b"idx1", b"".join(index))
    total = 4 + len(header) + 8 + at + len(entries)
    return b"".join([struct.pack("<4sI4s", b"RIFF", total, b"AVI "), header, struct.pack("<4sI4s", b"LIST", at, b"movi"), *body, entries])


class Movie(NamedTuple):
    width: int
    height: int
    frame_us: int
    frames: list[bytes]


class Spans(NamedTuple):
    """Where the frames of a file begin and how long they are."""

    width: int
    height: int
    frame_us: int
    frames: list[tuple[int, int]]


def read_avi(raw: bytes) -> Movie:
    """The frames in the order of the index, or of the 'movi' list where there is none.  Raises ValueError for other files."""
    m = frame_spans(raw)
    return Movie(*m[:3], [raw[at : at + n] for at, n in m.frames])


def frame_spans(raw: bytes) -> Spans:
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict = {"frames": [], "index": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
            begin, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST":
                if raw[begin : begin + 4] == b"movi":
                    found["movi"] = begin, stop
                else:
                    walk(begin + 4, stop)
            elif name == b"avih":
                found["frame_us"], (found["width"], found["height"]) = struct.unpack_from("<I", raw, begin)[0], struct.unpack_from("<2I", raw, begin + 32)
            elif name == b"idx1":
                found["index"] = [e for e in struct.iter_unpack("<4s3I", raw[begin : begin + (stop - begin) // 16 * 16])]
            at = begin + size + (size & 1)

    walk(12, min(len(raw), 8 + struct.unpack_from("<I", raw, 4)[0]))
    if "movi" not in found or "frame_us" not in found:
        raise ValueError("no movie in the file")
    begin, stop = found["movi"]
    video = [(o, n) for name, _, o, n in found["index"] if name[2:] in (b"dc", b"db")]
    if video:  # offsets count from the list's name, or from the file's beginning
        base = begin if raw[begin + video[0][0] : begin + video[0][0] + 4][2:] in (b"dc", b"db") else 0
        frames = [(base + o + 8, n) for o, n in video]
    else:
        frames, at = [], begin + 4
        while at + 8 <= stop:
            name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                frames.append((at + 8, size))
            at += 8 + size + (size & 1)
    return Spans(found["width"], found["height"], found["frame_us"], frames)


# --- shots ----------------------------------------------------------------------------------------


def histograms(pictures: np.ndarray) -> np.ndarray:
    """(n, BINS) counts of samples."""
    n = len(pictures)
    flat = pictures.reshape(n, -1) // (256 // BINS)
    return np.bincount((np.arange(n)[:, None] * BINS + flat).ravel(), minlength=n * BINS).reshape(n, BINS)


def shot_starts(hist: np.ndarray) -> list[int]:
    """Frames at which a shot begins: 0, and where the difference to the frame before stands out from the last WINDOW ones."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * hist[0].sum())
    usual = np.minimum(diff, LEAST)  # a cut shouldn't hide the next one
    total, square = np.concatenate([[0.0], np.cumsum(usual)]), np.concatenate([[0.0], np.cumsum(usual * usual)])
    at = np.arange(len(diff))
    low = np.maximum(at - WINDOW, 0)
    n = np.maximum(at - low, 1)
    mean = (total[at] - total[low]) / n
    deviation = np.sqrt(np.maximum((square[at] - square[low]) / n - mean * mean, 0))
    cut = diff > np.maximum(mean + SIGMAS * deviation, LEAST)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


class Clip(NamedTuple):
    first: int
    frames: int
    start_ms: int
    end_ms: int


def clips_of(hist: np.ndarray, frame_us: int) -> list[Clip]:
    starts = shot_starts(hist)
    ends = [*starts[1:], len(hist)] if starts else []
    return [Clip(a, b - a, a * frame_us // 1000, b * frame_us // 1000) for a, b in zip(starts, ends, strict=True)]


class Decoded(NamedTuple):
    coefficients: np.ndarray  # (frames, blocks, 64) in zigzag order
    hist: np.ndarray
    frame_us: int


def spans_of(files: list[bytes]) -> list[Spans | None]:
    out: list[Spans | None] = []
    for raw in files:
        try:
            out.append(frame_spans(raw))
        except (ValueError, KeyError, IndexError, struct.error):
            out.append(None)
    return out


def decode_runs(files: list[bytes], spans: list[Spans | None]):
    """(file, frame, coefficients, histogram) of the frames that can be decoded, TOGETHER of them in step; those with one head are in order."""
    frames = ((i, j, at, n) for i, m in enumerate(spans) if m for j, (at, n) in enumerate(m.frames))
    while run := list(islice(frames, TOGETHER)):
        groups: dict[tuple, list[tuple[int, int, Parsed]]] = {}
        for i, j, at, n in run:
            try:
                p = parse_jpeg(files[i][at : at + n])
            except (ValueError, KeyError, IndexError, struct.error):
                continue
            groups.setdefault(p[:5], []).append((i, j, p))
        for head, members in groups.items():
            for some, c in attempted(members):
                for (i, j, _), one, h in zip(some, c, histograms(samples(c, head[2], head[0], head[1])), strict=True):
                    yield i, j, one, h


def decode_movies(files: list[bytes]) -> list[Decoded | None]:
    """Coefficients and histograms of each file's frames; None for files that can't be decoded."""
    spans = spans_of(files)
    out: list[list] = [[None] * len(m.frames) if m else [] for m in spans]
    for i, j, c, h in decode_runs(files, spans):
        out[i][j] = c, h
    result: list[Decoded | None] = []
    for m, frames in zip(spans, out, strict=True):
        if m is None or any(f is None for f in frames) or len({f[0].shape for f in frames}) > 1:
            result.append(None)
        else:
            shape = frames[0][0].shape if frames else (0, 64)
            result.append(Decoded(np.array([f[0] for f in frames], np.int32).reshape(-1, *shape), np.array([f[1] for f in frames]).reshape(-1, BINS), m.frame_us))
    return result


def film(files: list[bytes]) -> list[tuple[list[Clip], str | None]]:
    """The clips of each file, from histograms alone, and why there are none where it can't be decoded."""
    spans = spans_of(files)
    hist = [np.zeros((len(m.frames) if m else 0, BINS), np.int64) for m in spans]
    done = [0] * len(files)
    for i, j, _, h in decode_runs(files, spans):
        hist[i][j] = h
        done[i] += 1
    out: list[tuple[list[Clip], str | None]] = []
    for m, h, n in zip(spans, hist, done, strict=True):
        if m is None:
            out.append(([], "no AVI file"))
        elif n < len(h):
            out.append(([], "frames that aren't greyscale baseline JPEG without restarts"))
        elif len(set(h.sum(axis=1).tolist())) > 1:
            out.append(([], "frames of several sizes"))
        else:
            out.append((clips_of(h, m.frame_us), None))
    return out


def attempted(members: list):
    """(members, coefficients): all at once, or each alone if one is broken."""
    try:
        yield members, decode_scans([p for _, _, p in members])
    except (ValueError, IndexError):
        for x in members:
            try:
                yield [x], decode_scans([x[2]])
            except (ValueError, IndexError):
                continue


# --- columns --------------------------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % PAD if raw else PAD)


def store(raw: bytes) -> bytes:
    """An AVI file that holds ``raw``, a multiple of FRAME bytes."""
    return write_avi(encode_frames(np.frombuffer(raw, np.uint8).reshape(-1, FRAME)))


def stored_bytes(coefficients: np.ndarray) -> bytes:
    """The payload of a file's coefficients: values of category 8, the first of each block relative to the block before."""
    c = coefficients.astype(np.int32)
    c[:, 1:, 0] -= coefficients[:, :-1, 0]
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()


def clips(media: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """id, clip, first_frame, n_frames, start_ms, end_ms for each shot of each AVI file of ``media`` (an id and a binary column).

    Null files and files without frames give no rows.  A file that can't be
    decoded (colour, progressive or arithmetic frames, restart intervals, or no
    AVI at all) gives none here; ``unreadable`` names it.
    """
    kind = media.schema[id_column].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, rows = b.column(id_column).to_pylist(), []
            for i, (found, _) in zip(ids, film([x or b"" for x in b.column(media_column).to_pylist()]), strict=True):
                rows += [(i, k, *c) for k, c in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(id_column).type), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["id", "clip", "first_frame", "n_frames", "start_ms", "end_ms"])

    return map_batches(media.select(id_column, media_column), run, f"id {kind}, clip bigint, first_frame bigint, n_frames bigint, start_ms bigint, end_ms bigint", rows=100)


def unreadable(media: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """id, problem for each file of ``media`` that isn't null and can't be decoded."""
    kind = media.schema[id_column].dataType.simpleString()

    def run(batches):
        for b in batches:
            bad = [(k, why) for k, (_, why) in enumerate(film(b.column(media_column).to_pylist())) if why]
            yield pa.RecordBatch.from_arrays([b.column(id_column).take(pa.array([k for k, _ in bad], pa.int64())), pa.array([why for _, why in bad], pa.string())], ["id", "problem"])

    return map_batches(media.select(id_column, media_column).filter(F.col(media_column).isNotNull()), run, f"id {kind}, problem string", rows=100)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media (an AVI file that holds the padded text) for each row of ``docs`` (doc_id, text); null counts as empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([store(payload(t)) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "media"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary", rows=200)


def digests(texts: list[str | None]) -> list[tuple]:
    """For each text, through its file: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips.

    Beside the texts and their files, only TOGETHER frames are held decoded.
    """
    sizes = [len((t or "").encode()) for t in texts]
    payloads = [payload(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    files, at = [], 0
    for p in payloads:
        files.append(write_avi(frames[at : at + len(p) // FRAME]))
        at += len(p) // FRAME
    del payloads, frames
    spans = spans_of(files)
    back, tails, n_back = [hashlib.sha256() for _ in files], [b""] * len(files), [0] * len(files)
    hist = [np.zeros((len(m.frames), BINS), np.int64) for m in spans]
    for i, j, c, h in decode_runs(files, spans):  # in order, for all frames have one head
        part = stored_bytes(c[None])
        back[i].update(part)
        tails[i], n_back[i] = part[-16:], n_back[i] + len(part)
        hist[i][j] = h
    out = []
    for file, m, sha, tail, n, h, size in zip(files, spans, back, tails, n_back, hist, sizes, strict=True):
        shots, levels = clips_of(h, m.frame_us), h.sum(axis=0)
        mean = int((levels * np.arange(BINS)).sum() * 1000 // levels.sum())
        feature = f"frames={len(h)};shots={len(shots)};longest_ms={max(c.end_ms - c.start_ms for c in shots)};mean_level={mean}"
        out.append((size, n, sha.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature, ",".join(f"{c.start_ms}-{c.end_ms}" for c in shots)))
    return out


def op6(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), with the timed clips of its file as text.

    Null and empty texts are one frame of spaces; equal texts have equal values;
    repeated rows each have their row; other columns are ignored; an empty table
    has no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def run(batches):
        for b in batches:
            cols = list(zip(*digests(b.column("text").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols]], names)

    return map_batches(
        docs.select("doc_id", "text"),
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips string",
        rows=1000,
        size=1 << 21,
    )

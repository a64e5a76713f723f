import hashlib
import zlib

import numpy as np
import pytest

from keepwell.llm import media as m

RNG = np.random.default_rng(0)


def bits_of(raw):
    return "".join(f"{b:08b}" for b in raw)


def scalar_decode(p):
    """One frame, bit by bit."""
    def codes(spec):
        out, code, at = {}, 0, 0
        for n, k in enumerate(spec[0], 1):
            for _ in range(k):
                out[f"{code:0{n}b}"] = spec[1][at]
                code, at = code + 1, at + 1
            code <<= 1
        return out

    dc, ac, bits, at = codes(p.dc), codes(p.ac), bits_of(p.scan), 0
    out, last = [], 0

    def symbol(table):
        nonlocal at
        n = 1
        while bits[at : at + n] not in table:
            n += 1
        at += n
        return table[bits[at - n : at]]

    def value(size):
        nonlocal at
        v = int(bits[at : at + size] or "0", 2)
        at += size
        return v if size == 0 or v >= 1 << (size - 1) else v - (1 << size) + 1

    for _ in range(-(-p.width // 8) * -(-p.height // 8)):
        block = [0] * 64
        last += value(symbol(dc))
        block[0], k = last, 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += s >> 4
            block[k] = value(s & 15)
            k += 1
        out.append(block)
    return np.array(out)


def frame(blocks, width, height):
    """A frame with runs, ends of blocks and long runs, coded bit by bit with our tables."""
    def table(codes):
        order, out, code, n = sorted(codes, key=lambda s: (codes[s], s)), {}, 0, 0
        for s in order:
            code <<= codes[s] - n
            n = codes[s]
            out[s] = f"{code:0{n}b}"
            code += 1
        return out

    dc, ac = table(m.DC_CODES), table({**m.AC_CODES, 0x18: 4, 0x34: 5})
    bits, last = "", 0
    extra = lambda v, n: f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""
    for b in blocks:
        d, last = int(b[0]) - last, int(b[0])
        n = abs(d).bit_length()
        bits += dc[n] + extra(d, n)
        at = 1
        for k in np.flatnonzero(b[1:]) + 1:
            run, n = int(k) - at, abs(int(b[k])).bit_length()
            while run > 15:
                bits, run = bits + ac[0xF0], run - 16
            bits += ac[run << 4 | n] + extra(int(b[k]), n)
            at = int(k) + 1
        if at < 64:
            bits += ac[0]
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    head = m.frame_header(width, height).replace(m.huffman_segment(0x10, m.AC_CODES), m.huffman_segment(0x10, {**m.AC_CODES, 0x18: 4, 0x34: 5}))
    return head + raw + b"\xff\xd9"


def sparse_frames(n, blocks=4):
    out = []
    for _ in range(n):
        b = np.zeros((blocks, 64), int)
        b[:, 0] = RNG.integers(-200, 200, blocks)
        for row in b:
            at = 0
            while True:
                run, size = [(0, 8), (1, 8), (3, 4), (16, 8)][RNG.integers(4)]
                at += run + 1
                if at > 63 or RNG.random() < 0.2:
                    break
                v = int(RNG.integers(1 << (size - 1), 1 << size))
                row[at] = v if RNG.random() < 0.5 else -v
        out.append(b)
    return out


def test_decoding_in_step_is_decoding_alone():
    blocks = sparse_frames(60)
    frames = [m.parse_jpeg(frame(b, 16, 16)) for b in blocks]
    together = m.decode_scans(frames)
    assert (together == np.array(blocks)).all() and all((scalar_decode(f) == t).all() for f, t in zip(frames[:10], together, strict=False))


def test_samples_are_the_inverse_transform():
    c = np.zeros((1, 1, 64), int)
    c[0, 0, :4] = [80, -30, 12, 7]
    plain = np.zeros(64)
    plain[m.ZIGZAG] = c[0, 0]
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    cu, cv = (0.5**0.5 if u == 0 else 1), (0.5**0.5 if v == 0 else 1)
                    want[y, x] += cu * cv / 4 * plain[v * 8 + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert np.abs(m.samples(c, b"\x01" * 64, 8, 8)[0].astype(float) - (want + 128)).max() <= 1


@pytest.mark.parametrize("n", [1, 3, 40])
def test_payload_round_trip(n):
    raw = RNG.integers(0, 256, m.PAD * n, dtype=np.uint8).tobytes()
    (d,) = m.decode_movies([m.store(raw)])
    assert m.stored_bytes(d.coefficients) == raw and len(d.hist) == n and m.read_avi(m.store(raw)).frame_us == 40_000


def test_index_and_list_agree():
    raw = m.store(bytes(range(192)) * 5)
    cut = raw[: raw.index(b"idx1")]
    assert m.read_avi(raw).frames == m.read_avi(cut).frames and len(m.read_avi(cut).frames) == 5


def test_broken_files_are_none():
    good = m.store(bytes(192))
    broken = good.replace(m.HEADER, m.HEADER[:-3] + b"\0\0\0")[:-100]
    got = m.decode_movies([b"", b"RIFF", good, good[:200], broken, b"x" * 500])
    assert [d is None for d in got][:3] == [True, True, False] and got[5] is None


def test_shots():
    dark, light = np.zeros((1, m.BINS)), np.zeros((1, m.BINS))
    dark[0, 2], light[0, 13] = 192, 192
    hist = np.concatenate([dark] * 10 + [light] * 5 + [dark] * 7)
    assert [(c.first, c.frames, c.start_ms, c.end_ms) for c in m.clips_of(hist, 40_000)] == [(0, 10, 0, 400), (10, 5, 400, 600), (15, 7, 600, 880)]
    assert m.clips_of(np.zeros((0, m.BINS)), 40_000) == [] and len(m.clips_of(np.concatenate([dark] * 30), 40_000)) == 1


def test_query(spark, sf, odd, none):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        want = []
        for r in docs.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
            want.append((str(r.doc_id), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
        rows = m.op6(docs).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    files = m.encode(docs)
    assert {r.doc_id: (r.media_bytes, r.media_sha256) for r in rows} == {r.doc_id: (len(r.media), hashlib.sha256(r.media).hexdigest()) for r in files.collect()}
    n = {r.id: r.n for r in m.clips(files, "doc_id").groupBy("id").sum("n_frames").toDF("id", "n").collect()}
    assert n == {r.doc_id: r.payload_bytes // 192 for r in rows}
    same = [r for r in m.op6(odd).collect() if r.doc_id in (6, 7)]
    assert len({r.media_sha256 for r in same}) == len({r.feature for r in same}) == 1
    assert m.op6(none).count() == 0 and m.clips(m.encode(none), "doc_id").count() == 0


def test_memory_of_one_long_text():
    """64 MB of text in a fresh process; what its frames take isn't multiplied."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import resource; from keepwell.llm import media as m; r = m.digests(['some words, ' * 5_592_405]); print(r[0][0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    n, peak = map(int, done.stdout.split())
    assert n > 64 * 2**20 - 100 and peak < 1000


def test_unreadable_files_are_named(make, spark):
    good = m.store(bytes(192))
    media = spark.createDataFrame([(1, good), (2, b"RIFF"), (3, None), (4, good.replace(b"\xff\xc0", b"\xff\xc2"))], "id long, media binary")
    assert {r.id: r.problem for r in m.unreadable(media).collect()} == {2: "no AVI file", 4: "frames that aren't greyscale baseline JPEG without restarts"}
    assert [(r.id, r.clip, r.start_ms, r.end_ms) for r in m.clips(media).collect()] == [(1, 0, 0, 40)]
    (row,) = m.op6(make([(1, "a" * 192 * 3, "en", "a")])).collect()
    assert row.clips == "0-120"

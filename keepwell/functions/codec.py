"""Payload codecs and checksums: what Spark has no builtin for runs on Arrow batches (D-01, D-10..D-12, T-08, W-14)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.schemas import SAMPLE_BYTES, SAMPLE_FLOOR, USEFUL_RATIO, ZSTD_LEVEL

#: Fixed value: the reflected Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(CASTAGNOLI), c >> 1).astype(np.uint32)
    return c


_TABLE = crc_table()


#: Bytes of a payload that are run through together; longer ones are cut into lanes of this size.
LANE = 1024


def _advanced(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each register after LANE zero bytes: the map is linear, so it is the sum of what each of its bytes becomes."""
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def _lane_tables() -> np.ndarray:
    out = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    for _ in range(LANE):
        out = _TABLE[out & 0xFF] ^ (out >> np.uint32(8))
    return out


_LANES = _lane_tables()


def crc32c_of(payloads: list[bytes | None]) -> list[int | None]:
    """CRC-32C of each payload.  Lanes of all payloads advance together, a byte a turn; then each payload's lanes are put together."""
    raw = [p or b"" for p in payloads]
    sizes, owner = [], []
    for i, p in enumerate(raw):
        cuts = [LANE] * (len(p) // LANE) + ([len(p) % LANE] if len(p) % LANE else [])
        sizes += cuts
        owner += [i] * len(cuts)
    crc = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    if not sizes:
        return [None if p is None else 0 for p in payloads]
    n, whose, data = np.array(sizes, np.int64), np.array(owner, np.int64), np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    first = np.flatnonzero(np.diff(whose, prepend=-1))
    lane = np.zeros(len(n), np.uint32)
    lane[first] = 0xFFFFFFFF
    own, at, size, alive = lane[order], starts[order], n[order], len(order)
    for k in range(int(size[0])):
        while size[alive - 1] <= k:
            alive -= 1
        own[:alive] = _TABLE[(own[:alive] ^ data[at[:alive] + k]) & 0xFF] ^ (own[:alive] >> np.uint32(8))
    lane[order] = own
    # A payload's register over its whole lanes in order; the last, shorter one is run through from there.
    crc[whose[first]] = lane[first]
    later = np.ones(len(n), bool)
    later[first] = False
    rank = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
    for turn in range(1, int(rank.max()) + 1):
        k = np.flatnonzero(later & (rank == turn) & (n == LANE))
        crc[whose[k]] = _advanced(crc[whose[k]], _LANES) ^ lane[k]
    for k in np.flatnonzero(later & (n < LANE)).tolist():
        c = int(crc[whose[k]])
        for b in data[starts[k] : starts[k] + n[k]].tolist():
            c = int(_TABLE[(c ^ b) & 0xFF]) ^ (c >> 8)
        crc[whose[k]] = c
    return [None if p is None else int(x) for p, x in zip(payloads, crc ^ np.uint32(0xFFFFFFFF), strict=True)]


@F.pandas_udf(T.LongType())
def crc32c(payload: pd.Series) -> pd.Series:
    return pd.Series(crc32c_of(payload.tolist()), dtype="Int64")


def compressed(raw: bytes) -> bytes:
    return pa.Codec("zstd", ZSTD_LEVEL).compress(raw, asbytes=True)


def decompressed(packed: bytes, size: int) -> bytes:
    """Bounded: exactly ``size`` bytes, or an error."""
    return pa.Codec("zstd", ZSTD_LEVEL).decompress(packed, size, asbytes=True)


@F.pandas_udf(T.BinaryType())
def zstd(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else compressed(x))


@F.pandas_udf(T.BinaryType())
def unzstd(packed: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else decompressed(x, int(n)) for x, n in zip(packed, size, strict=True)], dtype=object)


@F.pandas_udf(_fields(codec=T.StringType(), original_size=T.LongType(), compressed_size=T.LongType(), ratio=T.DoubleType(), original_crc=T.LongType(), compressed_crc=T.LongType(), original_hash=T.StringType(), compressed_hash=T.StringType(), verified=T.BooleanType()))
def compress_verified(payload: pd.Series) -> pd.DataFrame:
    """Compress, decompress and compare, as one row of facts."""
    raw = payload.tolist()
    packed = [None if x is None else compressed(x) for x in raw]
    sizes = [(len(x), len(p)) if x is not None else (None, None) for x, p in zip(raw, packed, strict=True)]
    return pd.DataFrame(
        {
            "codec": "zstd",
            "original_size": pd.array([a for a, _ in sizes], "Int64"),
            "compressed_size": pd.array([b for _, b in sizes], "Int64"),
            "ratio": [b / a if a else 1.0 for a, b in sizes],
            "original_crc": pd.array(crc32c_of(raw), "Int64"),
            "compressed_crc": pd.array(crc32c_of(packed), "Int64"),
            "original_hash": [None if x is None else hashlib.sha256(x).hexdigest() for x in raw],
            "compressed_hash": [None if x is None else hashlib.sha256(x).hexdigest() for x in packed],
            "verified": [x is not None and decompressed(p, len(x)) == x for x, p in zip(raw, packed, strict=True)],
        }
    )


@F.pandas_udf(_fields(ratio=T.DoubleType(), worthwhile=T.BooleanType()))
def benefit_estimate(payload: pd.Series) -> pd.DataFrame:
    """Whether a sample from the front compresses well enough; too small ones don't."""

    def one(x):
        sample = (x or b"")[:SAMPLE_BYTES]
        ratio = len(compressed(sample)) / len(sample) if len(sample) >= SAMPLE_FLOOR else 1.0
        return ratio, ratio < USEFUL_RATIO

    return pd.DataFrame([one(x) for x in payload], columns=["ratio", "worthwhile"])


def content_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def verified(payload: Column, expected: Column) -> Column:
    return content_hash(payload) == expected


def parsed_hash(text: Column) -> Column:
    """64 hex digits in either case become lower case, anything else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def archive_blob_name(key: Column) -> Column:
    return F.concat(F.lit("blob-"), F.sha2(key.cast("binary"), 256))


def _device(stem: Column) -> Column:
    return F.upper(stem).rlike("^(CON|PRN|AUX|NUL|CLOCK\\$|COM[1-9]|LPT[1-9])$")


def valid_file_key(key: Column) -> Column:
    """A portable name for a payload file (2.10 key validation)."""
    stem = F.split(key, "\\.")[0]
    device = F.upper(stem).rlike("^(CON|PRN|AUX|NUL|CLOCK\\$|COM[1-9]|LPT[1-9])$")
    return (
        F.octet_length(key).between(1, 200)
        & ~key.isin(".", "..")
        & ~key.startswith(".tmp-")
        & key.rlike("^[\\x20-\\x7E]*$")
        & ~key.rlike('[A-Z<>:"/\\\\|?*]')
        & ~key.rlike("[. ]$")
        & ~device
    )


def valid_archive_key(key: Column) -> Column:
    """A portable relative path for an archive blob."""
    parts = F.split(key, "/")
    bad_part = F.exists(parts, lambda p: (p == "") | p.rlike("[. ]$") | _device(F.split(p, "\\.")[0]))
    return (
        F.octet_length(key).between(1, 200)
        & key.rlike("^[\\x20-\\x7E]*$")
        & ~key.startswith("/")
        & ~key.rlike('[A-Z<>:"\\\\|?*]')
        & ~bad_part
        & ~F.translate(key, "/", "-").startswith(".tmp-archive-")
    )

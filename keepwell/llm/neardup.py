"""Operator 5: near-duplicates by SimHash and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
padded to a word of 23.  The binary Golay code [23, 12, 7] is perfect: every
word lies within 3 of exactly one codeword.  Write ``near(w)`` for that
codeword's 12-bit index, and ``around(w)`` for the indices within 3 or 4 of
``w``: one where the word is within 2 of its codeword, six where it is 3 away.
If ``x`` and ``y`` differ in at most one bit, ``near(y)`` is in ``around(x)``.

At most 3 differing bits fall on three segments either as 1, 1, 1, or they
leave one segment untouched and touch a second one at most once.  So a pair
within 3 bits meets under one of these keys, whichever of both comes first:

* for each ordered pair of segments (i, j): segment i exactly, with the index
  of segment j (one side: ``near``, other side: each of ``around``), 33 bits;
* for all three: ``near`` of the first with ``around`` of the other two on one
  side, ``around`` of the first with ``near`` of the others on the other side,
  36 bits.

Rows are brought together by key and verified.  Keys are long enough that
fingerprints that only chance brings together are few, so the work grows with
the number of distinct fingerprints.  Those of thousands of near copies under
one key are linked by a spanning forest, never by all pairs; a key with more
fingerprints than ``BLOCK`` is cut into blocks as it streams by, and the pairs
of its blocks are compared elsewhere, so no task holds more than two blocks.
Rows of keys are counted by hash bucket beforehand; those of a bucket far above
the others are dealt to several tasks, whose blocks are compared likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import map_batches, stored

SHINGLE = 3
MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the [23, 12] binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Rows of one key that are compared at once; a key with more is dealt out in blocks, with the same result.
BLOCK = 8192
#: Buckets in which rows of keys are counted, and how far above the mean one is dealt to several tasks.
BUCKETS, HOT = 1 << 16, 4
#: Bits of a key; what is above them says which deal of a hot bucket a row is in (from 1 on).
KEY_BITS = 44
#: Documents to leave out up to which their ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles (XXH64, seed 42) of a text with A-Z in lower case; without words 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 65_536):
        raw = b"".join([digest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + 65_536))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)  # most significant bit first
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row of ``docs``, which has doc_id and text."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


# --- the code -------------------------------------------------------------------------------------


def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of 2^12 indices the 11 check bits; for each of 2^11 syndromes the error, and the index changes to the codewords 4 away.

    A codeword is its index followed by its check bits.  Errors have weight 3 at
    most; one of weight 3 is part of five codewords of weight 7, which are those
    4 away.  The code is linear, so this holds around every codeword.
    """
    index = np.arange(1 << 12, dtype=np.int64)
    checks = index << 11
    for bit in range(22, 10, -1):
        checks ^= np.where(checks >> bit & 1, GENERATOR << (bit - 11), 0)
    weight7 = [c for c in ((index << 11) | checks).tolist() if c.bit_count() == 7]
    error = np.zeros(1 << 11, np.int64)
    change = np.zeros((1 << 11, 5), np.int64)
    ones = [1 << a for a in range(23)]
    for e in {a | b | c for a in ones for b in ones for c in ones}:
        syndrome = (e & 0x7FF) ^ int(checks[e >> 11])
        error[syndrome] = e
        if e.bit_count() == 3:
            change[syndrome] = [c >> 11 for c in weight7 if c & e == e]
    return checks, error, change


_code: list[np.ndarray] = []


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the codeword within 3 of each word, and the word's syndrome."""
    if not _code:  # built once for each process, from the generator alone
        _code.extend(golay())
    checks, error, _ = _code
    syndrome = (words & 0x7FF) ^ checks[words >> 11]
    return (words ^ error[syndrome]) >> 11, syndrome


def around(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs in order of row: six for a word 3 away from its codeword, else one."""
    first, syndrome = decode(words)
    change = _code[2][syndrome]
    found = np.concatenate([first[:, None], first[:, None] ^ change], axis=1)
    used = np.concatenate([np.ones((len(words), 1), bool), np.repeat(change.any(axis=1)[:, None], 5, axis=1)], axis=1)
    return np.nonzero(used)[0], found[used]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key) of unsigned fingerprints: 7 to 42 rows on either side."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    one = [decode(p)[0] for p in parts]
    many = [around(p) for p in parts]
    everyone = np.arange(len(fps))
    rows, sides, out = [], [], []

    def put(side, row, kind, key):
        rows.append(row)
        sides.append(np.full(len(row), side, np.int8))
        out.append(kind << 40 | key)

    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        put(0, everyone, kind, parts[i] << 12 | one[j])
        row, index = many[j]
        put(1, row, kind, parts[i][row] << 12 | index)
    row, index = many[0]
    put(1, row, 6, index << 24 | one[1][row] << 12 | one[2][row])
    # Each pair of one index of the second segment and one of the third.
    (r1, i1), (r2, i2) = many[1], many[2]
    n2 = np.bincount(r2, minlength=len(fps))
    reps = n2[r1]
    within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    row = np.repeat(r1, reps)
    put(0, row, 6, one[0][row] << 24 | np.repeat(i1, reps) << 12 | i2[(np.cumsum(n2) - n2)[row] + within])
    return np.concatenate(rows), np.concatenate(sides), np.concatenate(out)


# --- links ----------------------------------------------------------------------------------------


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect whatever distinct fingerprints are within ``bits`` of each other, fewer than there are fingerprints.

    Breadth first from the smallest: each is compared, once, with those that nothing has reached yet.
    """
    rest, found = np.unique(fps), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = np.bitwise_count(rest ^ x) <= bits
            if close.any():
                reached = rest[close]
                found += [(int(x), int(y)) for y in reached]
                queue += list(reached)
                rest = rest[~close]
    return found


FOUND = "a bigint, b bigint, key bigint, part int, members binary"
FOUND_TYPES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("members", pa.binary())])


def rows_found(links: list[tuple[int, int]], blocks: list[tuple[int, int, np.ndarray]] = ()) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    n, m = len(pairs), len(blocks)
    cols = [
        pa.array([*pairs[:, 0].tolist(), *[None] * m], pa.int64()),
        pa.array([*pairs[:, 1].tolist(), *[None] * m], pa.int64()),
        pa.array([*[None] * n, *[k for k, _, _ in blocks]], pa.int64()),
        pa.array([*[None] * n, *[i for _, i, _ in blocks]], pa.int32()),
        pa.array([*[None] * n, *[x.tobytes() for _, _, x in blocks]], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, schema=FOUND_TYPES)


def meet(batches):
    """From rows (key, side, fp) in order of key: links, and the blocks of keys with more than BLOCK rows."""
    key, side, fps = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    part, cut = 0, None  # the next block's number of the key that is being cut into blocks

    def block(x, k):
        nonlocal part, cut
        x = np.unique(x)
        part, cut = (part + 1 if cut == k else 0), k
        return rows_found(forest(x), [(k, part, x)])

    for b in chained(batches):
        if b is not None:
            key = np.concatenate([key, b.column("key").to_numpy()])
            side = np.concatenate([side, b.column("side").to_numpy()])
            fps = np.concatenate([fps, b.column("fp").to_numpy().view(np.uint64)])
        if not len(key):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        if b is not None:  # the last key may go on
            starts, last = starts[:-1], starts[-1]
        else:
            last = len(key)
        if len(starts):
            ends = np.concatenate([starts[1:], [last]])
            if cut == key[0]:
                yield block(fps[: ends[0]], cut)
                starts, ends = starts[1:], ends[1:]
            links = []
            if len(starts):
                at = starts[0]
                edges = starts - at
                low, high = np.minimum.reduceat(fps[at:last], edges), np.maximum.reduceat(fps[at:last], edges)
                sides = np.add.reduceat(side[at:last].astype(np.int64), edges)
                dealt = key[starts] >> KEY_BITS > 0  # others of the same key are elsewhere
                for i in np.flatnonzero((low != high) & (sides > 0) & (sides < ends - starts) & ~dealt):
                    links += forest(fps[starts[i] : ends[i]])
                for i in np.flatnonzero(dealt):
                    yield block(fps[starts[i] : ends[i]], int(key[starts[i]]))
            if links:
                yield rows_found(list(dict.fromkeys(links)))
        key, side, fps = key[last:], side[last:], fps[last:]
        while len(key) > BLOCK:
            yield block(fps[:BLOCK], int(key[0]))
            key, side, fps = key[BLOCK:], side[BLOCK:], fps[BLOCK:]


def chained(batches):
    yield from batches
    yield None


def scattered(x: np.ndarray, n: int) -> np.ndarray:
    """A number below ``n`` (at most 2^32) by the high bits of a product."""
    return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def parts_of(batches):
    for b in batches:
        fps = b.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fps), 2_000):
            yield fps[i : i + 2_000]


def loads(batches):
    """Rows (bucket, n) of a partition's keys."""
    total = np.zeros(BUCKETS, np.int64)
    for part in parts_of(batches):
        total += np.bincount(scattered(keys(part)[2], BUCKETS).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def deals(distinct: DataFrame) -> np.ndarray:
    """To how many tasks the rows of each bucket go: one, but for buckets far above the mean.  BUCKETS numbers reach the driver."""
    rows = map_batches(distinct.select("fp"), loads, "bucket int, n bigint", rows=10_000).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BUCKETS, np.int64)
    for r in rows:
        n[r["bucket"]] = r["n"]
    usual = max(HOT * BLOCK, int(HOT * n.mean()))
    return np.minimum(np.where(n > usual, -(-n // usual), 1), 1 << 18).astype(np.int64)


def spread(n_deals):
    def run(batches):
        n = n_deals()
        for part in parts_of(batches):
            row, side, key = keys(part)
            to = n[scattered(key, BUCKETS).astype(np.int64)]
            if (to > 1).any():
                own = (scattered(part, 1 << 32)[row] % to.astype(np.uint64)).astype(np.int64) + 1
                key = key | np.where(to > 1, own, 0) << KEY_BITS
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(part[row].view(np.int64))], ["key", "side", "fp"])

    return run


def compare(batches):
    for b in batches:
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            yield rows_found(forest(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that are within 3 bits of each other."""
    shared = distinct.sparkSession.sparkContext.broadcast(deals(distinct))
    met = map_batches(distinct.select("fp"), spread(lambda: shared.value), "key bigint, side tinyint, fp bigint", rows=10_000)
    found = stored(map_batches(met.repartition("key").sortWithinPartitions("key"), meet, FOUND, rows=50_000))
    across = map_batches(block_pairs(found), compare, FOUND, rows=16)
    return found.filter(F.col("a").isNotNull()).select("a", "b").union(across.select("a", "b")).distinct()


def block_pairs(found: DataFrame) -> DataFrame:
    """(x, y): the members of each two blocks of a key.  Pairs are made of names alone; members are joined by key and block, never by key."""
    low = (1 << KEY_BITS) - 1
    blocks = found.filter(F.col("members").isNotNull()).select(F.col("key").bitwiseAND(F.lit(low)).alias("key"), F.struct(F.shiftright("key", KEY_BITS).alias("deal"), "part").alias("p"), "members")
    names = blocks.select("key", "p")
    pairs = names.join(names.select("key", F.col("p").alias("q")), "key").filter("p < q")
    one = pairs.join(blocks.select("key", "p", F.col("members").alias("x")), ["key", "p"])
    return one.join(blocks.select("key", F.col("p").alias("q"), F.col("members").alias("y")), ["key", "q"]).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a, b): the smallest vertex that it reaches.

    Large-star and small-star steps in turn, until the links no longer change;
    each step is an aggregation by vertex and a join, and is stored.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.filter("a <> b").select(u.alias("u"), v.alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        before, state = state, now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``, which has doc_id and text; other columns are ignored.

    component_id is the smallest doc_id that can be reached over fingerprints
    with at most 3 differing bits.  Null and empty texts have fingerprint 0 and
    are linked like any other; null ids don't count as smallest (a component of
    none but those has a null id); repeated rows each get their row.
    """
    prints = stored(fingerprints(docs, shingle))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = stored(components(links(distinct)))
    linked = member.join(distinct, F.col("v") == F.col("fp")).select("v", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(smallest, "root").select(F.col("v").alias("fp"), "least")
    classes = stored(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars), one for each component: the one with the smallest doc_id.

    Of several rows with that doc_id the smallest in (text, lang, source, n_chars)
    stays.  Rows without a doc_id can't be named as copies; they all stay.
    """
    names = ["text", "lang", "source", "n_chars"]
    docs = docs.select("doc_id", *names)
    # Most documents stay as they are, where they are: only the others' ids are looked for.
    ids = near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    others = stored(ids.filter("not stays or n > 1").select("doc_id", "stays"))
    few = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
    several = few.filter("stays").select("doc_id")
    one = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*names)).alias("row")).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in names])
    return docs.join(few.select("doc_id"), "doc_id", "left_anti").select("doc_id", *names).unionByName(one)


def op5(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 hexadecimal digits; nulls, ties, repeated rows and empty tables as stated there."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

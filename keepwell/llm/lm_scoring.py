"""Operator 4: language-model scoring by context-tree weighting.

A byte is eight binary decisions, each node of the byte's bit tree has its own
context tree over the preceding bytes, and every node of a context tree keeps a
Krichevsky-Trofimov estimate of its bit.  The weighted probability of a node is
the even mixture of its own estimate and the product of its children's weighted
probabilities; the prediction in a context mixes the estimates of all depths
with the weights that follow.

Counts come from all training bytes, and every context that occurs is a node,
however rare: the model grows with the corpus and is never in one place.  Texts
are grouped into blocks; each block's distinct (context, byte) strings are
shared out by their two nearest context bytes, a share's task sums them over all
blocks, and the depths from ``NEAR`` on are computed in the share, at most one
context of three bytes (2^16 strings) or ``CHUNK`` strings at a time.  Only sums
for the contexts of one byte meet on the driver.  A block then gets the score of
each of its strings back.  A string of none but held-out texts takes part with a
count of 0, which leaves every weight as it is.

A text is framed by the byte 0xFF, which UTF-8 never has: as the context of its
first bytes, and as one end symbol.  The base score is a smoothed unigram model
of words; its vocabulary is never gathered in one place either: each block's
distinct words are shared out by ranges of their hash, a share's task sums every
word over all blocks and sends each block its counts back, and a block's texts
are scored from those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keepwell.llm.common import fold, map_batches, stored

DEPTH = 4
CONTEXTS = 16_384
FRAME = 0xFF
FOLDS, HELD_OUT = 5, 1
#: Bytes that one step of counting or scoring holds as 64-bit codes.
PIECE = 1 << 20
#: Texts of a block, and words after which it is closed.
BLOCK_TEXTS, BLOCK_WORDS = 2_000, 1_000_000
#: Words of all blocks, repeated between blocks, that a task counts.
SHARE_WORDS = 400_000
#: Likewise strings of all blocks; bytes of texts after which a block is closed; strings whose nodes are held at once.
SHARE_CODES = 400_000
BLOCK_BYTES = 1 << 24
CHUNK = 1 << 16
#: Contexts from this depth on are computed in the shares.
NEAR = 2
#: Distinct strings that a counting task holds before it hands them on.
HELD = 2_000_000


# --- counts ---------------------------------------------------------------------------------------


def framed(text: str | None) -> bytes:
    return b"\xff" * DEPTH + (text or "").encode() + b"\xff"


def codes(raw: np.ndarray) -> np.ndarray:
    """For each byte after the first DEPTH: that byte below its context, the nearest context byte lowest: 40 bits."""
    out = raw[DEPTH:].astype(np.int64)
    for back in range(1, DEPTH + 1):
        out |= raw[DEPTH - back : len(raw) - back].astype(np.int64) << np.int64(8 * back)
    return out


def pieces(texts: list[str | None]):
    """Codes of all texts, about PIECE at a time."""
    held, n = [], 0
    for t in texts:
        raw = np.frombuffer(framed(t), np.uint8)
        for at in range(0, len(raw) - DEPTH, PIECE):
            held.append(codes(raw[at : at + PIECE + DEPTH]))
            n += len(held[-1])
            if n >= PIECE:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([c for _, c in parts])[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(n, starts)


def count_strings(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for p in pieces(b.column("text").to_pylist()):
            held.append(np.unique(p, return_counts=True))
            if len(held) >= 8:
                held = [merged(held)]
                if len(held[0][0]) > HELD:
                    yield from handed_on(*held.pop())
    if held:
        yield from handed_on(*merged(held))


def handed_on(key: np.ndarray, n: np.ndarray):
    for i in range(0, len(key), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000]), pa.array(n[i : i + 50_000].astype(np.int64))], ["code", "n"])


# --- the model of a small corpus, in one place: what the shares compute, bounded by CONTEXTS ------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, moved up by 12: within 1e-12 for x >= 1/2."""
    low = np.zeros_like(x)
    for i in range(12):
        low += np.log(x + i)
    y = x + 12
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - low


def bit_counts(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of the 255 inner nodes (node 1 is the root, 2k and 2k + 1 follow k) for rows of 256 byte counts."""
    nodes = np.zeros((len(table), 512))
    nodes[:, 256:] = table
    for k in range(255, 0, -1):
        nodes[:, k] = nodes[:, 2 * k] + nodes[:, 2 * k + 1]
    inner = np.arange(1, 256)
    return nodes[:, 2 * inner], nodes[:, 2 * inner + 1]


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


def byte_scores(p_one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probability of a one at each inner node."""
    one, zero = np.log10(p_one), np.log10(1 - p_one)
    total = np.zeros((len(p_one), 512))
    for k in range(1, 256):
        total[:, 2 * k] = total[:, k] + zero[:, k - 1]
        total[:, 2 * k + 1] = total[:, k] + one[:, k - 1]
    return total[:, 256:]


class Model:
    """Context ids by depth, and a row of byte scores for each leaf.

    ``steps[d]`` leads from (node of depth d, byte before) to a node of depth
    d + 1; -1 means "other".  ``leaf[d]`` gives the row of each node's "other"
    child, and at the deepest depth of the node itself.
    """

    def __init__(self, steps: list[np.ndarray], leaf: list[np.ndarray], scores: np.ndarray):
        self.steps, self.leaf, self.scores = steps, leaf, scores

    def rows(self, code: np.ndarray) -> np.ndarray:
        node = np.zeros(len(code), np.int64)
        row = np.full(len(code), -1, np.int64)
        for d in range(DEPTH):
            to = self.steps[d][node << 8 | (code >> (8 * (d + 1)) & 255)]
            gone = (to < 0) & (row < 0)
            row[gone] = self.leaf[d][node[gone]]
            node = np.maximum(to, 0)
        still = row < 0
        row[still] = self.leaf[DEPTH][node[still]]
        return row

    def score(self, code: np.ndarray) -> np.ndarray:
        return self.scores[self.rows(code), code & 255]


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """``levels[d]``: contexts of depth d (nearest byte lowest) in ascending order, and their rows of 256 counts; depth 0 has the empty one."""
    weighted: list[np.ndarray] = []  # log of the weighted probability, by depth from the deepest
    chosen: list[tuple] = []
    below = None
    steps: list[np.ndarray] = []
    for d in range(DEPTH, -1, -1):
        contexts, table = levels[d]
        zeros, ones = bit_counts(table)
        own = log_kt(zeros, ones)
        kt = (ones + 0.5) / (zeros + ones + 1)
        if d == DEPTH:
            weighted = own
            chosen.insert(0, (None, kt, None, None))
        else:
            kids, kid_table, kid_weighted = below
            mask = (1 << (8 * d)) - 1
            parent = np.searchsorted(contexts, kids & mask)
            other = table.copy()
            np.subtract.at(other, parent, kid_table)
            o_zeros, o_ones = bit_counts(other)
            children = log_kt(o_zeros, o_ones)
            np.add.at(children, parent, kid_weighted)
            weighted = np.logaddexp(own, children) - math.log(2)
            # Share of the node's own estimate in its prediction.
            share = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
            chosen.insert(0, (share, kt, (o_ones + 0.5) / (o_zeros + o_ones + 1), parent))
            step = np.full(len(contexts) << 8, -1, np.int32)
            step[parent << 8 | (kids >> (8 * d))] = np.arange(len(kids))
            steps.insert(0, step)
        below = (contexts, table, weighted)
    # Predictions from the root down: what is above a node mixes linearly, as a * prediction of the child + b.
    leaf, out, n = [], [], 0
    a, b = np.ones((1, 255)), np.zeros((1, 255))
    for d in range(DEPTH + 1):
        share, kt, other, parent = chosen[d]
        if d < DEPTH:
            b = b + a * share * kt
            a = a * (1 - share)
            p = a * other + b
        else:
            p = a * kt + b
        out.append(byte_scores(p).astype(np.float32))
        leaf.append(np.arange(n, n + len(p)))
        n += len(p)
        if d < DEPTH:
            up = chosen[d][3]
            a, b = a[up], b[up]
    return Model(steps, leaf, np.concatenate(out))


def train(docs: DataFrame, contexts: int = CONTEXTS) -> Model:
    """The model of all texts of ``docs`` without contexts of less than ``1 / contexts`` of the bytes, which are their parent's "other" child.

    For looking at a model as a whole; ``score`` doesn't use it.
    """
    strings = stored(map_batches(docs.select("text"), count_strings, "code bigint, n bigint", rows=1000).groupBy("code").agg(F.sum("n").alias("n")))
    total = strings.agg(F.sum("n")).first()[0] or 0
    levels = []
    kept = None
    for d in range(DEPTH + 1):
        mask = (1 << (8 * (d + 1))) - 1
        level = strings.groupBy(F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(F.sum("n").alias("n"))
        if d:
            context = F.shiftright("code", 8)
            often = level.groupBy(context.alias("context")).agg(F.sum("n").alias("m")).filter(F.col("m") * contexts >= total).select("context")
            level = level.withColumn("context", context).join(F.broadcast(often), "context", "left_semi").select("code", "n")
        found = level.toPandas()
        code, n = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
        if d == 0:
            kept = np.zeros(1, np.int64)
        else:  # a context's own suffix takes at least as large a share
            kept = np.unique(code >> 8)
        table = np.zeros((len(kept), 256))
        table[np.searchsorted(kept, code >> 8), code & 255] = n
        levels.append((kept, table))
    return build(levels)


# --- the model, in shares --------------------------------------------------------------------------


def turned(code: np.ndarray) -> np.ndarray:
    """Codes with the nearest context byte highest and the byte itself lowest, so that in order a context's strings are neighbours."""
    return (code.byteswap() >> 24) << 8 & ((1 << 40) - 1) | code & 255


def share_of(code: np.ndarray, n_shares: int) -> np.ndarray:
    """A range of the hash of the two nearest context bytes."""
    return (scattered(code) * np.uint64(n_shares)) >> np.uint64(32)


def scattered(code: np.ndarray) -> np.ndarray:
    return (code >> 24).astype(np.uint64) * np.uint64(2_654_435_761) & np.uint64(0xFFFFFFFF)


def packed(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each number, all lowest bytes first: of numbers in order the higher ones compress well."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.int64).ravel()


def block_strings(texts: list[str | None], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct turned codes of the texts in order of share, then code; and how often each is in those that are not held out."""
    parts = []
    for out in (False, True):
        for p in pieces([t for t, h in zip(texts, held, strict=True) if h is out]):
            code, n = np.unique(turned(p), return_counts=True)
            parts.append((code, n * (not out)))
    code, n = merged(parts)
    order = np.argsort(scattered(code), kind="stable")
    return code[order], n[order]


def nodes(code: np.ndarray, n: np.ndarray, depth: int, below: list[tuple] | None = None) -> list[tuple]:
    """By bit: (name, log of the weighted probability, estimate of a one, share of the own estimate, zeros, ones) of the nodes of a depth.

    A name is a context above the bits of the byte so far.  ``below`` has the
    names and weighted probabilities of the next depth; without it a node is a leaf.
    """
    key, m = merged([(code >> 8 * (DEPTH + 1 - depth) << 8 | code & 255, n)])
    out = []
    for bit in range(8):
        name = key >> (8 - bit)
        starts = np.flatnonzero(np.diff(name, prepend=-1))
        ones = np.add.reduceat(m * (key >> (7 - bit) & 1), starts).astype(np.float64)
        zeros = np.add.reduceat(m, starts) - ones
        name, own = name[starts], log_kt(zeros, ones)
        weighted, share = own, np.ones(len(own))
        if below is not None:
            deeper, w = below[bit][:2]
            up = deeper >> (8 + bit) << bit | deeper & ((1 << bit) - 1)
            children = np.bincount(np.searchsorted(name, up), w, len(name))
            weighted = np.logaddexp(own, children) - math.log(2)
            share = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
        out.append((name, weighted, (ones + 0.5) / (zeros + ones + 1), share, zeros, ones))
    return out


def chunks(code: np.ndarray):
    """Slices of about CHUNK strings that cut no context of three bytes."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(code >> 16)) + 1, [len(code)]])
    at = 0
    while at < len(code):
        end = int(starts[max(np.searchsorted(starts, at + CHUNK, "right") - 1, np.searchsorted(starts, at, "right"))])
        yield slice(at, end)
        at = end


def near_nodes(code: np.ndarray, n: np.ndarray) -> list[tuple]:
    """The nodes of depth NEAR of a share, which has all strings of its contexts of that depth."""
    found = []
    for c in chunks(code):
        found.append([x[:2] for x in nodes(code[c], n[c], NEAR + 1, nodes(code[c], n[c], DEPTH))])
    below = [tuple(np.concatenate([f[bit][i] for f in found]) for i in range(2)) for bit in range(8)]
    return nodes(code, n, NEAR, below)


def string_scores(code: np.ndarray, n: np.ndarray, above: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the byte of each string of a share in its context; ``above`` is what the depths under NEAR give."""
    near, out = near_nodes(code, n), np.zeros(len(code))
    for c in chunks(code):
        x, symbol = code[c], code[c] & 255
        deepest = nodes(x, n[c], DEPTH)
        by_depth = [near, nodes(x, n[c], NEAR + 1, deepest), deepest]
        for bit in range(8):
            inner = (256 | symbol) >> (8 - bit)
            a, b = (t[x >> 32, inner] for t in above)
            for depth, level in enumerate(by_depth, NEAR):
                name, _, kt, share = level[bit][:4]
                at = np.searchsorted(name, x >> 8 * (DEPTH + 1 - depth) << bit | symbol >> (8 - bit))
                b = b + a * share[at] * kt[at]
                a = a * (1 - share[at])
            out[c] += np.log10(np.where(symbol >> (7 - bit) & 1, b, 1 - b))
    return out.astype(np.float32)


def code_shares(n_shares: int):
    """From blocks: (share, block, codes, learned)."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for block, codes_, learned in zip(*[b.column(c).to_pylist() for c in ("block", "codes", "code_counts")], strict=True):
                code, n = unpacked(codes_, 5), unpacked(learned, 5)
                share = share_of(code, n_shares)
                starts = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]])).tolist()
                rows += [(int(share[i]), block, packed(code[i:j], 5), packed(n[i:j], 5)) for i, j in zip(starts, [*starts[1:], len(code)], strict=True)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["share", "block", "codes", "learned"])

    return run


def summed(batches):
    """From rows (share, codes, learned) in order of share: one row for each share, with its strings, their counts over all blocks and its sums for contexts of one byte."""
    now, held, size = None, [], 0

    def close():
        code, n = merged(held)
        sums = np.zeros((3, 1 << 16))
        for bit, (name, weighted, _, _, zeros, ones) in enumerate(near_nodes(code, n)):
            at = name >> (8 + bit) << 8 | 1 << bit | name & ((1 << bit) - 1)
            for row, x in zip(sums, (zeros, ones, weighted), strict=True):
                row += np.bincount(at, x, 1 << 16)
        at = np.flatnonzero(sums.any(axis=0))
        cols = [pa.array([now], pa.int64()), *[pa.array([x], pa.binary()) for x in (packed(code, 5), packed(n, 5), at.astype(np.int64).tobytes(), sums[:, at].tobytes())]]
        return pa.RecordBatch.from_arrays(cols, ["share", "codes", "learned", "at", "sums"])

    for b in batches:
        for share, codes_, learned in zip(*[b.column(c).to_pylist() for c in ("share", "codes", "learned")], strict=True):
            if share != now and held:
                yield close()
                held, size = [], 0
            now = share
            held.append((unpacked(codes_, 5), unpacked(learned, 5)))
            size += len(held[-1][0])
            if len(held) > 1 and size > max(SHARE_CODES, 2 * len(held[0][0])):
                held = [merged(held)]
                size = len(held[0][0])
    if held:
        yield close()


def top_sums(batches):
    total = np.zeros((3, 1 << 16))
    for b in batches:
        for at, sums in zip(b.column("at").to_pylist(), b.column("sums").to_pylist(), strict=True):
            at = np.frombuffer(at, np.int64)
            total[:, at] += np.frombuffer(sums).reshape(3, -1)
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in total]], ["at", "zeros", "ones", "weighted"])


def mixed_above(strings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), by nearest byte and inner node: the prediction there is a * that of depth NEAR + b."""
    rows = map_batches(strings.select("at", "sums"), top_sums, "at bigint, zeros double, ones double, weighted double", rows=16)
    rows = rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toPandas()
    zeros, ones, children = (np.zeros((256, 256)) for _ in range(3))
    for table, c in ((zeros, "zeros"), (ones, "ones"), (children, "weighted")):
        table.ravel()[rows["at"].to_numpy(np.int64)] = rows[c].to_numpy(np.float64)

    def own(zeros, ones, children):
        kt = log_kt(zeros, ones)
        return (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(children - kt, -700, 700))), np.logaddexp(kt, children) - math.log(2)

    kt1, share1, weighted1 = own(zeros, ones, children)
    kt0, share0, _ = own(zeros.sum(axis=0), ones.sum(axis=0), weighted1.sum(axis=0))
    return (1 - share0) * (1 - share1), share0 * kt0 + (1 - share0) * share1 * kt1


def answered(above_of):
    """From rows (share, block, codes, learned) in order of share and block, the share's strings first, as block -1: each block's scores."""

    def run(batches):
        above = above_of()
        code = scores = None
        for b in batches:
            out: list[tuple] = []
            for share, block, codes_, learned in zip(*[b.column(c).to_pylist() for c in ("share", "block", "codes", "learned")], strict=True):
                if block < 0:
                    code = unpacked(codes_, 5)
                    scores = string_scores(code, unpacked(learned, 5), above)
                else:
                    out.append((share, block, scores[np.searchsorted(code, unpacked(codes_, 5))].tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["share", "block", "scores"])

    return run


class Strings:
    """Scores of a block's strings."""

    def __init__(self, code: np.ndarray, scores: np.ndarray):
        order = np.argsort(code)
        self.code, self.scores = code[order], scores[order]

    def score(self, code: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(turned(code), return_inverse=True)
        return self.scores[np.searchsorted(self.code, distinct)][back]


# --- scoring --------------------------------------------------------------------------------------


def text_scores(model: Model | Strings, texts: list[str | None]) -> np.ndarray:
    """log10 probability of each text and its end."""
    out = np.zeros(len(texts))
    held, ids, n = [], [], 0

    def flush():
        if held:
            s = model.score(np.concatenate(held)).astype(np.float64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
            np.add.at(out, ids, np.add.reduceat(s, at))

    for i, t in enumerate(texts):
        raw = np.frombuffer(framed(t), np.uint8)
        for at in range(0, len(raw) - DEPTH, PIECE):
            held.append(codes(raw[at : at + PIECE + DEPTH]))
            ids.append(i)
            n += len(held[-1])
            if n >= PIECE:
                flush()
                held, ids, n = [], [], 0
    flush()
    return out


END = b""  # stands among words for the end of a text


def hashes(words: list[bytes]) -> np.ndarray:
    """32 bits of each word, by which its counts are shared out."""
    return np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32)


BLOCK = "block bigint, n_words bigint, words binary, learned binary, texts binary, n_codes bigint, codes binary, code_counts binary"


def blocks(id_type: pa.DataType):
    """A row for each block of texts: its distinct words in order of hash, how often each occurs in its training texts, its texts' columns and word numbers, and its distinct strings with their counts."""

    def close(block, words, learned, meta, which, times):
        order = np.argsort(hashes(list(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        names = list(words)
        texts = pa.table({**{k: pa.array(v, id_type if k == "doc_id" else pa.string() if k == "text" else None) for k, v in meta.items()}, "which": pa.array([rank[w].tobytes() for w in which], pa.binary()), "times": pa.array([t.tobytes() for t in times], pa.binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(texts)
        cols = [pa.array([block], pa.int64()), pa.array([len(names)], pa.int64()), *[pa.array([x], pa.binary()) for x in (b"\n".join([names[i] for i in order]), np.array(learned, np.int64)[order].tobytes(), sink.getvalue().to_pybytes())]]
        code, n = block_strings(meta["text"], meta["held_out"])
        cols += [pa.array([len(code)], pa.int64()), pa.array([packed(code, 5)], pa.binary()), pa.array([packed(n, 5)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["block", "n_words", "words", "learned", "texts", "n_codes", "codes", "code_counts"])

    def run(batches):
        number, base = 0, TaskContext.get().partitionId() << 32
        fresh = lambda: ({}, [], {"doc_id": [], "held_out": [], "n_tokens": [], "text": [], "n_bytes": []}, [], [], 0, 0)
        words, learned, meta, which, times, total, size = fresh()
        for b in batches:
            for doc_id, t, held in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "held_out")], strict=True):
                raw = (t or "").encode()
                tokens = raw.lower().split()
                tokens.append(END)
                own = np.array([words.setdefault(w, len(words)) for w in tokens], np.uint32)
                distinct, n = np.unique(own, return_counts=True)
                learned += [0] * (len(words) - len(learned))
                if not held:
                    for i, k in zip(distinct.tolist(), n.tolist(), strict=True):
                        learned[i] += k
                for k, v in (("doc_id", doc_id), ("held_out", held), ("n_tokens", len(tokens)), ("text", t), ("n_bytes", len(raw))):
                    meta[k].append(v)
                which.append(distinct)
                times.append(n.astype(np.uint32))
                total += len(tokens)
                size += len(raw)
                if len(which) >= BLOCK_TEXTS or total >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield close(base + number, words, learned, meta, which, times)
                    number += 1
                    words, learned, meta, which, times, total, size = fresh()
        if which:
            yield close(base + number, words, learned, meta, which, times)

    return run


def shares(n_shares: int):
    """From blocks: (share, block, words, learned), a share being a range of hashes, so that each word's counts meet in one."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for block, words, learned in zip(*[b.column(c).to_pylist() for c in ("block", "words", "learned")], strict=True):
                names, n = words.split(b"\n"), np.frombuffer(learned, np.int64)
                share = (hashes(names).astype(np.uint64) * np.uint64(n_shares)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]])).tolist()
                for i, j in zip(starts, [*starts[1:], len(names)], strict=True):
                    rows.append((int(share[i]), block, b"\n".join(names[i:j]), n[i:j].tobytes()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["share", "block", "words", "learned"])

    return run


def counted(table: pa.Table) -> pa.Table:
    """All rows of a share: each block's words' counts over all blocks; and one row without a block, of the sum and the number of counts."""
    total: dict[bytes, int] = {}
    blocks_, words, learned = (table.column(c).to_pylist() for c in ("block", "words", "learned"))
    for w, n in zip(words, learned, strict=True):
        for x, k in zip(w.split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
            if k:
                total[x] = total.get(x, 0) + k
    counts = [np.array([total.get(x, 0) for x in w.split(b"\n")], np.int64).tobytes() for w in words]
    share = table.column("share")[0].as_py()
    return pa.table(
        {
            "share": pa.array([share] * (len(words) + 1), pa.int64()),
            "block": pa.array([*blocks_, None], pa.int64()),
            "counts": pa.array([*counts, b""], pa.binary()),
            "total": pa.array([*[0] * len(words), sum(total.values())], pa.int64()),
            "distinct": pa.array([*[0] * len(words), len(total)], pa.int64()),
        }
    )


RESULT = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def base_scores(n_train: int, n_distinct: int):
    """From a block's texts and its words' counts, share after share: the result rows."""
    unseen = 0.5 * (n_distinct + 1)

    def run(batches):
        for b in batches:
            for texts, counts, code, scores in zip(*[b.column(c).to_pylist() for c in ("texts", "counts", "codes", "scores")], strict=True):
                t = pa.ipc.open_stream(texts).read_all()
                c = np.frombuffer(b"".join(counts), np.int64)
                each = np.log10((c + 0.5) / (n_train + unseen))
                known, base = [], []
                for which, n in zip(t.column("which").to_pylist(), t.column("times").to_pylist(), strict=True):
                    which, n = np.frombuffer(which, np.uint32), np.frombuffer(n, np.uint32)
                    known.append(int(n[c[which] > 0].sum()))
                    base.append(float((each[which] * n).sum()))
                strings = Strings(unpacked(code, 5), np.frombuffer(b"".join(scores), np.float32))
                score, n_bytes = text_scores(strings, t.column("text").to_pylist()), t.column("n_bytes").to_numpy()
                cols = [t.column("doc_id"), t.column("held_out"), t.column("n_tokens"), pa.array(known, pa.int64()), pa.array([n_train] * len(known), pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(-score * math.log2(10) / (n_bytes + 1))]
                yield from pa.table(cols, ["doc_id", *RESULT]).combine_chunks().to_batches()

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of ``docs`` (doc_id, text).

    Learned from the rows whose crc32(doc_id as text) mod 5 is not 1.  Null and
    empty texts are one end token and one end symbol.  A null doc_id counts as
    the empty text in the fold.  Equal texts have equal CTW scores (base scores
    up to the order of a sum).  Without training texts every count is 0.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    found = stored(map_batches(docs, blocks(id_type), BLOCK, rows=500))
    # As many shares as there are words of SHARE_WORDS in all blocks, so a share fits a task at any size.
    n_words, n_codes = (n or 0 for n in found.agg(F.sum("n_words"), F.sum("n_codes")).first())
    n_shares = max(1, -(-n_words // SHARE_WORDS))
    shared = map_batches(found.select("block", "words", "learned"), shares(n_shares), "share bigint, block bigint, words binary, learned binary", rows=4)
    counts = stored(shared.groupBy("share").applyInArrow(counted, "share bigint, block bigint, counts binary, total bigint, distinct bigint"))
    totals = counts.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    by_block = counts.filter("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("share", "counts"))).alias("parts")).select("block", F.col("parts.counts").alias("counts"))

    asked = stored(map_batches(found.select("block", "codes", "code_counts"), code_shares(max(1, -(-n_codes // SHARE_CODES))), "share bigint, block bigint, codes binary, learned binary", rows=4))
    strings = stored(map_batches(asked.select("share", "codes", "learned").repartition("share").sortWithinPartitions("share"), summed, "share bigint, codes binary, learned binary, at binary, sums binary", rows=64))
    above = spark.sparkContext.broadcast(mixed_above(strings))
    both = strings.select("share", F.lit(-1).cast("bigint").alias("block"), "codes", "learned").union(asked.select("share", "block", "codes", F.lit(None).cast("binary")))
    answers = map_batches(both.repartition("share").sortWithinPartitions("share", "block"), answered(lambda: above.value), "share bigint, block bigint, scores binary", rows=64)
    scored = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("share", "scores"))).alias("parts")).select("block", F.col("parts.scores").alias("scores"))
    return map_batches(
        found.select("block", "texts", "codes").join(by_block.join(scored, "block"), "block").select("texts", "counts", "codes", "scores"),
        base_scores(totals["n"] or 0, totals["v"] or 0),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
        rows=1,
    )

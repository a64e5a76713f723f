"""Operator 7: sentence-piece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is the path of greatest weight over its
characters, with an edge for each piece.  Weights are pairs (sum of scores, sum
of tie marks), compared in that order and added componentwise, so max and plus
form a semiring and paths are unique but for accidents of the tie marks.

A text falls into segments that no piece reaches over: a run of space marks with
what follows up to the next mark, or a line feed.  A worker solves each distinct
segment once.  A giant document is cut into chunks at fixed offsets, wherever
those fall.  The state at a cut is how many characters beyond it the last piece
covers; a chunk yields the matrix of best weights from each state at its begin
to each at its end.  Matrices are combined associatively along the document,
which settles the state at each cut, and then every chunk finds its own pieces
independently.

The scores are those of the given model's pieces, read as a unigram model.  The
public file is a BPE, whose scores are only the order of its merges.  Nothing is
trained here: ``model_bytes`` gives each piece the log-probability that the law
of Zipf and Mandelbrot assigns to its rank, and writes that down as a unigram
model, which the library reads too.  Characters without a piece are spelled in
byte pieces; they weigh nothing, for no segmentation can avoid them.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm import token_counts
from keepwell.llm.common import map_batches, stored
from keepwell.llm.token_counts import MARK, processor

SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Documents with more code points are cut into chunks of so many.
CHUNK = 32_768
#: Segments that a worker remembers, and the longest it does.
REMEMBERED, LONGEST = 250_000, 63

#: Tie marks have 18 bits: those of a remembered segment sum to less than 2^24, so its weight fits one 64-bit integer.
TIE, TIE_BITS = (1 << 18) - 1, 24
#: Characters with the most continuations have a column of their own in the table of transitions.
COLUMNS = 160

#: Offset of the law of ranks, and units of a score: whole numbers, whose sums are exact.
OFFSET, UNITS = 100, 4096
#: Chunks whose matrices one task multiplies.
FAN = 64
#: Shifts of scores above tie marks in whole segments of any length; characters after which chunks are tried for a common path.
HIGH, TRIED = 40, 256

Weight = tuple[int, int]
NONE: Weight = (-(1 << 62), 0)


# --- the model file ---------------------------------------------------------------------------------


def number_at(raw: bytes, at: int) -> tuple[int, int]:
    """A base-128 number of a protocol buffer, and what follows it."""
    value = shift = 0
    while True:
        b = raw[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def fields(raw: bytes) -> list[tuple[int, bytes]]:
    """(key, body) of a message's fields: bodies of texts and messages without their lengths, numbers as written."""
    out, at = [], 0
    while at < len(raw):
        key, at = number_at(raw, at)
        kind = key & 7
        if kind == 2:
            size, at = number_at(raw, at)
            end = at + size
        else:
            end = at + (8 if kind == 1 else 4) if kind in (1, 5) else number_at(raw, at)[1]
        out.append((key, raw[at:end]))
        at = end
    return out


def message(parts: list[tuple[int, bytes]]) -> bytes:
    return b"".join(number(key) + (number(len(body)) if key & 7 == 2 else b"") + body for key, body in parts)


# Keys of the format's fields: pieces and the trainer's settings; a piece's score and type; the settings' model type.
PIECE, SETTINGS, SCORE, TYPE, MODEL_TYPE = 1 << 3 | 2, 2 << 3 | 2, 2 << 3 | 5, 3 << 3, 3 << 3
NORMAL, USER_DEFINED, UNIGRAM = 1, 4, 1


def unigram(bpe: bytes) -> bytes:
    """The BPE model ``bpe`` as a unigram model: a score of -r, the rank of a merge, becomes -log(r + OFFSET), in whole units."""
    out = []
    for key, body in fields(bpe):
        if key == PIECE:
            parts = fields(body)
            own = dict(parts)
            if number_at(own.get(TYPE, b"\x01"), 0)[0] in (NORMAL, USER_DEFINED):
                rank = -struct.unpack("<f", own.get(SCORE, bytes(4)))[0]
                parts = [p for p in parts if p[0] != SCORE] + [(SCORE, struct.pack("<f", round(-math.log(max(rank, 0) + OFFSET) * UNITS)))]
            body = message(parts)
        elif key == SETTINGS:
            body = message([p for p in fields(body) if p[0] != MODEL_TYPE] + [(MODEL_TYPE, number(UNIGRAM))])
        out.append((key, body))
    return message(out)


def model_bytes(path: str | None = None) -> bytes:
    """The unigram model of the BPE file at ``path``, by default of the public one; a file that is a unigram model stays as it is."""
    raw = token_counts.model_bytes(path)
    settings = dict(fields(dict(fields(raw)).get(SETTINGS, b"")))
    return raw if number_at(settings.get(MODEL_TYPE, b"\x01"), 0)[0] == UNIGRAM else unigram(raw)


class Vocabulary(NamedTuple):
    """ids: every prefix of a piece, with its id or -1; spelling: UTF-8 of each id, marks as spaces."""

    ids: dict[str, int]
    scores: list[int]
    spelling: list[bytes]
    bytes_from: int
    longest: int


def vocabulary(model: bytes) -> Vocabulary:
    sp = processor(model)
    ids: dict[str, int] = {}
    scores, spelling, byte_ids = [], [], []
    for i in range(sp.get_piece_size()):
        p, score = sp.id_to_piece(i), sp.get_score(i)
        scores.append(round(score))
        if sp.is_byte(i):
            byte_ids.append(i)
            spelling.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            spelling.append(b"")
        else:
            if score != round(score):
                raise ValueError("sums of scores would not be exact")
            if "\n" in p or re.search(f"[^{MARK}]{MARK}", p):
                raise ValueError(f"a piece reaches over segments: {p}")
            spelling.append(p.replace(MARK, " ").encode())
            for n in range(1, len(p)):
                ids.setdefault(p[:n], -1)
            ids[p] = i
    if byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError("the model has no byte pieces")
    return Vocabulary(ids, scores, spelling, byte_ids[0], max(map(len, ids)))


def tie(start: int, piece: int) -> int:
    return (piece * 2654435761 ^ (start + 1) * 40503) & TIE


def best_paths(v: Vocabulary, text: str, core: int, begin: int, rel: int) -> tuple[list[Weight], list[tuple[int, int] | None]]:
    """Weight of the best path from ``begin`` to each position, and its last edge (start, piece; -1 for an unknown character).

    Edges start before ``core`` and may end after it.  ``rel`` is the offset of
    position 0 in its segment, from which tie marks count.
    """
    get, scores, n, none = v.ids.get, v.scores, len(text), NONE[0]
    score, mark, edge = [none] * (n + 1), [0] * (n + 1), [None] * (n + 1)
    score[begin] = 0
    for i in range(begin, core):
        s = score[i]
        if s == none:
            continue
        t, one = mark[i], False
        for j in range(i + 1, n + 1):
            piece = get(text[i:j])
            if piece is None:
                break
            if piece >= 0:
                one = one or j == i + 1
                w = s + scores[piece]
                if w >= score[j]:
                    m = t + tie(rel + i, piece)
                    if w > score[j] or m > mark[j]:
                        score[j], mark[j], edge[j] = w, m, (i, piece)
        if not one and (s > score[i + 1] or s == score[i + 1] and t > mark[i + 1]):
            score[i + 1], mark[i + 1], edge[i + 1] = s, t, (i, -1)
    return list(zip(score, mark, strict=True)), edge


def path_ids(v: Vocabulary, text: str, edge: list[tuple[int, int] | None], begin: int, end: int) -> list[int]:
    out: list[int] = []
    while end > begin:
        start, piece = edge[end]
        out += [piece] if piece >= 0 else [v.bytes_from + b for b in reversed(text[start:end].encode())]
        end = start
    return out[::-1]


class Trie:
    """The pieces as arrays: transitions by (node, character), and the piece of each node or -1."""

    def __init__(self, v: Vocabulary):
        nodes = {"": 0} | {p: i + 1 for i, p in enumerate(v.ids)}
        self.piece = np.array([-1, *v.ids.values()], np.int64)
        moves = [(nodes[p[:-1]], p[-1], n) for p, n in nodes.items() if p]
        usual: dict[str, int] = {}
        for _, c, _ in moves:
            usual[c] = usual.get(c, 0) + 1
        chars = sorted(usual, key=lambda c: -usual[c])
        number = {c: i for i, c in enumerate(chars)}
        self.size, self.n_chars = min(COLUMNS, len(chars)), len(chars)
        #: Number of each code point, -1 for those in no piece; likewise, with -1 for those without a piece of their own.
        self.any, self.number = np.full(0x110000, -1, np.int32), np.full(0x110000, -1, np.int32)
        for c, i in number.items():
            self.any[ord(c)] = i
            if v.ids.get(c, -1) >= 0:
                self.number[ord(c)] = i
        self.dense = np.zeros((len(nodes), self.size), np.int32)
        rare = []
        for node, c, to in moves:
            if number[c] < self.size:
                self.dense[node, number[c]] = to
            else:
                rare.append((node * self.n_chars + number[c], to))
        rare.sort()
        self.keys = np.array([k for k, _ in rare] or [-1], np.int64)
        self.to = np.array([t for _, t in rare] or [0], np.int32)
        self.scores = np.array(v.scores, np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes; 0 where there is none."""
        out = self.dense[node, np.minimum(char, self.size - 1)]
        rare = np.flatnonzero(char >= self.size)
        if len(rare):
            key = node[rare].astype(np.int64) * self.n_chars + char[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.to[at], 0)
        return out

    def matches(self, text: str, core: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in ``text`` that starts before ``core``, in order of start, then end; and whether each of those characters is a piece."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, n = self.any[points], len(text)
        alive, node, found = np.arange(core), np.zeros(core, np.int32), []
        for size in range(1, longest + 1):
            if size > 1:
                more = alive + size <= n
                alive, node = alive[more], node[more]
            c = chars[alive + size - 1]
            node = np.where(c >= 0, self.step(node, np.maximum(c, 0)), 0)
            alive, node = alive[node > 0], node[node > 0]
            if not len(alive):
                break
            p = self.piece[node]
            found.append((alive[p >= 0], np.full(int((p >= 0).sum()), size), p[p >= 0]))
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(start, kind="stable")
        return start[order], (start + size)[order], piece[order], self.number[points[:core]] >= 0

    def search(self, text: str, core: int, begin: dict[int, int], rel: int, longest: int) -> tuple[list[int | None], list[tuple[int, int] | None]]:
        """``best_paths`` from several positions with given weights, each a score above HIGH bits of tie marks: all pieces are found at once, and one pass takes the best."""
        start, end, piece, single = self.matches(text, core, longest)
        add = (self.scores[piece] << HIGH) + ((piece * 2654435761 ^ (rel + start + 1) * 40503) & TIE)
        first = np.searchsorted(start, np.arange(core + 1)).tolist()
        end, piece, add, single = end.tolist(), piece.tolist(), add.tolist(), single.tolist()
        best: list[int | None] = [None] * (len(text) + 1)
        edge: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        for i, w in begin.items():
            best[i] = w
        for i in range(min(begin), core):
            w = best[i]
            if w is None:
                continue
            for k in range(first[i], first[i + 1]):
                j, new = end[k], w + add[k]
                if (old := best[j]) is None or new > old:
                    best[j], edge[j] = new, (i, piece[k])
            if not single[i] and ((old := best[i + 1]) is None or w > old):
                best[i + 1], edge[i + 1] = w, (i, -1)
        return best, edge

    def solve(self, segments: list[str], longest: int) -> list[bytes | None]:
        """Ids of segments of at most LONGEST characters; None for those with a character without a piece.

        All segments advance together: from each offset, along the trie, every
        piece offers its end a weight, and each end keeps the best.
        """
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        texts = [segments[i] for i in order]
        size = np.array([len(t) for t in texts], np.int64)
        chars = self.number[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        from_ = np.cumsum(size) - size
        base = from_ + np.arange(len(texts))  # each segment has one place more than characters
        bad = np.minimum.reduceat(chars, from_) < 0
        chars = np.maximum(chars, 0)
        best = np.full(len(chars) + len(texts), -(1 << 62), np.int64)
        best[base] = 0
        length, piece = np.zeros(len(best), np.int8), np.zeros(len(best), np.int32)
        for i in range(int(size[0])):
            alive = np.arange(np.searchsorted(-size, -i, "left"))  # longer than i
            node = np.zeros(len(alive), np.int32)
            for j in range(i + 1, i + longest + 1):
                if j > i + 1:
                    more = size[alive] >= j
                    alive, node = alive[more], node[more]
                node = self.step(node, chars[from_[alive] + j - 1])
                going = node > 0
                if not going.all():
                    alive, node = alive[going], node[going]
                if not len(alive):
                    break
                p = self.piece[node]
                ends = p >= 0
                whose, p = (alive, p) if ends.all() else (alive[ends], p[ends])
                weight = best[base[whose] + i] + (self.scores[p] << TIE_BITS) + ((p * 2654435761 ^ (i + 1) * 40503) & TIE)
                target = base[whose] + j
                better = weight > best[target]
                target = target[better]
                best[target], length[target], piece[target] = weight[better], j - i, p[better]
        # Back from every end at once; what comes last is found first.
        at, rows, found = size.copy(), [], []
        live = np.flatnonzero(~bad)
        while len(live):
            place = base[live] + at[live]
            rows.append(live)
            found.append(piece[place])
            at[live] -= length[place]
            live = live[at[live] > 0]
        raw, ends = b"", [0] * len(texts)
        if rows:
            row, ids = np.concatenate(rows[::-1]), np.concatenate(found[::-1])
            raw = ids[np.argsort(row, kind="stable")].astype(np.int32).tobytes()
            ends = (np.cumsum(np.bincount(row, minlength=len(texts))) * 4).tolist()
        out: list[bytes | None] = [None] * len(texts)
        begin = 0
        for i, end, wrong in zip(order, ends, bad.tolist(), strict=True):
            if not wrong:
                out[i] = raw[begin:end]
            begin = end
        return out


class Codec:
    """Encodes and decodes; remembers the ids of segments, as 32-bit integers.  A segment's weight is the sum of its ids' scores."""

    def __init__(self, model: bytes):
        self.v = vocabulary(model)
        self.trie = Trie(self.v)
        self.letters = np.frombuffer(b"".join(self.v.spelling), np.uint8)
        self.sizes = np.array([len(x) for x in self.v.spelling], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.scores = np.array(self.v.scores, np.int64)
        self.ids: dict[str, bytes] = {}

    def learn(self, segments: set[str]) -> list[str]:
        """Solve what isn't known; returns the long ones, for ``forget`` after use."""
        rest = segments.difference(self.ids)
        if len(self.ids) + len(rest) > REMEMBERED:
            self.ids = {}
            rest = segments
        usual = [s for s in rest if len(s) <= LONGEST]
        for at in range(0, len(usual), 50_000):
            part = usual[at : at + 50_000]
            self.ids.update(zip(part, self.trie.solve(part, self.v.longest), strict=True))
        for s in rest:
            if self.ids.get(s) is None:  # long, or with a character without a piece
                edge = self.trie.search(s, len(s), {0: 0}, 0, self.v.longest)[1]
                self.ids[s] = np.array(path_ids(self.v, s, edge, 0, len(s)), np.int32).tobytes()
        return [s for s in rest if len(s) > LONGEST]

    def forget(self, segments: list[str]) -> None:
        for s in segments:
            del self.ids[s]

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[int]]:
        """Ids, as bytes of 32-bit integers, and scores."""
        found = [SEGMENT.findall(marked(t)) for t in texts]
        long = self.learn(set().union(*found))
        ids = [b"".join(map(self.ids.__getitem__, s)) for s in found]
        self.forget(long)
        done = np.concatenate([[0], np.cumsum(self.scores[np.frombuffer(b"".join(ids), np.int32)])])
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        return ids, (done[ends[1:]] - done[ends[:-1]]).tolist()

    def decode(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        """Texts of ids, cut at ``ends``; without the mark that encoding puts first."""
        size = self.sizes[ids]
        done = np.cumsum(size)
        at = np.arange(int(done[-1]) if len(done) else 0) + np.repeat(self.starts[ids] - (done - size), size)
        raw = self.letters[at].tobytes()
        out, begin = [], 0
        for end in ends:
            stop = int(done[end - 1]) if end else 0
            text = raw[begin:stop].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
            begin = stop
        return out

    # --- chunks

    def parts(self, core: str, look: str, rel: int) -> tuple[int, int]:
        """The first and the last begin of a segment in a chunk; -1, -1 if there is none."""
        first = 0 if rel == 0 else first_begin(core)
        if first < 0:
            return -1, -1
        last = max(first, last_begin(core, 0, len(core)))
        if look and safe_between(core[-1], look[0]):
            last = len(core)
        return first, last

    def middles(self, chunks: list[tuple]) -> list[str]:
        """Solve the whole segments of all (core, look, rel, ...) at once."""
        found: set[str] = set()
        for core, look, rel, *_ in chunks:
            first, last = self.parts(core, look, rel)
            if first >= 0:
                found.update(SEGMENT.findall(core[first:last]))
        return self.learn(found)

    def transfer(self, core: str, look: str, rel: int) -> list[list[Weight]]:
        """[state at begin][state at end]: the best weights over pieces that start in the chunk.  ``middles`` comes first."""
        size, n = self.v.longest, len(core)
        first, last = self.parts(core, look, rel)
        matrix = [[NONE] * size for _ in range(size)]
        if first < 0:
            return self.through(core, look, rel)
        # Every path through the chunk has these pieces, so their tie marks don't matter.
        middle = (int(self.scores[np.frombuffer(b"".join(map(self.ids.__getitem__, SEGMENT.findall(core[first:last]))), np.int32)].sum()), 0)
        end = best_paths(self.v, core[last:] + look, n - last, 0, 0)[0][n - last :]
        for i in range(min(size, first + 1)):
            head = best_paths(self.v, core[:first], first, i, rel)[0][first]
            if head != NONE:
                matrix[i][: len(end)] = [plus(plus(head, middle), e) for e in end[:size]]
        return matrix

    def through(self, core: str, look: str, rel: int) -> list[list[Weight]]:
        """``transfer`` of a chunk in which no segment begins.

        The paths of all states soon run through the same positions.  From where
        every row of the matrix so far is another plus a constant, they go on
        alike, and one search does for all.
        """
        text, n, size = core + look, len(core), self.v.longest
        search = lambda a, b, begin: self.trie.search(text[a : b + size - 1], b - a, begin, rel + a, size)[0]
        rows: list[dict[int, int]] = [{i: 0} if i < n else {} for i in range(size)]  # by position, from ``at`` on
        at, tried = 0, TRIED
        while at < n:
            least = [min(r.values()) if r else 0 for r in rows]
            apart = [tuple(sorted((j, w - low) for j, w in r.items())) for r, low in zip(rows, least, strict=True)]
            alike = set(filter(None, apart))
            to, tried = n if len(alike) == 1 else min(n, at + tried), 2 * tried
            after = {}
            for r in alike:  # one search for all rows that differ by a constant
                inside = {j - at: x for j, x in r if j < to}
                w = search(at, to, inside) if inside else []
                out = {at + j: x for j, x in enumerate(w) if x is not None and at + j >= to}
                for j, x in r:  # states that reach beyond this stretch
                    if j >= to and (j not in out or x > out[j]):
                        out[j] = x
                after[r] = out
            rows = [{j: low + x for j, x in after[r].items()} if r else {} for r, low in zip(apart, least, strict=True)]
            at = to
        matrix = [[NONE] * size for _ in range(size)]
        for i, r in enumerate(rows):
            for j, w in r.items():
                matrix[i][j - n] = (w >> HIGH, w & ((1 << HIGH) - 1))
        return matrix

    def chunk_ids(self, core: str, look: str, rel: int, i: int, j: int) -> bytes:
        """The ids of a chunk's pieces, given the states at its begin and end.  ``middles`` comes first."""
        n = len(core)
        first, last = self.parts(core, look, rel)
        if first < 0:
            text = core + look
            return np.array(path_ids(self.v, text, self.trie.search(text, n, {i: 0}, rel, self.v.longest)[1], i, n + j), np.int32).tobytes()
        head, tail = core[:first], core[last:] + look
        return b"".join(
            [
                np.array(path_ids(self.v, head, best_paths(self.v, head, first, i, rel)[1], i, first), np.int32).tobytes(),
                *map(self.ids.__getitem__, SEGMENT.findall(core[first:last])),
                np.array(path_ids(self.v, tail, best_paths(self.v, tail, n - last, 0, 0)[1], 0, n - last + j), np.int32).tobytes(),
            ]
        )


def plus(a: Weight, b: Weight) -> Weight:
    return NONE if NONE in (a, b) else (a[0] + b[0], a[1] + b[1])


def times(a: list[list[Weight]], b: list[list[Weight]]) -> list[list[Weight]]:
    """The max-plus product."""
    return [[max(plus(a[i][k], b[k][j]) for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``times`` of matrices as arrays of scores and tie marks."""
    none = NONE[0]
    lost = (a[0] == none)[:, :, None] | (b[0] == none)[None, :, :]
    score = np.where(lost, none, a[0][:, :, None] + b[0][None, :, :])
    mark = np.where(lost, 0, a[1][:, :, None] + b[1][None, :, :])
    best = score.max(axis=1)
    return best, np.where(score == best[:, None, :], mark, -1).max(axis=1)


def safe_between(left: str, right: str) -> bool:
    return left == "\n" or right == "\n" or (right == MARK and left != MARK)


def first_begin(text: str) -> int:
    """The first begin of a segment after position 0, or -1."""
    line = text.find("\n")
    line = line or 1 if line >= 0 else len(text) + 1
    mark = text.find(MARK, 1)
    while mark > 0 and text[mark - 1] == MARK:
        mark = text.find(MARK, mark + 1)
    found = min(line, mark) if mark > 0 else line
    return found if found <= len(text) else -1


def last_begin(text: str, low: int, high: int) -> int:
    """The last begin of a segment in (low, high], or -1."""
    line = text.rfind("\n", low, high + 1)
    line = -1 if line < 0 else line + 1 if line + 1 <= high else line if line > low else -1
    mark = text.rfind(MARK, low + 1, high + 1)
    while mark > low and text[mark - 1] == MARK:
        mark -= 1
    return max(line, mark if mark > low else -1)


def marked(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def cut(text: str, size: int, overlap: int):
    """(core, look, rel) of the chunks of a marked text; only the last may be shorter than ``size``, but not than ``overlap``."""
    ends = list(range(size, len(text), size)) + [len(text)]
    if len(ends) > 1 and ends[-1] - ends[-2] < overlap:
        ends.pop(-2)
    begin = safe = 0  # safe: the last begin of a segment up to here
    for end in ends:
        yield text[begin:end], text[end : end + overlap - 1], begin - safe
        safe = max(safe, last_begin(text, begin, end))
        begin = end


def settle(matrices: list[list[list[Weight]]], begin: int = 0, end: int = 0) -> list[int]:
    """The state at each cut, both ends included, on the best way through all chunks from one state to another."""
    size = len(matrices[0])
    reach = [[(0, 0) if i == begin else NONE for i in range(size)]]
    for m in matrices:
        reach.append(times([reach[-1]], m)[0])
    states = [end]
    for before, m in zip(reverse(reach[:-1]), reverse(matrices), strict=True):
        states.append(max(range(size), key=lambda k: (plus(before[k], m[k][states[-1]]), -k)))  # noqa: B023
    return states[::-1]


def reverse(x: list) -> list:
    return x[::-1]


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    if (key := hash(model)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


# --- DataFrames -----------------------------------------------------------------------------------


def int_lists(raw: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def decoded(c: Codec, ids: pa.ListArray) -> list[str]:
    """Texts of an array of id lists; empty for null."""
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return c.decode(flat.astype(np.int64), (offsets[1:] - offsets[0]).tolist())


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, score for each row of ``docs``, which has doc_id and text.

    Null and empty texts have no ids and score 0.  A literal space mark counts
    as a space.  Equal texts have equal ids, cut or not.  Repeated rows each get
    their row; other columns are ignored.
    """
    return encoded(docs, path, chunk, "ids array<int>, score bigint", lambda c, ids, score: [ids, score])


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score, ids, and n_chars and text_crc32 of the text decoded from them."""

    def finish(c, ids, score):
        back = decoded(c, ids)
        n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
        return [n, score, ids, pa.array([len(t) for t in back], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64())]

    return encoded(docs, path, CHUNK, "n_tokens bigint, score bigint, ids array<int>, n_chars bigint, text_crc32 bigint", finish)


def encoded(docs: DataFrame, path: str | None, chunk: int, schema: str, finish) -> DataFrame:
    """doc_id and the columns that ``finish`` (codec, ids, scores) makes of a batch; in the worker that encodes, so that a task needs no second one."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))  # the model file's size
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]

    def whole(batches):
        c = codec(model.value)
        for b in batches:
            ids, scores = c.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *finish(c, int_lists(ids), pa.array(scores, pa.int64()))], names)

    def joined(batches):
        c = codec(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *finish(c, b.column("ids"), b.column("score"))], names)

    is_giant = F.coalesce(F.length("text"), F.lit(0)) > chunk
    giant = map_batches(encode_giant(docs.filter(is_giant), model, kind, chunk), joined, f"doc_id {kind}, {schema}")
    return map_batches(docs.filter(~is_giant), whole, f"doc_id {kind}, {schema}", rows=250).unionByName(giant)


def encode_giant(docs: DataFrame, model, kind: str, chunk: int) -> DataFrame:
    def cut_up(batches):
        c, base, n = codec(model.value), TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                parts = list(cut(marked(text), chunk, c.v.longest))
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + n] * len(parts), pa.int64()), pa.array([doc_id.as_py()] * len(parts), b.column("doc_id").type), pa.array(range(len(parts)), pa.int32()), *[pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)]],
                    ["row", "doc_id", "k", "core", "look", "rel"],
                )

    chunks = stored(map_batches(docs, cut_up, f"row bigint, doc_id {kind}, k int, core string, look string, rel bigint", rows=16).repartition("row", "k"))

    def matrices(batches):
        c = codec(model.value)
        for b in batches:
            chunks_ = list(zip(*[b.column(x).to_pylist() for x in ("core", "look", "rel")], strict=True))
            long = c.middles(chunks_)
            flat = [[w for line in c.transfer(*x) for w in line] for x in chunks_]
            c.forget(long)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), *[pa.array([[w[i] for w in m] for m in flat], pa.list_(pa.int64())) for i in (0, 1)]], ["row", "k", "scores", "ties"])

    measured = stored(map_batches(chunks.select("row", "k", "core", "look", "rel"), matrices, MATRIX, rows=64))
    settled = scanned(measured)

    def pieces(batches):
        c = codec(model.value)
        for b in batches:
            chunks_ = list(zip(*[b.column(x).to_pylist() for x in ("core", "look", "rel", "i", "j")], strict=True))
            long = c.middles(chunks_)
            ids = [c.chunk_ids(*x) for x in chunks_]
            c.forget(long)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("k"), int_lists(ids), b.column("score")], ["row", "doc_id", "k", "ids", "score"])

    found = map_batches(chunks.join(settled, ["row", "k"]).select("row", "doc_id", "k", "core", "look", "rel", "i", "j", "score"), pieces, f"row bigint, doc_id {kind}, k int, ids array<int>, score bigint", rows=64)
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.sum("score").alias("score"))
    return whole.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"), "score")


MATRIX = "row bigint, k int, scores array<bigint>, ties array<bigint>"


def combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Up to FAN neighbouring matrices of a document become one: their product."""
    pdf = pdf.sort_values("k")
    arrays = [square(s, t) for s, t in zip(pdf["scores"], pdf["ties"], strict=True)]
    score, mark = reduce(product, arrays)
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "k": [pdf["k"].iloc[0] // FAN], "scores": [score.ravel()], "ties": [mark.ravel()]})


def between(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at the cuts among up to FAN neighbours, given those before (i) and after (j) them all."""
    pdf = pdf.sort_values("k")
    ms = [unflat(s, t) for s, t in zip(pdf["scores"], pdf["ties"], strict=True)]
    states = settle(ms, int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]))
    weights = [m[i][j][0] for m, i, j in zip(ms, states, states[1:], strict=False)]
    return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "i": states[:-1], "j": states[1:], "score": weights})


def scanned(measured: DataFrame) -> DataFrame:
    """(row, k, i, j, score): the states at both ends of each chunk, from rows as MATRIX says.

    Matrices are multiplied in rounds of FAN neighbours until a document has one
    of at most FAN; from the outermost states back down, each round settles the
    cuts within.  No task has more than FAN matrices, however long a document.
    """
    rounds, last = [measured], measured.agg(F.max("k")).first()[0] or 0
    up = (F.col("k") / FAN).cast("int")
    while last >= FAN:
        rounds.append(stored(rounds[-1].groupBy("row", up.alias("up")).applyInPandas(combine, MATRIX)))
        last //= FAN
    states = None
    for level in reversed(rounds):
        if states is None:
            level = level.withColumns({"up": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
        else:
            level = level.withColumn("up", up).join(states.select("row", F.col("k").alias("up"), "i", "j"), ["row", "up"])
        states = level.groupBy("row", "up").applyInPandas(between, "row bigint, k int, i int, j int, score bigint")
    return states


def square(scores, ties) -> tuple[np.ndarray, np.ndarray]:
    size = round(len(scores) ** 0.5)
    return np.array(scores, np.int64).reshape(size, size), np.array(ties, np.int64).reshape(size, size)


def unflat(scores, ties) -> list[list[Weight]]:
    size = round(len(scores) ** 0.5)
    flat = [(int(s), int(t)) for s, t in zip(scores, ties, strict=True)]
    return [flat[i : i + size] for i in range(0, len(flat), size)]


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for each row of ``rows`` (doc_id, ids); null for null ids."""
    model = rows.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches):
        c = codec(model.value)
        for b in batches:
            given = b.column("ids")
            texts = decoded(c, given)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t if ok else None for t, ok in zip(texts, given.is_valid().to_pylist(), strict=True)], pa.string())], ["doc_id", "text"])

    return map_batches(rows.select("doc_id", "ids"), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string", rows=500)

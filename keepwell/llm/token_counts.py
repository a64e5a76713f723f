"""Operator 8: token counts with a whole-token shortcut.

A sentence-piece BPE merges inside a segment only: a run of space marks with
what follows them up to the next mark, or a line feed, which no piece holds.
That is so because no piece has a mark after another character; ``prove_whole``
checks it of the vocabulary that it gets.  Which pieces encode alone as one
token is proved once, on the driver, by encoding each; segments that are such
pieces count as one, and only the rest are merged, once for each worker and
segment.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from keepwell.llm.common import map_batches

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Merged segments that a worker remembers.
REMEMBERED = 400_000


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; ``path`` defaults to the public 32k BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def prove_whole(model: bytes) -> set[str]:
    """The pieces that encode alone as one token, by encoding every one of them.

    Raises if a piece could join two segments, for then segments aren't independent.
    """
    sp = processor(model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in ids]
    if joined := [p for p in pieces if "\n" in p or re.search(f"[^{MARK}]{MARK}", p)]:
        raise ValueError(f"pieces reach over segments: {joined[:3]}")
    return {p for p, n in zip(pieces, merge_counts(sp, pieces), strict=True) if n == 1}


def merge_counts(sp, segments: list[str]) -> list[int]:
    """Tokens of each segment as the library merges it.

    The library puts a mark before any text.  A segment that starts with one is
    given without it; before one that doesn't (after a line feed) go a line feed
    and the mark's own token, which are taken off again.
    """
    given = [s[1:] if s[0] == MARK else "\n" + s for s in segments]
    return [1 if s == MARK else len(x) - 2 * (s[0] != MARK) for s, x in zip(segments, sp.encode(given, num_threads=1), strict=True)]


class TokenCounter:
    """Counts tokens of texts; remembers merged segments up to a bound, then starts afresh."""

    def __init__(self, model: bytes, whole: set[str]):
        self.sp, self.whole = processor(model), dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def counts(self, texts: list[str | None]) -> list[int]:
        found, lines = [], []
        for t in texts:
            marked = MARK + t.replace(" ", MARK) if t else ""
            found.append(SEGMENT.findall(marked))
            lines.append(marked.count("\n"))
        known = self.known
        rest = list(set().union(*found).difference(known)) if found else []
        if len(known) + len(rest) > REMEMBERED + len(self.whole):
            known = self.known = dict(self.whole)
            rest = list(set().union(*found).difference(known))
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            known.update(zip(part, merge_counts(self.sp, part), strict=True))
        return [n + sum(map(known.__getitem__, s)) for s, n in zip(found, lines, strict=True)]


_counters: dict[int, TokenCounter] = {}


def counter(model: bytes, whole: set[str]) -> TokenCounter:
    """One for each worker process and model."""
    if (key := hash(model)) not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(model, whole)
    return _counters[key]


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of ``docs``, which has doc_id and text.

    Null and empty texts have 0 of either; equal texts have equal counts; other columns are ignored.
    """
    model = model_bytes(path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, prove_whole(model)))  # bounded by the vocabulary

    def run(batches):
        c = counter(*shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = c.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def vocabulary_share(texts: list[str], whole: set[str]) -> float:
    """The share of segments that the shortcut decides."""
    found = Counter(s for t in texts if t for s in SEGMENT.findall(MARK + t.replace(" ", MARK)))
    return sum(n for s, n in found.items() if s in whole) / max(1, sum(found.values()))

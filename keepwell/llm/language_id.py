"""Operator 10: language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier of hashed byte
n-grams (the log-odds of the languages with a one against those with a zero)
gives a margin per text.  Decoding is loss-weighted: the codeword with the least
sum of exponential losses of the margins, each weighted by how often that bit's
classifier is right about training texts of that language.

Training is two sums over all training texts: n-gram counts by language, and
the classifiers' hits by language.  The model is 2^16 weights for each bit.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import fold, map_batches, stored

ORDERS = (1, 2, 3)
BINS = 1 << 16
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
SMOOTHING = 0.5
#: The two nearest codewords' losses must differ by this share, else a text is flagged.
AMBIGUOUS = 0.1
#: Bytes whose n-grams a step holds.
PIECE = 1 << 19

ASCII_LETTER = re.compile("[A-Za-z]")
#: ASCII other than letters becomes a space; bytes of other characters stay.
FOLDED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


# --- codes ----------------------------------------------------------------------------------------


def codewords(n: int) -> np.ndarray:
    """+1/-1 rows for n languages: all splits in two for up to 5, else the best of random dense codes of 10 log2 n bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = range(1, 1 << (n - 1))  # the first language is always +1
        return np.array([[1] + [-1 if s >> i & 1 else 1 for i in range(n - 1)] for s in splits], float).T
    rng, best, least = np.random.default_rng(0), None, -1
    bits = math.ceil(10 * math.log2(n))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        d = np.min(((bits - m @ m.T) / 2) + bits * np.eye(n))
        if d > least and (np.abs(m.sum(axis=0)) < n).all():
            best, least = m, d
    return best


# --- n-grams --------------------------------------------------------------------------------------


def has_letter(text: str | None) -> bool:
    """Whether a character is of a Unicode category of letters (L); numerals, marks and symbols aren't."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def cleaned(text: str) -> bytes:
    return text.lower().encode().translate(FOLDED)


def bins(raw: np.ndarray) -> list[np.ndarray]:
    """Bins of the n-grams that begin at each byte, for each order; ``raw`` ends with as many bytes more as the highest order needs."""
    n = len(raw) - max(ORDERS) + 1
    wide, code, out = raw.astype(np.uint32), np.zeros(n, np.uint32), []
    for k in range(max(ORDERS)):
        code = code << np.uint32(8) | wide[k : k + n]
        if k + 1 in ORDERS:
            out.append((((code + np.uint32(k << 24)) * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int32))
    return out


def joined(texts: list[bytes]):
    """(raw, starts, numbers) pieces: texts framed by spaces, so that no n-gram has letters of two; longer ones are cut into overlapping pieces."""
    tail = max(ORDERS) - 1
    held, numbers, n = [], [], 0

    def piece():
        starts = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]]).astype(np.int64)
        return np.frombuffer(b"".join([*held, b" " * tail]), np.uint8), starts, numbers

    for i, t in enumerate(texts):
        t = b" " * tail + t
        for at in range(0, max(1, len(t)), PIECE):
            part = t[at : at + PIECE]
            if len(t) > PIECE:  # alone, with the first bytes of what follows
                if held:
                    yield piece()
                    held, numbers, n = [], [], 0
                yield np.frombuffer(part + (t[at + PIECE : at + PIECE + tail] + b" " * tail)[:tail], np.uint8), np.zeros(1, np.int64), [i]
            else:
                held.append(part)
                numbers.append(i)
                n += len(part)
                if n >= PIECE:
                    yield piece()
                    held, numbers, n = [], [], 0
    if held:
        yield piece()


def count_ngrams(batches):
    """Rows (lang, bin, n) of a partition's training texts."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(cleaned(t))
        for lang, own in texts.items():
            counts = total.setdefault(lang, np.zeros(BINS, np.int64))
            for raw, _, _ in joined(own):
                for g in bins(raw):
                    counts += np.bincount(g, minlength=BINS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bin", "n"])


def margins(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Mean log-odds per n-gram and bit."""
    out, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for raw, starts, numbers in joined(texts):
        for g in bins(raw):
            np.add.at(out, numbers, np.add.reduceat(weights[g], starts, axis=0))
        np.add.at(n, numbers, np.diff(np.append(starts, len(raw) - max(ORDERS) + 1)) * len(ORDERS))
    return out / np.maximum(n, 1)[:, None]


# --- training -------------------------------------------------------------------------------------


def classifiers(counts: np.ndarray, total: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds by bin and bit, from counts by language and bin; each language weighs the same on its side."""
    share = (counts + SMOOTHING) / (total[:, None] + SMOOTHING * BINS)
    one, zero = (code > 0).astype(float), (code < 0).astype(float)
    p1 = share.T @ (one / np.maximum(one.sum(axis=0), 1))
    p0 = share.T @ (zero / np.maximum(zero.sum(axis=0), 1))
    return np.where(zero.sum(axis=0) > 0, np.log(p1) - np.log(np.where(p0 > 0, p0, 1)), 1.0).astype(np.float32)


def learned(counts: DataFrame, langs: list[str], totals: dict[str, int], code: np.ndarray) -> np.ndarray:
    """The classifiers from rows (lang, bin, n).  Each bin's weights come from its own counts, so only the model itself, of BINS rows, reaches the driver."""
    number, total = {x: i for i, x in enumerate(langs)}, np.array([totals[x] for x in langs], float)

    def weigh(batches):
        for b in batches:
            table = np.zeros((len(langs), len(b)))
            for i, found in enumerate(b.column("found").to_pylist()):
                for f in found:
                    table[number[f["lang"]], i] = f["n"]
            yield pa.RecordBatch.from_arrays([b.column("bin"), pa.array([w.tobytes() for w in classifiers(table, total, code)], pa.binary())], ["bin", "weights"])

    by_bin = counts.groupBy("bin").agg(F.collect_list(F.struct("lang", "n")).alias("found"))  # a bin has at most a row for each language
    rows = map_batches(by_bin, weigh, "bin int, weights binary").toPandas()
    out = classifiers(np.zeros((len(langs), 1)), total, code).repeat(BINS, axis=0)
    out[rows["bin"].to_numpy(int)] = np.frombuffer(b"".join(rows["weights"]), np.float32).reshape(len(rows), -1)
    return out


def decode(f: np.ndarray, code: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of margins: the least weighted exponential loss, and how clearly it is the least."""
    z = np.clip(f / scale, -4, 4)
    loss = np.stack([np.exp(-z * code[r]) @ weight[r] for r in range(len(code))], axis=1)
    best = loss.argmin(axis=1)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    if len(code) < 2:
        return best, np.ones(len(f)), np.zeros(len(f), bool)
    two = np.sort(loss, axis=1)[:, :2]
    return best, 1 / share.sum(axis=1), two[:, 0] > (1 - AMBIGUOUS) * two[:, 1]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of ``docs``, which has doc_id, text and lang.

    Learned from the rows with a language whose crc32(doc_id as text) mod 4 is
    not 2; lang only labels those.  Null texts and texts without a letter are
    'und' with score 0, as is every text if there is nothing to learn from.  A
    null doc_id counts as the empty text in the fold.  Equal texts have equal
    results.  Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    learn = docs.select("text", "lang", held).filter("not held_out and lang is not null and text is not null").select("text", "lang")
    counts = stored(map_batches(learn, count_ngrams, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: x.encode())
    code = codewords(len(langs))
    shared = spark.sparkContext.broadcast(learned(counts, langs, totals, code) if langs else np.zeros((BINS, 1), np.float32))

    def measure(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            letter = list(map(has_letter, texts))
            f = margins(shared.value, [cleaned(t) if ok else b"" for t, ok in zip(texts, letter, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("lang"), pa.array(letter), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "held_out", "lang", "letter", "f"])

    names = ["doc_id", "text", "lang", held]
    found = stored(map_batches(docs.select(*names), measure, f"doc_id {kind}, held_out boolean, lang string, letter boolean, f array<double>", rows=500))
    bits = range(code.shape[1]) if langs else []
    stats = (
        found.filter("not held_out and letter and lang is not null")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("f")[i] > 0).cast("long")).alias(f"pos{i}") for i in bits], *[F.sum(F.abs(F.col("f")[i])).alias(f"abs{i}") for i in bits])
        .toPandas()
        .set_index("lang")
        .reindex(langs)
        .fillna(0)
    )
    n = stats["n"].to_numpy(float)
    weight, scale = np.zeros((0, 1)), np.ones(1)
    if langs:
        positive = np.stack([stats[f"pos{i}"].to_numpy(float) for i in bits], axis=1)
        right = np.where(code > 0, positive, n[:, None] - positive) / np.maximum(n, 1)[:, None] + 1e-3
        weight = right / right.sum(axis=1, keepdims=True)
        scale = np.array([stats[f"abs{i}"].sum() for i in bits]) / max(1.0, n.sum()) + 1e-9

    def choose(batches):
        for b in batches:
            letter = b.column("letter").to_numpy(zero_copy_only=False) & bool(langs)
            pred, score, unsure = np.full(len(letter), UNDETERMINED, object), np.zeros(len(letter)), np.ones(len(letter), bool)
            if letter.any():
                f = np.array(b.column("f").to_pylist(), float)[letter]
                best, score[letter], unsure[letter] = decode(f, code, scale, weight)
                pred[letter] = np.array(langs, object)[best]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return map_batches(found.select("doc_id", "held_out", "letter", "f"), choose, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean", rows=10_000)

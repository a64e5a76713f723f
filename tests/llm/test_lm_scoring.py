import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np

from keepwell.llm import lm_scoring as lm


def naive(train, texts, share):
    """Context-tree weighting node by node, as defined."""
    counts = [defaultdict(Counter) for _ in range(lm.DEPTH + 1)]
    total = 0
    for t in train:
        raw = lm.framed(t)
        for i in range(lm.DEPTH, len(raw)):
            total += 1
            for d in range(lm.DEPTH + 1):
                counts[d][raw[i - d : i]][raw[i]] += 1
    kept = [{c for c in counts[d] if d == 0 or sum(counts[d][c].values()) * share >= total} for d in range(lm.DEPTH + 1)]

    def bits(seen, node):
        depth, a, b = node.bit_length() - 1, 0, 0
        for s, n in seen.items():
            if (s | 256) >> (8 - depth) == node:
                a, b = (a, b + n) if s >> (7 - depth) & 1 else (a + n, b)
        return a, b

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @cache
    def kids(c):
        return [k for k in kept[len(c) + 1] if k[1:] == c] if len(c) < lm.DEPTH else []

    def other(c):
        rest = counts[len(c)][c].copy()
        for k in kids(c):
            rest.subtract(counts[len(k)][k])
        return rest

    @cache
    def weights(c, node):
        own = kt(*bits(counts[len(c)][c], node))
        if len(c) == lm.DEPTH:
            return own, None, own
        below = kt(*bits(other(c), node)) + sum(weights(k, node)[2] for k in kids(c))
        return own, below, np.logaddexp(own, below) - math.log(2)

    def one(context, node, c=b""):
        a, b = bits(counts[len(c)][c], node)
        p = (b + 0.5) / (a + b + 1)
        if len(c) == lm.DEPTH:
            return p
        own, below, _ = weights(c, node)
        share_ = 1 / (1 + math.exp(min(700, max(-700, below - own))))
        k = context[len(context) - len(c) - 1 :]
        if k in kept[len(k)]:
            return share_ * p + (1 - share_) * one(context, node, k)
        a, b = bits(other(c), node)
        return share_ * p + (1 - share_) * (b + 0.5) / (a + b + 1)

    out = []
    for t in texts:
        raw, total = lm.framed(t), 0.0
        for i in range(lm.DEPTH, len(raw)):
            node = 1
            for j in range(7, -1, -1):
                bit = raw[i] >> j & 1
                p = one(raw[i - lm.DEPTH : i], node)
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        out.append(total)
    return out


def test_scores_are_those_of_context_tree_weighting(spark):
    train = ["abab abba abracadabra été", "the cat sat on the mat", None, "", "aaaa"]
    texts = ["abra", "the cat é", "zz", None, "aaaa aaaa"]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"), contexts=30)
    assert np.allclose(lm.text_scores(model, texts), naive(train, texts, 30), rtol=1e-5)
    for row in model.scores:
        assert abs((10.0 ** row.astype(float)).sum() - 1) < 1e-4


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9 + 0.5])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_pieces_cut_nothing(monkeypatch):
    whole = np.concatenate(list(lm.pieces(["abc" * 50, None, "xyz"])))
    monkeypatch.setattr(lm, "PIECE", 7)
    assert (np.concatenate(list(lm.pieces(["abc" * 50, None, "xyz"]))) == whole).all()


def low(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def check(docs, rows):
    source = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    seen = Counter(w for i, t in source if fold(i) != 1 for w in low(t))
    n = sum(seen.values())
    want = sorted((str(i), fold(i) == 1, len(low(t)), sum(seen[w] > 0 for w in low(t)), n, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (len(seen) + 1))) for w in low(t)), 4)) for i, t in source)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want


def test_base_against_brute_force(spark, sf, odd, none, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lm.score(docs).collect()
    check(docs, rows)
    assert 1 < np.mean([r.bits_per_byte for r in rows if r.held_out]) < 3.5
    rows = lm.score(odd).collect()
    check(odd, rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and lm.score(none).count() == 0


def test_many_shares_and_blocks_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(lm, "SHARE_WORDS", 500)
    check(docs, lm.score(docs).collect())


def test_a_rare_context_stays_a_node_beside_much_other_text(spark, monkeypatch):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in range(200) if fold(i) != 1][:40]
    out = next(i for i in range(200) if fold(i) == 1)
    rows = [(i, "x" * 3_000) for i in ids] + [(1000 + i, t) for i, t in enumerate(["abab abba abracadabra été", "the cat sat", None, ""]) if fold(1000 + i) != 1] + [(out, "abracadabra the été zz")]
    train = [t for i, t in rows if i != out]
    want = naive(train, [t for _, t in rows], 10**18)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, rtol=1e-5)
    monkeypatch.setattr(lm, "SHARE_CODES", 20)
    again = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.allclose([again[i] for i, _ in rows], want, rtol=1e-5)


def test_chunks_cut_no_context_and_change_nothing(monkeypatch):
    code, n = lm.block_strings(["abab abba abracadabra été", "the cat sat on the mat", "aaaa"], [False, False, True])
    code, n = lm.merged([(code, n)])
    above = np.full((256, 256), 0.5), np.full((256, 256), 0.25)
    want = lm.string_scores(code, n, above)
    monkeypatch.setattr(lm, "CHUNK", 3)
    cut = list(lm.chunks(code))
    assert len(cut) > 5 and np.concatenate([code[c] for c in cut]).tolist() == code.tolist()
    assert all(code[a.stop - 1] >> 16 != code[b.start] >> 16 for a, b in zip(cut, cut[1:], strict=False))
    assert np.allclose(lm.string_scores(code, n, above), want)

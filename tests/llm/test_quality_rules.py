import re
from collections import Counter

import numpy as np
import pytest

from keepwell.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a b c a b c", "a a a a", "x\nx\ny\n\n \nx", "# $ é|< > a\x1cb", "a b c d a b c e a b", "one"])
def test_counts(text):
    assert qr.counts(text) == brute(text)
    assert qr.counts(None) == (0,) * 5


def test_query(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = qr.op3(docs).collect()
    wrong = 0
    for r in rows:
        n = brute(texts[r.doc_id])
        assert tuple(r[c] for c in qr.COUNTS) == n and r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)
        wrong += not r.base_failed and r.doc_id in quality and r.kept != bool(quality[r.doc_id])
    assert len(rows) == len(texts) and wrong <= 0.02 * len(quality)
    odd_rows = qr.op3(odd).collect()
    assert len(odd_rows) == odd.count() and all(r.base_failed for r in odd_rows if r.n_words < 50)
    assert qr.op3(none).count() == 0 and qr.clean(none).count() == 0


def test_clean_keeps_whole_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in qr.op3(docs).filter("kept").collect()}
    rows = qr.clean(docs).collect()
    assert {r.doc_id for r in rows} == kept and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_estimates_resist_a_quarter_of_outliers(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(0.5, 0.05, (900, qr.D))
    bad = rng.normal(3.0, 0.05, (200, qr.D))
    rows = [("en\x1fs", *map(float, v)) for v in np.concatenate([good, bad])]
    found, n = qr.estimates(spark.createDataFrame(rows, ["grp", *qr.VECTOR]))
    r = found.first()
    assert n == 1 and all(abs(r[f"c{i}"] - 0.5) < 0.02 for i in range(qr.D))


def test_small_groups_are_pooled(spark):
    rows = [(g, *[0.1] * qr.D) for g, n in (("en\x1fbig", 300), ("en\x1fa", 150), ("en\x1fb", 150), ("de\x1fc", 5)) for _ in range(n)]
    groups, _ = qr.pooled(spark.createDataFrame(rows, ["grp", *qr.VECTOR]))
    got = {r.raw: r.grp for r in groups.collect()}
    assert got == {"en\x1fbig": "en\x1fbig", "en\x1fa": "en\x1f\x01", "en\x1fb": "en\x1f\x01", "de\x1fc": "\x01"}


def test_either_kind_of_repetition_rejects_a_long_text(make):
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(2000)]
    text = lambda n, sep=" ", of=2000: sep.join(words[i] for i in rng.integers(0, of, n))
    rows = [(i, text(400 + i), "en", "s") for i in range(300)]
    passage = text(245)
    short = text(30)
    rows += [(1000, text(400, "\n", 40), "en", "s"), (1001, f"{passage} {text(510)} {passage}", "en", "s"), (1002, f"{short}\n{text(80)}\n{short}", "en", "s")]
    got = {r.doc_id: r for r in qr.op3(make(rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[1000].kept and not got[1001].kept and got[1002].kept and sum(got[i].kept for i in range(300)) >= 297


def least_determinant(x, rng, n_starts=60):
    """Fast MCD by the book: random subsets of D + 1, exact shares, steps until nothing changes, the least determinant."""
    h, floor, best = -(-len(x) * 3 // 4), np.diag(np.square(qr.FLOOR)), None
    for _ in range(n_starts):
        own = x[rng.choice(len(x), qr.D + 1, replace=False)]
        last = None
        for _ in range(100):
            centre, cov = own.mean(axis=0), np.cov(own.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = frozenset(np.argsort(d, kind="stable")[:h].tolist())
            if near == last:
                break
            last, own = near, x[sorted(near)]
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], d
    return best[0], best[1] / max(1.0, np.median(best[1]) / qr.MEDIAN)


def prose(rng, n, junk):
    """Texts of one source: prose of some length, and a clustered share of another kind."""
    out = []
    for i in range(n):
        words = ["".join(map(chr, rng.integers(97, 97 + 20, rng.integers(2, 9)))) for _ in range(rng.integers(60, 200))]
        if i < junk:
            words = [w + "#$!"[: rng.integers(1, 4)] for w in words]
        out.append(" ".join(words))
    return out


def test_verdicts_by_brute_force(make):
    rng = np.random.default_rng(11)
    texts = {("en", "a"): prose(rng, 120, 25), ("de", None): prose(rng, 60, 12)}
    rows = [(i, t, lang, source) for i, (lang, source, t) in enumerate((g[0], g[1], t) for g, ts in texts.items() for t in ts)]
    got = {r.doc_id: r for r in qr.op3(make(rows)).collect()}
    at = 0
    for ts in texts.values():
        x = np.array([qr.vector(t, qr.counts(t)) for t in ts])
        _, d = least_determinant(x, rng)
        for i, want in enumerate(d, at):
            assert abs(got[i].distance - want) < 0.1 * want + 0.5
            if abs(want - qr.CUTOFF) > 0.15 * qr.CUTOFF:
                assert got[i].kept == (want <= qr.CUTOFF and not got[i].base_failed)
        at += len(ts)
    assert sum(not r.kept for r in got.values()) >= 30


def test_other_groups_leave_a_group_alone(make):
    rng = np.random.default_rng(12)
    own = [(i, t, "en", "a") for i, t in enumerate(prose(rng, 40, 6))]
    others = [(1000 + i, t + " A B C D" * 30, "en", s) for i, t in enumerate(prose(rng, 90, 40)) for s in [("b", "c")[i % 2]]] + [(5000 + i, t, "fr", "a") for i, t in enumerate(prose(rng, 5, 1))]
    alone = {r.doc_id: (r.kept, round(r.distance, 6)) for r in qr.op3(make(own)).collect()}
    together = {r.doc_id: (r.kept, round(r.distance, 6)) for r in qr.op3(make(own + others)).collect()}
    assert {k: v for k, v in together.items() if k < 1000} == alone


def test_small_groups_are_judged_by_their_language(spark):
    rows = [(g, *[0.1 * k] * qr.D) for k, (g, n) in enumerate((("en\x1fbig", 31), ("en\x1fa", 30), ("de\x1fb", 20), ("de\x1fc", 11), ("fr\x1fd", 3))) for _ in range(n)]
    groups, parts, n = qr.judges(spark.createDataFrame(rows, ["grp", *qr.VECTOR]))
    assert n == 5 and {r.raw: r.grp for r in groups.collect()} == {"en\x1fbig": "en\x1fbig", "en\x1fa": "en\x1f\x01", "de\x1fb": "de\x1f\x01", "de\x1fc": "de\x1f\x01", "fr\x1fd": "\x01"}
    got = {}
    for r in parts.collect():
        got.setdefault(r.grp, set()).add(r.raw)
    assert got["en\x1f\x01"] == {"en\x1fbig", "en\x1fa"} and got["\x01"] == {r.raw for r in groups.collect()} and got["en\x1fbig"] == {"en\x1fbig"} and len(got) == 4

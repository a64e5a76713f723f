"""Quality classifier and language identification: held-out accuracy, brute force, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from keepwell.llm import common
from keepwell.llm import language_id as li
from keepwell.llm import quality_classifier as qc

LARGER = "/root/testdata/sf0.01"


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert all(r.f == common.fold_of(r.doc_id, 5) for r in df.select("doc_id", common.fold(F.col("doc_id"), 5).alias("f")).collect())
    assert common.fold_of(7, 5) == zlib.crc32(b"7") % 5


def test_moments_give_the_risk():
    rng = np.random.default_rng(0)
    p, u = rng.normal(size=(50, qc.D)), rng.normal(size=(80, qc.D))
    p1, p2, u1, u2 = p.mean(axis=0), p.T @ p / 50, u.mean(axis=0), u.T @ u / 80
    w = rng.normal(size=qc.D) / 10
    loss = lambda m: ((m - 1) ** 2 / 4).mean()
    want = loss(-(u @ w)) - 0.7 * loss(-(p @ w))
    got = (w @ u2 @ w + 2 * u1 @ w + 1 - 0.7 * (w @ p2 @ w + 2 * p1 @ w + 1)) / 4
    assert np.isclose(got, want)
    best = qc.minimise(u1, u2, p1, p2, 0.7)
    risk = lambda w: 0.7 * loss(p @ w) + max(0.0, loss(-(u @ w)) - 0.7 * loss(-(p @ w))) + qc.RIDGE / 2 * w @ w
    assert risk(best) < min(risk(np.zeros(qc.D)), risk(w))


def test_prior_of_separable_classes():
    rng = np.random.default_rng(1)
    texts = ["the quiet house on the hill was old and warm. " * 8] * 70 + ["BUY!! NOW!! " * 40] * 30
    x = np.array([qc.raw_features(t) for t in texts]) + rng.normal(0, 0.01, (100, len(qc.RAW)))
    phi = qc.expanded(x)
    assert abs(qc.class_prior(phi.T @ phi / 100, phi[:70].mean(axis=0)) - 0.7) < 0.05


def test_quality_on_the_held_out_fold(spark):
    docs, labels = common.documents(spark, LARGER), common.labels(spark, LARGER)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = qc.classify(docs, labels).collect()
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_used(spark, sf):
    docs, labels = common.documents(spark, sf), common.labels(spark, sf)
    held = common.fold(F.col("doc_id"), 5) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 6) for r in qc.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = qc.classify(odd, labels).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert qc.classify(none, labels).count() == 0 and qc.classify(odd, labels.limit(0)).count() == odd.count()


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = li.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(n)
        assert apart.min() >= (1 if n == 2 else 2 if n < 4 else 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_margins_do_not_depend_on_company(monkeypatch):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(li.BINS, 3)).astype(np.float32)
    texts = [li.cleaned(t) for t in ["Hello there", "", "été à Noël", "abc" * 100]]
    alone = np.concatenate([li.margins(w, [t]) for t in texts])
    assert np.allclose(li.margins(w, texts), alone, atol=1e-6)
    monkeypatch.setattr(li, "PIECE", 64)
    assert np.allclose(li.margins(w, texts), alone, atol=1e-5)


def test_language_on_the_held_out_fold(spark):
    docs = common.documents(spark, LARGER)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = li.identify(docs).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_labels_are_no_input(spark, sf):
    docs = common.documents(spark, sf)
    held = common.fold(F.col("doc_id"), 4) == 2
    hidden = docs.withColumn("lang", F.when(~held, F.col("lang")))
    a, b = ({r.doc_id: r.lang_pred for r in li.identify(x).collect()} for x in (docs, hidden))
    assert a == b


def test_language_of_odd_rows(odd, none, make):
    rows = li.identify(odd).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert li.identify(none).count() == 0
    assert {r.lang_pred for r in li.identify(make([(2, "hello", None, "a", 5)])).collect()} == {"und"}
    one = li.identify(make([(i, "hello there", "en", "a", 5) for i in range(8)])).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_texts_without_letters_are_undetermined(make):
    rows = [(i, "hello there you all", "en", "a", 5) for i in range(8)] + [(i, "hola que tal amigos", "es", "a", 5) for i in range(20, 28)]
    odd = ["½ ²", "①②③ 12", "ⅷ", "́̂", "123 _ #", "\u20dd\u0903"]
    got = {r.doc_id: r for r in li.identify(make(rows + [(100 + i, t, "en", "a", 5) for i, t in enumerate(odd)] + [(200, "½ é", "es", "a", 3), (201, "一", "es", "a", 1)])).collect()}
    assert all(got[100 + i].lang_pred == "und" and got[100 + i].score == 0 for i in range(len(odd)))
    assert got[200].lang_pred in ("en", "es") and got[201].lang_pred in ("en", "es")


def test_identification_by_brute_force(make):
    """Dictionaries and loops instead of arrays and sums: every prediction and score."""
    import math
    import random

    rng = random.Random(7)
    words = {"en": "the of and with you river house".split(), "de": "der und mit haus fluß über".split(), "es": "el que con río casa año".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 12))) + rng.choice(["", "!", " 42"]), x, "a") for i in range(90) for x in [rng.choice(list(words))]]

    def grams(t):
        raw = b"  " + t.lower().encode().translate(li.FOLDED) + b"  "
        for at in range(len(raw) - 2):
            for k in (1, 2, 3):
                code = int.from_bytes(raw[at : at + k], "big") + ((k - 1) << 24)
                yield (code * 2654435769 % (1 << 32)) >> 16

    langs = sorted(words)
    code = [[1, 1, 1], [-1, 1, -1], [1, -1, -1]]  # all splits of three
    assert (li.codewords(3) == np.array(code)).all()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    n = {x: {} for x in langs}
    for _, t, x, _ in train:
        for g in grams(t):
            n[x][g] = n[x].get(g, 0) + 1
    share = lambda x, g: (n[x].get(g, 0) + li.SMOOTHING) / (sum(n[x].values()) + li.SMOOTHING * li.BINS)

    def margin(t, bit):
        out = []
        for g in grams(t):
            one, zero = ([share(x, g) for i, x in enumerate(langs) if code[i][bit] == s] for s in (1, -1))
            out.append(math.log(sum(one) / len(one)) - math.log(sum(zero) / len(zero)))
        return sum(out) / len(out)

    f = {r[0]: [margin(r[1], b) for b in range(3)] for r in rows}
    scale = [sum(abs(f[r[0]][b]) for r in train) / len(train) + 1e-9 for b in range(3)]
    weight = []
    for i, x in enumerate(langs):
        own = [f[r[0]] for r in train if r[2] == x]
        right = [sum((m[b] > 0) == (code[i][b] > 0) for m in own) / len(own) + 1e-3 for b in range(3)]
        weight.append([r / sum(right) for r in right])
    got = {r.doc_id: r for r in li.identify(make(rows)).collect()}
    for i, m in f.items():
        loss = [sum(weight[x][b] * math.exp(-max(-4, min(4, m[b] / scale[b])) * code[x][b]) for b in range(3)) for x in range(3)]
        score = 1 / sum(math.exp(min(loss) - v) for v in loss)
        assert got[i].lang_pred == langs[loss.index(min(loss))] and abs(got[i].score - score) < 1e-4 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_by_brute_force(make, spark):
    """The risk over the rows themselves, minimised by steps instead of from moments: every score."""
    import random

    rng = random.Random(9)
    good = lambda: " ".join(rng.choice("the old house stood by a quiet river and nobody came".split()) for _ in range(rng.randint(20, 60))) + ".\n"
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "NOW", "CLICK", "|", "#1"]) for _ in range(rng.randint(20, 60)))
    rows = [(i, bad() if i % 3 == 0 else good(), "en", "a") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    phi = lambda some: qc.expanded(np.array([qc.raw_features(r[1]) for r in some], np.float32).astype(float))
    u, p = phi(learn), phi([r for r in learn if r[0] % 2 == 0 and r[0] % 3 != 0])
    h = p.mean(axis=0)
    prior = min(0.99, max(0.01, 1 / (h @ np.linalg.inv(u.T @ u / len(u) + qc.RIDGE * np.eye(qc.D)) @ h)))
    loss = lambda m: np.mean((m - 1) ** 2) / 4

    def risk(w):
        return prior * loss(p @ w) + max(0.0, loss(-(u @ w)) - prior * loss(-(p @ w))) + qc.RIDGE / 2 * w @ w

    got = {r.doc_id: r for r in qc.classify(make(rows), labels).collect()}
    assert len(got) == 120 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    # The scores determine the weights on the texts' span; no step from them lessens the risk by more than rounding.
    w, prior_found = qc.minimise(u.mean(axis=0), u.T @ u / len(u), h, p.T @ p / len(p), prior), prior
    want = np.clip((phi(rows) @ w + 1) / 2, 0, 1)
    assert abs(prior_found - prior) < 1e-9 and np.allclose([got[r[0]].score for r in rows], want, atol=1e-3)
    steps = np.random.default_rng(0).normal(size=(200, qc.D))
    assert all(risk(w) <= risk(w + s * e) + 1e-6 for s in steps for e in (1e-1, 1e-2, 1e-3))
    assert np.mean([got[i].score > got[j].score for i in got for j in got if i % 3 and not j % 3]) > 0.99

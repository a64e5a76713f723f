import hashlib
import re

from keepwell.llm import mixing
from tests.oracle import connect, same


def brute(rows, weights=(5, 2, 1), cap=3):
    """rows of (doc_id, text, source): copies by row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    entries = []
    for s in names:
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (hashlib.md5(("null" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest(), rows[i][0] or -1, size[i]))
        total = sum(size[i] for i in own)
        for p in range(cap):
            cum = 0
            for i in own:
                cum += size[i]
                if size[i]:
                    entries.append(((p * total + cum) / weight[s], s is None, s or "", p * total + cum, i))
    left, copies = sum(size), [0] * len(rows)
    for *_, i in sorted(entries):
        if size[i] > left:
            break
        left -= size[i]
        copies[i] += 1
    return [(rows[i][0], size[i], copies[i] * size[i]) for i in range(len(rows))], names, weight, size


def test_against_brute_force(make, spark, sf):
    few = [(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 4}") for i in range(60)] + [(99, "a b c", "s1")] * 3
    for rows in (few, few[:1], few[1:3], [(None, "x y", None), (1, "", "a")]):
        docs = make([(i, t, "en", s) for i, t, s in rows])
        got = mixing.op9(docs).collect()
        assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(i), z, t) for i, z, t in brute(rows)[0])


def test_against_sql(spark, sf):
    same(mixing.op9(spark.read.parquet(f"{sf}/documents.parquet")), connect(sf), mixing.ORACLE)


def test_targets_are_met_and_capped(make):
    rows = [(i, "w " * 10, "big" if i % 10 else "aaa") for i in range(400)]
    got = mixing.mix(make([(i, t, "en", s) for i, t, s in rows])).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
        assert r.taken <= 3 * r["size"]
    assert by["aaa"][1] == 3 * by["aaa"][0] and sum(x[1] for x in by.values()) == 4000.0
    assert all(abs(x[2] - x[1]) <= 10 for x in by.values())


def test_mixed_rows_are_those_taken(odd, none, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, odd):
        want = {}
        for r in mixing.mix(d).collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
        got = {}
        for r in mixing.mixed(d).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert got == {k: v for k, v in want.items() if v} or d is odd
    assert mixing.mixed(none).count() == 0 and mixing.op9(none).count() == 0


def test_odd_rows(odd):
    rows = mixing.op9(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if not r["size"]) and sum(r.taken for r in rows) <= sum(r["size"] for r in rows)


def test_plans_have_no_python(odd):
    assert "Python" not in mixing.op9(odd)._jdf.queryExecution().toString() and "Arrow" not in mixing.mixed(odd)._jdf.queryExecution().toString()


def test_repeats_at_a_cutoff_are_counted(make):
    """Rows of one id: repeats, variants and other texts, as many of each as the operator takes."""
    rows = [(5, "a b c", "en", "s", 1)] * 7 + [(5, "a b c", "de", "s", 1)] * 4 + [(5, "x y z", "en", "s", 1)] * 3 + [(None, "p q", "en", "t", i % 2) for i in range(9)] + [(i, "w " * 5, "en", "u", 1) for i in range(20, 26)]
    for some in (rows, rows[:14], rows[14:23], rows[7:25]):
        docs = make(some)
        want = {}
        for r in mixing.mix(docs).collect():
            want[(r.doc_id, r.source)] = want.get((r.doc_id, r.source), 0) + r.copies
        got = {}
        for r in mixing.mixed(docs).collect():
            got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + 1
        assert got == {k: v for k, v in want.items() if v}


def test_many_sources_share_the_margin(make):
    rows = [(i, "w " * (1 + i * 7 % 11), f"host-{i % 150}") for i in range(600)]
    got = mixing.op9(make([(i, t, "en", s) for i, t, s in rows])).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(i), z, t) for i, z, t in brute(rows)[0])

import numpy as np
import xxhash

from keepwell.llm import neardup as nd


def brute(fps):
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_the_code_is_perfect():
    checks, error, change = nd.golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    index, _ = nd.decode(words)
    codewords = index << 11 | checks[index]
    assert (np.bitwise_count((words ^ codewords).astype(np.uint32)) <= 3).all() and sorted(np.bitwise_count(error.astype(np.uint32)).tolist()).count(3) == 1771
    rows, found = nd.around(words)
    assert (np.bitwise_count((words[rows] ^ (found << 11 | checks[found])).astype(np.uint32)) <= 4).all()
    flipped = words ^ (1 << np.random.default_rng(1).integers(0, 23, 3000))
    sets = {}
    for r, f in zip(rows.tolist(), found.tolist(), strict=True):
        sets.setdefault(r, set()).add(f)
    assert all(i in sets[r] for r, i in enumerate(nd.decode(flipped)[0].tolist()))


def test_every_pair_within_three_bits_meets():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    have = {(r, s, k) for r, s, k in zip(*(a.tolist() for a in nd.keys(x)), strict=True)}
    met = {r for r, s, k in zip(*(a.tolist() for a in nd.keys(y)), strict=True) if s == 1 and (r, 0, k) in have}
    assert len(met) == len(x)


def batches(fps, size):
    import pyarrow as pa

    row, side, key = nd.keys(fps)
    o = np.argsort(key, kind="stable")
    row, side, key = row[o], side[o], key[o]
    return [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(side[i : i + size]), pa.array(fps[row[i : i + size]].view(np.int64))], ["key", "side", "fp"]) for i in range(0, len(key), size)]


def linked(found):
    out = []
    for b in found:
        out += [(a, c) for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True) if a is not None]
    return out


def test_blocks_of_a_hot_key_lose_no_link(monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([[c ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(0, 64, 7)] for c in centre]).astype(np.uint64))
    want = len(set(brute(fps)))
    for block in (8192, 16, 5):
        monkeypatch.setattr(nd, "BLOCK", block)
        for size in (50_000, 37):
            found = list(nd.meet(iter(batches(fps, size))))
            pairs = linked(found)
            cut = [(k, p, m) for b in found for k, p, m in zip(b.column("key").to_pylist(), b.column("part").to_pylist(), b.column("members").to_pylist(), strict=True) if m]
            assert bool(cut) == (block < 100)
            for k, p, m in cut:
                for k2, q, m2 in cut:
                    if k == k2 and p < q:
                        pairs += [(a - 2**64 if a >= 2**63 else a, c - 2**64 if c >= 2**63 else c) for a, c in nd.forest(np.concatenate([np.frombuffer(m, np.uint64), np.frombuffer(m2, np.uint64)]))]
            at = {int(v): i for i, v in enumerate(fps.view(np.int64))}
            parent = list(range(len(fps)))

            def root(a, parent=parent):
                while parent[a] != a:
                    a = parent[a]
                return a

            for a, c in pairs:
                a, c = root(at[a]), root(at[c])
                parent[max(a, c)] = min(a, c)
            assert len({root(i) for i in range(len(fps))}) == want


def test_fingerprint():
    assert nd.fingerprint(None) == nd.fingerprint(" \n") == 0
    one = nd.fingerprint("Two Words")
    assert one == xxhash.xxh64_intdigest(b"two words", 42)
    words = [b"a", b"b", b"c", b"d"]
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert nd.fingerprint("A b\tc\nd") == h[0] & h[1]


def test_components_of_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.v: r.root for r in nd.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}
    assert nd.components(chain.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.limit(30).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' again') as text")
    both = docs.select("doc_id", "text").union(copies)
    rows = sorted(nd.op5(both).collect())
    texts = dict(both.collect())
    fps = np.array([nd.fingerprint(texts[r.doc_id]) for r in rows], np.uint64)
    ids = [r.doc_id for r in rows]
    assert [int(r.fingerprint, 16) for r in rows] == fps.tolist() and [r.component_id for r in rows] == [ids[i] for i in brute(fps)]
    odd_rows = nd.op5(odd).collect()
    empty = [r for r in odd_rows if r.fingerprint == "0" * 16]
    assert len(odd_rows) == odd.count() and len(empty) == 4 and {r.component_id for r in empty} == {2}
    assert {r.component_id for r in odd_rows if r.doc_id in (6, 7)} == {6} and nd.op5(none).count() == 0


def test_one_of_each_component_stays(odd, none):
    kept = nd.deduplicated(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 8, 9] and sum(r.doc_id is None for r in kept) == 2
    assert nd.deduplicated(none).count() == 0


def test_hot_buckets_are_dealt_and_lose_no_link(spark, monkeypatch):
    """Near copies by the hundred under a few keys, dealt to many tasks in small blocks."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**64, 2, dtype=np.uint64)
    fps = np.unique(np.concatenate([*[[c ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(0, 64, 5)] for c in centre], rng.integers(0, 2**64, 300, dtype=np.uint64)]).astype(np.uint64))
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    monkeypatch.setattr(nd, "BLOCK", 16)
    n = nd.deals(distinct)
    assert n.max() > 1 and (n == 1).sum() > nd.BUCKETS // 2
    found = [(r.a, r.b) for r in nd.links(distinct).collect()]
    at = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, c in found:
        a, c = root(at[a]), root(at[c])
        parent[max(a, c)] = min(a, c)
    assert [root(i) for i in range(len(fps))] == brute(fps)


def test_documents_that_stay_are_not_shuffled(make, spark, monkeypatch):
    rows = [(i, f"text number {i // 2} of many that differ " * 3, "en", "a", 5) for i in range(40)] + [(7, "zz another row of seven", "en", "a", 1), (None, "no id", "en", "a", 1)]
    for limit in (1_000_000, 0):
        monkeypatch.setattr(nd, "BROADCAST_IDS", limit)
        kept = nd.deduplicated(make(rows))
        ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
        assert set(range(0, 40, 2)) <= set(ids) and len(ids) == len(set(ids)) and any(r.doc_id is None for r in kept.collect())

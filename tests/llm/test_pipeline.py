"""Every stage of the pipeline against a brute-force version of its own."""

import zlib

import numpy as np

import corpus_pipeline as cp
from keepwell.llm import common, neardup, pii, quality_rules
from keepwell.llm import piece_codec as pc
from tests.llm.test_mixing import brute as mix
from tests.llm.test_neardup import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)


def test_stages(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "encoding"] and cp.ORACLE_SQL is None
    docs = common.documents(spark, sf)
    out = {}
    for name, stage in cp.STAGES:
        done = common.stored(stage(spark, docs, sf))
        out[name] = docs, done
        if name != "encoding":
            assert done.columns == COLUMNS
        docs = done

    before, after = out["quality_rules"]
    kept = {r.doc_id for r in quality_rules.op3(before).filter("kept").collect()}
    assert rows(after) == [r for r in rows(before) if r[0] in kept] and 0 < after.count() < before.count()

    before, after = out["near_duplicates"]
    all_rows = sorted(rows(before), key=lambda r: r[0])
    first = set(components(np.array([neardup.fingerprint(r[1]) for r in all_rows], np.uint64)))
    assert rows(after) == sorted((r for i, r in enumerate(all_rows) if i in first), key=str)

    before, after = out["personal_data"]
    assert rows(after) == sorted(((i, pii.masked(t, pii.find(t)), lang, s) for i, t, lang, s in rows(before)), key=str)
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = out["mixing"]
    want = [r for r, (_, size, taken) in zip(rows(before), mix([(i, t, s) for i, t, _, s in rows(before)])[0], strict=True) for _ in range(taken // size if size else 0)]
    assert rows(after) == sorted(want, key=str)

    before, after = out["encoding"]
    codec = pc.Codec(pc.model_bytes())
    want = sorted((i, codec.encode([t])[0][0], len(t), zlib.crc32(t.encode())) for i, t, *_ in rows(before))
    assert sorted((r.doc_id, np.array(r.ids, np.int32).tobytes(), r.n_chars, r.text_crc32) for r in after.collect()) == want


def test_run_is_its_stages(spark, sf):
    assert cp.run(spark, sf).count() > 0


def test_odd_rows_pass_through(spark, odd, none):
    for docs in (odd, none):
        for _, stage in cp.STAGES:
            docs = common.stored(stage(spark, docs, ""))
        assert docs.count() == 0 or docs.count() <= 3 * odd.count()

from hypothesis import given, settings
from hypothesis import strategies as st

from keepwell.llm import token_counts as tc

MODEL = tc.model_bytes()
COUNTER = tc.TokenCounter(MODEL, tc.prove_whole(MODEL))


def library(texts):
    return [len(x) for x in COUNTER.sp.encode(texts, num_threads=1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)) | st.sampled_from(" \n▁aet"), max_size=60), max_size=5))
def test_counts_are_the_librarys(texts):
    assert COUNTER.counts(texts) == library(texts)


def test_special_strings_and_runs():
    texts = ["", "<s>", "</s> <unk>", "  x ", " " * 70, "\n\n a\n b", "▁x", "a\x00b", "é", "a" * 5000, " \n \n ", "\U0001f642"]
    assert COUNTER.counts(texts) == library(texts) and COUNTER.counts([None]) == [0]


def test_proof_is_of_single_tokens():
    some = sorted(COUNTER.whole)[::500]
    assert all(tc.merge_counts(COUNTER.sp, [s]) == [1] for s in some) and len(COUNTER.whole) > 30_000


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 10)
    c = tc.TokenCounter(MODEL, COUNTER.whole)
    texts = [f"qzx{i}qq" for i in range(50)]
    assert c.counts(texts[:25]) + c.counts(texts[25:]) == library(texts) and len(c.known) <= len(c.whole) + 30


def test_query(spark, sf, odd, none):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), library([r.text or ""])[0]) for r in docs.select("doc_id", "text").collect())
        got = tc.count_tokens(docs).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert tc.count_tokens(none).count() == 0

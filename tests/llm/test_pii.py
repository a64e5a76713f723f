import hashlib
import random
import re

from keepwell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(s)))) % 10 == 0,
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep[k](m[0])]


def base(text):
    return [tuple(s[:3]) for s in pii.find(text) if s.kind in pii.BASE]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1 +-(9_%2\né") for _ in range(rng.randint(0, 40)))
        assert base(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1.1." * 50_000, "+1" + "(" * 100_000, "@" * 100_000):
        pii.find(text)


def test_validators_and_context():
    iban = "DE89 3704 0044 0532 0130 00"
    assert [tuple(s[:3]) for s in pii.find(f"IBAN {iban}, thanks")] == [("iban", 5, 5 + len(iban))]
    assert not pii.find(iban[:-1] + "1") and not pii.find("XX89 3704 0044 0532 0130 00")
    assert [s.kind for s in pii.find("my social security number is 123-45-6789")] == ["ssn"] and not pii.find("part 123-45-6789")
    assert [s.kind for s in pii.find("amex card 378282246310005")] == ["card_short"] and not pii.find("lot 378282246310005") and not pii.find("card 378282246310006")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")


def test_masking():
    text = "write a@b.co or call +1 555 010 9999 now"
    assert pii.masked(text, pii.find(text)) == "write [EMAIL] or call [PHONE] now"
    assert not pii.find(pii.masked(text, pii.find(text)))


def test_odd_rows(odd, none, sf, spark):
    rows = pii.op2(odd).collect()
    assert len(rows) == odd.count()
    for r, t in zip(sorted(rows, key=str), sorted(rows, key=str), strict=True):
        assert r == t
    by = {r.doc_id: r for r in rows}
    assert (by[8].n_email, by[8].n_phone) == (1, 1) and by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.op2(none).count() == 0 and pii.redact(none).count() == 0 and pii.detect(none).count() == 0
    masked = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert masked[2].text is None and "[EMAIL]" in masked[8].text and masked[8].n_chars == len(masked[8].text)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in pii.op2(docs).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


def test_ibans_of_the_whole_registry():
    for x in ("SA0380000000608010167519", "AE070331234567890123456", "TR330006100519786457841326", "IL620108000000099999999", "BR1800360305000010009795493C1", "SC18SSCB11010000000000001497USD"):
        grouped = " ".join(x[i : i + 4] for i in range(0, len(x), 4))
        for text in (f"pay {x}.", f"pay {grouped}, then"):
            assert [(s.kind, text[s.start : s.end]) for s in pii.find(text) if s.kind == "iban"] == [("iban", text[4 : text.index(".") if "." in text else text.index(",")])]
        wrong = x[:3] + str((int(x[3]) + 1) % 10) + x[4:]
        assert not any(s.kind == "iban" for s in pii.find(wrong))


def test_spans_that_overlap_taken_ones():
    rng = random.Random(5)
    for _ in range(300):
        taken = [(s, s + rng.randint(1, 6)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        free = pii.free_of(taken)
        for s in range(62):
            for e in (s + 1, s + 4):
                assert free((s, e)) == (not any(s < b and a < e for a, b in taken))
    pii.find("4111111111111111 378282246310005 " * 20_000)


def test_scores_follow_the_spans(make):
    near, far = pii.op2(make([(1, "my card 4111111111111111", "en", "a"), (2, "zz 4111111111111111", "en", "a")])).orderBy("doc_id").collect()
    assert (near.spans, near.scores, far.scores) == ("card:8:24", "1.00", "0.80")

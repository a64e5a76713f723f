import random

import numpy as np
import sentencepiece

from keepwell.llm import piece_codec as pc

MODEL = pc.model_bytes()
CODEC = pc.Codec(MODEL)


def read(b, i):
    value = shift = 0
    while True:
        byte, i = b[i], i + 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def written(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def fields(b):
    """(key, value bytes as written) of a message."""
    i = 0
    while i < len(b):
        start = i
        key, i = read(b, i)
        if key & 7 == 0:
            _, i = read(b, i)
        elif key & 7 == 2:
            n, i = read(b, i)
            i += n
        else:
            i += 4 if key & 7 == 5 else 8
        yield key, b[start:i]


def as_unigram(model):
    """The same pieces and scores, with the trainer's model type (field 2.3) set to unigram: the library then searches the best segmentation."""
    out = b""
    for key, raw in fields(model):
        if key >> 3 == 2:
            n, at = read(raw, 1)
            spec = b"".join(b"\x18\x01" if k >> 3 == 3 else v for k, v in fields(raw[at : at + n]))
            raw = written(key) + written(len(spec)) + spec
        out += raw
    return out


def ids_of(text):
    return np.frombuffer(CODEC.encode([text])[0][0], np.int32).tolist()


def chunked(text, size):
    parts = list(pc.cut(pc.marked(text), size, CODEC.v.longest))
    assert "".join(p[0] for p in parts) == pc.marked(text)
    long = CODEC.middles(parts)
    ms = [CODEC.transfer(*p) for p in parts]
    states = pc.settle(ms)
    out = b"".join(CODEC.chunk_ids(*p, i, j) for p, i, j in zip(parts, states, states[1:], strict=False))
    CODEC.forget(long)
    return out, sum(m[i][j][0] for m, i, j in zip(ms, states, states[1:], strict=False))


def random_text(rng, kind):
    some = [list("ab the"), ["a", "\n", " ", "  ", "é", "丝", "🙂", "ing", "tion", "\x00", "▁"], list("theinasr")][kind]
    return "".join(rng.choice(some) for _ in range(rng.randint(1, 250)))


def test_best_segmentation_is_the_librarys():
    """Its exact lattice search (the first of two best), on words of known characters, where 32-bit sums are exact."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(MODEL))
    rng = random.Random(1)
    weight = lambda ids: sum(CODEC.v.scores[i] for i in ids)
    same = 0
    for _ in range(1500):
        word = "".join(rng.choice(["th", "in", "er", "a", "ou", "re", "str", "ion", "é", "x"]) for _ in range(rng.randint(1, 9)))
        mine, theirs = ids_of(word), sp.nbest_encode_as_ids(word, 2)[0]
        same += mine == theirs
        assert mine == theirs or weight(mine) == weight(theirs), word
    assert same > 1400


def test_vectors_solve_what_the_scalar_search_solves():
    rng = random.Random(2)
    segments = {s for kind in range(3) for _ in range(150) for s in pc.SEGMENT.findall(pc.marked(random_text(rng, kind)))}
    long = CODEC.learn(segments)
    for s in segments:
        weight, edge = pc.best_paths(CODEC.v, s, len(s), 0, 0)
        assert CODEC.ids[s] == np.array(pc.path_ids(CODEC.v, s, edge, 0, len(s)), np.int32).tobytes() and CODEC.scores[np.frombuffer(CODEC.ids[s], np.int32)].sum() == weight[-1][0]
    CODEC.forget(long)


def test_brute_force_over_all_segmentations():
    rng = random.Random(4)

    def best(text):
        if not text:
            return (0, ())
        out = []
        for n in range(1, len(text) + 1):
            piece = CODEC.v.ids.get(text[:n], -1)
            if piece >= 0:
                s, rest = best(text[n:])
                out.append((s + CODEC.v.scores[piece], (piece, *rest)))
        return max(out)

    for _ in range(150):
        word = "".join(rng.choice("theinars") for _ in range(rng.randint(1, 9)))
        score, _ = best(pc.marked(word))
        assert CODEC.encode([word])[1][0] == score


def test_chunks_give_what_the_whole_gives():
    rng = random.Random(0)
    for trial in range(900):
        text = random_text(rng, trial % 3)
        ids, scores = CODEC.encode([text])
        assert chunked(text, rng.choice([16, 17, 20, 33, 64])) == (ids[0], scores[0]), text


def test_products_are_associative():
    rng = random.Random(3)
    for _ in range(50):
        a, b, c = ([[rng.choice([pc.NONE, (rng.randint(-9, 0), rng.randint(0, 5))]) for _ in range(4)] for _ in range(4)] for _ in range(3))
        assert pc.times(pc.times(a, b), c) == pc.times(a, pc.times(b, c))


def test_round_trip(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for d in (docs, odd):
        for chunk in (pc.CHUNK, 300):
            encoded = pc.encode(d, chunk=chunk)
            back = sorted((r.doc_id or -1, r.text) for r in pc.decode(encoded).collect())
            assert back == sorted((r.doc_id or -1, r.text or "") for r in d.select("doc_id", "text").collect())
    whole = sorted((r.doc_id or -1, r.ids, r.score) for r in pc.encode(odd).collect())
    assert whole == sorted((r.doc_id or -1, r.ids, r.score) for r in pc.encode(odd, chunk=100).collect())
    assert pc.op7(none).count() == 0 and pc.decode(pc.encode(none)).count() == 0
    assert all(r.n_tokens == len(r.ids) for r in pc.op7(odd).collect())


def test_the_written_model_is_the_librarys():
    """It loads the unigram model, whose best segmentations and total of tokens are ours; scores are whole numbers of the ranks alone."""
    from keepwell.llm import token_counts

    bpe, sp = token_counts.processor(token_counts.model_bytes()), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert pc.model_bytes() == pc.unigram(token_counts.model_bytes()) and sp.get_piece_size() == bpe.get_piece_size()
    for i in range(0, sp.get_piece_size(), 37):
        assert sp.id_to_piece(i) == bpe.id_to_piece(i) and sp.get_score(i) == CODEC.v.scores[i] and (not bpe.is_byte(i) or CODEC.v.scores[i] == 0)


def test_token_totals_are_near_those_of_the_merges(spark, sf):
    from keepwell.llm import token_counts

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mine = pc.op7(docs).groupBy().sum("n_tokens").first()[0]
    merges = token_counts.count_tokens(docs).groupBy().sum("n_tokens").first()[0]
    assert abs(mine / merges - 1) < 0.03


def test_the_quick_search_is_the_scalar_one():
    rng = random.Random(6)
    for trial in range(400):
        text = pc.marked(random_text(rng, trial % 3))
        core, begin, rel = rng.randint(1, len(text)), 0, rng.randint(0, 9)
        begin = rng.randint(0, core - 1)
        weights, edges = pc.best_paths(CODEC.v, text, core, begin, rel)
        w, e = CODEC.trie.search(text, core, {begin: 0}, rel, CODEC.v.longest)
        assert e == edges and [None if x is None else (x >> pc.HIGH, x & ((1 << pc.HIGH) - 1)) for x in w] == [None if x == pc.NONE or x[0] <= pc.NONE[0] else x for x in weights]


def test_one_unbroken_text_in_many_chunks(spark, make):
    rng = random.Random(8)
    text = "".join(rng.choice("theinasrou") for _ in range(20 * 700 + 5))
    ids, scores = CODEC.encode([text])
    assert chunked(text, 700) == (ids[0], scores[0])
    spread = "".join(rng.choice(["the ", "in", "as", "\n", "é", "x"]) for _ in range(9000))
    both = pc.encode(make([(1, text, "en", "a"), (2, spread, "en", "a")]), chunk=64)
    want = dict(zip((1, 2), CODEC.encode([text, spread])[0], strict=True))
    for r in both.collect():  # hundreds of chunks: two rounds of products
        assert np.array(r.ids, np.int32).tobytes() == want[r.doc_id]


def test_products_of_arrays():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([[rng.choice([pc.NONE, (rng.randint(-9, 0), rng.randint(0, 5))]) for _ in range(4)] for _ in range(4)] for _ in range(2))
        flat = lambda m: tuple(np.array([[w[i] for w in row] for row in m]) for i in (0, 1))
        got = pc.product(flat(a), flat(b))
        assert [[tuple(w) for w in zip(s, t, strict=True)] for s, t in zip(*(x.tolist() for x in got), strict=True)] == pc.times(a, b)

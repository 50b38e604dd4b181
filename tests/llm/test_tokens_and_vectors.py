"""The tokenizer alignment, BPE coding and embedding whitening, each against a brute-force version."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from framescan.llm import alignment, bpe, spectrum, whitening

TEXTS = [
    (1, "the quick brown fox isn't lazy"),
    (2, "the quick brown fox isn't lazy"),
    (3, None),
    (4, ""),
    (5, "  two  spaces \n and\tlines \r\n\r\n end  "),
    (6, "日本語 ｆｕｌｌ é̀ 😀 ꟱ \x1c\x85 x　y ​"),
    (7, "▁ piece space"),
    (8, "<|endoftext|> <s> </s> <0x0A> it's  <|endoftext|>"),
    (9, "a" * 9000 + " " + "ab!" * 3000 + " " * 5000 + "z"),
    (9, "the end"),
    (None, "the end"),
    (10, "\x00 nul and " + "unwilling " * 300),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, 1, "g", 2, 3) for i, t in TEXTS], "doc_id long, text string, n_a long, groups string, block long, ids int").repartition(3)


# BPE


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def coder():
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        return bpe.Coder(f.read())


def test_round_trip_equals_the_library(spark, texts):
    t = reference_tokenizer()
    got = sorted(map(tuple, bpe.round_trip(texts).collect()), key=repr)
    want = []
    for i, text in TEXTS:
        ids = ids_of(t, text)
        back = t.decode(list(np.frombuffer(ids, "<u4")), skip_special_tokens=False)
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_encode_keeps_other_columns(spark, texts):
    coded = bpe.encode(texts, out="block")
    assert coded.columns == ["doc_id", "n_a", "groups", "ids", "block"]
    assert bpe.decode(texts.selectExpr("doc_id", "cast(null as binary) b"), "b").collect()[0]["text"] == ""
    assert bpe.round_trip(texts.where("false")).count() == 0


def test_parts_of_any_size_give_the_same_ids(coder, monkeypatch):
    t = reference_tokenizer()
    draw = np.random.default_rng(3)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "'ll", "é", "日本", "23", "!", "<|endoftext|>", "<|endof", "|>", "\xa0", "　", "꟱", "x" * 50, " " * 30, "unwilling", "\x1c", "ⅷ"]
    for _ in range(400):
        text = "".join(draw.choice(bits, draw.integers(0, 60)))
        monkeypatch.setattr(bpe, "HELD", int(draw.choice([4, 60, 400])))
        encoder, out, i = bpe.Encoder(coder), b"", 0
        while i < len(text):
            step = int(draw.choice([1, 2, 7, 30]))
            out, i = out + encoder.feed(text[i : i + step]), i + step
        assert out + encoder.finish() == ids_of(t, text), text


def test_what_is_held_does_not_grow_with_the_word(coder):
    encoder, most = bpe.Encoder(coder), 0
    given = b""
    for _ in range(40):
        given += encoder.feed("ab日" * 5000)
        most = max(most, len(encoder.piece) + len(encoder.text))
    # one part of the text and what the last buffer left
    assert most <= bpe.HELD + 3 * 15000
    assert given + encoder.finish() == ids_of(reference_tokenizer(), "ab日" * 200000)


def test_lookahead_settles_every_token(coder):
    v = coder.vocabulary
    assert v.lookahead == 170
    draw = np.random.default_rng(5)
    pieces = [v.bytes[i] for i in range(256, 50256)]
    for _ in range(300):
        whole = b"".join(pieces[i] for i in draw.integers(0, len(pieces), 80))
        cut = int(draw.integers(200, len(whole)))
        at = 0
        for a, b in zip(v.merge(whole), v.merge(whole[:cut]), strict=False):
            if at + v.lookahead > cut:
                break
            assert a == b
            at += len(v.bytes[a])
        assert at + v.lookahead > cut


def test_lookahead_by_hand():
    # a b c with ab, bc, abc: whether a stands alone hangs on the b behind it, whether that b is gone on the a before
    length = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert bpe.lookahead([(0, 1, 3)], length) == 2
    assert bpe.lookahead([(1, 2, 4), (0, 1, 3)], length) == 3
    with pytest.raises(ValueError):
        bpe.lookahead([(3, 2, 4)], length)


def test_decoding_any_ids(coder):
    t = reference_tokenizer()
    draw = np.random.default_rng(9)
    for _ in range(200):
        ids = draw.integers(0, 50257, 30)
        raw = ids.astype("<u4").tobytes()
        assert bpe.decode_ids(coder.vocabulary, raw) == t.decode(ids.tolist(), skip_special_tokens=False)
        d = bpe.Decoder(coder.vocabulary)
        assert "".join(d.feed(raw[i : i + 4], i + 4 == len(raw)) for i in range(0, len(raw), 4)) == bpe.decode_ids(coder.vocabulary, raw)


# alignment


def brute_alignment(rows):
    import sentencepiece

    a_path, b_path = alignment.tokenizer_paths()
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(a_path)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=b_path)
    byte = {c: bytes([b]) for c, b in bpe._spelling().items()}
    out, counts, links = [], {}, []
    for doc_id, text in rows:
        text = text or ""
        a = [(i, b"".join(byte[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()) for i in b_tok.encode(text)]
        spelled = (" " + text).encode()
        if not text or b"".join(s for _, s in a) != spelled or b"".join(s for _, s in b) != spelled:
            out.append([doc_id, 0, 0, 0, 0, ""])
            links.append([])
            continue
        groups, mine, i, j = [], [], 0, 0
        spans = []
        for tokens in (a, b):
            at, s = 0, []
            for t, raw in tokens:
                s.append((at, at + len(raw), t))
                at += len(raw)
            spans.append(s)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        start = 0
        for end in ends:
            ga = [t for t in spans[0] if start <= t[0] < end]
            gb = [t for t in spans[1] if start <= t[0] < end]
            groups.append(",".join(str(t[2]) for t in ga) + "|" + ",".join(str(t[2]) for t in gb))
            mine += [(x[2], y[2]) for x in ga for y in gb if max(x[0], y[0]) < min(x[1], y[1])]
            start = end
        for p in mine:
            counts[p] = counts.get(p, 0) + 1
        links.append(mine)
        out.append([doc_id, len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(*o[:5], sum(counts[p] == best[p[1]] for p in mine), sum(counts[p] for p in mine), o[5]) for o, mine in zip(out, links, strict=True)]


def test_alignment_against_brute_force(spark, texts):
    got = sorted(map(tuple, alignment.alignment_measures(texts).collect()), key=repr)
    assert got == sorted(brute_alignment(TEXTS), key=repr)


def test_alignment_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, alignment.alignment_measures(docs).collect()), key=repr)
    assert got == sorted(brute_alignment(rows), key=repr)


def test_alignment_in_many_blocks(spark, texts, monkeypatch):
    whole = sorted(map(tuple, alignment.alignment_measures(texts).collect()), key=repr)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 3)
    assert sorted(map(tuple, alignment.alignment_measures(texts).collect()), key=repr) == whole


def test_alignment_of_nothing(spark, texts):
    assert alignment.alignment_measures(texts.where("false")).count() == 0
    only = alignment.alignment_measures(texts.where("text is null or text = '' or text like '▁%'")).collect()
    assert sorted(map(tuple, only), key=repr) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (3, 4, 7)]


def test_groups_are_given_as_text(spark):
    df = spark.createDataFrame([("the fox", 2)], "text string, copies long").selectExpr("text", "copies", "unhex('00') digest")
    row = alignment.align_texts(df).collect()[0]
    assert row["n_groups"] == row["groups"].count(";") + 1 == row["groups"].count("|")


# whitening


def matrices():
    draw = np.random.default_rng(1)
    q, _ = np.linalg.qr(draw.standard_normal((40, 40)))
    yield np.cov(draw.standard_normal((300, 64)).T)
    yield np.diag([3.0, 3, 2, 1, 1])
    yield np.eye(6)
    yield np.ones((20, 20))
    yield np.zeros((3, 3))
    yield (q * np.r_[5, 5 - 1e-13, 5 - 1e-9, 4, np.linspace(0, 3, 36)]) @ q.T
    for _ in range(60):
        a = draw.integers(-3, 4, (n := int(draw.integers(1, 10)), n)).astype(float)
        yield a + a.T


def test_leading_eigenpairs():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = spectrum.leading(a, 4)
        size = max(np.abs(a).max(), 1)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:4], atol=1e-13 * size * len(a))
        np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-12 * size * len(a))
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)


def test_counts_of_eigenvalues():
    draw = np.random.default_rng(2)
    for a in matrices():
        a = (a + a.T) / 2
        for shift in draw.standard_normal(5):
            assert spectrum.above(a, shift) == (np.linalg.eigvalsh(a) >= shift).sum()


def brute_whitening(rows, count=4):
    """Rows of (vec_id, component) by numpy's own eigenvectors."""
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dim in {len(x) for _, x in usable}:
        mine = [(i, x) for i, x in usable if len(x) == dim]
        fit = sorted({tuple(x) for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        mean = [Fraction(s, n) for s in sums]
        cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(dim)] for i in range(dim)])
        e, w = np.linalg.eigh(cov)
        e, w = e[::-1][:count], w[:, ::-1][:, :count]
        for i, x in mine:
            away = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            for k in range(len(e)):
                real = e[k] > 1e-12 * max(np.trace(cov), 1)
                white = float(np.array([float(c - m) for c, m in zip(x, mean, strict=True)]) @ w[:, k] / np.sqrt(e[k])) if real else None
                out.append((i, k + 1, n, away, white, float(e[k] / np.trace(cov)) if np.trace(cov) else None))
    return out


def check_whitening(got, want):
    key = lambda r: (repr(r[0]), r[1], r[2], r[3], abs(r[4] or 0))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        if g[4] is not None:
            assert abs(abs(g[4]) - abs(w[4])) < 1e-8 * (1 + abs(w[4]))
        if g[5] is not None:
            assert abs(g[5] - w[5]) < 1e-9
        assert g[6] is None or g[6] < 1e-9


VECTORS = "vec_id long, embedding array<float>, n int, x array<int>, dim string"


def test_whitening_against_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.standard_normal(6) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (101, None), (102, []), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] * 6), (105, [float("inf")] + [0.0] * 5), (106, [0.0] * 6)]
    rows += [(200 + i, [float(i), 1.0]) for i in range(4)] + [(300, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1, [1], "d") for i, v in rows], VECTORS).repartition(5)
    got = whitening.whiten(df).collect()
    check_whitening(got, brute_whitening(rows))
    assert {r["identity_error"] is None for r in got if r["vec_id"] == 300} == {True}
    assert whitening.whiten(df.where("vec_id = 102")).count() == 0
    assert whitening.whiten(df.where("false")).columns == [c.split()[0] for c in whitening.OUT.split(", ")]


def test_signs_and_columns_agree_over_runs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = sorted(map(tuple, whitening.whiten(df).collect()))
    two = sorted(map(tuple, whitening.whiten(df.repartition(7)).collect()))
    assert [r[:4] for r in one] == [r[:4] for r in two]
    np.testing.assert_allclose([r[4] for r in one], [r[4] for r in two], atol=1e-12)
    assert [r[5] for r in one] == [r[5] for r in two]
    check_whitening(one, brute_whitening([tuple(r) for r in df.select("vec_id", "embedding").collect()]))


def test_very_large_components(spark):
    rows = [(i, [1e300 * (i % 2), float(i)]) for i in range(4)] + [(9, [-3e15, 2.0])]
    df = spark.createDataFrame([(i, v, 1, [1], "d") for i, v in rows], "vec_id long, embedding array<double>, n int, x array<int>, dim string")
    got = whitening.whiten(df).collect()
    assert len(got) == 10 and all(r["deviation"] is None for r in got)
    assert all(abs(r["identity_error"]) < 1e-4 for r in got)

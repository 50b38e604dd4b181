"""Embeddings, chats, the language model and the pipeline."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from framescan.llm import chat_repair, embed_dedup, gru, lm


# ---------------------------------------------------------------- embeddings
def test_int8_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embed_dedup.quantise(x)
    approx = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(approx - x @ x.T) <= e[:, None] + e[None] + np.outer(e, e) + 1e-12).all()


def test_embedding_groups(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8))
    v = [c + rng.normal(size=8) * rng.uniform(0, 0.5) for c in centres for _ in range(12)]
    data = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]
    data += [(1000 + i, data[0][1]) for i in range(40)]
    data += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [1.0, 2.0]), (None, data[0][1]), (2005, [float("inf")] * 8), (2006, [])]
    df = spark.createDataFrame([(i, x, 1, "n", 2) for i, x in data], "vec_id long, embedding array<float>, label int, node string, n int")
    got = {r["vec_id"]: r for r in embed_dedup.embedding_groups(df).collect()}
    good = [(i, np.array(x, np.float64)) for i, x in data if i is not None and x and len(x) == 8 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    m = np.stack([x / np.linalg.norm(x) for _, x in good])
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    for _ in range(50):
        label = np.array([min(label[k], label[link[k]].min()) if link[k].any() else label[k] for k in range(len(ids))])
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[k].sum(), label[k], label[k] == i)
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert tuple(got[i]) == (i, 0, i, True)
    assert tuple(got[None]) == (None, 0, None, False) and len(got) == len(data)
    assert embed_dedup.embedding_groups(df.where("false")).collect() == []


# ---------------------------------------------------------------- chats
def cheapest(given, costs):
    """Least cost over all ways, by brute force."""
    best = np.inf
    for choice in itertools.product(range(12), repeat=len(given)):
        state, cost = chat_repair.START, 0.0
        for g, c in zip(given, choice, strict=True):
            ways = [w for w in chat_repair._choices(g, costs) if w[0] == state]
            if c >= len(ways):
                break
            state, cost = ways[c][1], cost + ways[c][2]
        else:
            best = min(best, cost + chat_repair._ending(costs)[state])
    return best


def test_chat_repair(spark):
    rng = np.random.default_rng(2)
    names = ["user", "assistant", "system", None, "robot", "Human"]
    data, roles = [], {}
    for conv in range(25):
        roles[conv] = [names[k] for k in rng.integers(0, 6, rng.integers(1, 4))]
        data += [(conv, t, r, f"text {t}" if t % 3 else None, 9, "x") for t, r in enumerate(roles[conv])]
    data += [(None, 0, "user", "no id", 9, "x"), (None, None, "assistant", "no id", 9, "x"), (777, 1, "user", "same", 9, "x"), (777, 1, "user", "same", 9, "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part int, cost string")
    got = {r["conv_id"]: r for r in chat_repair.repair_chats(df).collect()}
    costs = chat_repair.Costs()
    for conv, given in roles.items():
        assert got[conv]["cost"] == cheapest([chat_repair._role(r) for r in given], costs), given
    order = [line[2:-2] for line in got[None]["rendered"].splitlines() if line.startswith("<|") and line != "<|end|>"]
    assert order == ["user", "assistant"] and got[777]["rendered"].count("same") == 2
    for r in got.values():
        order = [line[2:-2] for line in r["rendered"].splitlines() if line.startswith("<|") and line != "<|end|>"]
        body = order[1:] if order[0] == "system" else order
        assert body == ["user", "assistant"] * (len(body) // 2) and body
    parts = {}
    for r in sorted(chat_repair.repair_chats(df, chunk=2).collect(), key=lambda r: r["part"]):
        parts[r["conv_id"]] = parts.get(r["conv_id"], "") + r["rendered"]
    assert parts == {k: r["rendered"] for k, r in got.items()}
    assert chat_repair.repair_chats(df.where("false")).collect() == []


# ---------------------------------------------------------------- language model
def _toy(seed=0):
    shape = gru.Shape(n_inputs=9, n_classes=5, n_head=2, per_class=4, hidden=6)
    p = gru.start(shape, np.ones(5), np.ones(8), seed)
    rng = np.random.default_rng(seed)
    docs = []
    for n in (1, 5, 70, 200):
        cls = rng.integers(0, 5, n)
        docs.append((rng.integers(0, 9, n), cls, np.where(cls < 2, rng.integers(0, 4, n), -1)))
    return {k: v.astype(np.float64) for k, v in p.items()}, docs


def test_state_is_carried_across_windows():
    p, docs = _toy()
    assert np.allclose(gru.score(p, docs, window=7, group=2), gru.score(p, docs, window=1000, group=10))
    states = np.zeros((1, 6))
    total = sum(np.exp(gru.log_probs(p, states, np.array([c]), np.array([w])))[0] for c in range(5) for w in (range(4) if c < 2 else [-1]))
    assert abs(total - 1) < 1e-9


def test_gradients():
    p, docs = _toy()
    inp, cls, word = (a[:60].reshape(2, 30).T for a in docs[2])
    fresh = np.zeros((30, 2), bool)
    fresh[0] = fresh[11, 1] = True
    args = (np.zeros((2, 6)), inp, cls, word, fresh)
    _, g, own, _ = gru.gradients(p, *args)
    met = np.zeros_like(p["x"])
    met[:, own] = g["x"]
    g["x"] = met
    rng = np.random.default_rng(0)
    for k, v in p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            keep = v[at]
            v[at] = keep + 1e-5
            up = gru.gradients(p, *args)[0]
            v[at] = keep - 1e-5
            down = gru.gradients(p, *args)[0]
            v[at] = keep
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_lm_scores(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").withColumn("doc_id", odd["doc_id"] + 10**6))
    # a small head sends most words through the join
    got = lm.lm_scores(d, head_words=3000, replica_tokens=30_000).collect()
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in texts if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w := words(t)), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, t in texts)
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 4)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in got) and lm.lm_scores(none).collect() == []


def test_every_training_document_is_learned_from(spark):
    texts = [(i, f"w{i % 37} w{i % 11} common words of text {i % 5}") for i in range(400)] + [(7, "the same row again and again")] * 300 + [(None, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    training = d.where(~lm.held_out("doc_id"))
    counts = lm.word_counts(training)
    v = lm._with_totals(lm.vocabulary(counts, 0, 64, 64, 32, 8), counts)
    rows = lm.dealt(training, v, 200, 2).collect()
    tokens = Counter()
    for r in rows:
        tokens[r["replica"]] += len(r["codes"]) // 4 * r["copies"]
    assert sum(tokens.values()) == v.total and len(tokens) > 10 and max(tokens.values()) < 5 * 200
    got = Counter()
    for r in rows:
        got[tuple(np.stack(v.unpacked(r["codes"]), 1).ravel().tolist())] += r["copies"]
    want = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            want[tuple(np.stack(v.code([*lm.words(t or ""), lm.END], {})[1:4], 1).ravel().tolist())] += 1
    assert got == want


def test_training_leaves_no_token_over(monkeypatch):
    p, _ = _toy()
    seen, real = [], gru.gradients

    def watched(p, h, inp, cls, word, fresh):
        assert inp.shape == fresh.shape and len(h) == inp.shape[1]
        seen.extend(zip(inp.ravel().tolist(), cls.ravel().tolist(), fresh.ravel().tolist(), strict=True))
        return real(p, h, inp, cls, word, fresh)

    monkeypatch.setattr(gru, "gradients", watched)
    rng = np.random.default_rng(3)
    for lengths in ([1], [5, 3], [700, 1, 9], [64] * 50, [3] * 1000 + [2]):
        docs = [(rng.integers(0, 9, n), c := rng.integers(0, 5, n), np.where(c < 2, 1, -1)) for n in lengths]
        seen.clear()
        gru.train(p, docs)
        assert Counter(s[:2] for s in seen) == Counter((int(i), int(c)) for d in docs for i, c in zip(d[0], d[1], strict=True))
        assert sum(s[2] for s in seen) >= len(lengths)


def _log_softmax(logits, at):
    top = max(logits)
    return logits[at] - top - math.log(sum(math.exp(x - top) for x in logits))


def plain_score(p, inp, cls, word):
    """A document's log-probability, a number at a time."""
    _, n = p["u"].shape[1:]
    h, total = [0.0] * n, 0.0
    dot = lambda a, b: sum(x * float(y) for x, y in zip(a, b, strict=True))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for i, c, w in zip(inp, cls, word, strict=True):
        total += _log_softmax([dot(h, p["c"][:, k]) + float(p["cb"][k]) for k in range(p["c"].shape[1])], c)
        if w >= 0:
            total += _log_softmax([dot(h, p["w"][c][:, k]) + float(p["wb"][c][k]) for k in range(p["w"].shape[2])], w)
        x = [[float(y) for y in p["x"][k][i]] for k in range(3)]
        u = [[dot(h, p["u"][k][:, j]) for j in range(n)] for k in range(3)]
        z, r = ([logistic(x[k][j] + u[k][j]) for j in range(n)] for k in range(2))
        h = [h[j] + z[j] * (math.tanh(x[2][j] + r[j] * u[2][j]) - h[j]) for j in range(n)]
    return total


def test_scores_equal_a_plain_forward_pass(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{min(k, 400)}" for k in rng.zipf(1.3, rng.integers(0, 60)))) for i in range(300)] + [(300, None), (None, "w1 w2"), (301, "never-seen w1 Ünseen!")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    args = {"softmax_words": 64, "input_words": 50, "per_class": 16, "hidden": 6}
    training = d.where(~lm.held_out("doc_id"))
    counts = lm.word_counts(training)
    v = lm._with_totals(lm.vocabulary(counts, 0, **args), counts)
    p = lm.fit(training, v, 2000, 2)
    assert any(np.abs(p[k] - w).max() > 0.05 for k, w in lm._first_weights(v).items())
    c = {r["word"].encode(): r["n"] for r in counts.collect()}
    want = {}
    for i, t in texts:
        tokens = [*lm.words(t or ""), lm.END]
        inp, cls, word = v.code(tokens, {})[1:4]
        tails = sum(math.log((c.get(w, 0) + 1) / float(v.tail_total[k - v.shape.n_head])) for w, k, own in zip(tokens, cls, word, strict=True) if own < 0)
        want[i] = (plain_score(p, inp.tolist(), cls.tolist(), word.tolist()) + tails) / math.log(10)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(d, replica_tokens=2000, **args).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-3 * (1 + abs(want[i])) for i in want)


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pii", "mixture", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == corpus_pipeline.run(spark, sf).columns and last.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).collect() == []
        stage(spark, odd, sf).collect()


def test_links_over_blocks_of_mixed_lengths(spark):
    import numpy as np

    from framescan.llm.embed_dedup import embedding_groups

    draw = np.random.default_rng(11)
    rows = [(i, draw.standard_normal(16).tolist()) for i in range(400)]
    for n in range(3, 9):  # rare lengths: most blocks have none of them
        v = draw.standard_normal(n)
        rows += [(1000 + 10 * n + k, (v * (k + 1)).tolist()) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_groups(df, least_block=16).collect()}
    for i, v in rows:
        mates = [j for j, w in rows if j != i and len(v) == len(w) and np.dot(v, w) >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i][0] == len(mates), i
        if i >= 1000:
            assert got[i] == (2, i // 10 * 10)


def test_words_are_taken_from_whole_batches_as_from_single_texts(spark):
    import pyarrow as pa

    texts = ["", "  lead and TRAIL \t", "Éa ÀB, été! x. ? ,a a, ñ ÿ; 日本 日本。 \x0b\x0cz\x1c\x85 \xa0y", "one", "\n", "known KNOWN unknown? \x00 é"] * 3
    flat, n = lm.split_words(pa.array(texts).slice(1))
    want = [lm.words(t) for t in texts[1:]]
    assert n.tolist() == [len(w) for w in want] and flat.cast(pa.binary()).to_pylist() == [x for w in want for x in w]
    assert lm.tail_classes(flat.slice(2)).tolist() == [lm.tail_class(w) for w in flat.slice(2).cast(pa.binary()).to_pylist()]
    assert [len(s) for s in lm.slices(pa.array(["x" * lm._SLICE, "a", "b", "x" * lm._SLICE]))] == [1, 2, 1]
    # the numbers that are kept and shuffled are no wider than the vocabulary needs, and say the same
    counts = lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r["word"]: r["n"] for r in counts.collect()} == {**{w.decode(): n for w, n in Counter(x for t in texts for x in lm.words(t)).items()}, "\n": len(texts)}
    v = lm._with_totals(lm.vocabulary(counts, 0, 4, 5, 2, 8), counts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = {(r["h"], r["replica"]): r["codes"] for r in lm.dealt(d, v, 20, 2).collect()}
    small = lm.narrow(lm.dealt(d, v, 20, 2), v).collect()
    assert len(small) == len(wide) > 3
    for r in small:
        assert 2 * len(r["codes"]) == len(wide[r["h"], r["replica"]])
        assert np.frombuffer(r["codes"], np.uint16).tolist() == np.frombuffer(wide[r["h"], r["replica"]], np.int32).tolist()
    c = v.of_texts(pa.array(texts), v.names())
    assert c.unheld().to_pylist() == [" ".join(w.decode() for w in lm.words(t) if w not in v.ids) for t in texts]

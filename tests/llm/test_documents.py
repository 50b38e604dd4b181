"""Operators on documents against brute-force versions."""

import hashlib
import itertools
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest
import xxhash

from framescan.llm import cutting, mixing, packing, pii, quality_knn, quality_rules, sharding, simhash
from framescan.llm.components import components

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- SQL twins
@pytest.mark.parametrize("made", [lambda d: (quality_rules.quality_rules(d), quality_rules.sql()), *(lambda d, n=n: (sharding.shards(d, n), sharding.sql(n)) for n in (30, 5000, 10**9))])
def test_matches_sql(odd, tmp_path, made):
    odd.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    df, sql = made(odd)
    rel = con.sql(sql)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(rows(df), key=str) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)


def test_line_rules_keep_clean_and_remove_junk(spark):
    clean = "A plain sentence of ten good words stands right here. " * 1 + "\nAnother line with quite different words follows after that one."
    junk = "\n".join(["home | news | sport | about | help | login | more", "wow!! buy!! now!! great!! deal!! yes!!", "x### y$$$ z*** a%%% b&&& c###"])
    df = spark.createDataFrame([(1, clean, "keep"), (2, junk, "keep"), (3, clean + "\n" + junk[:49], "keep")], "doc_id long, text string, cleaned string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[3]["n_removed_lines"] == 1
    cleaned = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert cleaned[3]["text"] == clean and cleaned[1]["cleaned"] == "keep" and 2 not in cleaned


def test_shards_fit_and_hold_every_row(docs, spark, tmp_path):
    got = sharding.shards(docs, 20_000).collect()
    assert len(got) == docs.count()
    sums = {}
    for r in got:
        key = (r["depth"], r["prefix"], r["overflow"])
        sums[key] = sums.get(key, 0) + r["n_bytes"]
    assert all(sums[r["depth"], r["prefix"], r["overflow"]] == r["shard_bytes"] for r in got)
    assert all(r["shard_bytes"] <= 20_000 or r["n_bytes"] == r["shard_bytes"] for r in got)
    sharding.write_shards(docs, str(tmp_path / "s"), 100_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# ---------------------------------------------------------------- SimHash
def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(nodes, linked):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in itertools.combinations(nodes, 2):
            if linked(a, b):
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash_groups(odd, none):
    got = simhash.simhash_groups(odd).collect()
    fps = {(r["doc_id"], t): plain_fingerprint(t) for r, t in ((r, r["text"]) for r in odd.collect())}
    label = plain_groups(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = sorted(((r["doc_id"], f"{(f := plain_fingerprint(r['text'])):016x}", least.get(label[f])) for r in odd.collect()), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert rows(simhash.simhash_groups(none)) == []
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]


def test_one_row_of_each_group_stays(spark):
    near = "the same long text of many words stands here twice and is kept once only in the end"
    texts = [(1, f"text number {i} about {chr(97 + i % 26) * 3} and w{i * 7} q{i * 13}") for i in range(30)]
    texts += [(1, near), (5, near), (1, "shared by null ids"), (None, "shared by null ids"), (None, "null only a b c d"), (None, "null only a b c d"), (None, "another null e f g"), (9, "copied x y z"), (9, "copied x y z")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    label = plain_groups(sorted({plain_fingerprint(t) for _, t in texts}), lambda a, b: (a ^ b).bit_count() <= 2)
    kept = rows(simhash.drop_near_duplicates(df))
    groups = {}
    for i, t in texts:
        groups.setdefault(label[plain_fingerprint(t)], []).append((i is None, i or 0))
    assert sorted(label[plain_fingerprint(t)] for _, t in kept) == sorted(groups)
    assert all((i is None, i or 0) == min(groups[label[plain_fingerprint(t)]]) for i, t in kept) and set(kept) <= set(texts)


@pytest.mark.parametrize("max_bits,bucket", [(1, 2), (2, 2), (2, 1000)])
def test_hamming_edges_lose_no_link(spark, max_bits, bucket):
    rng = np.random.default_rng(max_bits)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63, 40)}
    for f in list(fps):
        for _ in range(6):
            g = f & (2**64 - 1)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                g ^= 1 << int(b)
            fps.add(g - 2**64 if g >> 63 else g)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.hamming_edges(df, max_bits=max_bits, bucket_rows=bucket)
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    pairs = rows(edges.select("a", "b"))
    assert all(far(a, b) <= max_bits for a, b in pairs)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = plain_groups(sorted(fps), lambda a, b: far(a, b) <= max_bits)
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(rows(components(edges)))
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# ---------------------------------------------------------------- mixing
def test_fit_counts_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 6))
        lengths = rng.choice(np.arange(1, 30), n, replace=False)
        counts = rng.integers(1, 4, n)
        budget = int(rng.integers(0, 60))
        best = max(s for c in itertools.product(*(range(k + 1) for k in counts)) if (s := int(np.dot(c, lengths))) <= budget)
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int(take @ lengths) == best


def test_mix(odd, none, docs):
    assert rows(mixing.mix_plan(none)) == [] and rows(mixing.mix(none)) == []
    for df in (odd, docs):
        plan = mixing.mix_plan(df).collect()
        size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
        source = {}
        for r in df.collect():
            source.setdefault(r["source"], []).append(size(r["text"]))
        names = sorted((s for s in source if s is not None), key=lambda s: s.encode()) + [None] * (None in source)
        total = {s: sum(source[s]) for s in names}
        weight = {s: 1 + i % 3 for i, s in enumerate(names)}
        target = dict.fromkeys(names, 0.0)
        left, free = float(sum(total.values())), set(names)
        while left > 1e-9 and free:  # pour by weight, stop at three times the size, pour the rest again
            share, w = left, sum(weight[s] for s in free)
            left = 0.0
            for s in list(free):
                target[s] += share * weight[s] / w
                if target[s] >= 3 * total[s]:
                    left += target[s] - 3 * total[s]
                    target[s] = 3.0 * total[s]
                    free.discard(s)
        got = {}
        for r in plan:
            got.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
        assert len(plan) == df.count()
        assert set(got) == {(total[s], round(target[s], 6)) for s in names}
        assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in plan)
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns
        assert sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in plan)
        assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.mix_plan(df.repartition(5)).collect()), key=str)
    by_source = {}
    for r in mixing.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        by_source.setdefault(r["source"], []).append(r)
    for found in by_source.values():
        sizes, target = [r["size"] for r in found], found[0]["target"]
        epochs, rest = divmod(target, sum(sizes))
        sums = 1
        for n in sizes:
            sums |= sums << n
        best = (sums & ((1 << (int(rest) + 1)) - 1)).bit_length() - 1
        assert sum(r["taken"] for r in found) == epochs * sum(sizes) + best


def test_mix_of_repeated_ids_fills_the_budget(spark, tmp_path):
    same = [(7, "one two three", "a", i) for i in range(90)] + [(7, f"four five w{i}", "a", i) for i in range(30)] + [(None, "six seven eight", None, i) for i in range(60)]
    spark.createDataFrame([*same, *[(100 + i, "nine ten", "b", i) for i in range(50)]], "doc_id long, text string, source string, n int").repartition(4).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == df.count()
    got = {}
    for r in plan:
        got.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in got.items():
        step = 2 if size == 100 else 3
        assert sum(taken) == int(target) // step * step, (size, target)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in plan)


# ---------------------------------------------------------------- quality votes
def test_quality_votes(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality_knn.quality_scores(d, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) >= 0.95
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (6, 0), (7, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    scored = quality_knn.quality_scores(odd, marks).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert rows(quality_knn.quality_scores(none, marks)) == []
    assert {r["score"] for r in quality_knn.quality_scores(odd, marks.where("false")).collect()} == {0.5}
    assert quality_knn.keep_good(odd, marks).columns == odd.columns


# ---------------------------------------------------------------- personal data
def plain_base(text):
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(3)
    alphabet = list("a@@..-+ 0123456789()é%\n") + ["4111 1111 1111 1111", "10.0.0.1", "a@b.c", "+1 (743) 555-3824", "256.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        assert pii.base_spans(text) == plain_base(text), text


def test_spans_added_and_decoys_left(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(d)
    spelled = "please mail bob.smith (at) example (dot) org or phone (743) 555-3824 today"
    base, spans = model.spans(spelled)
    assert base == [] and {spelled[s:e] for s, k, e in spans if k == 0} == {"bob.smith (at) example (dot) org"}
    for decoy in ("version 2.0 of 1234567890123456 is here", "order 20240105 and 300.1.2.3", "look at the dot. Then go", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'):
        assert model.spans(decoy) == ([], []), decoy
    got = {r["doc_id"]: r for r in pii.pii_spans(odd).collect()}
    text = {r["doc_id"]: r["text"] for r in odd.collect()}[7]
    joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_base(text))
    assert (got[7]["n_email"], got[7]["n_ip"], got[7]["n_card"], got[7]["n_phone"]) == (1, 1, 1, 1)
    assert got[7]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[7]["spans"].startswith(joined[:9])
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.pii_spans(odd).count() == odd.count() and rows(pii.pii_spans(none)) == []
    clean = {r["doc_id"]: r for r in pii.redact_pii(odd).collect()}
    assert clean[7]["text"] == "write to <EMAIL> or <IP>, card <CARD>, call <PHONE> now please." and clean[3]["text"] is None
    assert pii.redact_pii(odd).columns == odd.columns


def plain_spans(rows, precision=0.99, rounds=60, depth=3, rate=0.2, bins=32):
    """Margins of the held examples and thresholds, by boosting in one piece of numpy; rows: (held, kind, x, y)."""
    held, kind, y = (np.array([r[i] for r in rows]) for i in (0, 1, 3))
    x = np.array([r[2] for r in rows], np.float64)
    edges = [np.unique(np.quantile(x[~held, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    p = y[~held].mean()
    margin = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for _ in range(depth):
            right = np.zeros(len(y), bool)
            for k in np.unique(node):
                best, at = 1e-9, ~held & (node == k)
                gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                for j, e in enumerate(edges):
                    for t in e:
                        new = gain(at & (x[:, j] <= t)) + gain(at & (x[:, j] > t)) - gain(at)
                        if new > best + 1e-9:
                            best, side = new, x[:, j] > t
                            right[node == k] = side[node == k]
            node = 2 * node + right
        for k in np.unique(node):
            at = ~held & (node == k)
            margin[node == k] -= rate * g[at].sum() / (h[at].sum() + 1)
    score, lowest = 1 / (1 + np.exp(-margin)), []
    for k in range(4):
        s, t = score[held & (kind == k)], y[held & (kind == k)]
        good = [v for v in np.unique(s) if (s >= v).sum() >= 10 and t[s >= v].mean() >= precision]
        lowest.append(max(0.5, min(good)) if good else 2.0)
    return margin, lowest


def test_spans_are_learnt_from_all_documents(spark):
    texts = [f"n {i} mail a{i}@ex{i % 7}.org, card 4111 1111 1111 1111, host 10.0.{i % 200}.{i % 9}, call +1 (743) 555-{i % 9000 + 1000}, no {i * 7919 % 10**9}" for i in range(2300)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[0]), (9999, "nothing here")], "doc_id long, text string")
    found = pii.training_examples(d.repartition(5)).collect()
    assert len({r["doc_id"] for r in found}) == 2300
    of_five = {(tuple(x), y) for x, y in zip(*pii.examples(texts[5]), strict=True)}
    assert len(of_five) > 64 and sorted((tuple(r["x"]), r["y"]) for r in found if r["doc_id"] == 5) == sorted(of_five)


def test_spread_boosting_equals_boosting_in_one_piece(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 4, (500, 1)), rng.integers(0, 40, (500, pii.N_FEATURES - 1))], axis=1).astype(float)
    x[:, 3:] = 0
    y = ((x[:, 1] > 15) ^ (x[:, 2] > 30) | (rng.random(500) < 0.02)).astype(int)
    rows_ = [(bool(i % 3 == 0), int(r[0]), r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "doc_id long, held boolean, kind int, x array<double>, y int")
    model = pii.fit_spans(d.repartition(3), 0.9, per_task=100, rounds=12)
    margin, thresholds = plain_spans(rows_, 0.9, rounds=12)
    assert np.allclose(model.trees.margin(x), margin, atol=1e-4) and np.allclose(model.thresholds, thresholds, atol=1e-4)
    assert pii.fit_spans(d.repartition(7), 0.9, per_task=20, rounds=12).thresholds == model.thresholds
    assert pii.fit_spans(d.where("false")).thresholds == (2.0,) * 4


def test_numbers_beside_other_numbers(spark):
    rng = np.random.default_rng(9)
    for _ in range(500):
        text = "x" + "".join(rng.choice(list("0123456789") * 3 + [" ", "-", ". ", " (", ") "], rng.integers(0, 60)))
        found = {(s + (text[s] == "("), k, e) for s, k, e in pii.proposals(text) if k > 1}
        groups = [m.span() for m in re.finditer("[0-9]+", text)]
        for (s, _), (_, e) in ((a, b) for i, a in enumerate(groups) for b in groups[i:]):
            n = sum(c.isdigit() for c in text[s:e])
            if not re.search(r"[^0-9]{4}", text[s:e]) and e - s >= 7:
                assert ((s, 3, e) in found) == (7 <= n <= 15) and ((s, 2, e) in found) == (13 <= n <= 19), (text, s, e)
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    spans = lambda text: {(pii.KINDS[k], text[s:e]) for s, k, e in model.spans(text)[1]}
    assert spans("call 2024 (743) 555-3824 now") == {("phone", "(743) 555-3824")}
    assert spans("743 555 3824 743 555 3825") == {("phone", "743 555 3824"), ("phone", "743 555 3825")}
    assert spans("card 2024 4111 1111 1111 1111 ok") == {("card", "4111 1111 1111 1111")}
    assert spans("host 10 dot 0 dot 0 dot 12 is down") == {("ip", "10 dot 0 dot 0 dot 12")}
    assert spans("server 10[.]20[.]30[.]40 up") == {("ip", "10[.]20[.]30[.]40")}
    many = "12 3456 " * 20_000
    assert len(pii.proposals(many)) < 30 * 40_000


# ---------------------------------------------------------------- packing
def test_packing(odd, none, docs):
    from tokenizers import Tokenizer

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        t = Tokenizer.from_str(f.read())
    for df, fill in ((odd, 0.5), (docs, 0.95)):
        want = {}
        for r in df.collect():
            ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            for s in range(0, len(ids), 2048):
                part = ids[s : s + 2048]
                key = (r["doc_id"], s, len(part), zlib.crc32(array("I", part).tobytes()), len(ids))
                want[key] = want.get(key, 0) + 1
        got = packing.pack(df).collect()
        seen, ends = {}, {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            key = tuple(r)[:5]
            seen[key] = seen.get(key, 0) + 1
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert seen == want and max(ends.values()) <= 2048
        assert sum(ends.values()) >= fill * 2048 * len(ends)
    assert rows(packing.pack(none)) == []


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(2):
        sizes = np.arange(1, 256)
        demand = rng.integers(0, 4000, 255)
        plan = cutting.plan_bins(sizes, demand, 256)
        assert all(p @ sizes <= 256 for p, _ in plan)
        assert (sum(p * n for p, n in plan) >= demand).all()
        assert sum(n for _, n in plan) <= 1.01 * np.ceil((sizes @ demand) / 256)


def test_very_long_digit_runs(spark):
    from framescan.llm.pii import pii_spans, redact_pii

    texts = ["0" * 5000 + "1.2.3.4", "1" * 5000 + ".2.3.4 and " + "0" * 5000 + "9.8.7.6", "mail ann@example.com ip 10.0.0.1 " * 20 + "0" * 5000 + "7.7.7.7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_spans(docs).collect()}
    assert (got[0]["n_ip"], got[0]["spans"]) == (1, "ip:0:5007")
    assert got[1]["n_ip"] == 1 and got[2]["n_ip"] == 21
    assert [r["text"] for r in redact_pii(docs).where("doc_id = 0").collect()] == ["<IP>"]


def test_numbers_set_apart_by_wide_marks_are_proposed():
    from framescan.llm.pii import proposals

    for mark in ("\xa0", " ", " ", "‑", "–", "—", "\n", "\r\n", "\t"):
        text = f"call 743{mark}555{mark}3824 now, card 4111{mark}1111{mark}1111{mark}1111."
        found = {text[s:e] for s, _, e in proposals(text)}
        assert f"743{mark}555{mark}3824" in found and mark.join(["4111", *["1111"] * 3]) in found


def test_long_menu_lines_fail(spark):
    from framescan.llm.quality_rules import judge

    bar = "Home About Us Contact FAQ Help Login Sign Up Register Search Next Previous Print Share Menu Top"
    body = " ".join(f"w{i} went to the market." for i in range(30))
    long = " | ".join(["about us", "about", "read more"] * 20_000)
    docs = spark.createDataFrame([(1, f"{bar}\n{body}"), (2, f"{long}\n{body}"), (3, f"{bar} of the town was busy.\n{body}")], "doc_id long, text string")
    removed = {r["row"]["doc_id"]: r["n_removed_lines"] for r in judge(docs).collect()}
    assert removed == {1: 1, 2: 1, 3: 0}


def test_short_texts_fill_sequences(spark):
    from framescan.llm.packing import pack

    # 20,000 pieces of one token, 1,000 of four or five
    docs = spark.range(21_000).selectExpr("id AS doc_id", "CASE WHEN id < 20000 THEN '' ELSE 'one two three four' END AS text")
    rows = pack(docs).selectExpr("sum(length) n", "max(sequence_id) + 1 s", "count(distinct sequence_id) d").first()
    assert rows["s"] == rows["d"] <= -(-rows["n"] // 2048) + 1


def test_training_passes_take_as_many_tasks_as_examples_need(spark, monkeypatch):
    rows_ = [(i, i % 3 == 0, 0, [float(i * j % 50) for j in range(pii.N_FEATURES)], i % 2) for i in range(300)]
    d = spark.createDataFrame(rows_, "doc_id long, held boolean, kind int, x array<double>, y int")
    seen, dealt, fit = [], type(d).repartition, pii.fit_trees
    # a cluster where every keyed shuffle has many parts
    monkeypatch.setattr(type(d), "repartition", lambda self, n, *keys: dealt(self, max(n, 61) if keys else n, *keys))
    monkeypatch.setattr(pii, "fit_trees", lambda rows, *a, **k: seen.append(rows.rdd.getNumPartitions()) or fit(rows, *a, **k))
    pii.fit_spans(d, per_task=100, rounds=2)
    assert seen == [3]

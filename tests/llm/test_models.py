"""Classifiers by held-out accuracy and numeric gradients; decontamination against planted leaks."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from sluice.llm import common, decontaminate, quality, queries, sampling, toxicity

SF = "/root/testdata/sf0.01"


def held(rows, parts, part, label):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    got = pd.DataFrame([r.asDict() for r in rows]).merge(labels, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % parts == part)).all()
    test = got[got.held_out]
    return test.predicted.to_numpy(), test[label].to_numpy()


def test_op3(spark):
    rows = queries.op3_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    predicted, toxic = held(rows, 5, 0, "toxic")
    assert predicted[toxic == 0].mean() <= 0.02 and predicted[toxic == 1].mean() >= 0.5


def test_op6(spark):
    rows = queries.op6_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    predicted, good = held(rows, 4, 2, "quality")
    assert predicted[good == 1].mean() >= 0.97 and predicted[good == 0].mean() <= 0.2


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.fit(odd, labels)
        rows = module.score(odd, model).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 5)}) == 1
        assert module.score(none, module.fit(none, labels)).count() == 0
        assert module.score(odd, module.fit(odd, labels.limit(0))).count() == 10
    assert quality.accepted(odd, model).columns == odd.columns


def test_risk_is_corrected_for_the_prior():
    """Half of U is positive; plain training on P against U would score those at a half or less."""
    r = np.random.default_rng(0)
    pos = lambda n: [np.unique(np.append(r.integers(10, 400, 20), 1)) for _ in range(n)]
    neg = lambda n: [np.unique(np.append(r.integers(10, 400, 20), 2)) for _ in range(n)]
    model = toxicity.train(pos(300), pos(500) + neg(500), 0.5)
    score = lambda x: 1 / (1 + np.exp(-model.logits(np.zeros(len(x), np.int64), x, 1)[0]))
    assert np.mean([score(x) for x in pos(100)]) > 0.9 and np.mean([score(x) for x in neg(100)]) < 0.1


def test_network_gradients():
    r = np.random.default_rng(0)
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, flag = r.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8), r.random((5, quality.CHUNK)) < 0.3
    y, w = np.array([0, 1, 0, 1, 1.0]), np.full(5, 0.2)
    tables = net.responses
    net.responses = lambda d, f: tables(d, f).astype(np.float64)

    def loss():
        z = net.chunk_logits(data, flag)
        return (w * (np.logaddexp(0, z) - y * z)).sum()

    g = net.gradients(data, flag, y, w)
    for k in ("out", "bias", "shift", "filter", "embed"):
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        for at in np.argsort(-np.abs(grad))[:4]:
            old, eps = flat[at], 1e-4
            flat[at] = old + eps
            up = loss()
            flat[at] = old - eps
            down = loss()
            flat[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(grad[at], rel=0.05, abs=1e-4)


def test_chunks_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 447, 448, 449, 5000):
        doc = bytes(random.Random(n).randrange(256) for _ in range(n))
        data, _ = quality.chunks(doc)
        whole = bytearray(len(data) * quality.STEP + quality.CHUNK)
        for k, c in enumerate(data):
            whole[k * quality.STEP : k * quality.STEP + quality.CHUNK] = c.tobytes()
        assert bytes(whole[:n]) == doc


def test_scores_do_not_depend_on_the_company():
    net = quality.Network(3)
    docs = [b"", b"short", b"The long one, " * 9000, b"a b c" * 200]
    assert np.allclose(net.scores(docs), [net.scores([d])[0] for d in docs])


def test_toxicity_scores_by_hand(monkeypatch):
    """Distinct words' weights, summed up in plain Python; long texts in parts."""
    words = ["bad", "worse", "é", "ok"]
    feature = np.array([int(common.Words([w.encode()]).hashes().view(np.int64)[0]) for w in words])
    weight, order = np.array([2.0, 3.0, -1.5, 0.25]), np.argsort(feature)
    model = toxicity.Model(feature[order], weight[order].astype(np.float32), -4.0)
    docs = ["", "Bad bad, WORSE!", "bad-worse é " * 50, "ok " * 100 + "bad", "none of these"]
    want = []
    for d in docs:
        plain_words = set("".join(c.lower() if c.isascii() else c if not c.isascii() else " " for c in "".join(c if not c.isascii() or c.isalpha() else " " for c in d)).split())
        want.append(1 / (1 + np.exp(4.0 - sum(w for x, w in zip(words, weight) if x in plain_words))))
    for limit in (10, 1 << 20):
        monkeypatch.setattr(common, "SLICE_BYTES", limit)
        assert np.allclose(model.scores([d.encode() for d in docs]), want)


def test_quality_scores_by_hand():
    """Repetition flags, filters, pooling and combination in plain loops."""
    net = quality.Network(5)
    net.p["shift"] = np.linspace(-0.3, 0.3, quality.FILTERS).astype(np.float32)
    net.p["mean"], net.p["least"], net.p["base"] = (np.array([v], np.float32) for v in (0.7, 0.4, -0.1))
    r = random.Random(4)
    for n in (0, 3, 100, 256, 300, 700):
        doc = bytes(r.choice(b"ab c") for _ in range(n // 2)) + (b"word again " * n)[: n - n // 2]
        flag = [any(all(i + k < n and i >= lag and doc[i + k] == doc[i + k - lag] for k in range(quality.AGREE)) for lag in quality.LAGS) for i in range(n)]
        logits, at = [], 0
        while True:
            data = [doc[at + k] if at + k < n else 32 for k in range(quality.CHUNK)]
            marks = [flag[at + k] if at + k < n else False for k in range(quality.CHUNK)]
            z = float(net.p["bias"][0])
            for f in range(quality.FILTERS):
                best = max(net.p["shift"][f] + sum(net.p["embed"][data[p + w]] @ net.p["filter"][w, :-1, f] + marks[p + w] * net.p["filter"][w, -1, f] for w in range(quality.WIDTH)) for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE))
                z += max(best, 0) * net.p["out"][f]
            logits.append(z)
            if at + quality.CHUNK >= n:
                break
            at += quality.STEP
        z = 0.7 * np.mean(logits) + 0.4 * min(logits) - 0.1
        assert net.scores([doc])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_samples_have_a_bound(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("k"))
    ids = ids.unionByName(ids.where("doc_id = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    for rows in (10, 100, 1000):
        got = sampling.smallest(ids, rows)
        assert 0.8 * rows <= got.count() <= rows
        assert sorted(got.collect()) == sorted(sampling.smallest(ids.repartition(7), rows).collect())
    assert sampling.smallest(ids, 5000).count() == 5000
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "x" * 50), (4, "no")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, k int")
    assert sorted(tuple(r) for r in sampling.texts_of(docs, chosen, 40).collect()) == [(1, 0, "a"), (2, 1, "")]


def test_op1_rules_by_hand(spark):
    """Every pair by dense cosines, plain LCS and the answer rule; few words, so that many pairs are near the bounds."""
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(4, 20))) + ". " + " ".join(r.choices(vocabulary, k=r.randint(2, 6)))) for k in range(12)]
    docs = []
    for k in range(60):
        own = r.choice(items)[1].replace(".", "").split()
        spoiled = [w for w in own if r.random() < r.choice([0.55, 0.65, 0.9])]
        docs.append((k, " ".join(r.choices(vocabulary, k=r.randint(0, 30)) + spoiled + r.choices(vocabulary, k=r.randint(0, 60)))))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    n = len(docs)
    df = {w: sum(w in d.split() for _, d in docs) for w in vocabulary}
    idf = {w: np.log((1 + n) / (1 + df[w])) + 1 for w in vocabulary}

    def passages(words):
        return [(s, min(s + decontaminate.PASSAGE, len(words))) for s in decontaminate.passage_starts(len(words)).tolist()]

    def vector(words):
        v = {w: np.sqrt(words.count(w)) * idf[w] for w in set(words)}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    want, edge = set(), set()
    for d, text in docs:
        words = text.split()
        for i, item in items:
            own = item.replace(".", "").split()
            answer = [s for s in item.split(".") if len(s.split()) >= 3][-1].split()
            for a, b in passages(words):
                cosine = max(sum(x * vector(words[a:b]).get(w, 0) for w, x in vector(own[c:e]).items()) for c, e in passages(own))
                reach = max(len(own), decontaminate.STEP) // 2
                part = words[max(0, a - reach) : b + reach]
                share, said = lcs(own, part) / len(own), lcs(answer, part) / len(answer)
                if share >= decontaminate.LCS_ALONE or (share >= decontaminate.LCS_WITH_ANSWER and said >= decontaminate.ANSWER):
                    if cosine >= decontaminate.COSINE + 1e-3:
                        want.add((d, i))
                    elif cosine >= decontaminate.COSINE - 1e-3 or " ".join(own) in text:
                        edge.add((d, i))
    assert want and want <= got <= want | edge


def test_op1_long_texts_in_parts(monkeypatch):
    """A text in overlapping parts has the same leaks as the whole one."""
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(900)]
    texts = [" ".join(r.choices(vocabulary, k=25)) for _ in range(8)]
    idf = np.ones(1 << decontaminate.HASH_BITS, np.float32)
    feature = np.unique(decontaminate._feature(decontaminate._words(texts)[0]))
    space = decontaminate.Space(idf, feature, np.linalg.qr(np.random.default_rng(1).standard_normal((len(feature), 6)))[0])
    items = decontaminate.Items(list(enumerate(texts)), space)
    doc = " ".join(x for t in texts[:6] for x in (t, " ".join(r.choices(vocabulary, k=300))))
    whole = {(d, i) for d, i, *_ in decontaminate.matches([doc, "short"], space, items)}
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 16)
    for limit in (200, 3000):
        monkeypatch.setattr(common, "SLICE_BYTES", limit)
        assert {(d, i) for d, i, *_ in decontaminate.whole_matches([doc, "short"], space, items)} == whole == {(0, i) for i in range(6)}


def test_op1_space_over_the_heaviest_words_only(spark, monkeypatch):
    """Features beyond the space's bound count as outside of it, and no leak is lost."""
    monkeypatch.setattr(decontaminate, "SPACE", 40)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2000)
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d, i) for d, t in docs[["doc_id", "text"]].values for i, x in items[["item_id", "text"]].values if f" {plain(x)} " in f" {plain(t)} "}
    bench = spark.createDataFrame(items[["item_id", "text"]])
    assert want == {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs[["doc_id", "text"]]), bench).collect()}


def test_lcs():
    r = random.Random(0)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randrange(30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def test_op1(spark):
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d, i) for d, t in docs[["doc_id", "text"]].values for i, x in items[["item_id", "text"]].values if f" {plain(x)} " in f" {plain(t)} "}
    assert want and {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, SF).collect()} == want


def test_op1_paraphrases(spark, monkeypatch):
    """Words dropped, replaced and put in between; in several passes over the items."""
    r = random.Random(5)
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    base, rows, want = docs.text[docs.text.str.len() > 800].tolist(), [], set()
    for k, (i, text) in enumerate(items[["item_id", "text"]].values):
        words = text.upper().split()
        if len(words) < 15:
            continue
        spoiled = [w for x in words for w in ([] if r.random() < 0.1 else ["other"] if r.random() < 0.1 else [x, "also"] if r.random() < 0.1 else [x])]
        other = base[k % len(base)].split()
        rows.append((k, " ".join([*other[:50], *spoiled, *other[50:]])))
        want.add((k, i))
    monkeypatch.setattr(decontaminate, "ITEMS", 13)
    bench = spark.createDataFrame(items[["item_id", "text"]])
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(want - got) <= 0.05 * len(want)
    clean = spark.createDataFrame(docs[["doc_id", "text"]]).join(decontaminate.leaks(spark.createDataFrame(docs[["doc_id", "text"]]), bench), "doc_id", "left_anti")
    assert decontaminate.leaks(clean, bench).count() == 0


@pytest.mark.parametrize("n", [2000, 8000])
def test_op1_large_benchmarks(spark, n):
    """Many more items than singular vectors; each is a run of a document's words, and all are found there."""
    r = random.Random(n)
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]]
    words = [(d, w) for d, t in docs.values if len(w := plain(t).split()) >= 60]
    rows, want = [], set()
    for i in range(n):
        (d, w), size = r.choice(words), r.randint(15, 59)
        at = r.randrange(len(w) - size + 1)
        rows.append((i, " ".join(w[at : at + size])))
        want.add((d, i))
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(docs).repartition(4), bench).collect()}
    assert not want - got


def test_op1_full_cosines():
    """The products on all words, and the passages that need them, against a dense version; the space leaves most out."""
    r = np.random.default_rng(3)
    vocabulary = np.array([f"w{k}" for k in range(400)])
    texts = [" ".join(r.choice(vocabulary, 30)) for _ in range(150)]
    docs = [" ".join([*r.choice(vocabulary, r.integers(60)), x, *r.choice(vocabulary, 50)]) for x in texts]
    idf = np.ones(1 << decontaminate.HASH_BITS, np.float32)
    feature = np.unique(decontaminate._feature(decontaminate._words(texts)[0]))
    q = np.linalg.qr(r.standard_normal((len(feature), 5)))[0]
    space = decontaminate.Space(idf, feature, q)
    items = decontaminate.Items(list(enumerate(texts)), space)
    got = {(d, i): c for d, i, c, _, _ in decontaminate.matches(docs, space, items)}
    dense = lambda rows: [(k, np.bincount(f, w, 1 << decontaminate.HASH_BITS)[feature]) for k, f, w in decontaminate.vectors(rows, idf)]
    known, full = dense(texts), {}
    for k, x in dense(docs):
        full[k] = max(full.get(k, 0), x @ known[k][1])
    assert all((k, k) in got and got[k, k] >= full[k] - 1e-4 for k in range(len(docs)))


def test_op1_copies_at_low_cosines(spark):
    """Short and common words of an item among rare ones: no cosine tells of it, but it is there."""
    docs = [(k, " ".join([*(f"rare{k}x{j}" for j in range(30)), "it is so", *(f"seldom{k}x{j}" for j in range(30))])) for k in range(50)]
    bench = spark.createDataFrame([(7, "It is so."), (8, "It is not so.")], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.lcs_share) for r in got if r.item_id == 7) == [(k, 7, 1.0) for k in range(50)]


def test_op1_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "the same words stand here twice over and over again", "x"), (4, "?!", "x")], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(odd, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(4, None), (9, None), (9, None)]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == 7
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == 10

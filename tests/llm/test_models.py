"""The classifiers against plain versions of themselves, and the odd rows that they have to take."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import language_id, toxicity


def plain_decode(model, row):
    """Loss of each codeword, bit by bit."""
    losses = []
    for word in model.code:
        loss = 0.0
        for b in range(len(word)):
            margin = sum(float(row[k]) * float(model.weights[k, b]) for k in np.flatnonzero(row)) + float(model.bias[b])
            loss += float(model.trust[b]) * math.log(1 + math.exp(-2 * margin * word[b]))
        losses.append(loss)
    p = [math.exp(-model.scale * (x - min(losses))) for x in losses]
    order = sorted(range(len(p)), key=lambda k: (losses[k], k))
    return order[0], p[order[0]] / sum(p), (p[order[0]] - p[order[1]]) / sum(p)


@pytest.mark.parametrize("n", [2, 4, 9])
def test_decoding_against_a_loop_over_codewords(n):
    rng = np.random.default_rng(n)
    pools = [[chr(97 + int(c)) * 2 + chr(97 + int(d)) for c, d in rng.integers(0, 26, (6, 2))] for _ in range(n)]
    texts = [" ".join(rng.choice(pools[k % n], 12)) for k in range(40 * n)]
    x = np.stack([language_id.features(t) for t in texts])
    model = language_id.fit(x, [f"l{k % n}" for k in range(len(texts))])
    mixed = [" ".join([*rng.choice(pools[0], 3), *rng.choice(pools[1], 3)]) for _ in range(6)]
    rows = np.stack([language_id.features(t) for t in [*texts[: 3 * n], *mixed, "", "zz"]])
    best, p, lead = model.decode(rows)
    for k, row in enumerate(rows):
        want = plain_decode(model, row)
        assert best[k] == want[0] or lead[k] < 1e-9
        assert (p[k], lead[k]) == pytest.approx(want[1:], abs=1e-5)


def test_equal_codewords_losses_go_to_the_first():
    model = language_id.Model(["a", "b"], np.array([[1.0], [1.0]]), np.zeros((4, 1), np.float32), np.zeros(1), np.ones(1), 6.0, 4)
    best, p, lead = model.decode(np.zeros((3, 4), np.float32))
    assert best.tolist() == [0, 0, 0] and p == pytest.approx(0.5) and lead == pytest.approx(0)


def plain_window(net, x, numbers):
    """One window through the network, unit by unit."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    s = lambda v: 1 / (1 + math.exp(-v))

    def run(order, way):
        state, out = [0.0] * h, {}
        for t in order:
            if numbers[t] > 0:
                a = [sum(x[numbers[t]][i] * p["x" + way][i][j] for i in range(len(x[0]))) + p["b" + way][j] for j in range(3 * h)]
                b = [sum(state[i] * p["u" + way][i][j] for i in range(h)) for j in range(3 * h)]
                r, z = [s(a[j] + b[j]) for j in range(h)], [s(a[h + j] + b[h + j]) for j in range(h)]
                new = [math.tanh(a[2 * h + j] + r[j] * b[2 * h + j]) for j in range(h)]
                state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            out[t] = state
        return out

    n = toxicity.WINDOW
    f, b = run(range(n), "f"), run(range(n - 1, -1, -1), "b")
    live = [t for t in range(n) if numbers[t] > 0]
    hs = {t: [*f[t], *b[t]] for t in live}
    u = {t: sum(math.tanh(sum(hs[t][i] * p["wa"][i][k] for i in range(2 * h)) + p["ba"][k]) * p["va"][k] for k in range(toxicity.ATTENTION)) for t in live}
    e = {t: math.exp(u[t] - max(u.values())) for t in live}
    c = [sum(e[t] * hs[t][i] for t in live) / sum(e.values()) for i in range(2 * h)]
    return sum(c[i] * p["wo"][i] for i in range(2 * h)) + p["bo"][0]


def small_net(seed=5):
    """A network with weights large enough to matter, and some windows of different lengths."""
    net, words = toxicity.Net(seed), toxicity.Words()
    rng = np.random.default_rng(seed)
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in net.p.items()}
    texts = [b"some words, here and there", b"one", b"a longer text of so many words that it takes more than one window " * 4]
    table, owner = toxicity.window_table([words.numbers(t) for t in texts])
    return net, words.features(), table, owner


def test_forward_pass_against_loops():
    net, features, table, owner = small_net()
    x = net.inputs(features)
    got = net.logits(x, table)
    assert len(table) > 3 and set(owner.tolist()) == {0, 1, 2}
    for k, row in enumerate(table.tolist()):
        assert got[k] == pytest.approx(plain_window(net, x.astype(float), row), abs=1e-4)


def test_gradient_against_differences():
    """The step's gradient, as its Adam moments hold it after one step, against central differences of the loss."""
    net, features, table, _ = small_net()
    table, y = table[:4], np.array([1, 0, 1, 0], np.float32)
    used = np.unique(table)

    def loss():
        z = net.logits(net.inputs(features), table).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    before = {k: v.copy() for k, v in net.p.items()}
    adam = {"t": 0}
    net.step(features, table, y, adam, 0.0)
    rng = np.random.default_rng(1)
    assert used[-1] > 0
    for name in ("xf", "ub", "bf", "wa", "ba", "va", "wo", "bo", "word", "char"):
        grad = adam[name][0] / 0.1
        flat = np.flatnonzero(np.abs(grad.ravel()) > 2e-3)
        for at in rng.permutation(flat)[:4]:
            where, wide = np.unravel_index(at, grad.shape), 5e-3
            sides = []
            for sign in (1, -1):
                net.p = {k: v.copy() for k, v in before.items()}
                net.p[name][where] += sign * wide
                sides.append(loss())
            assert grad[where] == pytest.approx((sides[0] - sides[1]) / (2 * wide), rel=0.08, abs=4e-4)
        net.p = {k: v.copy() for k, v in before.items()}


def test_odd_rows(spark):
    """Rows without an id, repeated rows, a text over a slice, labelled texts that are all very long, clashing columns."""
    long_text = "ein langer text der viele worte hat und und " * 60_000
    rows = [(i, ("the thing is in" if i % 2 else "der ding ist und") + f" w{i}", "ab"[i % 2], 1) for i in range(40)]
    rows += [(None, "the thing is in", "b", 1), (5, rows[5][1], "b", 1), (5, rows[5][1], "b", 1), (50, long_text, "a", 1), (51, "", "a", 1), (52, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "1 AS held_out", "'x' AS lang_pred", "2 AS _id", "3 AS toxic")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 5 for r in got) == 3 and len({(r["lang_pred"], round(r["score"], 6), r["ambiguous"]) for r in got if r["doc_id"] == 5}) == 1
    by = {r["doc_id"]: r for r in got}
    assert by[50]["lang_pred"] == "a" and by[None]["held_out"] is None and by[51]["lang_pred"] == by[52]["lang_pred"] == "und"
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(40)] + [(5, 1, 9), (None, 1, 9)], "doc_id long, toxic int, text int")
    scored = toxicity.assess(df, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored) and len({round(r["score"], 5) for r in scored if r["doc_id"] == 5}) == 1
    net = toxicity.train(df, labels, max_chars=10)
    assert net is not None


def test_repeated_rows_do_not_grow_the_sample(spark):
    """Of rows that share a doc_id the network is fitted on one, the smallest text, however many there are."""
    rows = [(i, ("nice words here" if i % 2 else "vile words here") + f" w{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(30)], "doc_id long, toxic int")
    kinds = "doc_id long, text string"
    once = toxicity.train(spark.createDataFrame(rows, kinds), labels)
    again = toxicity.train(spark.createDataFrame(rows + [(3, rows[3][1])] * 50 + [(3, "zz other words")] * 50, kinds), labels)
    assert all(np.array_equal(once.p[k], again.p[k]) for k in once.p) and (once.scale, once.shift) == (again.scale, again.shift)


def many_texts(rng, n, letters):
    return [" ".join("".join(rng.choice(letters, 4)) for _ in range(12)) for _ in range(n)]


@pytest.mark.parametrize("doc_id,alike", [(7, False), (30, False), (7, True), (30, True)])
def test_language_training_with_one_repeated_doc_id(spark, doc_id, alike):
    """However many rows share a doc_id, the sample keeps its bound and every language is learned."""
    rng = np.random.default_rng(4)
    one, other = many_texts(rng, 1 if alike else 3000, list("abcdef")), many_texts(rng, 60, list("uvwxyz"))
    rows = [(doc_id, one[k % len(one)], "aa") for k in range(3000)] + [(100 + k, t, "bb") for k, t in enumerate(other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    keyed = df.withColumn("key", F.xxhash64(F.lit("fit"), "doc_id", "text"))
    counts = {r["lang"]: r["n"] for r in language_id.chosen(keyed, 80).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert counts == {"aa": 1 if alike else 40, "bb": 40}
    model = language_id.train(df, max_rows=80)
    assert model.languages == ["aa", "bb"]
    probe = spark.createDataFrame([(1, " ".join(one[:3])), (None, " ".join(other[:3])), (1, None)], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(probe, model).collect()] == ["aa", "bb", "und"]


def test_more_languages_than_rows(spark):
    rows = [(100 + k, "xy " * (k + 1), f"l{k}") for k in range(30)] + [(200 + k, f"zz {'abcdefghij'[k]}", "l3") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.xxhash64(F.lit("fit"), "doc_id", "text"))
    got = [r["lang"] for r in language_id.chosen(df, 10).collect()]
    assert len(got) == len(set(got)) == 10 and "l3" in got


def plain_train(docs):
    """The model that all labelled rows of different texts give when they are fewer than the bound."""
    rows = sorted({(lang, language_id.features(t).astype(np.float16).tobytes()) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 5})
    return language_id.fit(np.stack([np.frombuffer(x, np.float16).astype(np.float32) for _, x in rows]), [k for k, _ in rows])


def test_language_training_against_a_plain_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(k, t, ("aa", "bb", "cc")[k % 3]) for k, t in enumerate(t for x in zip(*(many_texts(rng, 30, list(c)) for c in ("abcde", "fghij", "klmno")), strict=True) for t in x)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    want = plain_train(rows)
    assert model.languages == want.languages and np.allclose(model.weights, want.weights, atol=1e-5) and np.allclose(model.trust, want.trust)

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import bpe, language_id, mixing, pii, records, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Don't stop... it's 3.5% of e.g. this, ok. end."), (5, "ÀÉÎ ß ñandú ª º µ ½ x\xa0y\x85z"), (6, "日本語 тест 𝄞 café ΑΣ"), (7, "a" * 3000), (8, "lorem ipsum, dolor. " * 4000), (9, "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>"), (10, "..., a., b.. c,\nd.\n.e")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "?", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")


def test_bpe_equals_library(spark, library):
    df = docs(spark, ODD)
    got = {r["doc_id"]: r for r in bpe.digest(df).collect()}
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, reuse_chunks=False)).collect()}
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and texts[i] == text
    assert bpe.digest(docs(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAZ'sSt.,;!<|>09 \n\t\x0b\x1c\x85\xa0éÉßª½²ñ日́Σ"), max_size=40), min_size=1, max_size=4))
def test_words_and_chunks_equal_library(texts):
    e = bpe.encoder(bpe.default_path())
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    data = [t.encode() for t in texts]
    assert e.by_words(data) == want and e.by_chunks(data) == want


def test_chunks_are_content_defined():
    rng = np.random.default_rng(0)
    shared = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = bpe.chunked(b"one " + shared), bpe.chunked(b"quite another start " + shared)
    assert b"".join(a) == b"one " + shared and len(set(a) & set(b)) > 0.8 * len(a)
    assert b"".join(bpe.chunked("é日".encode() * 5000)) == "é日".encode() * 5000


def test_records_round_trip(spark, library):
    more = [(10, "twice"), (-5, "first"), (12, "very long text, " * 200_000), (None, "no id")]
    df = docs(spark, ODD + more).repartition(3)
    manifest = records.write(df)
    got = records.read(manifest).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(ODD + more, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    first = manifest.filter("n_docs > 1").orderBy("part").first()
    assert records.read_one(first["folder"], first["part"], 0)[0] == records.NO_ID
    doc_id, ids = records.read_one(first["folder"], first["part"], 1)
    assert doc_id == -5 and ids.tolist() == [*library.encode("first", add_special_tokens=False).ids, 1]
    assert records.read(records.write(docs(spark, []))).count() == 0


def test_damage_is_noticed():
    data = bytearray(records.frame(7, np.array([1, 2, 70_000])))
    assert records.unframe(bytes(data), 0)[1].tolist() == [1, 2, 70_000]
    for at in (2, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


def simple_spans(text):
    """The base kinds by plain patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a@.-+% 0123456789()é"), max_size=60))
def test_base_spans(text):
    assert [s[:3] for s in pii.spans(text) if pii.KINDS.index(s[0]) < pii.BASE] == simple_spans(text)


def test_pii_examples(spark):
    text = "mail a.b@x.org, 4111 1111 1111 1111 or 10.0.0.255; call +1 (555) 010-9999. IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789 but 987-65-4321"
    assert [s[0] for s in pii.spans("a token = " + "0f" * 20)] == ["secret"] and not pii.spans("0f" * 20) and not pii.spans("token " + "0f" * 15)
    found = {s[0]: text[s[1] : s[2]] for s in pii.spans(text)}
    assert set(found) == {"email", "card", "ip", "phone", "iban", "ssn"} and found["iban"].startswith("DE89")
    assert not pii.spans("number 123-45-6789 and DE88 3704 0044 0532 0130 00")
    for hard in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " * 60_000, "AA11" * 50_000, "0f" * 100_000):
        pii.spans(hard)
    rows = pii.digest(pii.find(docs(spark, [(1, text), (2, None), (3, "")]))).orderBy("doc_id").collect()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in simple_spans(text))
    assert rows[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[0]["n_card"] == 1 and rows[1]["spans"] == rows[2]["spans"] == ""


def test_language(spark):
    rng = np.random.default_rng(0)
    pools = {"aa": "the and ing tion of".split(), "bb": "der ung sch ein über".split(), "cc": "que ción los ña el".split(), "dd": "zz xq kk".split()}
    rows = [(i, " ".join("".join(rng.choice(p, 3)) for _ in range(30)), g, "s", 0) for i, (g, p) in enumerate(list(pools.items()) * 40)]
    rows += [(900, None, "aa", "s", 0), (901, "12 !?", "bb", "s", 0), (902, "ingtionof", None, "s", 0), (903, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 903))
    held = [r for r in rows if r[0] < 900 and got[r[0]]["held_out"]]
    assert held and np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    kept = language_id.recognised(df, language_id.train(df), 0.4)
    assert kept.columns == df.columns and not {900, 901, 903} & {r["doc_id"] for r in kept.collect()}
    nothing = language_id.identify(df.withColumn("lang", df.lang.substr(1, 0)).filter("1 = 0"))
    assert nothing.count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def test_codewords_keep_apart():
    for n in (2, 3, 5, 12):
        c = language_id.codewords(n)
        assert len({tuple(r) for r in c}) == n
    assert language_id.codewords(4).shape == (4, 7)


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "b", "a", "é"][i % 4], 0) for i in range(200)] + [(500, None, "a", 0), (501, "", "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    got = mixing.mix(df, block_words=16).toPandas().fillna(-1)
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    src = {i: s for i, _, s, _ in rows}
    total = got["size"].sum()
    got["source"] = [src[i] if src[i] is not None else "~" for i in got.doc_id]
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), told=("source_size", "first"))
    assert (abs(by.target - by.taken) < 1.0 + 1e-9).all() and (by["size"] == by.told).all() and by.target.sum() == pytest.approx(total)
    again = mixing.mix(df.repartition(5), block_words=16).toPandas().fillna(-1)
    assert set(map(tuple, again.values)) == set(map(tuple, got[again.columns].values))
    assert mixing.mix(df.limit(0)).count() == 0
    assert ((got.first_slot >= 0) == (got.taken > 0)).all() and ((got.n_slots > 0) == (got.taken > 0)).all()
    # any stretch of the delivered mix has the sources in about their target shares
    order = [(r["source"] if r["source"] is not None else "~", len(r["text"].split())) for r in mixing.mixed_documents(df, block_words=16).collect()]
    words = np.cumsum([n for _, n in order])
    for share in (0.25, 0.5, 0.75):
        head = order[: int(np.searchsorted(words, share * words[-1]))]
        for s in ("a", "b", "é", "~"):
            assert abs(sum(n for k, n in head if k == s) / sum(n for _, n in head) - by.target[s] / by.target.sum()) < 0.06
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_targets_stop_at_three_times():
    target, whole = mixing.targets([10, 10, 1000], [1, 1, 1])
    assert target == [30.0, 30.0, 960.0] and whole == [30, 30, 960]
    assert mixing.targets([], []) == ([], []) and mixing.targets([0, 0], [1, 2])[1] == [0, 0]


def test_schedule_follows_the_weights(spark):
    slots = mixing.schedule(spark, [600, 300, 100]).toPandas()
    assert sorted(slots.groupby("source_no")["rank"].agg(["min", "max", "count"]).values.tolist()) == [[0, 99, 100], [0, 299, 300], [0, 599, 600]]
    head = slots[slots.slot < 100].groupby("source_no").size()
    assert abs(head[0] - 60) <= 3 and abs(head[1] - 30) <= 3


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}" for a in ("ba", "lo", "ti", "mu", "re", "sa", "no") for b in ("dal", "rin", "tos", "mek", "vul", "pan")]
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(clean, int(rng.integers(20, 120))))
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, len(words), 4):
                words[k] = f"grob{rng.choice(['an', 'ek', 'ol', 'iz'])}"
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic), 0))
    rows += [(900, None, 1), (901, "", 1), (902, "x" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(5000, 1, 0), (901, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.assess(df, lab).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got.loc[900, "score"] == got.loc[901, "score"] == got.score.min()
    held = got[got.held_out & (got.index < 500)]
    y = held.index.to_numpy() % 4 == 0
    assert held.predicted[y].mean() > 0.9 and held.predicted[~y].mean() < 0.1
    none = toxicity.assess(df, lab.limit(0)).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 0).all()


def test_gradient():
    net = toxicity.Net(1)
    words = toxicity.Words()
    table, _ = toxicity.window_table([words.numbers(b"some words here and there are enough of them")])
    f, y = words.features(), np.ones(1, np.float32)
    loss = lambda: float(-np.log(toxicity.sigmoid(net.logits(net.inputs(f), table)[0])))
    before, adam = loss(), {"t": 0}
    for _ in range(5):
        net.step(f, table, y, adam, 0.01)
    assert loss() < before


def test_windows_cover_every_word():
    for n in (0, 1, 16, 17, 31, 32, 33, 100, 1000):
        seen = np.zeros(n, int)
        for s in toxicity.windows(n):
            seen[s : s + toxicity.WINDOW] += 1
        assert (seen > 0).all() and (n <= 32 or (seen[16 : n - 16] >= 1).all())

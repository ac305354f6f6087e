"""Base counts against a loop, estimates against a plain minimum covariance determinant."""

from collections import Counter

import numpy as np
import pytest

from panelspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, grp string, distance string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain_counts(text):
    text = text or ""
    words = text.encode().split()
    at = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if at[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    out = [(i, text(int(rng.integers(60, 300))), ("en", "de")[i % 2], ("s1", None)[i % 4 // 2]) for i in range(600)]
    out += [(700 + i, text(80) + " #$%" * 30, "en", "s1") for i in range(25)]
    out += [(800, None, "en", "s1"), (801, "", None, None), (802, " \n\t", "en", "s1"), (803, "a b c " * 30, "en", "s1"), (804, "x\ny\nx\n\nx \n" + text(60), "de", None), (805, text(55).replace(" ", "  é𝄞 "), "en", "s1")]
    out += [(806, text(70), "zz", "rare"), (807, text(70) + " #|<>" * 60, "zz", "rare"), (5, text(90), "en", "s1"), (None, text(90), "en", "s1"), (None, text(90), "en", "s1")]
    return out


def plain_estimate(x, counts):
    """The minimum covariance determinant from many random starts, with the operator's factors and floors."""
    floors = np.diag([(quality.UNIT * f) ** 2 for f in quality.FLOORS.values()])
    inverse = lambda c: np.linalg.inv(c)
    h = int(np.ceil(quality.SHARE * len(x)))
    best = None
    for seed in range(60):
        part = x[np.random.default_rng(seed).choice(len(x), 10, replace=False)]
        for _ in range(40):
            mean, cov = part.mean(0), quality.consistency(quality.SHARE) * np.cov(part.T, bias=True) + floors
            part = x[np.argsort(np.einsum("ij,jk,ik->i", x - mean, inverse(cov), x - mean), kind="stable")[:h]]
        mean, cov = part.mean(0), quality.consistency(quality.SHARE) * np.cov(part.T, bias=True) + floors
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mean, cov
    near = x[np.einsum("ij,jk,ik->i", x - best[1], inverse(best[2]), x - best[1]) <= quality.chi2_quantile(quality.REWEIGHT, quality.D)]
    return near.mean(0), quality.consistency(quality.REWEIGHT) * np.cov(near.T, bias=True) + floors


def test_against_plain_versions(spark, rows):
    df = docs(spark, rows)
    got = quality.assess(df).collect()
    assert len(got) == len(rows)
    counts = [tuple(r)[1:7] for r in got]
    assert Counter((r["doc_id"], *c) for r, c in zip(got, counts, strict=True)) == Counter((r[0], *plain_counts(r[1])) for r in rows)
    vectors = quality.vectors_of(quality.statistics(df)).toPandas()
    by_id = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in got}
    fit = vectors[~vectors.base_failed]
    columns = [f"v{i}" for i in range(quality.D)]
    far = 0
    for grp, part in [*fit.groupby("grp"), ("*", fit)]:
        if len(part) < quality.LEAST_ROWS:
            continue
        mean, cov = plain_estimate(part[columns].to_numpy(float), None)
        judged = part if grp != "*" else fit[fit.lang == "zz"]
        x = judged[columns].to_numpy(float) - mean
        d = np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x)
        for one, want in zip(judged.itertuples(), d, strict=True):
            r = by_id[None if np.isnan(one.doc_id) else one.doc_id, one.n_words, one.word_chars]
            assert r["distance"] == pytest.approx(want, rel=0.15, abs=0.3)  # subsets are whole buckets here, exact shares there
            assert r["kept"] == (r["distance"] <= quality.chi2_quantile(quality.CUTOFF, quality.D))
            far += not r["kept"]
    assert far == 26  # the planted ones
    assert all(r["kept"] for r in got if not r["base_failed"] and r["n_symbols"] == 0)


def test_rows_do_not_depend_on_order(spark, rows):
    one = sorted(map(tuple, quality.assess(docs(spark, rows).repartition(1)).collect()), key=str)
    two = sorted(map(tuple, quality.assess(docs(spark, rows[::-1]).repartition(7)).collect()), key=str)
    assert one == two


def test_small_and_empty_tables(spark):
    assert quality.assess(docs(spark, [])).count() == 0
    few = quality.assess(docs(spark, [(1, None, None, None), (2, "one " * 60, "en", "s"), (3, " ".join(f"w{i}" for i in range(60)), "en", "s")])).collect()
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in few} == {1: (True, False), 2: (True, False), 3: (False, True)}


def test_a_text_beyond_a_slice(spark):
    long = " ".join(f"w{i}" for i in range(300_000)) + "\nw1 w2 w3"
    got = quality.assess(docs(spark, [(1, long, "en", "s"), (2, "# " * 1_200_000, "en", "s")])).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got] == [plain_counts(long), plain_counts("# " * 1_200_000)]


def test_chi_square():
    assert quality.chi2_quantile(0.975, 4) == pytest.approx(11.1433, abs=1e-4) and quality.chi2_cdf(7.7794, 4) == pytest.approx(0.9, abs=1e-5)

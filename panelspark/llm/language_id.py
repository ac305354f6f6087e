"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary classifier over hashed character n-grams predicts each bit. A text
goes to the language whose codeword has the smallest loss under the predicted margins, each bit weighted by how well
its classifier separates the training rows; a text whose best two codewords lie close together is flagged ambiguous.
The model is fitted in numpy, in one task, on a bounded sample of labelled rows; the driver gets the fitted weights
only. Every text is then scored whole, in its own task.
"""

from __future__ import annotations

import itertools
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_batches, crc_bucket, map_texts, slices, written

#: Character n-grams of 1 to 3 letters fall into so many buckets.
BUCKETS = 4096
#: Bound on the labelled rows that the model is fitted on, over all languages.
MAX_TRAIN_ROWS = 3200
#: The best codeword's probability less the second's; below this a text is ambiguous.
AMBIGUOUS = 0.2
RIDGE = 0.05
LETTER = re.compile(r"[^\W\d_]")

#: Multipliers that spread n-grams over buckets (fixed values).
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vector of the square roots of the counts of letter n-grams; anything but letters counts as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = (codes >= 97) & (codes <= 122) | (codes > 127)
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[np.append(True, letter[1:] | letter[:-1])] if len(codes) else codes
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    with np.errstate(over="ignore"):
        h = (codes + np.uint32(1)) * MIX[0]
        grams = [h]
        for n in (1, 2):
            if len(codes) > n:
                h = (h[:-1] ^ (codes[n:] + np.uint32(n))) * MIX[n]
                grams.append(h)
        spread = np.concatenate([(g ^ (g >> np.uint32(15))) * MIX[0] for g in grams])
    x = np.sqrt(np.bincount(spread >> shift, minlength=buckets)).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: every way to split the languages in two for up to 6, else the best of 64 draws of
    random codes; no column is constant or repeats another or its complement."""
    if n <= 6:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns).T if columns else np.ones((n, 1))
    best, widest = None, -1
    length = 4 * int(np.ceil(np.log2(n))) + 8
    for seed in range(64):
        code = np.random.default_rng(seed).choice((-1, 1), size=(n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * 10**6
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    scale: float
    buckets: int

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the language's number, its probability, the lead over the second."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -2 * margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-self.scale * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        top = np.take_along_axis(p, order[:, :2], 1)
        return order[:, 0], top[:, 0], top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Ridge regression on each bit, solved among the training rows; a bit is trusted by its margins on the other half."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    code = codewords(len(languages)).astype(np.float64)
    share = np.bincount(y, minlength=len(languages))[y]
    weight = np.sqrt(len(y) / (len(languages) * share))[:, None]

    def solve(rows):
        w = weight[rows].astype(np.float32)
        a = x[rows] * w
        k = (a @ a.T + w * w.T).astype(np.float64)
        k[np.diag_indices_from(k)] += RIDGE
        del a  # as large as x: made again rather than held while the system is solved
        dual = np.linalg.solve(k, code[y[rows]] * weight[rows])
        return (x[rows] * w).T @ dual.astype(np.float32), (weight[rows].T @ dual)[0]

    half = np.arange(len(y)) % 2 == 0
    if len(y) >= 4 and len(languages) > 1:
        beta, bias = solve(np.flatnonzero(half))
        held = (x[~half] @ beta + bias) * code[y[~half]]
        trust = np.clip(1 - np.logaddexp(0, -2 * held).mean(0) / np.log(2), 0.05, 1)
    else:
        trust = np.ones(code.shape[1])
    beta, bias = solve(np.arange(len(y)))
    return Model(languages, code, beta, bias, trust / trust.sum(), 6.0, x.shape[1])


def chosen(labelled: DataFrame, max_rows: int) -> DataFrame:
    """lang and key (a hash of doc_id and text) of the rows to learn from: of each language's different keys the smallest,
    max_rows over all languages and equally many of each, but one at least. With more than max_rows languages, only the
    max_rows with the most keys are learned."""
    keys = written(labelled.select("lang", "key").distinct(), "fit-keys")
    sizes = keys.groupBy("lang").agg(F.count("*").alias("n"), F.min("key").alias("first")).orderBy(F.desc("n"), "lang").limit(max_rows)
    sizes = written(sizes, "fit-languages")
    each, parts = max(1, max_rows // max(1, sizes.count())), 1 << 20
    # about twice as many as are wanted come to the ranking, so it holds a bounded number of rows of a language
    near = (F.pmod(F.col("key"), F.lit(parts)) < F.ceil(2.0 * each * parts / F.col("n"))) | (F.col("key") == F.col("first"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.col("key") == F.col("first")), F.pmod(F.col("key"), F.lit(parts)), "key"))
    return written(keys.join(sizes, "lang").filter(near).withColumn("_rn", number).filter(F.col("_rn") <= each).select("lang", "key"), "fit-chosen")


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, folds: int = 5, held_fold: int = 0) -> Model | None:
    """Fit on labelled rows outside the held-out fold (a row without doc_id is in no fold): at most max_rows, equally many
    of each language, picked by a hash of doc_id and text, so that rows alike count once and rows of one doc_id are told
    apart. None if there are none."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held_fold))
    labelled = rows.select("lang", "text", F.xxhash64(F.lit("fit"), F.col("doc_id"), F.col("text")).alias("key"))
    picked = labelled.join(chosen(labelled, max_rows), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.any_value("text").alias("text"))

    def of(piece):
        lang, text = piece.column("lang").to_pylist(), piece.column("text").to_pylist()
        return {"lang": lang, "x": [features(t).astype(np.float16).tobytes() for t in text]}

    def learn(batches):
        rows = sorted((r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), key=lambda r: r)
        if rows:
            x = np.empty((len(rows), BUCKETS), np.float32)
            for i, (_, packed) in enumerate(rows):
                x[i] = np.frombuffer(packed, np.float16)
            lang = [k for k, _ in rows]
            del rows
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(x, lang))]})

    sample = map_texts(picked.select("lang", "text"), of, "lang string, x binary")
    fitted = sample.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def predict(docs: DataFrame, model: Model | None, threshold: float = AMBIGUOUS) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row. A text that is null or has no letter is `und` with score 0;
    so is every text where there was nothing to learn from. Every row is predicted from its own text, whether or not its
    doc_id repeats or is missing. Extra columns are ignored."""

    def of(piece):
        ids, text = piece.column("doc_id"), piece.column("text").to_pylist()
        lang, score, doubt = ["und"] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
        at = [i for i, t in enumerate(text) if t and LETTER.search(t)]
        if at and model is not None:
            best, p, lead = model.decode(np.stack([features(text[i], model.buckets) for i in at]))
            for k, i in enumerate(at):
                lang[i], score[i], doubt[i] = model.languages[best[k]], p[k], lead[k] < threshold
        return {"doc_id": ids, "lang_pred": lang, "score": score, "ambiguous": doubt}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs, with all their columns, that are not `und` nor ambiguous with a score under `least`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.schema
    if "text" not in docs.columns:
        raise ValueError("docs has no column text")

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                keep = [t is not None and LETTER.search(t) is not None for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
                piece = piece.filter(pa.array(keep))
                if model is not None and piece.num_rows:
                    text = piece.column(piece.schema.get_field_index("text")).to_pylist()
                    _, p, lead = model.decode(np.stack([features(t, model.buckets) for t in text]))
                    piece = piece.filter(pa.array((p >= least) | (lead >= AMBIGUOUS)))
                yield pa.RecordBatch.from_arrays(piece.columns, schema=to_arrow_schema(schema))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on docs' own labels outside fold 0 and predict every row: doc_id, held_out, lang_pred, score, ambiguous."""
    found = predict(docs, train(docs))
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")

"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

N-grams of one to three code points of the lower-cased text are hashed into
``BUCKETS`` buckets; a bucket weighs (1 + log count) * idf, and a text's vector
has length one.  The idf counts all documents that may be learned from.  The
weights are trained on the driver with follow-the-regularised-leader (one
learning rate per weight, elastic-net penalty: the L1 part leaves most weights
at zero) on at most ``PER_LANGUAGE`` documents of each language, drawn by hash
of the id; a fifth of them is kept aside and sets the softmax temperature.  Every
language is learned, however rare; beyond ``FULL_LANGUAGES`` of them each gives
fewer documents (at least ``LEAST_ROWS``), as a step costs in proportion to their
number.  Weights travel to the tasks as their nonzero entries.  Scoring runs in
Spark tasks over whole texts.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
a lang column of more than ``MAX_TAGS`` values holds no languages and is refused;
documents with null lang or null id teach nothing but are predicted; if no
language was learned every document is ``und``; one language only: its score is
1; repeated rows are scored one by one; an empty table gives an empty result;
other columns are ignored by :func:`predict` and kept by
:func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_chunks, is_text

BUCKETS = 1 << 14
FOLDS, HELD_OUT = 4, 2
#: At most so many documents of a language, on average, teach the weights.
PER_LANGUAGE = 500
#: With more languages each gives fewer documents, but at least so many.
FULL_LANGUAGES, LEAST_ROWS = 16, 20
#: A column with more values is not one of language tags.
MAX_TAGS = 10_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
#: The pipeline rejects documents whose language is less sure than this.
MIN_SCORE = 0.5


def has_letter(text) -> bool:
    return is_text(text) and any(map(str.isalpha, text))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets met and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ c[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    three = (two[:-1] ^ c[2:]) * np.uint64(0x94D049BB133111EB)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    count = np.bincount((np.concatenate([one, two, three]) >> shift).astype(np.int64), minlength=BUCKETS)
    met = np.flatnonzero(count)
    return met, count[met]


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias = languages, idf, weights, bias
        self.temperature = temperature

    def __getstate__(self) -> dict:
        at = np.flatnonzero(self.weights)
        return {**self.__dict__, "weights": (self.weights.shape, at, self.weights.reshape(-1)[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, value = state["weights"]
        self.__dict__.update(state, weights=np.zeros(shape, value.dtype))
        self.weights.reshape(-1)[at] = value

    def logits(self, met: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[met]
        norm = np.sqrt(x @ x)
        return (x / norm if norm else x) @ self.weights[met] + self.bias

    def predict(self, text) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngrams(text)) / self.temperature)
        i = int(np.argmax(p))
        return self.languages[i], float(min(1.0, p[i]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over the rows ``(language number, buckets, counts)``."""
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # last row: bias
    model = Model(languages, idf, np.zeros((BUCKETS, k)), np.zeros(k), 1.0)

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    def vector(met, count):
        x = (1 + np.log(count)) * idf[met]
        norm = np.sqrt(x @ x)
        return np.append(met, BUCKETS), np.append(x / norm if norm else x, 1.0)

    teach = [r for i, r in enumerate(rows) if i % 5 != 4 or len(rows) < 20]
    watch = [r for i, r in enumerate(rows) if i % 5 == 4] if len(rows) >= 20 else []
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(teach)):
            label, met, count = teach[i]
            at, x = vector(met, count)
            w = weights(at)
            slope = softmax(x @ w)
            slope[label] -= 1
            g = x[:, None] * slope[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:-1], w[-1]
    if watch:
        logits = np.array([model.logits(m, c) for _, m, c in watch])
        label = np.array([r[0] for r in watch])

        def loss(t):
            p = softmax(logits / t)[np.arange(len(label)), label]
            return -np.log(np.maximum(p, 1e-12)).mean()

        model.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(5), 93)), key=loss))
    return model


def learnable(docs: DataFrame, text: str, key: str, lang: str) -> DataFrame:
    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
            .filter(F.col("__text").isNotNull() & F.col("__lang").isNotNull() & (fold("__key", FOLDS) != HELD_OUT)))


def train(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    own = learnable(docs, text, key, lang)
    counts = own.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_TAGS + 1).collect()
    if len(counts) > MAX_TAGS:
        raise ValueError(f"{lang} has more than {MAX_TAGS} values: it does not hold language tags")
    languages = sorted(r["__lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    if len(languages) > FULL_LANGUAGES:
        per_language = min(per_language, max(LEAST_ROWS, per_language * FULL_LANGUAGES // len(languages)))
    # a language with n documents gives each with probability per_language / n
    share = {r["__lang"]: min(1.0, per_language / r["n"]) for r in counts}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, df = 0, np.zeros(BUCKETS, np.int64)
        for part in in_chunks(frames, "__text"):
            rows = []
            for key_, text_, lang_, draw in zip(part["__key"], part["__text"], part["__lang"], part["__draw"]):
                if not has_letter(text_):
                    continue
                met, count = ngrams(text_)
                df[met] += 1
                seen += 1
                if draw < share.get(lang_, 0.0):
                    rows.append((lang_, str(key_), met.astype("<u2").tobytes(), np.minimum(count, 65535).astype("<u2").tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "key", "met", "count"]).assign(bucket=-1, df=0)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"lang": None, "key": None, "met": None, "count": None,
                            "bucket": np.append(at, BUCKETS), "df": np.append(df[at], seen)})

    draw = F.pmod(F.xxhash64("__key", "__lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = own.withColumn("__draw", draw).mapInPandas(
        run, "lang string, key string, met binary, count binary, bucket long, df long")
    from .common import cut

    got = cut(got)
    df = np.zeros(BUCKETS + 1)
    for r in got.filter("bucket >= 0").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # at most BUCKETS + 1
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    number = {x: i for i, x in enumerate(languages)}
    # repeated ids of one language share one draw: at most 2 * per_language of each
    w = got.filter("bucket < 0").orderBy(F.xxhash64("key", "met"), "lang").limit(2 * per_language * len(languages))
    rows = [(number[r["lang"]], np.frombuffer(r["met"], "<u2").astype(np.int64), np.frombuffer(r["count"], "<u2").astype(float))
            for r in w.select("lang", "met", "count").collect()]
    return fit(rows, languages, idf)


def _scores(model: Model, text: str, kept: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, text):
            got = [model.predict(t) for t in part[text]]
            yield part[kept].assign(__lang=[g[0] for g in got], __score=[g[1] for g in got])

    return run


def predict(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, lang_pred, score`` of every document."""
    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(
        _scores(model, "__text", ["__key"]), f"__key {kind}, __lang string, __score double")
    return got.select(F.col("__key").alias(key),
                      F.coalesce(fold("__key", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                      F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def filter_documents(docs: DataFrame, model: Model, *, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Documents in a learned language that is at least ``min_score`` sure, with
    exactly their own columns."""
    kept = list(docs.columns)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["__lang string, __score double"])
    got = docs.mapInPandas(_scores(model, text, kept), ddl)
    return got.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score)).select(docs.columns)

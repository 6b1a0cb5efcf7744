"""Language of texts by a byte convolutional network in numpy (operator 9).

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's greatest response
goes to a softmax over the languages. A text is the whole of its windows: their probabilities are averaged by length.
The network is trained on the driver on a bounded sample: at most `per_language` documents of each language, chosen by
a hash of the id, and at most `windows_each` windows of each. Everything else works on all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
PAD = 256
WIDTHS = (2, 3, 4)
WIDEST = max(WIDTHS)
#: Texts whose windows are in memory at once.
AT_ONCE = 128


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # 257, e
    filters: np.ndarray  # WIDEST * e, f; narrower filters have zeros beyond their width
    bias: np.ndarray  # f
    out: np.ndarray  # f, languages
    out_bias: np.ndarray
    window: int

    def features(self, x: np.ndarray, where: bool = False):
        """Greatest response of each filter in each window, and where it is."""
        n, e = len(x), self.embedding.shape[1]
        flat = self.embedding[x].reshape(n, -1)
        seen = np.lib.stride_tricks.as_strided(flat, (n, x.shape[1] - WIDEST + 1, WIDEST * e), (flat.strides[0], e * flat.itemsize, flat.itemsize))
        response = np.ascontiguousarray(seen).reshape(-1, WIDEST * e) @ self.filters
        response = response.reshape(n, -1, self.filters.shape[1])
        if not where:
            return np.maximum(response.max(axis=1) + self.bias, 0)
        at = response.argmax(axis=1)
        return np.maximum(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + self.bias, 0), at, seen

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), 64):
            z = self.features(x[i : i + 64]) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + 64] = z / z.sum(axis=1, keepdims=True)
        return out


def windows(text: bytes, window: int) -> np.ndarray:
    """All of the text in rows of `window` bytes, the last one padded."""
    n = max(1, -(-len(text) // window))
    out = np.full(n * window, PAD, dtype=np.uint16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, window)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], embed: int = 8, per_width: int = 16, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross entropy. x: windows of bytes; y: index of the language."""
    rng, f = np.random.default_rng(seed), per_width * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(WIDEST * embed) < w * embed, per_width).reshape(-1, per_width) for w in WIDTHS], axis=1)
    parameters = [
        rng.normal(0, 0.5, (257, embed)).astype(np.float32),
        (rng.normal(0, 0.3, (WIDEST * embed, f)) * mask).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.2, (f, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    ]
    parameters[0][PAD] = 0
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    model = Model(languages, *parameters, window=x.shape[1])
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            rows, goal = x[order[i : i + 64]], y[order[i : i + 64]]
            n = len(rows)
            h, at, seen = model.features(rows, where=True)
            z = h @ model.out + model.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(n), goal] -= 1
            d /= n
            dh = (d @ model.out.T) * (h > 0)
            taken = seen[np.arange(n)[:, None], at]  # n, f, WIDEST * e
            d_filters = np.einsum("nf,nfk->kf", dh, taken) * mask
            d_taken = dh[:, :, None] * model.filters.T[None]
            places = at[:, :, None] + np.arange(WIDEST)
            d_embedding = np.zeros_like(model.embedding)
            np.add.at(d_embedding, rows[np.arange(n)[:, None, None], places], d_taken.reshape(n, f, WIDEST, -1))
            d_embedding[PAD] = 0
            step += 1
            for k, g in enumerate([d_embedding, d_filters, dh.sum(0), h.T @ d, d.sum(0)]):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                parameters[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def sample(docs: DataFrame, window: int, per_language: int, windows_each: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and languages of a bounded sample of labelled documents; docs: doc_id, text, lang without nulls."""
    total = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(total)
    if not languages:
        return np.zeros((0, window), np.int64), np.zeros(0, np.int64), []
    per_language = max(20, min(per_language, 40_000 // len(languages)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_language / total[k] + 10 / total[k])))])
    order = F.pmod(F.xxhash64("doc_id", F.lit("lang sample")), F.lit(1 << 40))
    chosen = docs.select("lang", "text", order.alias("o")).filter(F.col("o") < share[F.col("lang")] * float(1 << 40))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text, o in zip(batch["lang"], batch["text"], batch["o"], strict=True):
                w = windows(text.encode(), window)
                for k in sorted({(int(o) * (j + 1)) % len(w) for j in range(windows_each)}):
                    rows.append((lang, int(o), w[k].astype("<u2").tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "o", "w"])

    got = chosen.mapInPandas(cut, "lang string, o long, w binary").toPandas().sort_values(["lang", "o", "w"])
    kept = got[got.groupby("lang")["o"].rank(method="dense") <= per_language]
    index = {k: i for i, k in enumerate(languages)}
    x = np.frombuffer(b"".join(kept["w"]), "<u2").reshape(-1, window)
    return x, kept["lang"].map(index).to_numpy(np.int64), languages


def fit(docs: DataFrame, window: int = 256, per_language: int = 400, windows_each: int = 3) -> Model | None:
    """A model of the labelled documents (doc_id, text, lang; null labels or texts are left out); None if there are none."""
    x, y, languages = sample(docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null"), window, per_language, windows_each)
    return train(x, y, languages) if languages else None


def score(texts: list[str | None], model: Model | None) -> list[tuple[str, float]]:
    """(language, its probability) of each whole text; `und`, 0 for null, for texts without a letter, and without a model.

    Of equally probable languages the first in order of their names. Windows of some texts are held at a time.
    """
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    where = [i for i, t in enumerate(texts) if model and isinstance(t, str) and any(map(str.isalpha, t))]
    for first in range(0, len(where), AT_ONCE):
        some = where[first : first + AT_ONCE]
        encoded = [texts[i].encode() for i in some]
        parts = [windows(b, model.window) for b in encoded]
        p = model.probabilities(np.concatenate(parts))
        at = 0
        for i, b, w in zip(some, encoded, parts, strict=True):
            size = np.full(len(w), model.window, np.float32)
            size[-1] = len(b) - model.window * (len(w) - 1)
            mean = (p[at : at + len(w)] * size[:, None]).sum(0) / size.sum()
            k = int(mean.argmax())
            out[i], at = (model.languages[k], float(min(1.0, mean[k]))), at + len(w)
    return out


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang: str = "lang_pred", probability: str = "score") -> DataFrame:
    """docs with two more columns: a language and its probability.

    A null text, or one without letters, is `und` with probability 0; every row stays, repeated ones too; of equally
    probable languages the first in the model's order counts; a text of any length is read whole, window by window; an
    empty table stays empty; columns of these names are replaced, all others stay.
    """
    kept = docs.drop(lang, probability)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang, T.StringType()), T.StructField(probability, T.DoubleType())])
    text = kept.columns.index(text_col)

    def add(batches) -> Iterator:
        import pyarrow as pa

        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            got = score(batch.column(text).to_pylist(), model)
            extra = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, lang, probability])

    return kept.mapInArrow(add, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    out = common.held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.filter(~out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")

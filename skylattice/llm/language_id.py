"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3) of the lower-cased text,
weighted by TF-IDF and scaled to unit length.  Document frequencies count
every row that may be learned from.  The model is trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on at
most ``sample`` rows a language, and a temperature fitted on rows kept out of
training calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.text import bound_batches, trim
from skylattice.storage import materialize

#: Hash buckets of n-grams.
FEATURES = 1 << 14
ORDERS = (1, 2, 3)
#: Code points counted at once; a longer text is counted in overlapping pieces.
_PIECE = 1 << 18
_U = np.uint32


def counts(text: str) -> np.ndarray:
    """n-gram counts of a whole text, by hash bucket."""
    out = np.zeros(FEATURES, np.int64)
    lowered = " " + text.lower() + " "
    longest = max(ORDERS)
    for at in range(0, len(lowered), _PIECE):
        piece = lowered[at : at + _PIECE + longest - 1]
        code = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        gram = np.zeros(len(code), _U)
        for n in range(1, longest + 1):
            m = min(len(code) - n + 1, _PIECE)
            if m <= 0:
                break
            gram = gram[: len(code) - n + 1] * _U(0x01000193) + (code[n - 1 :] + _U(n)) * _U(0x9E3779B1)
            if n in ORDERS:
                g = gram[:m]
                out += np.bincount(((g ^ (g >> _U(15))) * _U(0x85EBCA6B)) >> _U(18), minlength=FEATURES)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Weights, inverse document frequencies and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def vector(self, count: np.ndarray) -> np.ndarray:
        x = count * self.idf
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; ``und`` and 0 without a letter."""
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0
        z = (self.vector(counts(text)) @ self.weights + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, alpha=1.0, beta=1.0, l1=1e-3, l2=1e-4, epochs=4, batch=16, seed=7
) -> np.ndarray:
    """FTRL-proximal for softmax regression over sparse rows (index, value, class), in mini-batches; the last weight is the bias.

    A step takes the gradient summed over ``batch`` rows, and moves only the
    features that occur in them.
    """
    z = np.zeros((features + 1, classes))
    n = np.zeros((features + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(i) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[r] for r in order[at : at + batch]]
            index, place = np.unique(np.concatenate([r[0] for r in some] + [[features]]), return_inverse=True)
            x = np.zeros((len(some), len(index)))
            x[:, -1] = 1.0  # the bias is the last feature
            owner = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
            x[owner, place[:-1]] = np.concatenate([r[1] for r in some])
            w = weights(index)
            s = x @ w
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), [r[2] for r in some]] -= 1.0
            g = x.T @ p
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(slice(None))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    lo, hi, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = 1500) -> Model:
    """Fit on the rows where ``learn`` holds and lang and text are not null.

    ``sample`` bounds the texts of a language that reach the driver (as sparse
    counts); the distinct texts with the smallest hashes are used.  Document
    frequencies come from all rows.
    """
    bound_batches(docs)
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    per = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    languages = sorted(per)
    # the sample is a range of hashes of each language; 1.3: what chance and the estimated count leave out
    top = {name: min(1.0, 1.3 * sample / max(1, per[name])) for name in languages}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, sent = np.zeros(FEATURES, np.int64), 0, set()
        for batch in batches:
            out = []
            h = batch.column(2).to_numpy().view(np.uint64) / 2.0**64
            for r, lang in enumerate(batch.column(0).to_pylist()):
                c = counts(batch.column(1)[r].as_py())
                at = np.flatnonzero(c)
                seen[at] += 1
                total += 1
                if h[r] < top[lang] and (lang, h[r]) not in sent:
                    sent.add((lang, h[r]))
                    out.append((lang, float(h[r]), at.astype(np.int32), c[at]))
            if out:
                yield _sample_batch(out)
            trim()
        at = np.flatnonzero(seen)
        yield _sample_batch([(None, float(total), at.astype(np.int32), seen[at])])

    found = materialize(rows.mapInArrow(count, "lang string, h double, at array<int>, n array<long>"), "language-counts")
    parts = found.filter("lang is null")
    df = np.zeros(FEATURES)
    for r in parts.select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).collect():
        df[r["at"]] = r["n"]
    total = parts.agg(F.sum("h")).first()[0] or 0
    idf = np.log((total + 1) / (df + 1)) + 1
    # texts that several tasks have seen count once; at most about 1.3 * sample a language are left
    held = found.filter("lang is not null").groupBy("lang", "h").agg(F.any_value("at").alias("at"), F.any_value("n").alias("n")).toArrow().combine_chunks()
    names, hashes = held.column("lang").to_pylist(), held.column("h").to_numpy()
    (at, bounds), (n, _) = (_lists(held.column(c)) for c in ("at", "n"))
    fit, hold = [], []
    for k, name in enumerate(languages):
        rows_of = sorted((hashes[r], r) for r in range(len(names)) if names[r] == name)
        for i, (_, r) in enumerate(rows_of[:sample]):
            index = at[bounds[r] : bounds[r + 1]]
            x = n[bounds[r] : bounds[r + 1]] * idf[index]
            (hold if i % 5 == 4 else fit).append((index, (x / np.sqrt(x @ x)).astype(np.float32), k))
    w = ftrl(fit, FEATURES, len(languages)) if languages else np.zeros((FEATURES + 1, 0))
    scores = np.array([x @ w[at] + w[-1] for at, x, _ in hold]).reshape(len(hold), len(languages))
    return Model(languages, idf, w[:-1], w[-1], temperature(scores, np.array([k for *_, k in hold], int)))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) and one.num_chunks else one
    if not len(one):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    bounds = np.asarray(one.offsets).astype(np.int64)
    return np.asarray(one.flatten()), bounds - bounds[0]


def _sample_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "h", "at", "n"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, which depend on the text alone; with ``least``, only rows of a known language and that score."""
    docs = docs.drop("lang_pred", "score")
    at, names = docs.columns.index(text_col), docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(at)]
            out = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            out = pa.RecordBatch.from_arrays(out, [*names, "lang_pred", "score"])
            if least is not None:
                out = out.filter(pa.array([f[0] != "und" and f[1] >= least for f in found], pa.bool_()))
            yield out
            trim()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1500) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Null text, and text without a letter, is ``und`` with score 0, as is
    everything if no row can be learned from.  A null id is not held out.
    Repeated rows get equal results; an empty table gives none.
    """
    model = train(docs, ~held_out(id_col), text_col, lang_col, sample)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(rows, model, "__text").select(id_col, "held_out", "lang_pred", "score")


def drop_unknown(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less likely than ``least``."""
    model = train(docs, ~held_out(id_col), text_col, lang_col)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"))
    return predict(rows, model, "__text", least).select("__row.*")

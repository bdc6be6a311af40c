"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams, hashed; the document
frequencies are counted over every learnable document.  The weights are
trained with follow-the-regularised-leader and elastic-net penalties on a
bounded, documented sample, and a temperature, fitted on a part of the
sample kept out of training, calibrates the probabilities.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_workers
from .ftrl import Ftrl

GRAMS, DIMS = (1, 2, 3), 1 << 15
#: Bound of the training sample: so many rows, about the same for each
#: language, or LEAST for each if there are more languages.  Every language is
#: learned; training holds two numbers per language and n-gram of the sample.
MAX_SAMPLE, LEAST = 6000, 20
EPOCHS, CALIBRATION_SHARE = 3, 5       # one sample row in five calibrates
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20                       # characters counted at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None if it has no letter."""
    clean = _OTHER.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, clean)):
        return None
    points = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total, longest = np.zeros(DIMS, np.int64), max(GRAMS)
    for at in range(0, len(points), _PIECE):
        p = points[at:at + _PIECE + longest - 1]
        h = np.zeros(len(p), np.uint64)
        for n in range(1, longest + 1):
            if n > len(p):
                break
            h = h[:len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1:] + np.uint64(n)
            if n in GRAMS:
                mine = h[:_PIECE]
                total += np.bincount(((mine * _MIX) >> np.uint64(49)).astype(np.int64), minlength=DIMS)
    return total


def features(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    v = (1.0 + np.log(count[at])) * idf[at]
    return at, v / max(1e-12, float(np.sqrt(v @ v)))


@dataclass
class Model:
    """The weights that the l1 penalty left, by feature: those of feature f
    are ``weight[begin[f]:begin[f + 1]]``, for the languages in ``lang``."""
    langs: list[str]
    idf: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    @staticmethod
    def empty() -> Model:
        none = np.zeros(0)
        return Model([], np.ones(DIMS), np.zeros(DIMS + 1, np.int64), none.astype(np.int64), none, none, 1.0)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, langs=np.array(self.langs, dtype=str), idf=self.idf.astype(np.float32),
                            begin=self.begin, lang=self.lang, w=self.weight, bias=self.bias, t=self.temperature)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        m = np.load(io.BytesIO(raw))
        return Model(m["langs"].tolist(), m["idf"].astype(float), m["begin"], m["lang"], m["w"], m["bias"], float(m["t"]))

    def scores(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        first, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        where = np.repeat(first - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(n.sum())
        return self.bias + np.bincount(self.lang[where], weights=self.weight[where] * np.repeat(v, n),
                                       minlength=len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); of equally likely ones the first by name."""
        count = counts(text)
        if count is None or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.scores(*features(count, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows, langs: list[str], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Train on (feature indices, values, language, calibrates?) rows."""
    order = {lang: k for k, lang in enumerate(langs)}
    train = [r for r in rows if not r[3]] or rows
    hold = [r for r in rows if r[3]] or rows
    # State for the n-grams of the sample only; the last feature is the bias.
    used = np.unique(np.concatenate([r[0] for r in train])).astype(np.int64)
    ftrl = Ftrl(len(used) + 1, len(langs), alpha=1.0, beta=1.0, l1=0.05, l2=0.01)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            at, v, lang, _ = train[i]
            at, v = np.append(np.searchsorted(used, at), len(used)), np.append(v, 1.0)
            w = ftrl.weights(at)
            g = softmax(v @ w)
            g[order[lang]] -= 1.0
            ftrl.update(at, w, v[:, None] * g[None, :])
    w = ftrl.weights()
    i, j = np.nonzero(w[:-1])
    begin = np.searchsorted(used[i], np.arange(DIMS + 1))
    model = Model(langs, idf, begin, j, w[i, j], w[-1], 1.0)
    scores = np.array([model.scores(at.astype(np.int64), v) for at, v, _, _ in hold])
    right = np.array([order[r[2]] for r in hold])
    best, best_t = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 400)):
        p = softmax(scores / t)[np.arange(len(right)), right]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best:
            best, best_t = loss, float(t)
    model.temperature = best_t
    return model


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (c := counts(text)) is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())],
            ["dim", "n"])


def _sample_features(idf_raw):
    def f(batches):
        idf = np.frombuffer(idf_raw.value, np.float64)
        for batch in batches:
            out = []
            for text, lang, holds in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (c := counts(text)) is not None:
                    at, v = features(c, idf)
                    out.append((at.astype(np.int32), v.astype(np.float32), lang, holds))
            if out:
                at, v, lang, holds = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32())),
                     pa.array(lang, pa.string()), pa.array(holds, pa.bool_())],
                    ["at", "v", "lang", "holds"])
    return f


def _trained(langs, idf_raw, epochs):
    def f(batches):
        rows = [(at, v, lang, holds) for b in batches for at, v, lang, holds in zip(
            (x.values.to_numpy() for x in b.column(0)), (x.values.to_numpy() for x in b.column(1)),
            b.column(2).to_pylist(), b.column(3).to_pylist())]
        # Their order must not depend on the shuffle.
        rows.sort(key=lambda r: (r[2], r[3], r[0].tobytes(), r[1].tobytes()))
        if rows:
            model = fit(rows, langs, np.frombuffer(idf_raw.value, np.float64), epochs)
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])
    return f


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          learnable=None, max_sample: int = MAX_SAMPLE, epochs: int = EPOCHS) -> Model:
    """Fit a model on ``docs`` (rows where ``learnable`` holds).  Document
    frequencies cover all of them; the weights use at most about
    ``max_sample`` rows (or LEAST of each language), drawn by a hash of the
    id, evenly by language.  Every language is learned.  Rows without a
    language or letter teach nothing; with none left the model predicts
    ``und``."""
    spark = with_workers(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                    (F.lit(True) if learnable is None else learnable).alias("ok"))
    d = d.where("ok and lang is not null")
    per_lang = {r.lang: r.n for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
                .collect()}                                # one row per language
    langs = sorted(per_lang)
    if not langs:
        return Model.empty()
    df = d.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(
        F.sum("n").alias("n")).collect()                       # at most DIMS + 1 rows
    freq = np.zeros(DIMS + 1)
    for r in df:
        freq[r.dim] = r.n
    idf = spark.sparkContext.broadcast((np.log((1 + freq[DIMS]) / (1 + freq[:DIMS])) + 1).tobytes())
    share = {lang: max(max_sample / len(langs), LEAST) / n for lang, n in per_lang.items()}
    wanted = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")]
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = (d.where(draw < wanted).select(
        "text", "lang", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(CALIBRATION_SHARE)) == 0).alias("holds"))
        .mapInArrow(_sample_features(idf), "at array<int>, v array<float>, lang string, holds boolean"))
    got = (sample.repartition(1).mapInArrow(_trained(langs, idf, epochs), "model binary").collect())
    return Model.load(bytes(got[0].model)) if got else Model.empty()


def _predicted(raw):
    def f(batches):
        model = Model.load(raw.value)
        for batch in batches:
            out = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()),
                 pa.array([x[1] for x in out], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])
    return f


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            held_out=None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  A null
    text or one without a letter is ``und`` with score 0; of equally likely
    languages the first by name is taken; repeated rows stay, a null id stays
    null, no rows give none, other columns are ignored."""
    spark = with_workers(docs.sparkSession)
    raw = spark.sparkContext.broadcast(model.dump())
    flag = F.lit(False) if held_out is None else held_out
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"),
                        F.col(text_col).alias("text"))
            .mapInArrow(_predicted(raw), "doc_id long, held_out boolean, lang_pred string, score double"))


def is_held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and predict every row.  Rows
    without an id teach nothing."""
    learnable = ~is_held_out(id_col) & F.col(id_col).isNotNull()
    model = train(docs, id_col, text_col, lang_col, learnable)
    return predict(docs, model, id_col, text_col, is_held_out(id_col))

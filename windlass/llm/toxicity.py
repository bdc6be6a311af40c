"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k | x) = sigmoid(theta_k - w . x): one sparse weight vector is
shared by all thresholds, which stay ordered.  Features are the distinct
words of a text; weights are trained with an l1 penalty, so only
words that tell remain.  The outputs are the expected severity and the most
likely grade.  Words whose share differs between toxic and other texts by
less than MIN_Z standard errors are noise and are no features.

``labels`` only says toxic or not.  Grades above 0 are made from it: the words
that are more frequent in toxic texts are markers, and toxic texts are graded
1 to 3 by how many markers they hold (thirds of the sample; none: grade 1).
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialise, with_workers

#: Bound of the training sample (labelled documents, drawn by a hash of the
#: id; toxic ones may take half of it, or more if there are few others), the
#: fewest drawn texts a word must be in, and grades 0..GRADES-1.
MAX_SAMPLE, MIN_TEXTS, MIN_Z, GRADES, ROUNDS = 12_000, 5, 4.0, 4, 400
PREFIXES = (3, 4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The features of a text: its distinct words, and their first 3 to 6
    letters (marked ``*``), which stand for the other forms of a word."""
    whole = set(_WORDS.findall(text.lower())) if text else set()
    return whole | {w[:k] + "*" for w in whole for k in PREFIXES if len(w) > k}


@dataclass
class Model:
    vocabulary: dict[str, float]       # the words with a weight
    thresholds: np.ndarray             # ascending; empty: nothing was learned
    cut: float                         # of the probability of any toxicity

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, v=np.array(list(self.vocabulary), dtype=str),
                            w=np.array(list(self.vocabulary.values()), float), t=self.thresholds, c=self.cut)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        m = np.load(io.BytesIO(raw))
        return Model(dict(zip(m["v"].tolist(), m["w"].tolist())), m["t"], float(m["c"]))

    def predict(self, text: str | None) -> tuple[int, float, bool]:
        """(grade, expected severity, toxic?); of equally likely grades the
        lower one, and a probability at the cut is toxic."""
        if not len(self.thresholds):
            return 0, 0.0, False
        s = sum(self.vocabulary[w] for w in words(text) & self.vocabulary.keys())
        above = 1.0 - sigmoid(self.thresholds - s)             # P(grade > k)
        p = -np.diff(np.concatenate(([1.0], above, [0.0])))
        return int(p.argmax()), float(above.sum()), bool(above[0] >= self.cut)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def grades(hits: np.ndarray, toxic: np.ndarray, top: int) -> np.ndarray:
    """Grades 0..top from the labels and the markers in each text."""
    marked = np.sort(hits[(toxic == 1) & (hits > 0)])
    if not len(marked):
        return toxic.astype(int)
    cuts = [marked[len(marked) * k // top] for k in range(1, top)]
    return np.where(toxic == 1, 1 + sum((hits > c).astype(int) for c in cuts), 0)


def fit(texts: list[list[str]], toxic: np.ndarray, z: dict[str, float], n_grades: int = GRADES,
        rounds: int = ROUNDS, l1: float = 1.0, l2: float = 0.01, shares=(1.0, 1.0)) -> Model:
    """Train on the features ``z`` (word -> standard errors) of the texts;
    ``shares`` of the other and of the toxic texts were drawn, and the
    thresholds and the cut are brought back to all of them."""
    kept = sorted(z)
    of = {w: i for i, w in enumerate(kept)}
    score = np.array([z[w] for w in kept])
    ids = [np.array(sorted(of[w] for w in t if w in of), np.int64) for t in texts]
    grade = grades(np.array([int((score[x] > 0).sum()) for x in ids], int), toxic, n_grades - 1)
    if not grade.any() or grade.all():
        return Model({}, np.zeros(0), 1.0)
    top = int(grade.max())
    n, rows = len(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    cols = np.concatenate(ids) if n else np.zeros(0, np.int64)
    used, cols = np.unique(cols, return_inverse=True)
    share = np.array([(grade <= k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    # Accelerated proximal gradient steps, each weight with a step of its
    # own: 1 / (how much its texts can bend the likelihood).
    width = np.bincount(rows, minlength=n)
    bend = np.bincount(cols, weights=width[rows], minlength=len(used)) + 1.0
    w = look = np.zeros(len(used))
    first, last, t = grade == 0, grade == top, 1.0
    for _ in range(rounds):
        s = np.bincount(rows, weights=look[cols], minlength=n)
        hi = np.where(last, 1.0, sigmoid(theta[np.minimum(grade, top - 1)] - s))
        lo = np.where(first, 0.0, sigmoid(theta[np.maximum(grade - 1, 0)] - s))
        like = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g = np.bincount(cols, weights=(dhi - dlo)[rows], minlength=len(used)) + l2 * look
        step = look - g / bend
        new = np.sign(step) * np.maximum(np.abs(step) - l1 / bend, 0.0)
        more = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / more * (new - w), new, more
        pull = (np.bincount(np.maximum(grade - 1, 0), weights=np.where(first, 0, dlo), minlength=top)[:top]
                - np.bincount(np.minimum(grade, top - 1), weights=np.where(last, 0, dhi), minlength=top)[:top])
        theta = np.maximum.accumulate(theta - pull / n)
    s = np.bincount(rows, weights=w[cols], minlength=n)
    theta = theta + np.log(shares[1] / shares[0])
    return Model({kept[used[i]]: float(w[i]) for i in np.flatnonzero(w)}, theta,
                 best_cut(sigmoid(s - theta[0]), grade > 0, shares))


def best_cut(p: np.ndarray, toxic: np.ndarray, shares=(1.0, 1.0)) -> float:
    """The probability of toxicity above which a text is called toxic: best
    F1 on the sample, each text counted 1 / the share drawn of its kind,
    halfway (in log-odds) to the next lower text."""
    order = np.argsort(-p, kind="stable")
    p, toxic = p[order], toxic[order]
    hit, called = np.cumsum(toxic / shares[1]), np.cumsum(np.where(toxic, 1 / shares[1], 1 / shares[0]))
    ends = np.append(np.flatnonzero(p[1:] < p[:-1]), len(p) - 1)       # a cut never parts ties
    f1 = 2 * hit[ends] / (called[ends] + hit[-1])
    best = ends[int(f1.argmax())]
    odds = lambda x: np.log(max(x, 1e-9) / max(1 - x, 1e-9))
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float(sigmoid((odds(p[best]) + odds(below)) / 2))


def _word_rows(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(words(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string())),
             b.column(1)], ["words", "toxic"])


def _known_words(z):
    def f(batches):
        known = z.value.keys()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(words(t) & known) for t in b.column(0).to_pylist()], pa.list_(pa.string())),
                 b.column(1)], ["words", "toxic"])
    return f


def _trained(z, options):
    def f(batches):
        rows = sorted((w, t) for b in batches for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if rows:
            model = fit([w for w, _ in rows], np.array([t for _, t in rows]), z.value, **options)
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])
    return f


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_sample: int = MAX_SAMPLE, **options) -> Model:
    """Fit on labelled documents, about ``max_sample`` of them, drawn by kind
    of label from the ids alone; words are counted in the drawn texts.  A
    document labelled twice counts as toxic if one label says so; of rows with
    one id the least text teaches; rows without id or label teach nothing;
    without both kinds of label the model finds nothing toxic."""
    spark = with_workers(docs.sparkSession)
    marks = (labels.where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Ids only: no text moves for the labels.
    labelled = materialise(marks.join(d.select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    both = labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not both[0] or not both[1]:
        return Model({}, np.zeros(0), 1.0)
    n1, n0 = float(both[0]), float(both[1])
    want = min(n1, max(max_sample / 2, max_sample - n0))
    shares = (min(1.0, (max_sample - want) / n0), want / n1)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    # About max_sample ids, however many labels there are: the texts stay
    # where they are, and only the drawn ones leave their tasks.
    drawn = labelled.where(draw < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    sample = materialise(d.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic")
                         .agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    m1, m0 = (float(x or 0) for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not m1 or not m0:
        return Model({}, np.zeros(0), 1.0)
    c = (sample.mapInArrow(_word_rows, "words array<string>, toxic int")
         .select(F.explode("words").alias("w"), "toxic").groupBy("w")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n1")))
    p = F.col("n") / (m1 + m0)
    se = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / m1 + 1 / m0))
    c = c.where(F.col("n") >= MIN_TEXTS).select("w", ((F.col("n1") / m1 - (F.col("n") - F.col("n1")) / m0) / se).alias("z"))
    # Words of the sample only: bounded by it.
    z = spark.sparkContext.broadcast({r.w: r.z for r in c.where(F.abs("z") > MIN_Z).collect()})
    got = (sample.mapInArrow(_known_words(z), "words array<string>, toxic int")
           .repartition(1).mapInArrow(_trained(z, {"shares": shares, **options}), "model binary")
           .collect())
    return Model.load(bytes(got[0].model)) if got else Model({}, np.zeros(0), 1.0)


def _predicted(raw):
    def f(batches):
        model = Model.load(raw.value)
        for b in batches:
            out = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.int32()),
                 pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[2] for x in out], pa.bool_())],
                ["doc_id", "grade", "severity", "toxic"])
    return f


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, grade, severity (expected grade), toxic
    (a grade over 0 is at least as likely as the cut that was best on the
    sample).  A null or empty text is scored
    by the thresholds alone; repeated rows stay, a null id stays null, no
    rows give none, other columns are ignored."""
    raw = with_workers(docs.sparkSession).sparkContext.broadcast(model.dump())
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_predicted(raw), "doc_id long, grade int, severity double, toxic boolean"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows the model calls toxic; columns unchanged.  A
    null or empty text is judged by the thresholds alone, ids are not looked
    at, repeated rows share their verdict, no rows give none."""
    raw = with_workers(docs.sparkSession).sparkContext.broadcast(model.dump())

    @pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        m = Model.load(raw.value)
        return pd.Series([m.predict(t)[2] for t in texts], dtype=bool)
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return safe.where(~toxic(F.col(f"c{names.index(text_col)}"))).toDF(*names)

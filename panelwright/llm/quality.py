"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (toxic), 1 (poor) or 2 (good).  One weight
vector over hashed text features is shared by all grades; ordered thresholds
cut its score into grades: P(grade <= k) = sigmoid(threshold_k - score).  The
model gives the expected grade and the tail probability P(grade >= 2) that
selection uses.

It is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, the rows
with the smallest hash of their id, so the same at every partitioning);
scoring reads all rows, as a map without shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, store, text_or_empty

SAMPLE_ROWS = 12_000
DIM = 1 << 18
MIN_DF = 4
MIN_Z = 5.0
GRADES = 3
PREFIXES = (4, 5)
KEEP_TAIL = 0.5

_WORD = re.compile(r"\w+")
_SIGNS = re.compile(r"[^\w\s]+")


def _level(share: float) -> int:
    return 0 if share < 0.02 else 1 if share < 0.1 else 2 if share < 0.3 else 3


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


class Slots(dict):
    """Word or word beginning → its hashed feature as a tuple, empty if the
    model has no weight for it (``live``).  Remembers up to 200,000 names."""

    def __init__(self, kind: str, live: np.ndarray | None = None):
        super().__init__()
        self.kind, self.live = kind, live

    def __missing__(self, name):
        at = _slot(self.kind + name)
        if len(self) >= 200_000:
            self.clear()
        self[name] = out = (at,) if self.live is None or self.live[at] else ()
        return out


def all_slots(live: np.ndarray | None = None) -> list[Slots]:
    return [Slots("w:", live)] + [Slots(f"p{k}:", live) for k in PREFIXES]


def features(text: str, slots: list[Slots]) -> set[int]:
    """Hashed binary features: the distinct lower-cased words and their first
    four and five letters (word families), and levels of runs of signs,
    upper-case words, repeated words and length."""
    words = _WORD.findall(text)
    n = len(words)
    distinct = set(map(str.lower, words))
    out = set(chain.from_iterable(map(slots[0].__getitem__, distinct)))
    for k, known in zip(PREFIXES, slots[1:]):
        out.update(chain.from_iterable(map(known.__getitem__, {w[:k] for w in distinct})))
    length = n.bit_length()
    runs: dict[str, int] = {}
    for s in _SIGNS.findall(text):
        s = s[:4]
        runs[s] = runs.get(s, 0) + 1
    for s, c in runs.items():
        out.add(_slot(f"s:{s}:{_level(c / max(n, 1))}"))
    upper = sum(map(str.isupper, words))
    twice = sum(map(str.__eq__, words, words[1:]))
    out.add(_slot(f"upper:{_level(upper / max(n, 1))}"))
    out.add(_slot(f"twice:{_level(twice / max(n, 1))}"))
    out.add(_slot(f"new:{10 * len(distinct) // max(n, 1)}:{length}"))
    out.add(_slot(f"len:{length}"))
    return out


@dataclass
class OrdinalModel:
    weights: np.ndarray        # DIM
    thresholds: np.ndarray     # GRADES - 1, ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), …, P(grade >= GRADES - 1), one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def screened(df: np.ndarray, top: np.ndarray, mean: float, std: float, slack: float = 0.0) -> np.ndarray:
    """Which features get a weight: rows with the feature (``df``, of them
    ``top`` of the top grade) have the top grade clearly less often than all."""
    z = (top / np.maximum(df, 1) - mean) * np.sqrt(df) / max(std, 1e-9)
    return (df >= MIN_DF) & (z <= slack - MIN_Z)


def fit(rows: list[np.ndarray], grade: np.ndarray, rounds: int = 500, ridge: float = 0.1,
        rate: float = 0.05) -> OrdinalModel | None:
    """Maximum likelihood with ridge, by Adam on the full sample.  Only
    features of at least ``MIN_DF`` rows whose share of top grades lies
    ``MIN_Z`` standard errors below the overall share get a weight: a fault counts the
    same in a long text as in a short one.  None without rows."""
    if not len(rows):
        return None
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df = np.bincount(at, minlength=DIM)
    top = (grade == GRADES - 1).astype(float)
    used = screened(df, np.bincount(at, top[row], DIM), top.mean(), top.std())
    at, row = at[used[at]], row[used[at]]
    names, col = np.unique(at, return_inverse=True)
    w = np.zeros(len(names))
    cut = np.array([-1.0, 1.0])
    params = np.concatenate([w, [cut[0], np.log(cut[1] - cut[0])]])
    m = np.zeros_like(params)
    v = np.zeros_like(params)

    def sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for t in range(1, rounds + 1):
        w, th = params[:-2], np.array([params[-2], params[-2] + np.exp(params[-1])])
        score = np.bincount(row, w[col], len(rows))
        hi = np.where(grade == GRADES - 1, 1.0, sig(np.take(th, np.minimum(grade, GRADES - 2)) - score))
        lo = np.where(grade == 0, 0.0, sig(np.take(th, np.maximum(grade - 1, 0)) - score))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = dhi - dlo                                   # d(-log p)/d score
        g_th = np.array([-(dhi * (grade == k)).sum() + (dlo * (grade == k + 1)).sum() for k in (0, 1)])
        grad = np.concatenate([np.bincount(col, g_score[row], len(names)) + ridge * w,
                               [g_th.sum(), g_th[1] * np.exp(params[-1])]])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        params = params - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(DIM)
    weights[names] = params[:-2]
    return OrdinalModel(weights, np.array([params[-2], params[-2] + np.exp(params[-1])]))


def _sample_features(batches):
    slots = all_slots()
    for pdf in batches:
        rows = [sorted(features(t, slots)) for t in pdf["text"]]
        yield pd.DataFrame({"key": pdf["key"], "grade": pdf["grade"], "at": rows})


def _slot_counts(batches):
    """Rows and rows of the top grade by feature; slot ``DIM`` counts all rows."""
    df, top = np.zeros(DIM + 1, np.int64), np.zeros(DIM + 1, np.int64)
    for pdf in batches:
        for grade, at in zip(pdf["grade"], pdf["at"]):
            at = np.append(at, DIM)
            df[at] += 1
            if grade == GRADES - 1:
                top[at] += 1
    seen = np.flatnonzero(df)
    yield pd.DataFrame({"slot": seen, "df": df[seen], "top": top[seen]})


def _only(used: np.ndarray):
    """Rows with those of their features that are ``used``."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(at=[at[used[at]] for at in pdf["at"].map(lambda x: np.asarray(x, np.int64))])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """Fit on at most ``sample_rows`` labelled rows of ``docs``.

    A row of ``labels`` (doc_id, quality, toxic) gives grade 0 for toxic
    text, 1 for quality 0, else 2; a NULL quality is no label, a NULL toxic counts
    as 0.  Labels of documents that ``docs`` lacks do not use up the sample, and
    an id that ``docs`` repeats counts once, with the text of the smallest hash,
    so no more than ``sample_rows`` rows come to the driver, and only with the
    features that pass the screening, which is counted in tasks.  None if no
    labelled row is found."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    valid = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
             .select(F.xxhash64(F.col("doc_id").cast("long")).alias("key"), F.col("doc_id").cast("long").alias("l_id"), grade.alias("grade")).distinct())
    present = rows.where(F.col("id").isNotNull()).select("id").distinct()                   # ids alone, no texts
    chosen = valid.join(present, F.col("l_id") == F.col("id"), "left_semi").orderBy("key", "l_id", "grade").limit(sample_rows)
    picked = (rows.join(F.broadcast(chosen), F.col("id") == F.col("l_id"))                  # <= sample_rows rows
              .groupBy("key", "l_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text"))
              .select("key", "grade", "text"))
    sample = store(on_workers(picked).mapInPandas(_sample_features, "key long, grade int, at array<int>"), "sample-features")
    counts = (sample.select("grade", "at").mapInPandas(_slot_counts, "slot int, df long, top long")
              .groupBy("slot").agg(F.sum("df").alias("df"), F.sum("top").alias("top")).filter(F.col("df") >= MIN_DF).toArrow())
    df, top = np.zeros(DIM + 1, np.int64), np.zeros(DIM + 1, np.int64)
    df[counts["slot"].to_numpy()], top[counts["slot"].to_numpy()] = counts["df"].to_numpy(), counts["top"].to_numpy()
    mean = top[DIM] / max(df[DIM], 1)
    # a little slack: ``fit`` screens again, by the same rule
    used = screened(df[:DIM], top[:DIM], mean, (mean * (1 - mean)) ** 0.5, 1e-6)
    got = sample.mapInPandas(_only(used), "key long, grade int, at array<int>").toArrow()
    order = np.lexsort((got["grade"].to_numpy(), got["key"].to_numpy()))
    at = got["at"].combine_chunks()
    if not len(got):
        return None
    flat, offsets = at.values.to_numpy(), at.offsets.to_numpy()
    return fit([flat[offsets[i]:offsets[i + 1]] for i in order], got["grade"].to_numpy().astype(int)[order])


def score_column(df: DataFrame, model: OrdinalModel, text_col: str) -> Column:
    """struct<grade, tail>: expected grade and P(grade >= 2) of each row's text."""
    shared = on_workers(df).sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def score(batches):
        weights, thresholds = shared.value
        slots = all_slots(weights != 0)
        for texts in batches:
            s = np.array([float(weights[list(features(t, slots))].sum(dtype=np.float64)) for t in texts])
            tails = OrdinalModel(weights, thresholds).tails(s)
            yield pd.DataFrame({"grade": tails.sum(axis=1), "tail": tails[:, -1]})
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "grade double, tail double")(text_or_empty(text_col))


def grade_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep_tail: float = KEEP_TAIL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, expected_grade, tail_prob, kept``.

    NULL text is scored as empty text.  Without labelled rows both scores are
    NULL and every row is kept.  NULL and repeated ids do not matter; other
    columns are ignored; an empty table gives an empty result."""
    model = train(docs, labels, id_col, text_col, sample_rows)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col(id_col).alias("doc_id"), none.alias("expected_grade"), none.alias("tail_prob"), F.lit(True).alias("kept"))
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, model, text_col).alias("s"))
    return scored.select("doc_id", F.col("s.grade").alias("expected_grade"), F.col("s.tail").alias("tail_prob"),
                         (F.col("s.tail") >= keep_tail).alias("kept"))


def select_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep_tail: float = KEEP_TAIL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches ``keep_tail``, with
    all columns; all rows if nothing is labelled."""
    model = train(docs, labels, id_col, text_col, sample_rows)
    if model is None:
        return docs
    return docs.filter(score_column(docs, model, text_col)["tail"] >= keep_tail)

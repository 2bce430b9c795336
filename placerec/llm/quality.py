"""Quality classifier: naive Bayes support vectors over hashed n-grams.

Indicators of token 1- and 2-grams and of shape 1- to 3-grams (case, digits,
punctuation runs, a token that repeats the one before) are scaled by the log-count
ratio of the two classes, each text's vector is brought to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent. The margin becomes a score by a
logistic curve fitted on rows the model has not seen, weighted to the classes' share.

Fitting reads at most ``PER_CLASS`` labelled rows of each class (those of the smallest
id digests), which bounds what is sent to the driver; scoring reads every whole text.

Defined results: a null text is an empty one; texts without tokens get the score of a
zero margin; with labels of one class only every text gets that class's score (1 or
0), without labels 0.5; labels that are null or other than 0 and 1 are passed over, an
id labelled twice counts with its smaller label; repeated rows give equal rows; an empty
table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from placerec.llm import textkernel as K

BITS, PER_CLASS, EPOCHS, COST, THRESHOLD = 18, 4000, 12, 1.0, 0.7
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_ALNUM = K.ALNUM_WORDS.copy()
_ALNUM[0x41:0x5B] = True
_PUNCT &= ~_ALNUM
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct features of each text behind each other, offsets)."""
    buf, offs = K.flat(texts)
    for i, j, part, at in K.chunks(buf, offs):
        n = j - i
        s1, e1, _ = K.words(part, at, _ALNUM)
        s2, e2, _ = K.words(part, at, _PUNCT)
        order = np.argsort(np.concatenate([s1, s2]), kind="stable")
        starts, ends = np.concatenate([s1, s2])[order], np.concatenate([e1, e2])[order]
        per = np.diff(np.searchsorted(starts, at, "left"))
        text = np.repeat(np.arange(n), per)
        token = K.span_hashes(K.LOWER[part], starts, ends)
        count = lambda table: np.concatenate([[0], np.cumsum(table[part])])
        up, digit = count(_UPPER), count(_DIGIT)
        up, digit, size = up[ends] - up[starts], digit[ends] - digit[starts], ends - starts
        shape = np.where(digit > 0, 4, np.where(up == 0, 3, np.where((up > 1) & (up * 2 > size), 1, np.where(up == 1, 2, 5)))).astype(np.uint64)
        punct = _PUNCT[part[starts]] if len(starts) else np.zeros(0, bool)
        shape[punct] = token[punct]
        # the token before it of the same kind, in the same text
        for kind in (~punct,):
            k = np.flatnonzero(kind)
            again = np.zeros(len(k), bool)
            again[1:] = (token[k[1:]] == token[k[:-1]]) & (text[k[1:]] == text[k[:-1]])
            shape[k[again]] = 6
        keys = []
        for seed, values, longest in ((1, token, 2), (101, shape, 3)):
            h = values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
            for length in range(1, longest + 1):
                m = len(values) - length + 1
                if m <= 0:
                    break
                x = h[:m].copy()
                for d in range(1, length):
                    x = x * np.uint64(0xD6E8FEB86659FD93) + values[d : d + m]
                ok = text[:m] == text[length - 1 :]
                keys.append(text[:m][ok] << BITS | (K.mix(x[ok] + np.uint64(length)) >> np.uint64(64 - BITS)).astype(np.int64))
        all_keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        all_keys.sort()
        if len(all_keys):
            all_keys = all_keys[np.concatenate([[True], all_keys[1:] != all_keys[:-1]])]
        yield i, j, (all_keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(all_keys >> BITS, np.arange(n + 1), "left")


def dual_descent(x: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-loss linear SVM (rows of norm 1, bias feature 1) by coordinate descent on its dual."""
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i], values[i]
            grad = y[i] * (v @ w[at] + b) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[at] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin) by Newton steps on the penalised likelihood."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + c)))
        g = np.array([np.sum(weight * (p - y) * margin) + 1e-3 * a, np.sum(weight * (p - y))])
        d = weight * p * (1 - p) + 1e-9
        h = np.array([[np.sum(d * margin**2) + 1e-3, np.sum(d * margin)], [np.sum(d * margin), np.sum(d) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -5, 5), c - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), c


class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset)))."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.ratio2, self.bias, self.slope, self.offset = weights * ratio, ratio**2, bias, slope, offset

    def score(self, at: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total = lambda table: np.diff(np.concatenate([[0.0], np.cumsum(table[at])])[offs])
        margin = total(self.weights) / np.sqrt(np.maximum(total(self.ratio2), 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled rows of each class."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    known = known.withColumn("digest", F.xxhash64("id"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    zeros = np.zeros(1 << BITS)
    if len(n) < 2:
        return Model(zeros, zeros, 0.0, 1.0, 0.0 if not n else 40.0 if 1 in n else -40.0)
    first = [known.where(F.col("y") == k).orderBy("digest", "id").limit(per_class) for k in (0, 1)]
    chosen = first[0].unionByName(first[1]).select("id", "y")
    # at most 2 * per_class ids and labels, so it can be sent to all
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")

    def run(batches):
        for batch in batches:
            for i, j, at, offs in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(at))], ["y", "at"])

    got = part.mapInArrow(K.releasing(run), "y int, at array<int>").toArrow()
    y = got["y"].to_numpy().astype(np.float64) * 2 - 1
    lists = got["at"].combine_chunks() if got["at"].num_chunks != 1 else got["at"].chunk(0)
    flat, offs = np.asarray(lists.values), np.asarray(lists.offsets)
    # the same rows in the same order whatever order the tasks ended in
    rows = sorted(((flat[a:b], t) for a, b, t in zip(offs[:-1], offs[1:], y, strict=True) if b > a), key=lambda r: (r[1], len(r[0]), r[0].tobytes()))
    if not rows or len({t for _, t in rows}) < 2:
        return Model(zeros, zeros, 0.0, 1.0, 0.0)
    x, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    order = np.random.default_rng(11).permutation(len(x))
    aside = np.zeros(len(x), bool)
    aside[order[: len(x) // 5]] = True
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    use = np.flatnonzero(~aside)
    count = {s: 1.0 + np.bincount(np.concatenate([x[i] for i in use if y[i] == s]), minlength=1 << BITS) for s in (1.0, -1.0)}
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    values = [ratio[a] / max(float(np.sqrt(ratio[a] @ ratio[a])), 1e-6) for a in x]
    share = {s: (y[use] == s).mean() for s in (1.0, -1.0)}
    w, b = dual_descent([x[i] for i in use], [values[i] for i in use], y[use], np.array([COST / (2 * share[t]) for t in y[use]]))
    seen = np.flatnonzero(aside) if aside.any() else use
    margin = np.array([values[i] @ w[x[i]] + b for i in seen])
    weight = np.array([n[int(t > 0)] / max(1, (y[seen] == t).sum()) for t in y[seen]])
    slope, offset = _logistic(margin, (y[seen] > 0).astype(float), weight * len(seen) / weight.sum())
    return Model(w, ratio, b, slope, offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (default: the id) and each text's score; an own column of that name stays beside it, and ``name`` must be another."""
    keep = keep or [id_col]
    share = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text"))

    names = part.columns[:-1]

    def run(batches):
        for batch in batches:
            out = np.concatenate([np.zeros(0), *(share.value.score(at, offs) for _, _, at, offs in features(batch.column(len(keep))))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*names, "score"])

    from pyspark.sql import types as T

    return part.mapInArrow(K.releasing(run), T.StructType([*part.schema.fields[:-1], T.StructField("score", T.DoubleType())])).toDF(*keep, name)

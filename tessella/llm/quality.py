"""Quality by Bradley-Terry pairwise ranking.

Texts of label 1 should beat texts of label 0: the score is linear in features of
the text, and its weights minimise the mean logistic loss of the score difference
over all preference pairs, one text of each label. Features are measures of the
whole text, each also as its place among quantiles, so that "too much" and "too
little" can both be bad. A quantile of the scores is the threshold.

Every labelled training row counts, in the quantiles, the pairs and the threshold.
The features of all rows are measured once and written; training passes over them
on the executors, and the driver gets sums whose size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, is_training, materialise

#: Weight of |w|^2 / 2 beside the mean loss of a pair (3 for 60,000 pairs), and the most Newton steps.
RIDGE, ROUNDS = 5e-5, 30

#: Grids of raw scores: sums over all pairs come from counts at their nodes, a score shared between its two neighbours. The fine one
#: gives loss and gradient (an error of at most 3e-5 in a probability), the coarse one curvature only. Scores beyond the ends count as there.
FINE, COARSE = np.linspace(-64, 64, 4097), np.linspace(-64, 64, 257)

MERGE = 32  # partial sums that are added up at once, on the driver or by a task

KEEP_AT = 0.3  # the score of the threshold
BINS = 12

_CLASS = np.zeros(256, np.int64)  # of UTF-8 bytes: 1 upper, 2 lower, 3 digit, 4 white, 5 marks of sentences, 6 bar, 7 other ASCII, 8 beyond ASCII
_CLASS[:128] = 7
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[ord("|")] = 6
_CLASS[128:] = 8

NAMES = ["words", "word length", "distinct words", "same as last word", "commonest word", "upper case", "digits", "marks", "bars", "symbols", "beyond ASCII", "white space", "distinct lines", "line length", "capital words", "exclamations", "longest word", "distinct trigrams"]


def features(text: str | None) -> list[float]:
    """Measures of a whole text, all finite; an empty or null text is all zero."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by = np.bincount(_CLASS[raw], minlength=9) / len(raw)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)), len(text) / n, len(count) / n, sum(map(str.__eq__, words, words[1:])) / n, max(count.values()) / n,
        by[1], by[3], by[5], by[6], by[7], by[8], by[4], len(set(lines)) / max(1, len(lines)), float(np.log1p(len(text) / max(1, len(lines)))),
        sum(map(str.isupper, words)) / n, text.count("!") / n, float(np.log1p(max(map(len, words)))), len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
    ]


def spread(x: np.ndarray, cuts: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features and, for each, which of its quantile cuts it has passed."""
    passed = [(x[:, [j]] > cuts[j][None, :]).astype(float) for j in range(x.shape[1])]
    return np.concatenate([np.clip((x - mean) / sd, -5, 5), *passed], 1)


def _hats(s: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each score the node under it and the share that goes to the next one."""
    at = (np.clip(s, nodes[0], nodes[-1]) - nodes[0]) / (nodes[1] - nodes[0])
    low = np.minimum(at.astype(np.int64), len(nodes) - 2)
    return low, at - low


def _at_nodes(s: np.ndarray, nodes: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    low, t = _hats(s, nodes)
    weight = np.ones(len(s)) if weight is None else weight
    return np.bincount(low, weight * (1 - t), len(nodes)) + np.bincount(low + 1, weight * t, len(nodes))


def _over(count: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """At each node of FINE, the sum over all nodes v of count[v] * kernel(FINE[v] - the node)."""
    n = len(FINE)
    return np.convolve(kernel((n - 1 - np.arange(2 * n - 1)) * (FINE[1] - FINE[0])), count, "valid")


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _arrays(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _total(rows: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of measure(x, y), `size` numbers, over all batches of `rows`; the driver gets at most about MERGE arrays at once."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += measure(_arrays(b), b.column("y").to_numpy())
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = sum((np.frombuffer(v.as_buffer()) for v in t["total"]), np.zeros(size))
        return pa.table({"part": pa.array([t["part"][0].as_py() // MERGE], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    parts, n = rows.mapInArrow(part, "part int, total binary"), rows.rdd.getNumPartitions()
    while n > MERGE:
        parts, n = parts.groupBy(F.floor(F.col("part") / MERGE)).applyInArrow(merge, "part int, total binary"), -(-n // MERGE)
    return sum((np.frombuffer(r["total"]) for r in sorted(parts.collect(), key=lambda r: r["part"])), np.zeros(size))


def quantiles(rows: DataFrame, n: int, qs: np.ndarray) -> np.ndarray:
    """For each feature the least values that shares `qs` of all `n` rows do not exceed; exact, by counts of a byte a pass."""
    prefix = np.zeros((len(NAMES), len(qs)), np.uint32)
    rank = np.tile(np.maximum(np.ceil(qs * n - 1e-9), 1), (len(NAMES), 1))
    for shift in (24, 16, 8, 0):

        def count(x: np.ndarray, _y: np.ndarray, prefix: np.ndarray = prefix, shift: int = shift) -> np.ndarray:
            key = np.ascontiguousarray(x.T, np.float32).view(np.uint32)  # of numbers from 0 on, so in their order
            out = np.zeros((*prefix.shape, 256))
            for j, k in enumerate(key):
                above, byte = k.astype(np.uint64) >> np.uint64(shift + 8), (k >> np.uint32(shift)) & np.uint32(255)
                for p in np.unique(prefix[j]):
                    out[j, prefix[j] == p] = np.bincount(byte[above == p], minlength=256)
            return out.ravel()

        below = np.cumsum(_total(rows, count, prefix.size * 256).reshape(*prefix.shape, 256), 2)
        byte = (below < rank[:, :, None]).sum(2)
        rank = rank - np.where(byte > 0, np.take_along_axis(below, np.maximum(byte - 1, 0)[:, :, None], 2)[:, :, 0], 0)
        prefix = prefix * np.uint32(256) + byte.astype(np.uint32)
    return prefix.view(np.float32).astype(float)


def bradley_terry(rows: DataFrame, model: dict, n1: int, n0: int) -> np.ndarray:
    """Weights that minimise the mean logistic loss of w . (good - bad) over all pairs, by Newton steps, shortened where they overshoot."""
    d = len(NAMES) * BINS
    cuts, mean, sd = model["cuts"], model["mean"], model["sd"]

    def counts(w: np.ndarray) -> np.ndarray:
        def measure(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = spread(x, cuts, mean, sd) @ w
            return np.concatenate([_at_nodes(s[y == 1], FINE), _at_nodes(s[y == 0], FINE)])

        got = _total(rows, measure, 2 * len(FINE)).reshape(2, -1)
        return got / np.array([[n1], [n0]])

    def loss(count: np.ndarray, w: np.ndarray) -> float:
        return float(count[0] @ _over(count[1], lambda x: np.logaddexp(0, x)) + RIDGE / 2 * (w @ w))

    def slopes(w: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature at `w`; a row enters by what it shares with all rows of the other label."""
        loses, wins = _over(count[1], _logistic), _over(count[0], lambda x: _logistic(-x))
        rough = [_at_nodes(FINE, COARSE, c) for c in count]
        bend = _logistic(COARSE[:, None] - COARSE[None, :])
        bend = bend * (1 - bend)
        bend1, bend0 = bend @ rough[1], bend @ rough[0]

        def measure(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            f = spread(x, cuts, mean, sd)
            s = f @ w
            good = y == 1
            pull = np.where(good, -np.interp(s, FINE, loses) / n1, np.interp(s, FINE, wins) / n0)
            own = np.where(good, np.interp(s, COARSE, bend1) / n1, np.interp(s, COARSE, bend0) / n0)
            low, t = _hats(s, COARSE)
            hats = np.zeros((len(s), len(COARSE)))
            hats[np.arange(len(s)), low], hats[np.arange(len(s)), low + 1] = 1 - t, t
            return np.concatenate([pull @ f, ((f * own[:, None]).T @ f).ravel(), (hats[good].T @ f[good]).ravel() / n1, (hats[~good].T @ f[~good]).ravel() / n0])

        got = _total(rows, measure, d + d * d + 2 * len(COARSE) * d)
        at1, at0 = got[d + d * d :].reshape(2, len(COARSE), d)
        cross = at1.T @ bend @ at0
        return got[:d] + RIDGE * w, got[d : d + d * d].reshape(d, d) - cross - cross.T + RIDGE * np.eye(d)

    w = np.zeros(d)
    count = counts(w)
    for _ in range(ROUNDS):
        grad, curve = slopes(w, count)
        step, before = -np.linalg.solve(curve, grad), loss(count, w)
        if np.abs(step).max() < 1e-4:
            return w + step
        while True:
            count = counts(w + step)
            if loss(count, w + step) <= before + 1e-9 or np.abs(step).max() < 1e-4:
                break
            step = step / 2
        w = w + step
    return w


def _best_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rising scores of a partition (s, n1, n0): its first, its rows by label, and the cut with fewest misses, the least of equals."""
    first, n1, n0, best = None, 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        s, a, c = (b.column(k).to_numpy() for k in ("s", "n1", "n0"))
        first = s[0] if first is None else first
        lost, dropped = n1 + np.cumsum(a) - a, n0 + np.cumsum(c) - c
        k = int(np.argmin(lost - dropped))
        if best is None or lost[k] - dropped[k] < best[0]:
            best = (int(lost[k] - dropped[k]), float(s[k]), int(lost[k] + dropped[k]))
        n1, n0 = n1 + int(a.sum()), n0 + int(c.sum())
    if best:
        yield pa.RecordBatch.from_pydict({"first": [float(first)], "n1": [n1], "n0": [n0], "misses": [best[0]], "cut": [best[1]], "below": [best[2]]})


def threshold(scores: DataFrame) -> tuple[float, int]:
    """The score of (s, y) at which a cut misses fewest labels, and the rows below it; every score is tried.

    A cut takes all rows of its score. Misses of label 0 from the cut on are those below it taken from a constant.
    """
    by = scores.groupBy("s").agg(F.sum("y").cast("long").alias("n1"), F.sum(1 - F.col("y")).cast("long").alias("n0"))
    parts = by.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(_best_cut, "first double, n1 long, n0 long, misses long, cut double, below long").collect()
    n1 = n0 = 0
    best = None
    for r in sorted(parts, key=lambda r: r["first"]):
        if best is None or n1 - n0 + r["misses"] < best[0]:
            best = (n1 - n0 + r["misses"], r["cut"], n1 + n0 + r["below"])
        n1, n0 = n1 + r["n1"], n0 + r["n0"]
    return best[1], best[2]


def train(rows: DataFrame) -> dict:
    """Model of all `rows` (y 0 or 1, x features), which are read several times.

    The threshold is the quantile of their scores at which fewest labels are missed.
    With one label only, every text scores on its side; without any, 1.
    """
    k = len(NAMES)
    sums = _total(rows, lambda x, y: np.concatenate([[y.sum(), len(y)], x.sum(0, dtype=float), (x.astype(float) ** 2).sum(0)]), 2 + 2 * k)
    n1, n = int(sums[0]), int(sums[1])
    model = {"n1": n1, "n0": n - n1, "w": None, "cut": 0.0, "only": float(n1 == n)}
    if n1 in (0, n):
        return model
    mean = sums[2 : 2 + k] / n
    sd = np.maximum(np.sqrt(np.maximum(sums[2 + k :] / n - mean**2, 0)), 1e-9)
    model |= {"cuts": quantiles(rows, n, np.linspace(0, 1, BINS + 1)[1:-1]), "mean": mean, "sd": sd}
    w = bradley_terry(rows, model, n1, n - n1)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(spread(_arrays(b), model["cuts"], mean, sd) @ w), b.column("y")], ["s", "y"])

    cut, below = threshold(rows.mapInArrow(raw, "s double, y int"))
    return model | {"w": w, "cut": cut, "quantile": below / n, "only": None}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1 that pass KEEP_AT where the raw score passes the threshold."""
    if model["w"] is None:
        return np.full(len(x), model["only"])
    raw = spread(x, model["cuts"], model["mean"], model["sd"]) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(raw + np.log(KEEP_AT / (1 - KEEP_AT)) + 1e-9, -40, 40)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of `docs`: the features of its whole text, written to the shared folder."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([np.array(features(t), np.float32) for t in b], dtype=object)

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("x")), "quality")


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The model of all rows (doc_id, x) that have a label and may be learnt from.

    Ids labelled twice count by the larger label; rows without id or label train nothing.
    Of rows of one id, those with other features train too, and equal ones once.
    """
    own = labels.where(is_training(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return train(materialise(rows.where(is_training(F.col("doc_id"))).distinct().join(own, "doc_id").select("y", "x"), "training"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    return learn(measured(docs), labels, label)


def scored(docs: DataFrame, labels: DataFrame, at_least: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    A null text counts as empty and is scored like any. Repeated rows give repeated
    results, a null id is not held out. Without labels every text scores 1.
    """
    rows = measured(docs)
    held = docs.sparkSession.sparkContext.broadcast(learn(rows, labels))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(apply(held.value, _arrays(b)))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))

"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of words. A word enters as the sum of a
hashed word vector and the mean of its hashed character n-grams; both are learnt.
A GRU reads each window in both directions, attention pools its states into one
vector, and a logistic unit scores it. A text scores as its worst window.

Trained in numpy on the driver, on a bounded sample of labelled rows: the label of
a text trains its worst window (and, for clean texts, a random one too). Vectors
start from the sample's log odds, so that training begins near a bag of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, is_training

WINDOW, STRIDE, WIDE = 32, 24, 24
GRAMS = (3, 5)
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"

#: Bounds of the training sample: rows of either label, and characters of a row (longer rows are not chosen).
SAMPLE_ROWS, SAMPLE_CHARS = (2000, 5000), 20_000


@dataclass
class Shape:
    words: int = 1 << 15
    grams: int = 1 << 15
    vector: int = 8
    state: int = 8
    attention: int = 8


def _units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (n x WIDE, zero-filled) and lengths of words in lower case without outer punctuation, with edge marks."""
    marked = [f"^{w.lower().strip(STRIP)[: WIDE - 2]}$" for w in words]
    m = np.array(marked, f"U{WIDE}").view(np.uint32).reshape(len(words), WIDE) if words else np.zeros((0, WIDE), np.uint32)
    return m, np.array([len(x) for x in marked], np.int64)


def word_features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket (n), n-gram buckets (n x g) and length (n); made in parts, kept in 16 bits (buckets are at most 65,536)."""
    parts = [_word_features(words[i : i + 8192], shape) for i in range(0, max(len(words), 1), 8192)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _word_features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = _units(words)
    m = m.astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    whole = np.zeros(len(m), np.uint64)
    for j in range(WIDE):
        whole = (whole ^ m[:, j]) * odd
        whole ^= whole >> np.uint64(29)
    ids = []
    for size in GRAMS:
        h = np.zeros((len(m), WIDE - size + 1), np.uint64)
        for j in range(size):
            h = (h ^ m[:, j : WIDE - size + 1 + j]) * odd
            h ^= h >> np.uint64(31)
        ids.append((h % np.uint64(shape.grams)).astype(np.uint16))
    return (whole % np.uint64(shape.words)).astype(np.uint16), np.concatenate(ids, 1), n.astype(np.int16)


def gram_weights(n: np.ndarray) -> np.ndarray:
    """Weights of a word's n-grams, which sum to 1; 0 for those beyond its end."""
    w = np.concatenate([np.arange(WIDE - size + 1)[None, :] <= (n - size)[:, None] for size in GRAMS], 1).astype(np.float32)
    return w / np.maximum(w.sum(1, keepdims=True), 1)


def split_words(text: str | None) -> list[str]:
    """Words at white space; a word too long for the character input is read as several, so nothing is left out."""
    words = (text or "").split()
    if len(words) and len(max(words, key=len)) > WIDE - 2:
        return [w[i : i + WIDE - 2] for w in words for i in range(0, len(w), WIDE - 2)]
    return words


def windows_of(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover `n` words; one window for a text without words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _direction(x: np.ndarray, u: np.ndarray, mask: np.ndarray, reverse: bool, keep: list | None) -> np.ndarray:
    """States (B x T x H) of one direction; x: inputs (B x T x 3H), projected already. keep: gets what training needs."""
    b, t, h3 = x.shape
    h = h3 // 3
    s, out = np.zeros((b, h), np.float32), np.empty((b, t, h), np.float32)
    for i in reversed(range(t)) if reverse else range(t):
        g = s @ u
        zr = _sigmoid(x[:, i, : 2 * h] + g[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(x[:, i, 2 * h :] + r * g[:, 2 * h :])
        new = s + (z * (c - s)) * mask[:, i, None]
        if keep is not None:
            keep.append((i, s, z, r, c, g[:, 2 * h :]))
        s = new
        out[:, i] = s
    return out


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; x: projected inputs (B x T x 6H), mask: 1 where there is a word."""
    h3 = x.shape[2] // 2
    kf, kb = ([], []) if keep is not None else (None, None)
    states = np.concatenate([_direction(x[:, :, :h3], p["uf"], mask, False, kf), _direction(x[:, :, h3:], p["ub"], mask, True, kb)], 2)
    a = np.tanh(states @ p["wa"])
    score = a @ p["va"] + (mask - 1) * np.float32(1e9)
    e = np.exp(score - score.max(1, keepdims=True)) * np.maximum(mask, np.float32(1e-6))
    alpha = e / e.sum(1, keepdims=True)
    pooled = (alpha[:, :, None] * states).sum(1)
    if keep is not None:
        keep.update(kf=kf, kb=kb, states=states, a=a, alpha=alpha, pooled=pooled)
    return pooled @ p["wo"] + p["bo"][0]


def _direction_back(d: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray, dx: np.ndarray, du: np.ndarray) -> None:
    """Backpropagation through time of `_direction`; d: gradient of its states, dx and du receive theirs."""
    h = u.shape[0]
    ds = np.zeros((len(mask), h), np.float32)
    for i, s, z, r, c, gc in reversed(kept):
        ds = ds + d[:, i]
        m = mask[:, i, None]
        dz, dc = ds * (c - s) * m, ds * z * m
        dc_in = dc * (1 - c * c)
        dr = dc_in * gc
        dzi, dri = dz * z * (1 - z), dr * r * (1 - r)
        dg = np.concatenate([dzi, dri, dc_in * r], 1)
        dx[:, i] = np.concatenate([dzi, dri, dc_in], 1)
        du += s.T @ dg
        ds = ds - ds * z * m + dg @ u.T


def backward(p: dict, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[np.ndarray, dict]:
    g = {"wo": keep["pooled"].T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["wo"]
    states, alpha, a = keep["states"], keep["alpha"], keep["a"]
    dstates = alpha[:, :, None] * dpooled[:, None, :]
    dalpha = (states * dpooled[:, None, :]).sum(2)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
    da = dscore[:, :, None] * p["va"] * (1 - a * a)
    g["va"] = (dscore[:, :, None] * a).sum((0, 1))
    g["wa"] = np.einsum("bth,bta->ha", states, da)
    dstates += da @ p["wa"].T
    h = p["uf"].shape[0]
    dx = np.empty((*mask.shape, 6 * h), np.float32)
    g["uf"], g["ub"] = np.zeros_like(p["uf"]), np.zeros_like(p["ub"])
    _direction_back(dstates[:, :, :h], keep["kf"], p["uf"], mask, dx[:, :, : 3 * h], g["uf"])
    _direction_back(dstates[:, :, h:], keep["kb"], p["ub"], mask, dx[:, :, 3 * h :], g["ub"])
    return dx, g


def vectors(p: dict, feats: tuple) -> np.ndarray:
    word, gram, n = feats
    return p["ew"][word] + np.einsum("ng,nge->ne", gram_weights(n), p["ec"][gram])


def project(p: dict, words: list[str], shape: Shape) -> np.ndarray:
    """Projected inputs of words (n x 6H), made in parts of bounded memory."""
    parts = [vectors(p, word_features(words[i : i + 4096], shape)) @ p["wx"] + p["bx"] for i in range(0, len(words), 4096)]
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, p["wx"].shape[1]), np.float32)


class Scorer:
    """Scores texts; remembers the projected inputs of up to `most` distinct words (and those of the texts at hand)."""

    def __init__(self, model: dict, most: int = 100_000):
        self.p, self.shape, self.most = model["p"], model["shape"], most
        self.shift, self.empty = model["shift"], model["empty"]
        self.clear()

    def clear(self):
        self.row: dict[str, int] = {}
        self.table = np.zeros((1, self.p["wx"].shape[1]), np.float32)
        self.n = 1

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        if self.n > self.most:
            self.clear()
        new = list({w for d in docs for w in d if w not in self.row})
        if new:
            need = self.n + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((need - len(self.table) + 20_000, self.table.shape[1]), np.float32)])
            self.table[self.n : need] = project(self.p, new, self.shape)
            self.row.update(zip(new, range(self.n, need), strict=True))
            self.n = need
        get = self.row.__getitem__
        return [np.fromiter(map(get, d), np.int32, len(d)) for d in docs]

    def window_logits(self, rows: list[np.ndarray], batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and the text each belongs to."""
        starts = [windows_of(len(r)) for r in rows]
        of = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
        base = np.cumsum([0, *(max(len(r), WINDOW) for r in rows)])
        flat = np.zeros(base[-1], np.int32)
        for r, a in zip(rows, base, strict=False):
            flat[a : a + len(r)] = r
        at = np.concatenate([s + a for s, a in zip(starts, base, strict=False)])
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), batch):
            idx = flat[at[i : i + batch, None] + np.arange(WINDOW)]
            out[i : i + batch] = forward(self.p, self.table[idx], (idx > 0).astype(np.float32))
        return out, of

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows = self.rows([split_words(t) for t in texts])
        logits, of = self.window_logits(rows)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, of, logits)
        worst[[len(r) == 0 for r in rows]] = self.shift + self.empty
        return 1 / (1 + np.exp(-np.clip(worst - self.shift, -60, 60)))


def _log_odds(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    return np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))


def train(texts: list[str], labels: np.ndarray, prior: float, shape: Shape = Shape(), epochs: int = 8, seed: int = 11) -> dict:
    """Fit the network to labelled texts. prior: the share of label 1 among all labelled rows, for the threshold.

    With fewer than two labels present, every text scores that label's side. A text
    without words shows nothing and scores the prior, on the clean side.
    """
    rng = np.random.default_rng(seed)
    e, h = shape.vector, shape.state
    normal = lambda *n: (rng.standard_normal(n) * 0.5 / np.sqrt(n[0])).astype(np.float32)
    p = {
        "ew": (rng.standard_normal((shape.words, e)) * 0.02).astype(np.float32), "ec": (rng.standard_normal((shape.grams, e)) * 0.02).astype(np.float32),
        "wx": normal(e, 6 * h), "bx": np.zeros(6 * h, np.float32), "uf": normal(h, 3 * h), "ub": normal(h, 3 * h),
        "wa": normal(2 * h, shape.attention), "va": normal(shape.attention), "wo": normal(2 * h), "bo": np.zeros(1, np.float32),
    }
    share = min(max(prior, 0.001), 0.4)
    model = {"p": p, "shape": shape, "shift": 0.0, "empty": float(np.log(share / (1 - share)))}
    y = np.asarray(labels).astype(int)
    if len(set(y.tolist())) < 2:
        p["wo"][:], p["bo"][0] = 0, 4.0 if len(y) and y[0] else -4.0
        return model
    # A text's words become numbers at once; only distinct words stay as strings.
    vocab: dict[str, int] = {}
    rows = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in split_words(t)], np.int32) for t in texts]
    feats = word_features(list(vocab), shape)
    seen = [np.zeros(len(vocab) + 1) for _ in range(2)]
    for r, k in zip(rows, y, strict=True):
        seen[k][np.unique(r)] += 1
    n1, n0 = int(y.sum()), int((1 - y).sum())
    for name, ids in (("ew", feats[0][:, None]), ("ec", feats[1])):
        size = len(p[name])
        by = [np.zeros(size), np.zeros(size)]
        used = np.zeros(size)
        for i in range(0, len(ids), 8192):
            there = np.ones((len(ids[i : i + 8192]), 1)) if name == "ew" else gram_weights(feats[2][i : i + 8192]) > 0
            used += np.bincount(ids[i : i + 8192].ravel(), minlength=size)
            for total, s in zip(by, (seen[1], seen[0]), strict=True):
                total += np.bincount(ids[i : i + 8192].ravel(), (s[1 + i : 8193 + i, None] * there).ravel(), size)
        p[name][:, 0] += np.clip(_log_odds(*by, *((n1, n0) if name == "ew" else (by[0].sum(), by[1].sum()))), -3, 3) * (0.7 if name == "ew" else 1.0)
        p[name][used == 0, 0] = 0
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step, rate = 0, 0.01
    scorer = Scorer(model)
    scorer.row = vocab

    def refresh() -> None:
        if len(scorer.table) <= len(vocab):
            scorer.table = np.zeros((len(vocab) + 1, 6 * h), np.float32)
        for i in range(0, len(vocab), 8192):
            scorer.table[1 + i : 8193 + i] = vectors(p, tuple(f[i : i + 8192] for f in feats)) @ p["wx"] + p["bx"]
        scorer.n = len(vocab) + 1

    starts = [windows_of(len(r)) for r in rows]
    first = np.cumsum([0, *(len(s) for s in starts)])
    for epoch in range(epochs):
        refresh()
        logits, of = scorer.window_logits(rows, 256)
        pick, want = [], []
        for d in range(len(rows)):
            own = logits[first[d] : first[d + 1]]
            pick.append((d, int(np.argmax(own))))
            want.append(y[d])
            if not y[d] and len(own) > 1:
                pick.append((d, int(rng.integers(len(own)))))
                want.append(0)
        order, want = rng.permutation(len(pick)), np.array(want, np.float32)
        for i in range(0, len(order), 256):
            some = order[i : i + 256]
            idx = np.zeros((len(some), WINDOW), np.int32)
            for j, k in enumerate(some):
                d, w = pick[k]
                r = rows[d][starts[d][w] : starts[d][w] + WINDOW]
                idx[j, : len(r)] = r
            mask = (idx > 0).astype(np.float32)
            local, back = np.unique(idx[idx > 0], return_inverse=True)
            part = tuple(f[local - 1] for f in feats)
            v = vectors(p, part)
            x = np.zeros((*idx.shape, 6 * h), np.float32)
            x[idx > 0] = (v @ p["wx"] + p["bx"])[back]
            keep: dict = {}
            logit = forward(p, x, mask, keep)
            err = (_sigmoid(logit) - (want[some] * 0.96 + 0.02)) / len(some)
            dx, g = backward(p, mask, keep, err.astype(np.float32))
            flat = dx[idx > 0]
            dproj = np.stack([np.bincount(back, flat[:, k], len(local)) for k in range(6 * h)], 1).astype(np.float32)
            g["wx"], g["bx"] = v.T @ dproj, dproj.sum(0)
            dv = dproj @ p["wx"].T
            g["ew"] = np.stack([np.bincount(part[0], dv[:, k], shape.words) for k in range(e)], 1)
            ids, weight = part[1].ravel(), gram_weights(part[2])
            g["ec"] = np.stack([np.bincount(ids, (weight * dv[:, k, None]).ravel(), shape.grams) for k in range(e)], 1)
            step += 1
            lr = rate * (0.5 if epoch >= epochs // 2 else 1)
            for k, grad in g.items():
                grad = grad.astype(np.float32)
                m1, m2 = mom[k]
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                p[k] -= np.float32(lr) * (m1 / np.float32(1 - 0.9**step)) / (np.sqrt(m2 / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    refresh()
    logits, of = scorer.window_logits(rows, 256)
    worst = np.full(len(rows), -np.inf)
    np.maximum.at(worst, of, logits)
    model["shift"] = threshold(worst, y, prior)
    return model


def threshold(score: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The middle of the widest-scoring gap region where the weighted errors, with label 1 weighted to `prior`, are fewest."""
    order = np.argsort(score)
    s, lab = score[order], y[order]
    w1, w0 = prior / max(1, lab.sum()), (1 - prior) / max(1, (1 - lab).sum())
    lost = np.concatenate(([0.0], np.cumsum(lab * w1)))  # label 1 under the cut
    kept = np.concatenate((np.cumsum(((1 - lab) * w0)[::-1])[::-1], [0.0]))  # label 0 above it
    err = lost + kept
    near = np.flatnonzero(err <= err.min() + 0.002)
    cuts = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    return float((cuts[near[0]] + cuts[near[-1]]) / 2)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], chars: int) -> tuple[DataFrame, float]:
    """A bounded sample (doc_id, text, y) of the labelled training rows, and the share of label 1 among all of them.

    rows: at most so many ids of label 1 and of label 0, chosen by a hash of the id;
    chars: rows with longer texts are left out of the sample. An id gives one text, the
    least of its own, however many rows repeat it. Ids labelled twice count by the
    larger label; rows without id or label train nothing.
    """
    own = labels.where(is_training(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    share = own.agg(F.avg("y")).first()[0] or 0.0
    ids = [own.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, rows[0]), (0, rows[1]))]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    return chosen.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), float(share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict:
    """The trained network; a text repeated in the sample trains once."""
    chosen, share = sample(docs, labels, label, rows, chars)
    got = chosen.select("doc_id", "text", "y").toArrow().to_pandas().sort_values(["doc_id", "text"], kind="stable").drop_duplicates("text")
    texts, y = got["text"].tolist(), got["y"].to_numpy()
    del got
    return train(texts, y, share)


def scoring(docs: DataFrame, model: dict):
    """A column function text -> score; only the texts go to Python, and each is read whole."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: the shape of the network

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for b in batches:
            parts = [scorer(b.iloc[i : i + 500].tolist()) for i in range(0, len(b), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) per row of `docs` (doc_id, text): 0 to 1, higher for toxic; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scoring(docs, model)(F.col("text")).alias("score"))


def scored(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; an empty table gives no rows, without labels nothing is toxic."""
    return score(docs, fit(docs, labels)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, that score under `at_least`; each row is scored where it stands."""
    return docs.where(scoring(docs, fit(docs, labels))(F.col("text")) < at_least)

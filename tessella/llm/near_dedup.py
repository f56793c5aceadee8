"""Near-duplicate classes by ProbMinHash, banding and verification.

A text's weighted set is its shingles of five words with their counts. ProbMinHash
draws, for every shingle, a Poisson process whose rate is its weight; each arrival
goes to a random register, which keeps its earliest, and a shingle stops as soon as
its next arrival is later than every register's. Two texts agree in a register with
their probability Jaccard similarity. Bands of registers propose candidates;
candidates are verified exactly on the whole texts.

Texts with equal word sequences are one node. In a bucket every node is compared
with the bucket's hub, the node that shares buckets with most others (an original
among its edited copies), which costs a line per node however large the bucket.
After the classes that follow, only buckets that still hold two classes or more
compare their nodes across classes, so a link that the hubs missed is found: small
buckets pair by pair; large ones, grouped by hub, in tiles of bounded size, whose
similarities are a matrix product inside a task that emits nothing but links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, join_by_size, materialise, mix64, semi_by_size

#: Words of a shingle; least similarity; bands and registers of each. A pair at 0.8 shares no band with probability 3e-6.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 5

#: Links up to which one task finds their classes (16 MB of ids); beyond, rounds of joins do.
ONE_TASK = 1_000_000

#: Nodes of a bucket up to which its pairs are listed, nodes of a tile, and columns of a tile's matrix at a time.
SMALL, TILE, COLUMNS = 24, 512, 8192

#: Pairs of a hub that one task verifies, about.
PART = 256

_ODD = [np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(7).integers(1, 2**62, 64)]


def _hasher():
    return BoundedCache(lambda w: xxhash.xxh64_intdigest(w) >> 2, 200_000)


def shingles(text: str | None, known: dict, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and their counts. Words are split at white space, case folded.

    A text of fewer words is one shingle, a text without words none.
    """
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    w = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)
    k = min(n_words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _ODD[j]
    return np.unique(mix64(h), return_counts=True)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """ProbMinHash signatures (sets x m) of weighted sets; all zero for an empty set."""
    n = len(sets)
    sig, best = np.zeros((n, m), np.uint64), np.full((n, m), np.inf)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    if not len(doc):
        return sig
    e, w = np.concatenate([h for h, _ in sets]), np.concatenate([c for _, c in sets]).astype(float)
    x, i = np.zeros(len(e)), 0
    flat_best, flat_sig = best.ravel(), sig.ravel()
    while len(doc):
        r = mix64(e + np.uint64((2 * i + 1) * 0xD1342543DE82EF95 % 2**64))
        x = x - np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / w
        at = doc * m + (mix64(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat_best, at, x)
        won = x == flat_best[at]
        flat_sig[at[won]] = e[won]
        live, back = np.unique(doc, return_inverse=True)
        latest = best[live].max(1)
        on = x < latest[back]
        doc, e, w, x, i = doc[on], e[on], w[on], x[on], i + 1
    return sig


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard: the sum over shared shingles d of 1 / sum over d' of max(x'/x_d, y'/y_d)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    keys = np.union1d(ha, hb)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, ha)], y[np.searchsorted(keys, hb)] = wa, wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    rs, xs, ys = ratio[order], x[order], y[order]
    above = np.cumsum(xs[::-1])[::-1]  # x of shingles with a ratio at least as high
    below = np.concatenate(([0.0], np.cumsum(ys)))
    first = np.searchsorted(rs, ratio[both], "left")
    total = above[np.minimum(first, len(rs) - 1)] / x[both] + below[first] / y[both]
    return float((1 / total).sum())


def _signer(n_words: int, bands: int, rows: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _hasher()
        for b in batches:
            for a in range(0, len(b), 1000):
                part = b.iloc[a : a + 1000]
                sets = [shingles(t, known, n_words) for t in part["text"]]
                sig = prob_minhash(sets, bands * rows).reshape(len(sets), bands, rows)
                h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sets), 1), np.uint64)
                for j in range(rows):
                    h = mix64(h ^ sig[:, :, j])
                keys = [hashlib.md5(" ".join((t or "").lower().split()).encode()).hexdigest() for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "key": keys, "bands": [list(x) if len(s[0]) else None for x, s in zip(h.view(np.int64), sets, strict=True)]})

    return sign


def _verifier(n_words: int, least: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _hasher()
        held = BoundedCache(lambda t: shingles(t, known, n_words), 256)
        for p in batches:
            ok = [similarity(held[s], held[t]) >= least - 1e-9 for s, t in zip(p["text_a"], p["text_b"], strict=True)]
            yield p.loc[ok, ["a", "b"]]

    return verify


def _blobs(n_words: int):
    def blob(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _hasher()
        for b in batches:
            sets = [shingles(t, known, n_words) for t in b["text"]]
            yield pd.DataFrame({"node": b["doc_id"].to_numpy(), "hashes": [h.astype("<u8").tobytes() for h, _ in sets], "counts": [c.astype("<u4").tobytes() for _, c in sets]})

    return blob


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted hash sets, rows x cols, as products of 0/1 matrices a run of columns at a time."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[at] > 1  # what one set alone has is shared by none
    _, at = np.unique(at[keep], return_inverse=True)
    of = of[keep]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, z = np.searchsorted(at, (lo, lo + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[of[a:z], at[a:z] - lo] = 1
        out += m[rows] @ m[cols].T
    return out


def _tile_links(least: float):
    """Links across classes among the nodes of two tiles (or of one): a spanning set of them."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates(["node", "side"])
        one = g["t"].iloc[0] == g["u"].iloc[0] and not g["main"].iloc[0]
        g = g.drop_duplicates("node") if one else g
        side, node, kind = g["side"].to_numpy(), g["node"].to_numpy(np.int64), g["class"].to_numpy(np.int64)
        sets = [np.frombuffer(x, "<u8") for x in g["hashes"]]
        counts = [np.frombuffer(x, "<u4").astype(float) for x in g["counts"]]
        rows, cols = (np.arange(len(g)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(rows) or not len(cols):
            return pd.DataFrame({"a": [], "b": []})
        both = shared_counts(sets, rows, cols)
        size = np.array([len(x) for x in sets], float)
        plain = np.array([len(c) > 0 and c.max() == 1 for c in counts])
        across = (kind[rows][:, None] != kind[cols][None, :]) & (both > 0)
        # Where every count is 1 the similarity is the plain Jaccard one; other pairs are worked out in full.
        easy = plain[rows][:, None] & plain[cols][None, :]
        near = across & easy & (both / (size[rows][:, None] + size[cols][None, :] - both) >= least - 1e-9)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for hard in (False, True):
            for i, j in zip(*np.nonzero(across & ~easy if hard else near), strict=True):
                p, q = int(rows[i]), int(cols[j])
                x, y = find(int(kind[p])), find(int(kind[q]))
                if x != y and (not hard or similarity((sets[p], counts[p]), (sets[q], counts[q])) >= least - 1e-9):
                    parent[max(x, y)] = min(x, y)
                    out.append((min(node[p], node[q]), max(node[p], node[q])))
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def _across_large(docs: DataFrame, placed: DataFrame, n_words: int, least: float) -> DataFrame:
    """Links across classes in large buckets. Nodes that share a large bucket meet in its hub's group.

    placed: (hub, node, class). A group's nodes of the hub's own class are tiled apart
    from the others, and two tiles of that class never meet.
    """
    rows = materialise(placed.distinct(), "large")
    main = materialise(rows.where("node = hub").select("hub", F.col("class").alias("main_class")), "main")
    n_hubs = main.count()
    if not n_hubs:
        return rows.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # Hubs have more than SMALL nodes each; what is known of a hub comes to its nodes, which stay where they are.
    tagged = join_by_size(rows, main, "hub", n_hubs).withColumn("main", F.col("class") == F.col("main_class"))
    tiles = lambda c: F.ceil(F.count_if(c) / TILE).cast("int")
    sizes = materialise(tagged.groupBy("hub").agg(tiles(F.col("main")).alias("tm"), tiles(~F.col("main")).alias("to")), "sizes")
    at = join_by_size(tagged, sizes, "hub", n_hubs).where("to > 0").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("tm")).otherwise(F.col("to"))).cast("int"))
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda main, t, u, side: F.struct(main.alias("main"), t.alias("t"), u.alias("u"), side.alias("side"))
    yes, no = F.lit(True), F.lit(False)
    own = F.col("own")
    of_main = F.transform(each(F.col("to")), lambda u: key(yes, own, u, F.lit(0)))
    to_main = F.transform(each(F.col("tm")), lambda t: key(yes, t, own, F.lit(1)))
    to_other = F.transform(each(F.col("to")), lambda u: key(no, F.least(own, u), F.greatest(own, u), F.when(own <= u, 0).otherwise(1)))
    met = at.select("hub", "node", "class", F.explode(F.when(F.col("main"), of_main).otherwise(F.concat(to_main, to_other))).alias("k")).select("hub", "node", "class", "k.*")
    ids = materialise(rows.select(F.col("node").alias("doc_id")).distinct(), "ids")
    blobs = semi_by_size(docs, ids, "doc_id", ids.count()).mapInPandas(_blobs(n_words), "node long, hashes binary, counts binary")
    return met.join(blobs, "node").groupBy("hub", "main", "t", "u").applyInPandas(_tile_links(least), "a long, b long")


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"node": np.array(nodes, np.int64), "class": np.array([find(x) for x in nodes], np.int64)})


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, class): the smallest node connected to each node of `edges` (a, b), loops left out.

    Up to `one_task` links (ONE_TASK by default) are joined by one task; more by alternating large and
    small stars, each round of which is written to the shared folder. Rounds grow with
    the logarithm of the longest chain. Both ways give the same classes.
    """
    links = edges.where("a <> b")
    if links.count() <= (ONE_TASK if one_task is None else one_task):
        return links.coalesce(1).mapInPandas(_union_find, "node long, class long")
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        near = both(e)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        e = materialise(small, "edges")
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark:
            break
        mark = (n, total)
    return e.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())


def near_classes(docs: DataFrame, n_words: int = WORDS, least: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for each row of `docs` (doc_id, text).

    class_id is the smallest doc_id of the rows whose texts are connected by links of
    probability Jaccard >= `least`. A text without words (null, empty) is alone in its
    class. Rows with one doc_id are one document. A null doc_id belongs to no class:
    its row has a null class_id. Repeated rows give repeated results.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = materialise(named.where("doc_id is not null").mapInPandas(_signer(n_words, bands, rows), "doc_id long, key string, bands array<long>"), "signed")
    member = signed.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("key")).alias("key"))
    nodes = signed.where("bands is not null").groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("n"))
    buckets = materialise(nodes.select(F.col("n.doc_id").alias("node"), F.explode("n.bands").alias("bucket")), "buckets")
    # Written, so that the joins below are between plain tables, whose hot buckets the engine can split.
    size = materialise(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "size")
    shared = materialise(buckets.join(size, "bucket"), "shared")
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = shared.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("hub")).select("bucket", (-F.col("hub.minus")).alias("hub"))
    hubs = materialise(hubs, "hubs")
    star = shared.join(hubs, "bucket").where("node <> hub").groupBy(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).agg(F.min("hub").alias("hub"))
    tried = materialise(star, "star")
    keys = member.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"))
    linked = materialise(_verified(named, tried, n_words, least), "linked")
    first = materialise(components(linked), "classes")
    placed = shared.join(first, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    mixed = materialise(placed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n"), "mixed")
    open_ = materialise(placed.join(mixed, "bucket"), "open")
    few = open_.where(F.col("n") <= SMALL)
    left, right = few.select("bucket", F.col("node").alias("a"), F.col("class").alias("ca")), few.select("bucket", F.col("node").alias("b"), F.col("class").alias("cb"))
    across = left.join(right, "bucket").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti").withColumn("hub", F.col("a"))
    of_hubs = open_.where(F.col("n") > SMALL).join(hubs, "bucket").select("hub", "node", "class")
    more = materialise(_verified(named, materialise(across, "across"), n_words, least).unionByName(_across_large(named, of_hubs, n_words, least)), "more")
    merged = first if more.isEmpty() else components(linked.unionByName(more))
    of_key = keys.join(merged.withColumnRenamed("class", "class_id"), "node", "left").select("key", F.coalesce("class_id", "node").alias("class_id"))
    out = member.join(of_key, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    nobody = named.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nobody)


def _verified(docs: DataFrame, pairs: DataFrame, n_words: int, least: float) -> DataFrame:
    """The `pairs` (a, b, hub: one of both) whose texts are similar enough.

    A pair moves with the text of its other node; the hub's text moves once for every
    part of at most PART pairs, so a hub of many pairs is neither copied to each nor
    read by one task. Texts that no pair names are not shuffled if the pairs are few.
    """
    n_pairs = pairs.count()
    own = pairs.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"))
    hubs = materialise(own.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "hubs")
    many = hubs.where("parts > 1")
    of = join_by_size(own, many, "hub", many.count(), "left").select("hub", "node", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    text = lambda name: docs.select(F.col("doc_id").alias(name), "text")
    nodes = join_by_size(text("node"), of, "node", 3 * n_pairs).select("hub", "part", "node", F.col("text").alias("text_b"))
    centres = join_by_size(text("hub"), hubs, "hub", 2 * hubs.count()).dropDuplicates(["hub", "text"]).select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("text_a"))
    met = nodes.join(centres, ["hub", "part"]).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "text_a", "text_b")
    return met.mapInPandas(_verifier(n_words, least), "a long, b long")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that stay, with all columns: of each class the row with its smallest doc_id (one, if its
    rows repeat), and every row without an id."""
    classes = materialise(near_classes(docs.select("doc_id", "text"), **how), "classes")
    gone = materialise(classes.where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    again = materialise(classes.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    n = gone.count() + again.count()
    small = (lambda d: F.broadcast(d)) if n <= 1_000_000 else (lambda d: d)
    kept = docs.join(small(gone), "doc_id", "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(small(again), "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))

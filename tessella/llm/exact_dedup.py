"""Exact dedup by Golomb-coded fingerprint exchange.

1. Every partition hashes its normalised texts and sends each *owner* (a range of
   the fingerprint space) one message: its sorted distinct fingerprints, as
   Golomb-Rice coded gaps, with a bit for those it holds more than once itself.
2. An owner decodes its messages and answers each with a bitmap: which of the
   sent fingerprints somebody else holds too, or the sender holds twice.
3. A sender maps its bitmaps back to its rows. Only rows so marked (suspects)
   have their texts shuffled, grouped by the bytes themselves.

A fingerprint travels once per partition however many copies the partition has,
so a group of copies with a third of all rows costs an owner one entry per
sender. Texts are compared in full: equal fingerprints alone merge nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, semi_by_size

#: What normalisation deletes: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"

#: Names (an id and 32 bytes each) that are broadcast at most.
FEW = 200_000

#: Fingerprints an owner is meant to receive.
PER_OWNER = 500_000


def normalised(text) -> object:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of sorted distinct uint64 `values`: gaps split into a unary quotient and `k` remainder bits."""
    gaps = np.diff(values, prepend=np.uint64(0))
    high, low = gaps >> np.uint64(k), gaps & np.uint64((1 << k) - 1)
    unary = np.ones(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high.astype(np.int64) + 1) - 1] = 0
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    coded = np.packbits(unary)
    return np.array([len(gaps), k, len(coded)], "<u4").tobytes() + coded.tobytes() + np.packbits(bits.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k, size = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, 12))
    ends = np.flatnonzero(unary == 0)[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=12 + size))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def rice_parameter(n: int, span: float) -> int:
    """Remainder bits for `n` values spread over `span`: the logarithm of the mean gap."""
    return int(min(56, max(0, np.floor(np.log2(max(1.0, span / max(n, 1)))))))


def owner_of(fp: np.ndarray, owners: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


SENT = "kind int, pid int, doc_id long, sha string, alt long, fp long, n_cp long, owner long, blob binary, twice binary"


def _sender(owners: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, seen = TaskContext.get().partitionId(), []
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            seen.append(fp.view(np.uint64))
            yield b.assign(kind=0, pid=pid, owner=None, blob=None, twice=None)[[c.split()[0] for c in SENT.split(", ")]]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        to = owner_of(values, owners)
        edges = np.flatnonzero(np.diff(to, prepend=np.uint64(owners)))
        rows = []
        for a, z in zip(edges, [*edges[1:], len(values)], strict=True):
            k = rice_parameter(z - a, 2.0**64 / owners)
            rows.append((int(to[a]), rice_encode(values[a:z] - base_of(int(to[a]), owners), k), np.packbits(counts[a:z] > 1).tobytes()))
        out = pd.DataFrame(rows, columns=["owner", "blob", "twice"])
        yield out.assign(kind=1, pid=pid, doc_id=None, sha=None, alt=None, fp=None, n_cp=None)[[c.split()[0] for c in SENT.split(", ")]]

    return send


def base_of(owner: int, owners: int) -> np.uint64:
    """The smallest fingerprint that `owner` owns."""
    return np.uint64(-(-(owner << 32) // owners) << 32)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(x) for x in group["blob"]]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(v)].astype(bool) for x, v in zip(group["twice"], lists, strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    marks = [np.packbits(f | np.isin(v, shared, assume_unique=True)).tobytes() for v, f in zip(lists, flags, strict=True)]
    return pd.DataFrame({"pid": group["pid"], "owner": group["owner"], "marks": marks})


def _marked(owners: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pid, owner, blob, marks in b[["pid", "owner", "blob", "marks"]].itertuples(index=False):
                v = rice_decode(blob)
                hit = v[np.unpackbits(np.frombuffer(marks, np.uint8))[: len(v)].astype(bool)] + base_of(int(owner), owners)
                if len(hit):
                    yield pd.DataFrame({"pid": pid, "fp": hit.view(np.int64)})

    return read


def exact_dedup(docs: DataFrame, per_owner: int = PER_OWNER) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting space and tab to carriage return;
    of equal texts the one with the most code points before that stays, ties going
    to the smallest doc_id (a null id comes last). A null text counts as empty, so
    all null and blank texts form one group. Rows that repeat an id and text are
    all counted and all report kept alike. An empty table gives no rows; other
    columns of `docs` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.char_length(text).cast("long").alias("n_cp"))
    sha = F.sha2("norm", 256)
    fps = own.select("doc_id", sha.alias("sha"), F.xxhash64("norm").alias("alt"), F.xxhash64(sha).alias("fp"), "n_cp")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // per_owner))
    sent = materialise(fps.mapInPandas(_sender(owners), SENT), "sent")
    rows = sent.where("kind = 0").select("pid", "doc_id", "sha", "alt", "fp", "n_cp")
    messages = sent.where("kind = 1").select("pid", "owner", "blob", "twice")
    bitmaps = messages.groupBy("owner").applyInPandas(_answer, "pid int, owner long, marks binary")
    marked = messages.select("pid", "owner", "blob").join(bitmaps, ["pid", "owner"]).mapInPandas(_marked(owners), "pid int, fp long")
    suspects = materialise(rows.join(marked, ["pid", "fp"], "left_semi").groupBy("sha", "alt", "fp").agg(F.min(F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), "doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size")), "suspects")
    n = suspects.count()
    texts = semi_by_size(own.select("norm", F.xxhash64(sha).alias("fp")), suspects.select("fp").distinct(), "fp", n)
    # Grouping by the text itself compares bytes; partial groups shrink the copies of a partition before the shuffle.
    equal = texts.groupBy("norm").count().select(sha.alias("sha"), F.xxhash64("norm").alias("alt"), F.col("count").alias("n_equal"))
    groups = suspects.join(equal, ["sha", "alt"]).select(
        "sha", "alt", F.col("best.doc_id").alias("best_id"),
        F.when(F.col("group_size") == F.col("n_equal"), F.col("group_size")).otherwise(F.raise_error(F.lit("two different texts share a 320-bit digest")).cast("long")).alias("group_size"),
    )
    out = rows.join(groups, ["sha", "alt"], "left")
    lone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | F.col("doc_id").eqNullSafe(F.col("best_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows repeating an id and text one stays.

    The rows that go are named by id and digest; if they are few (`FEW`, checked) each
    row is judged where it stands, else rows and names are shuffled together.
    """
    judged = materialise(exact_dedup(docs.select("doc_id", "text")).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "judged")
    gone = judged.where("not kept").select("doc_id", "sha").distinct()
    again = materialise(judged.where("kept").groupBy("doc_id", "sha").count().where("count > 1").select("doc_id", "sha"), "again")
    own = docs.withColumn("_sha", F.unhex(F.sha2(normalised(F.col("text")), 256)))

    def named(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
        side = names.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_of"))
        side = F.broadcast(side) if names.count() <= FEW else side
        return rows.join(side, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_sha"] == F.col("_of")), how)

    kept = named(own, gone, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = named(kept, again, "left_anti").select(*docs.columns)
    return once.unionByName(named(kept, again, "left_semi").dropDuplicates(["doc_id", "_sha"]).select(*docs.columns))

"""Token counts per document from flat token files without an index.

A flat token file is nothing but token ids, each document ended by a separator.
It is read in blocks that may begin and end anywhere. Every block finds its
separators with one vectorised comparison; a prefix scan over the blocks'
summaries (tokens, separators, place of the last separator) then tells each
block the number of its first document and how many tokens of it came before.
The scan has two levels, runs of `RUN` blocks and the runs of a file, so no task
sorts more than `RUN` summaries or a file's runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import chunk_encoder
from .common import materialise

#: Bytes of a block; blocks of a run for the two-level scan.
BLOCK_BYTES = 1 << 18
RUN = 512

BLOCKS = "file string, block long, bytes binary"


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (file, block, bytes) of flat token files; the files' bytes are sliced by the JVM, up to 2 GB a file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    at = files.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(0L, (length - 1) div {block_bytes}))")))
    return at.select(F.col("path").alias("file"), "block", F.expr(f"substring(content, cast(block * {block_bytes} + 1 as int), {block_bytes})").alias("bytes"))


def token_files(docs: DataFrame, path: str, pattern: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` (doc_id, text) as flat token files, one per partition, cut into blocks of `block_bytes` (the last is shorter).

    Ids are unsigned 16-bit where the separator fits, as it does for the public
    vocabularies. Rows with `bytes` null are the side list (file, block: the
    document's number in its file, doc_id) that only names documents in the end.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, file, seen, block, rest = chunk_encoder(path, pattern), f"part-{TaskContext.get().partitionId():06d}", 0, 0, b""
        for b in batches:
            names, size = b["doc_id"].tolist(), 0
            parts = [rest]
            for text in b["text"].tolist():
                parts.append(np.array([*encode(text), separator], "<u2" if separator < 1 << 16 else "<u4").tobytes())
            rest = b"".join(parts)
            full = len(rest) // block_bytes
            out = [rest[k * block_bytes : (k + 1) * block_bytes] for k in range(full)]
            yield pd.DataFrame({"file": file, "block": np.arange(block, block + full), "bytes": out, "doc_id": None})
            rest, block = rest[full * block_bytes :], block + full
            ids = pd.array([None if i is None or i != i else int(i) for i in names], "Int64")
            yield pd.DataFrame({"file": file, "block": np.arange(seen, seen + len(names)), "bytes": None, "doc_id": ids})
            seen += len(names)
        if rest:
            yield pd.DataFrame({"file": [file], "block": [block], "bytes": [rest], "doc_id": [None]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(write, BLOCKS + ", doc_id long")


def _scan(separator: int, wide: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, ends = [], []
            for raw in b["bytes"]:
                ids = np.frombuffer(raw, "<u4" if wide else "<u2")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pd.DataFrame({"file": b["file"], "block": b["block"], "n": np.array(n, np.int64), "ends": ends})

    return scan


def count_tokens(blocks: DataFrame, separator: int, wide: bool = False) -> DataFrame:
    """(file, number, n_tokens, closed) per document of the flat token `blocks` (file, block, bytes).

    n_tokens leaves out the separator. What follows a file's last separator is a
    document too (closed is false) if it has tokens. Separators side by side
    are empty documents. A null or empty block counts as no tokens; blocks are in
    the order of their numbers, which may have gaps. No blocks, no rows.
    """
    b = blocks.where(F.length("bytes") > 0).select("file", F.col("block").cast("long").alias("block"), "bytes").mapInPandas(_scan(separator, wide), "file string, block long, n long, ends array<long>")
    b = materialise(b, "scanned").withColumn("run", F.expr(f"block div {RUN}"))
    one = b.select("file", "run", "block", "n", F.size("ends").cast("long").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    w = W.partitionBy("file", "run").orderBy("block")
    inside = one.select("file", "run", "block", "n", "k", "last", F.coalesce(F.sum("n").over(before(w)), F.lit(0)).alias("n_in"), F.coalesce(F.sum("k").over(before(w)), F.lit(0)).alias("k_in"))
    inside = inside.withColumn("at", F.col("n_in") + F.col("last")).withColumn("at_in", F.last("at", ignorenulls=True).over(before(w)))
    runs = inside.groupBy("file", "run").agg(F.sum("n").alias("rn"), F.sum("k").alias("rk"), F.max("at").alias("rat"))
    v = W.partitionBy("file").orderBy("run")
    runs = runs.select("file", "run", "rn", "rat", F.coalesce(F.sum("rn").over(before(v)), F.lit(0)).alias("n_run"), F.coalesce(F.sum("rk").over(before(v)), F.lit(0)).alias("k_run"))
    runs = runs.withColumn("at_run", F.last(F.col("n_run") + F.col("rat"), ignorenulls=True).over(before(v)))
    placed = inside.join(runs.select("file", "run", "n_run", "k_run", "at_run"), ["file", "run"]).select(
        "file", "block", (F.col("n_run") + F.col("n_in")).alias("base"), (F.col("k_run") + F.col("k_in")).alias("first"),
        F.coalesce(F.col("n_run") + F.col("at_in"), F.col("at_run"), F.lit(-1)).alias("prev"),
    )
    docs = b.where(F.size("ends") > 0).select("file", "block", "ends").join(placed, ["file", "block"])
    each = docs.select("file", "base", "first", "prev", F.posexplode("ends").alias("i", "end"), F.col("ends").alias("all"))
    closed = each.select("file", (F.col("first") + F.col("i")).alias("number"), (F.col("base") + F.col("end") - F.when(F.col("i") == 0, F.col("prev")).otherwise(F.col("base") + F.expr("all[i - 1]")) - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = runs.join(inside.groupBy("file").agg(F.sum("k").alias("number")), "file").groupBy("file", "number").agg(F.max(F.col("n_run") + F.col("rn")).alias("n"), F.max(F.col("n_run") + F.col("rat")).alias("last"))
    open_ = tail.select("file", "number", (F.col("n") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(open_)


def document_token_counts(docs: DataFrame, path: str, pattern: str, separator: int) -> DataFrame:
    """doc_id, file, number, n_tokens per row of `docs`, counted from the flat token files written for them; null text: 0 tokens."""
    files = materialise(token_files(docs, path, pattern, separator), "tokens")
    counts = count_tokens(files.where("bytes is not null").select("file", "block", "bytes"), separator)
    names = files.where("bytes is null").select("file", F.col("block").alias("number"), "doc_id")
    return names.join(counts.where("closed"), ["file", "number"]).select("doc_id", "file", "number", "n_tokens")

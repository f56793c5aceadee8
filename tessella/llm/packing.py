"""Vector best-fit packing of token pieces into sequences.

A piece is a vector: its tokens, one document, and its attention cost (tokens
squared). A bin has a capacity of each. Pieces are taken by falling size; a piece
goes to the open bin, among those with room in every dimension, for which the
weighted dot product of piece and residual is least wasteful (or the norm of the
residual left is smallest), else to a new bin.

Pieces are dealt by hash into shards of bounded size, which pack independently;
bins that a shard leaves with much room are broken up, dealt anew into fewer
shards and packed once more. Full pieces are sequences by themselves.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, materialise

#: Pieces of a shard, about; more pack tighter, but each piece looks at every open bin.
PER_SHARD = 4096

#: White space for str.split that the tokenizer's own rules do not count as such, and the strings of special tokens.
_ODD = re.compile("[\x1c-\x1f]|<\\|(?:startoftext|endoftext)\\|>")

_WORD_END = b"\xff"  # a byte that UTF-8 text never has


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def merges(path: str):
    """The tokenizer's merges for a faster engine, or None if its file has other rules than lower-case words with an end mark.

    Ids of such a vocabulary are merge ranks, so a word's bytes and an end byte, which
    merges with the last one first, give the same ids. `word_encoder` is tested
    against the tokenizer itself.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    if rules["model"].get("end_of_word_suffix") != "</w>" or rules["model"]["type"] != "BPE":
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in rules["added_tokens"]}
    ranks = {}
    for token, i in rules["model"]["vocab"].items():
        if token not in special:
            body, mark = token.removesuffix("</w>"), _WORD_END if token.endswith("</w>") else b""
            ranks[bytes(shown[c] for c in body) + mark] = i
    names = list(rules["model"]["vocab"])
    if any(rules["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] != 512 + i for i, m in enumerate(rules["model"]["merges"])) or len(names) < 512:
        return None
    return tiktoken.Encoding(path, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


#: The tokenizer's own split of a word (fixed pattern of the vocabulary file).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def word_encoder(path: str, most: int = 250_000):
    """text -> bytes of little-endian unsigned 32-bit ids, as `encode(text, add_special_tokens=False)`.

    The tokenizer drops white space and none of its rules looks across it, so a text
    is encoded word by word, with up to `most` words remembered. Words of Latin
    letters go to the merges directly, others to the tokenizer; a text with
    separators or special strings that break this is encoded whole.
    """
    full, piece = tokenizer(path), merges(path)

    pack = lambda ids: np.array(ids, "<u4").tobytes()

    def word(w: str) -> bytes:
        if piece is None or max(w) >= "\u0250":
            return pack(full.encode(w, add_special_tokens=False).ids)
        w = w.lower()
        if w.isalpha():
            return pack(piece(w.encode() + _WORD_END))
        return pack([i for p in _SPLIT.findall(w) for i in piece(p.encode() + _WORD_END)])

    known = BoundedCache(word, most)

    def ids(text: str | None) -> bytes:
        if _ODD.search(text or ""):
            return pack(full.encode(text, add_special_tokens=False).ids)
        return b"".join(map(known.__getitem__, (text or "").split()))

    return ids


def pieces(docs: DataFrame, path: str, most: int, end: int = 0) -> DataFrame:
    """Pieces of every row of `docs` (doc_id, text): its ids, then `end`, cut every `most` tokens if longer than that.

    A null or empty text is the one id `end`. Repeated rows and null ids keep their pieces.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = word_encoder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                ids = encode(text) + last
                i = None if i is None or i != i else int(i)
                out += [(i, k, k * most, len(x := ids[4 * k * most : 4 * (k + 1) * most]) // 4, zlib.crc32(x)) for k in range(-(-len(ids) // (4 * most)))]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights=(1.0, 1e-3, 1e-3), rule: str = "dot") -> np.ndarray:
    """The bin of each piece. Pieces are vectors (length, 1, length squared); bins hold (tokens, documents, cost).

    rule "dot": the bin with the smallest weighted dot product of piece and
    residual, both as shares of capacity; "norm": the smallest weighted norm of what
    would be left. Both keep every constraint; ties go to the older bin.
    """
    cap, w = np.array([tokens, documents, cost], float), np.array(weights)
    items = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    left, bins = np.zeros((len(items), 3)), np.zeros(len(items), np.int64)
    open_, n = np.zeros(0, np.int64), 0
    least = items.min(0) if len(items) else cap
    for j in np.argsort(-lengths, kind="stable"):
        item = items[j]
        room = left[open_]
        fits = (room >= item).all(1)
        if fits.any():
            at = np.flatnonzero(fits)
            share = room[at] / cap
            score = share @ (w * item / cap) if rule == "dot" else ((share - item / cap) ** 2) @ w
            k = open_[at[int(np.argmin(score))]]
            left[k] -= item
        else:
            k, n = n, n + 1
            left[k] = cap - item
            open_ = np.append(open_, k)
        bins[j] = k
        if (left[k] < least).any():
            open_ = open_[open_ != k]
    return bins


def pack(items: DataFrame, n_items: int, tokens: int = 2048, documents: int | None = None, cost: int | None = None, rule: str = "dot", per_shard: int = PER_SHARD, loose: float = 0.03) -> DataFrame:
    """`items` (length and any other columns; a piece is at most `tokens` long) with sequence_id and offset.

    documents and cost bound the documents and the sum of squared lengths of a
    sequence; by default they are as wide as `tokens` alone allows. n_items sizes
    the shards and need not be exact. Sequences with over `loose` of their tokens
    free after the first round are packed again. Offsets leave no gaps.
    """
    documents, cost = documents or tokens, cost or tokens * tokens
    items = materialise(items, "pieces")  # read twice below, and making pieces is the dear part
    shards = max(1, -(-n_items // per_shard))
    again = max(1, shards // 16)
    names = [f for f in items.columns]
    kinds = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)

    def packed(level: int):
        def shard(key, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values([c for c in ("length", "doc_id", "piece") if c in g], ascending=False, kind="stable").reset_index(drop=True)
            n = g["length"].to_numpy(np.int64)
            bins = best_fit(n, tokens, documents, cost, rule=rule)
            order = np.argsort(bins, kind="stable")
            run, b = np.cumsum(n[order]) - n[order], bins[order]
            first = np.flatnonzero(np.diff(b, prepend=-1))
            offset = np.empty(len(n), np.int64)
            offset[order] = run - np.repeat(run[first], np.diff(np.append(first, len(b))))
            g["sequence_id"] = ((level << 60) + (int(key[0]) << 32)) + bins
            g["offset"] = offset
            g["_free"] = (tokens - np.bincount(bins, n, minlength=1)[bins]) / tokens
            return g[[*names, "sequence_id", "offset", "_free"]]

        return shard

    out = f"{kinds}, sequence_id long, offset long, _free double"
    key = F.xxhash64(*[F.col(f"`{n}`") for n in names])
    small = items.where(F.col("length") < tokens)
    whole = items.where(F.col("length") >= tokens).withColumn("sequence_id", (F.lit(3 << 60) + F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))
    first = small.withColumn("_shard", F.pmod(key, F.lit(shards))).groupBy("_shard").applyInPandas(packed(0), out)
    if shards == 1:
        return first.drop("_free").unionByName(whole)
    first = materialise(first, "first")
    done = first.where(F.col("_free") <= loose).drop("_free")
    rest = first.where(F.col("_free") > loose).select(*[F.col(f"`{n}`") for n in names])
    second = rest.withColumn("_shard", F.pmod(key, F.lit(again))).groupBy("_shard").applyInPandas(packed(1), out).drop("_free")
    return done.unionByName(second).unionByName(whole)

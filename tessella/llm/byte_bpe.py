"""Byte-level BPE encoding and decoding by a global exchange of distinct words.

Encoding
1. A block of documents (bounded by its characters) is cut into pre-tokens. The
   block keeps its distinct pre-tokens, numbered by falling frequency, and each
   document as the sequence of these numbers by position.
2. A block sends each owner (a hash range of words within a region of blocks) one
   message with its distinct words of that range. With one region the owner encodes
   every distinct word of all its messages once, and answers each message with the
   ids in the message's order. With more, it merges its messages and asks the global
   owners of its words in the same way, so a word leaves a region once.
3. Blocks meet their answers and put the documents together by position.

A word is sent once per block however often it occurs there, packed with the
others, so no word is hot and the text itself never moves. Regions, owners and tasks
are as many as the input's bytes ask for, so none of them grows with it. Documents and
messages leave the first step in one shuffle, dealt by block and by owner, which the
later steps read; lost parts are made again from the partition they came from.

Decoding joins ids by position to the token-byte table, a fixed vocabulary that every
worker holds, a few million positions at a time, and puts the bytes together by position.
(As a join of exploded rows this took 1,091 CPU seconds a GB with the encoding, of 900.)
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache

#: Characters of text after which a block is closed; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000

#: Bytes of text of a region, of an owner within a region, and of a task of a shuffle (with a large input); documents of a packed row.
REGION, OWNER, TASK, PACKED = 4 << 30, 16 << 20, (12 << 20, 256 << 20), 512

#: A space is a sure cut if no white space follows it: what stands left and right of it is then split independently.
_UNSURE = re.compile(r" (?:\s|$)")


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def chunks(text: str) -> list[str]:
    """`text` cut before spaces, only where no pre-token can cross the cut."""
    if not text:
        return []
    if _UNSURE.search(text) is None:
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [" " + x for x in rest]
    return re.split(r"(?= \S)", text) if not text.startswith(" ") else [x for x in re.split(r"(?= \S)", text) if x]


ROWS = "k long, block long, body binary"


def _varint(x: np.ndarray) -> bytes:
    """LEB128 of non-negative numbers under 2^28."""
    x = x.astype(np.uint32)
    if not len(x):
        return b""
    size = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21)
    out, at = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    for k in range(4):
        has = size > k
        out[at[has] + k] = ((x[has] >> np.uint32(7 * k)) & np.uint32(127)) | ((size[has] > k + 1) << 7).astype(np.uint32)
    return out.tobytes()


def _unvarint(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def pack_words(words: list[bytes], numbers: np.ndarray) -> bytes:
    """A message: ascending numbers as gaps, the words' lengths, and their bytes, compressed."""
    a, b = _varint(np.diff(numbers, prepend=0)), _varint(np.fromiter(map(len, words), np.int64, len(words)))
    return zlib.compress(np.array([len(words), len(a), len(b)], "<u4").tobytes() + a + b + b"".join(words), 1)


def unpack_words(message: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zlib.decompress(message)
    _, a, b = (int(x) for x in np.frombuffer(raw, "<u4", 3))
    ends = np.cumsum(_unvarint(raw[12 + a : 12 + a + b])).tolist()
    body = raw[12 + a + b :]
    return np.cumsum(_unvarint(raw[12 : 12 + a])), [body[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def pack_ids(ids: list[bytes]) -> bytes:
    """An answer: how many ids each word has, and the ids (little-endian unsigned 32-bit), compressed."""
    n = _varint(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
    flat = _varint(np.frombuffer(b"".join(ids), "<u4"))
    return zlib.compress(np.array([len(n)], "<u4").tobytes() + n + flat, 1)


def unpack_ids(answer: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(answer)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return _unvarint(raw[4 : 4 + n]), _unvarint(raw[4 + n :])


def pack_docs(ids: list[int | None], bodies: list[bytes]) -> bytes:
    """Documents of a row: how many, which ids are null, ids, lengths and bodies."""
    null = np.array([i is None for i in ids], np.uint8)
    return b"".join([np.array([len(ids)], "<u4").tobytes(), null.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.fromiter(map(len, bodies), "<u4", len(bodies)).tobytes(), *bodies])


def unpack_docs(row: bytes) -> tuple[list[int | None], list[bytes]]:
    n = int(np.frombuffer(row, "<u4", 1)[0])
    null = np.frombuffer(row, np.uint8, n, 4)
    ids = np.frombuffer(row, "<i8", n, 4 + n).tolist()
    ends = (4 + 13 * n + np.cumsum(np.frombuffer(row, "<u4", n, 4 + 9 * n), dtype=np.int64)).tolist()
    return [None if z else i for i, z in zip(ids, null, strict=True)], [row[a:z] for a, z in zip([4 + 13 * n, *ends], ends, strict=False)]


def _messages(words: list[bytes], owners: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """(owner, message) for each of `n` owners that has words; a message names words by their place in `words`."""
    by = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[by], np.arange(n + 1))
    return [(o, pack_words([words[i] for i in by[a:z]], by[a:z])) for o, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < z]


def _crc(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def _cutter(pattern: str, block_chars: int, regions: int, owners: int):
    """Documents to blocks: rows of packed documents (k: the block) and messages to owners (k: -1 - number of the region's owner)."""

    def close(block: int, region: int, ids: list, texts: list[str], split) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {}
        of: dict[str, tuple[int, ...]] = {}
        docs = []
        for text in texts:
            seq: list[int] = []
            for c in chunks(text):
                got = of.get(c)
                if got is None:
                    got = of[c] = tuple([number.setdefault(w, len(number)) for w in split(c)])
                seq += got
            docs.append(np.array(seq, np.int32))
        n = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs)
        order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        ends = np.cumsum(n)
        bodies = [_varint(rank[flat[z - k : z]]) for z, k in zip(ends, n, strict=True)]
        yield pd.DataFrame({"k": block, "block": block, "body": [pack_docs(ids[i : i + PACKED], bodies[i : i + PACKED]) for i in range(0, len(ids), PACKED)]})
        raw = [w.encode("utf-8", "surrogatepass") for w in number]
        raw = [raw[i] for i in order]
        sent = _messages(raw, _crc(raw) % owners, owners)
        yield pd.DataFrame({"k": np.array([-1 - region * owners - o for o, _ in sent], np.int64), "block": block, "body": [m for _, m in sent]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, pid, k = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                ids.append(None if i is None or i != i else int(i))
                texts.append(text or "")
                size += len(texts[-1])
                if size >= block_chars or len(ids) >= 50_000:
                    yield from close((pid << 32) + k, pid % regions, ids, texts, split)
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield from close((pid << 32) + k, pid % regions, ids, texts, split)

    return cut


def _answers(senders: pd.Series, bodies: pd.Series, known: dict[bytes, bytes]) -> pd.DataFrame:
    """An answer to each message: the numbers it used, and the ids of its words."""
    numbers, ids = [], []
    for message in bodies:
        number, words = unpack_words(message)
        numbers.append(_varint(np.diff(number, prepend=0)))
        ids.append(pack_ids([known[w] for w in words]))
    return pd.DataFrame({"sender": senders.to_numpy(), "number": numbers, "ids": ids})


def _distinct(bodies: pd.Series) -> list[bytes]:
    """The distinct words of messages, in order, so that every run of a task numbers them alike."""
    return sorted({w for message in bodies for w in unpack_words(message)[1]})


ANSWER = "sender long, number binary, ids binary"


def _word_owner(path: str, pattern: str):
    """Messages (sender, body) to an owner -> answers; each distinct word of the group is encoded once."""

    def own(group: pd.DataFrame) -> pd.DataFrame:
        piece = encoding(path, pattern)._encode_single_piece
        return _answers(group["sender"], group["body"], {w: np.array(piece(w), "<u4").tobytes() for w in _distinct(group["body"])})

    return own


def _merger(owners: int, fold: int):
    """The messages to a region's owner -> a message of their distinct words to each global owner of them."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        words = _distinct(group["body"])
        crc = _crc(words)
        first = int(crc[0] % owners) * fold  # all words of the group have one owner in their region
        sent = _messages(words, crc // owners % fold, fold)
        return pd.DataFrame({"g": np.array([first + o for o, _ in sent], np.int64), "sender": int(group["k"].iloc[0]), "body": [m for _, m in sent]})

    return merge


def _pass_on(key, group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """What the global owners answered to a region's owner, as answers to the messages of its blocks."""
    if not len(group):
        return pd.DataFrame({"sender": [], "number": [], "ids": []})
    size, start, flat = _placed(found)
    words = _distinct(group["body"])
    return _answers(group["sender"], group["body"], {w: flat[a : a + n].tobytes() for w, a, n in zip(words, start.tolist(), size.tolist(), strict=True)})


def _placed(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many ids each numbered word has, where they start, and all ids."""
    numbers = [np.cumsum(_unvarint(x)) for x in answers["number"]]
    parts = [unpack_ids(x) for x in answers["ids"]]
    size = np.zeros(sum(map(len, numbers)), np.int64)
    for at, (n, _) in zip(numbers, parts, strict=True):
        size[at] = n
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), "<u4")
    for at, (n, ids) in zip(numbers, parts, strict=True):
        flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return size, start, flat


def _assembler(path: str, digest: bool):
    """A block's documents and answers to token ids, or to digests of the ids and of what they decode to, a packed row at a time."""

    def assemble(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        size, start, flat = _placed(answers)
        names_of = [str(i) for i in range(len(token_table(path)))] if digest else []
        names, out = [], []
        for row in docs["body"]:
            ids, bodies = unpack_docs(row)
            coded = []
            for body in bodies:
                seq = _unvarint(body)
                n = size[seq]
                coded.append(flat[np.repeat(start[seq] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int32))
            names += ids
            if digest:
                back = _bytes_of(pa.array(coded, pa.list_(pa.int32())), token_table(path))
                sha = lambda x: hashlib.sha256(x).hexdigest()
                out += [(len(x), sha(",".join(map(names_of.__getitem__, x.tolist())).encode()), sha(d.as_buffer())) for x, d in zip(coded, back, strict=True)]
            else:
                out += coded
        made = pd.DataFrame({"doc_id": pd.array(names, "Int64")})
        return pd.concat([made, pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1) if digest else made.assign(ids=out)

    return assemble


def encode(docs: DataFrame, path: str, pattern: str, **how) -> DataFrame:
    """(doc_id, ids array<int>) for each row of `docs` (doc_id, text).

    A null or empty text has no ids. Rows are never merged: repeated ids and a null
    id keep their rows. No rows, no result. Other columns are not read.
    """
    return _coded(docs, path, pattern, False, **how)


def digests(docs: DataFrame, path: str, pattern: str, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of what the ids decode to) for each row.

    Rows are as those of `encode`; a block's ids are decoded, as `decode` does, where
    they are put together, so they need not move.
    """
    return _coded(docs, path, pattern, True, **how)


def _coded(docs: DataFrame, path: str, pattern: str, digest: bool, block_chars: int = BLOCK_CHARS, region_bytes: int = REGION, owner_bytes: int = OWNER) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    regions = max(1, -(-size // region_bytes))
    owners = max(8, -(-min(size, region_bytes) // owner_bytes))
    tasks = int(max(8, min(size // TASK[0], 2000), size // TASK[1]))
    rows = named.mapInPandas(_cutter(pattern, block_chars, regions, owners), ROWS).repartition(tasks, "k")
    # Both sides read one shuffle: a condition that depends on the task is not moved before it.
    side = lambda c: rows.where(F.when(F.spark_partition_id() >= 0, c))
    messages = side(F.col("k") < 0).select("k", F.col("block").alias("sender"), "body")
    if regions == 1:
        answers = messages.groupBy("k").applyInPandas(_word_owner(path, pattern), ANSWER)
    else:
        asked = messages.groupBy("k").applyInPandas(_merger(owners, -(-regions // owners)), "g long, sender long, body binary").repartition(tasks, "g")
        found = asked.groupBy("g").applyInPandas(_word_owner(path, pattern), ANSWER)
        answers = messages.groupBy("k").cogroup(found.groupBy("sender")).applyInPandas(_pass_on, ANSWER)
    return side(F.col("k") >= 0).groupBy("k").cogroup(answers.groupBy("sender")).applyInPandas(_assembler(path, digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>")


@functools.lru_cache(4)
def token_table(path: str) -> pa.BinaryArray:
    """The token-byte table, of the vocabulary's fixed size: the bytes of an id at its place, null where no token has it."""
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.binary())


def _bytes_of(ids: pa.ListArray, table: pa.BinaryArray) -> pa.BinaryArray:
    """What each list of ids means: all its positions join the table at once, and the bytes found stand in the order of positions."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
    flat = ids.flatten()
    if len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(table)):
        raise ValueError("an id is not in the token-byte table")
    tokens = table.take(flat)
    if tokens.null_count:
        raise ValueError("an id is not in the token-byte table")
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[upto] if len(flat) else np.zeros(len(upto), np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), tokens.buffers()[2] or pa.py_buffer(b"")])


def decode(coded: DataFrame, path: str, at_once: int = 4_000_000) -> DataFrame:
    """`coded` (ids array<int>, and any other columns) with `bytes` in the place of `ids`; null or no ids are no bytes.

    The ids of up to `at_once` positions (more only if one row has them) join the
    token-byte table together; a row's bytes are put together by position. An id that
    is not in the table is an error.
    """
    rest = [c for c in coded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy())
            first = 0
            while first < b.num_rows:
                before = upto[first - 1] if first else 0
                n = max(1, int(np.searchsorted(upto, before + at_once, "right")) - first)
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], _bytes_of(part.column("ids"), table)], names=[*rest, "bytes"])
                first += n

    own = coded.select(*[F.col(f"`{c}`") for c in rest])
    return coded.select(*[F.col(f"`{c}`") for c in [*rest, "ids"]]).mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in own.dtypes], "bytes binary"]))


def chunk_encoder(path: str, pattern: str, most: int = 300_000):
    """text -> token ids, remembering the ids of up to `most` chunks; for callers that need ids in the place of the text."""
    known = BoundedCache(encoding(path, pattern).encode_ordinary, most)

    def ids(text: str | None) -> list[int]:
        out: list[int] = []
        for c in chunks(text or ""):
            out += known[c]
        return out

    return ids

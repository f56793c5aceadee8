"""Edge cases of every corpus operator on small tables: nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, exact_dedup, near_dedup, packing, pii, quality, token_counts, topk_search, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, block long, score double, _h long"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 1, 0.5, 7) for i, t in rows], SCHEMA)


ODD = [(1, "a b"), (2, "ab"), (3, "a\tb\n "), (4, None), (5, ""), (6, " \r\n"), (None, "ab"), (7, "x" * 200_000), (7, "x" * 200_000), (8, "ab c"), (9, "é😀   b")]


def test_rice_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        v = np.unique(rng.integers(0, 2**60, n, dtype=np.uint64))
        for k in (0, 40, 50, 56):
            if k or n < 3:
                v2 = np.arange(n, dtype=np.uint64) * np.uint64(3) if k == 0 else v
                assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v2, k)) == v2).all()


def plain_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=str)


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark, ODD)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(ODD)
    kept = exact_dedup.keep_one(frame(spark, ODD))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [3, 6, 7, 8, 9]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0 and exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_byte_bpe_round_trip(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    alphabet = "aab bc  \n\t'sll dve123.,!?éß你好😀 　\x1c\x85Ǆ-_|"
    rows = ODD + [(100 + k, "".join(random.choice(alphabet) for _ in range(random.randint(0, 80)))) for k in range(400)]
    want = sorted(((i or 0), enc.encode_ordinary(t or "")) for i, t in rows)
    for region in (1 << 30, 2000):  # one level of owners, and two
        ids = byte_bpe.encode(frame(spark, rows), path, P.PATTERN, block_chars=500, region_bytes=region, owner_bytes=300)
        assert sorted(((r["doc_id"] or 0), r["ids"]) for r in ids.collect()) == want
    back = sorted(((r["doc_id"] or 0), bytes(r["bytes"])) for r in byte_bpe.decode(ids, path).collect())
    assert back == sorted(((i or 0), (t or "").encode()) for i, t in rows)
    assert byte_bpe.digests(frame(spark, []), path, P.PATTERN).count() == 0
    digests = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.digests(frame(spark, rows), path, P.PATTERN, block_chars=500).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == sorted((i or 0, len(x := enc.encode_ordinary(t or "")), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows)


def test_decoding_checks_ids(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # documents that go over batches
    try:
        ids = spark.createDataFrame([(1, [7, 8, 9, 10, 11], "x"), (2, None, "y"), (3, [], "z"), (4, [50], None), (5, list(range(40)), "v")], "doc_id long, ids array<int>, pos string")
        ranks = {i: t for t, i in byte_bpe.load_ranks(path).items()}
        got = {r["doc_id"]: (bytes(r["bytes"]), r["pos"]) for r in byte_bpe.decode(ids, path, at_once=6).collect()}
        assert got == {r["doc_id"]: (b"".join(ranks[i] for i in r["ids"] or []), r["pos"]) for r in ids.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="not in the token-byte table"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**9])], "doc_id long, ids array<int>"), path).collect()


def test_chunks_never_cut_a_token():
    import regex

    split = regex.compile(P.PATTERN).findall
    random.seed(3)
    for _ in range(3000):
        t = "".join(random.choice("ab '1.\n\t  s") for _ in range(random.randint(0, 30)))
        assert [w for c in byte_bpe.chunks(t) for w in split(c)] == split(t)


def test_token_counts_stitch_blocks(spark):
    rng = np.random.default_rng(4)
    for size in (2, 4, 10, 64, 4096):
        tokens = rng.integers(0, 6, 500).astype("<u2")
        raw = tokens.tobytes()
        blocks = spark.createDataFrame([("f", k, raw[i : i + size]) for k, i in enumerate(range(0, len(raw), size))] + [("g", 0, np.array([5, 5, 1], "<u2").tobytes()), ("h", 0, None), ("i", 3, b"")], token_counts.BLOCKS)
        got = token_counts.count_tokens(blocks, 5).collect()
        want, n = [], 0
        for t in tokens:
            if t == 5:
                want.append(n)
                n = 0
            else:
                n += 1
        f = sorted((r["number"], r["n_tokens"], r["closed"]) for r in got if r["file"] == "f")
        assert f == [(k, w, True) for k, w in enumerate(want)] + ([(len(want), n, False)] if n else [])
        assert sorted((r["number"], r["n_tokens"], r["closed"]) for r in got if r["file"] == "g") == [(0, 0, True), (1, 0, True), (2, 1, False)]
        assert not [r for r in got if r["file"] in "hi"]


def test_token_counts_of_files(spark, tmp_path):
    data = np.array([1, 2, 9, 9, 3, 9, 4], "<u2").tobytes()
    (tmp_path / "a.bin").write_bytes(data)
    blocks = token_counts.read_flat(spark, str(tmp_path), block_bytes=4)
    assert sorted((r["number"], r["n_tokens"]) for r in token_counts.count_tokens(blocks, 9).collect()) == [(0, 2), (1, 0), (2, 1), (3, 1)]


def test_document_token_counts(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoding(path, P.PATTERN)
    got = sorted(((r["doc_id"] or 0), r["n_tokens"]) for r in token_counts.document_token_counts(frame(spark, ODD), path, P.PATTERN, 50256).collect())
    assert got == sorted(((i or 0), len(enc.encode_ordinary(t or ""))) for i, t in ODD)
    assert token_counts.document_token_counts(frame(spark, []), path, P.PATTERN, 50256).count() == 0


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 100, 400)
    for rule in ("dot", "norm"):
        b = packing.best_fit(n, 128, 4, 10000, rule=rule)
        for k in np.unique(b):
            own = n[b == k]
            assert own.sum() <= 128 and len(own) <= 4 and (own**2).sum() <= 10000
    assert len(np.unique(packing.best_fit(n, 128, 128, 128**2))) <= -(-n.sum() // 128) + 6


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = ODD + [(20 + k, " ".join(["Straße isn't 42!"] * k)) for k in range(60)] + [(90, "<|endoftext|> a\x1cb ΣΑΣ İ")]
    for shard in (4096, 16):
        got = packing.pack(packing.pieces(frame(spark, rows), path, 64), len(rows), 64, per_shard=shard).toPandas()
        texts = {i: t for i, t in rows}
        for i, g in got[got["doc_id"].notna()].groupby("doc_id"):
            ids = np.array([*tok.encode(texts[int(i)] or "", add_special_tokens=False).ids, 0], "<u4")
            copies = sum(1 for j, _ in rows if j == i)
            g = g.sort_values("piece").iloc[::copies] if copies > 1 else g.sort_values("piece")
            assert g["length"].sum() == len(ids) and (g["length"].iloc[:-1] == 64).all()
            for r in g.itertuples():
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        s = got.sort_values(["sequence_id", "offset"])
        assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all()
        assert s.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack(packing.pieces(frame(spark, []), path, 64), 0, 64).count() == 0


def brute_classes(rows, least=0.8):
    known = near_dedup._hasher()
    sets = [near_dedup.shingles(t, known) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and (rows[a][0] == rows[b][0] or near_dedup.similarity(sets[a], sets[b]) >= least - 1e-9):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted((str(i), str(min(g)) if i is not None else "None") for g in groups.values() for i in g)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.integers(len(out))] = f"w{rng.integers(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("small", [24, 2])
def test_near_classes(spark, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = np.random.default_rng(6)
    base = [f"v{rng.integers(500)}" for _ in range(120)]
    rows = [(k, edited(base, int(rng.integers(0, 7)), rng)) for k in range(70)] + [(100 + k, " ".join(f"u{rng.integers(500)}" for _ in range(40))) for k in range(30)]
    rows += [(200, None), (201, ""), (202, "  "), (203, "one two"), (204, "ONE  two"), (None, rows[0][1]), (3, rows[3][1]), (300, "hi " * 50_000), (301, "hi " * 50_000)]
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.near_classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_near_keep_one_and_empty(spark):
    kept = near_dedup.keep_one(frame(spark, [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None), (8, None), (None, "a b c d e f")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "8", "9", "None"]
    assert near_dedup.near_classes(frame(spark, [])).count() == 0 and near_dedup.keep_one(frame(spark, [])).count() == 0


def test_components_agree(spark):
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(k, k + 1) for k in range(1000, 1030)], "a long, b long")
    one = sorted(map(tuple, near_dedup.components(edges).collect()))
    assert one == sorted(map(tuple, near_dedup.components(edges, one_task=0).collect()))


def test_similarity_is_jaccard_for_sets():
    a, b = (np.arange(10, dtype=np.uint64), np.ones(10)), (np.arange(5, 15, dtype=np.uint64), np.ones(10))
    assert abs(near_dedup.similarity(a, b) - 5 / 15) < 1e-12
    rng = np.random.default_rng(9)
    x, y = (np.arange(8, dtype=np.uint64), rng.integers(1, 5, 8).astype(float)), (np.arange(3, 11, dtype=np.uint64), rng.integers(1, 5, 8).astype(float))
    wx, wy = dict(zip(*x, strict=True)), dict(zip(*y, strict=True))
    want = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in set(wx) | set(wy)) for d in set(wx) & set(wy))
    assert abs(near_dedup.similarity(x, y) - want) < 1e-12
    sig = near_dedup.prob_minhash([x, y] * 1, 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


PII_TEXTS = [
    (1, "mail a.b+c@x-y.co.uk, then x@y and a@b.c%@d.e; .@-.-"), (2, "ip 1.2.3.4.5.6.7.8 999.1.1.1 0255.0.00.1 1.2.3"), (3, "card 4785380592391139 4111 1111-1111 1111 4111  1111 1111 1111 1 2"),
    (4, "tel +1 (202) 555-0143. +49.30.123456- +1234567 +12345678901234567"), (5, None), (6, ""), (7, "é😀 q@w.e +1 202 555 0143 😀 4785380592391139"), (8, "9" * 60_000 + " " + "a" * 60_000 + " " + "b.c@" * 3000 + "d.e"), (8, "x@y.z"), (None, "x@y.z"), (10, " 12 a@b.c"), (11, "퟿ 4111-1111-1111-1111"),
]


def plain_spans(t):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in pats.items() for m in re.finditer(p, t) if ok[k](m.group())]


def test_pii_base_spans(spark):
    got = pii.digest(pii.find(frame(spark, PII_TEXTS))).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(",".join(plain_spans((t or "") if i != 8 or len(t) < 10 else t)).encode()).hexdigest()) for i, t in PII_TEXTS)
    assert pii.digest(pii.find(frame(spark, []))).count() == 0


def test_pii_terms_and_text(spark):
    rows = [(k, f"filler{k} words near secretive{k % 2} boss@corp.com end{k}") for k in range(8)] + [(50 + k, f"plain text number {k} with nothing") for k in range(200)] + [(300, "the secretive1 name alone"), (301, None)]
    limits = pii.Limits(support=3, share=0.6, bits=3.0)
    found = pii.find(frame(spark, rows), limits)
    terms = {r["doc_id"]: r["spans"] for r in pii.digest(found).where("spans <> ''").collect()}
    assert "term:" in terms[1] and "email:" in terms[1] and "term:4:14" in terms.get(300, "") and 55 not in terms
    clean = pii.sanitise(frame(spark, rows), limits)
    out = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == [c.split()[0] for c in SCHEMA.split(", ")] and len(out) == len(rows)
    assert "boss@corp.com" not in out[1]["text"] and "[EMAIL]" in out[1]["text"] and "[TERM]" in out[300]["text"]
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[301]["text"] is None and out[55]["text"] == dict(rows)[55]
    assert pii.sanitise(frame(spark, [])).count() == 0


def test_pii_terms_of_any_length_and_spelling(spark):
    """Names that the address spells, short names and numbers are flagged; words inside another address are not."""
    limits = pii.Limits(support=3, share=0.6, bits=3.0)
    rows = [(k, f"{k}aaa {k}bbb smith Wu 40417 mail john.smith@corp.com or hal9000@corp.com 张伟 {k}ccc") for k in range(5)] + [(50 + k, f"plain text number {k} of hal9000 and corp") for k in range(200)] + [(300, "smith and wu had 40417 with 张伟")]
    terms = {r["term"] for r in pii.disclosing_terms(pii.with_base(frame(spark, rows)), limits).collect()}
    assert {"smith", "wu", "40417", "张伟", "mail", "or"} <= terms and not {"john", "corp", "com", "hal9000"} & terms
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows), limits).collect()}
    assert out[300] == " and  had  with " and out[51] == dict(rows)[51]


def test_pii_copies_count_once(spark, monkeypatch):
    """Neither copies of a page with the term alone nor copies of a page with the entity change shares and bits."""
    limits = pii.Limits(support=3, share=0.6, bits=3.0)
    rows = [(k, f"{k}aaa secretive boss@corp.com {k}bbb") for k in range(3)] + [(10, "secretive alone")] + [(50 + k, f"plain text number {k}") for k in range(60)]
    copies = [(1000 + k, rows[3][1]) for k in range(49)] + [(2000 + k, rows[0][1]) for k in range(49)]
    terms = lambda r: sorted((t["term"], t["share"], t["bits"]) for t in pii.disclosing_terms(pii.with_base(frame(spark, r)), limits).collect())
    want = terms(rows)
    assert [(t, s, round(b, 6)) for t, s, b in want] == [("secretive", 0.75, 4.0)]
    assert terms(rows + copies) == want
    monkeypatch.setattr(pii, "FEW", -1)
    assert terms(rows + copies) == want


def brute_terms(texts, limits):
    """Disclosing terms by loops over distinct texts: {term: (share, bits)}."""
    word = regex.compile(r"[\p{L}\p{N}_]+")
    texts = sorted(set(texts))
    holds = {t: {w.lower() for w in word.findall(t)} for t in texts}
    contexts, both, with_entity = {}, {}, {}
    for t in texts:
        spans = [(kind, int(a), int(z)) for kind, a, z in (x.split(":") for x in plain_spans(t))]
        inside = {i for _, a, z in spans for i in range(a, z)}
        for kind, a, z in spans:
            entity = f"{kind}:{t[a:z].lower()}"
            with_entity.setdefault(entity, set()).add(t)
            left = [(m.start(), m.end()) for m in word.finditer(t[:a])][-limits.window :]
            right = [(z + m.start(), z + m.end()) for m in word.finditer(t[z:])][: limits.window]
            key = (tuple(t[i:j].lower() for i, j in left), tuple(t[i:j].lower() for i, j in right))
            for i, j in left + right:
                if not set(range(i, j)) <= inside:
                    contexts.setdefault((entity, t[i:j].lower()), set()).add(key)
                    both.setdefault((entity, t[i:j].lower()), set()).add(t)
    out = {}
    for (entity, term), seen in contexts.items():
        n = len(both[entity, term])
        share = n / max(n, sum(term in holds[t] for t in texts))
        bits = math.log2(share * len(texts) / len(with_entity[entity]))
        if len(seen) >= limits.support and share >= limits.share and bits >= limits.bits:
            old = out.get(term, (0.0, -1e9))
            out[term] = (max(old[0], share), max(old[1], bits))
    return out


def test_pii_terms_against_brute_force(spark):
    """Contexts behind padding, words cut by a span, spans that overlap, copies, and long tokens beside a mention."""
    rng = random.Random(4)
    vocab = [*"alpha beta Gamma δέλτα Wu 张伟 40417 x_1 the of and".split(), "w" * 150]
    people = ["jo@corp.com", "10.1.2.3", "+44 20 7946 0958", "ann.lee@mail.example.org", "4111 1111 1111 1111"]
    rows = []
    for k in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        who = rng.randrange(6)
        if who < 5:
            words.insert(rng.randint(0, len(words)), rng.choice(["", "id", " " * 300, "-" * 5000]) + people[who])
            words.insert(rng.randint(0, len(words)), f"secret{who}")
        rows.append((k, rng.choice([" ", " | ", "  "]).join(words)))
    rows += [(400 + k, rows[k % 7][1]) for k in range(60)]
    limits = pii.Limits(support=3, share=0.3, bits=1.0)
    got = {r["term"]: (r["share"], r["bits"]) for r in pii.disclosing_terms(pii.with_base(frame(spark, rows)), limits).collect()}
    want = brute_terms([t for _, t in rows], limits)
    assert len(want) >= 5 and got.keys() == want.keys()
    assert all(math.isclose(got[t][i], want[t][i], rel_tol=1e-9) for t in want for i in (0, 1))


def test_pii_long_texts(spark):
    """300,000 words with flagged terms, and 60,000 spans in one text, are found and rewritten in time that grows with the text."""
    limits = pii.Limits(support=3, share=0.6, bits=3.0)
    rows = [(k, f"{k}aaa secretive boss@corp.com {k}bbb") for k in range(8)] + [(50 + k, f"plain text number {k}") for k in range(200)]
    long = "é word Secretive " * 100_000
    many = " ".join(f"10.0.{k % 250}.{k % 99} a{k}@b.org" for k in range(30_000))
    pii.sanitise(frame(spark, rows), limits).count()
    began = time.perf_counter()
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, [*rows, (300, long), (301, many)]), limits).where("doc_id >= 300").collect()}
    took = time.perf_counter() - began
    assert out[300] == "é word [TERM] " * 100_000 and out[301] == " ".join(["[IP] [EMAIL]"] * 30_000)
    spans = {r["doc_id"]: r for r in pii.digest(pii.find(frame(spark, [*rows, (300, long), (301, many)]), limits)).where("doc_id >= 300").collect()}
    assert spans[300]["spans"].split(",") == [f"term:{17 * k + 7}:{17 * k + 16}" for k in range(100_000)]
    assert (spans[301]["n_email"], spans[301]["n_ip"]) == (30_000, 30_000) and spans[301]["spans"] == ",".join(plain_spans(many))
    assert took < 60, took


def test_top_k(spark):
    rng = np.random.default_rng(10)
    v = np.round(rng.standard_normal((300, 8)) * 0.5, 1)
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [1.0, 2.0]), (1004, [2.0, 1.0]), (5, [0.1] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk_search.quantised(df, "vec_id", "embedding").withColumn("block", F.lit(0)).withColumn("dim", F.lit("clash"))
    got, one = {}, topk_search.top_k(q, q.where("vec_id % 50 = 3 OR vec_id = 1003"), 4, tile_rows=7, block_queries=3).collect()
    assert sorted(one) == sorted(topk_search.top_k(q, q.where("vec_id % 50 = 3 OR vec_id = 1003"), 4, tile_rows=7, block_queries=3, round_bytes=300).collect())
    for r in one:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(1024 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    for i, x in ok:
        if i % 50 == 3 or i == 1003:
            want = sorted([(-int(x @ y), j) for j, y in ok if j != i and len(y) == len(x)])[:4]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    none = df.where("vec_id < 0")
    assert topk_search.top_k(topk_search.quantised(none, "vec_id", "embedding"), topk_search.quantised(none, "vec_id", "embedding")).count() == 0


def test_top_k_of_large_integers(spark):
    big = spark.createDataFrame([(0, [2**31, 1]), (1, [2**31, 2]), (2, [2**31 - 1, 9])], "vec_id long, v array<long>")
    got = [(r["vec_id"], r["score"]) for r in topk_search.top_k(big, big.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(1, 2**62 + 2), (2, 2**31 * (2**31 - 1) + 9)]


def test_url_filter(spark):
    import datetime

    d = lambda n: datetime.date(2024, 1, n)
    entries = spark.createDataFrame([("Bad.com", "l", "add", d(5)), ("bad.com", "l", "add", d(6)), ("bad.com", "l", "remove", d(10)), ("bad.com", "l", "add", d(20)), ("ok.com/x", "p", "add", d(1)), ("same.com", "l", "add", d(3)), ("same.com", "l", "remove", d(3)), (None, "l", "add", d(1)), ("gone.com", "l", "remove", d(2))], "pattern string, list string, event string, at date")
    urls = [("http://bad.com/a", 4), ("http://www.BAD.com:80/a", 5), ("https://u:p@bad.com.", 9), ("http://bad.com", 10), ("http://bad.com", 20), ("http://notbad.com", 6), ("http://ok.com/x/y?q", 2), ("http://ok.com/xy", 2), ("http://same.com", 3), ("http://gone.com", 3), (None, 3), ("", 3), ("no url", 3)]
    rows = [(k, u, d(n), "x") for k, (u, n) in enumerate(urls)] + [(0, *[urls[0][0], d(4), "x"]), (99, "http://bad.com", None, "x")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_at date, list string"), entries)
    blocked = sorted({r["page_id"] for r in got.collect() if r["blocked"]})
    assert blocked == [1, 2, 4, 6] and got.count() == len(rows)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_at date"), entries).count() == 0


def test_url_filter_against_brute_force(spark):
    """Hot patterns in many parts, deep paths, very long URLs and many lists, against a loop over all entries."""
    rng = np.random.default_rng(3)
    names = ["hot.com", "a.hot.com", "b.org", "hot.com/p", "hot.com/p/q/r/s", "a.hot.com/" + "x" * 5000]
    events = [(names[rng.integers(len(names))], f"l{rng.integers(4)}", "add" if rng.random() < 0.6 else "remove", int(rng.integers(100))) for _ in range(150)]
    urls = ["http://" + u for u in [*names, "hot.com/p/q", "hot.com/p/q/r/s/t?u", "c.b.org//p", "www.a.hot.com/" + "x" * 5000 + "/y", "a.hot.com/" + "x" * 5000 + "/y", "none.net"]]
    rows = [(k, urls[0] if rng.random() < 0.4 else urls[rng.integers(len(urls))], int(rng.integers(100))) for k in range(600)]

    def active(pattern, name, t):
        state = False
        for e in sorted({(at, event) for p, n, event, at in events if (p, n) == (pattern, name) and at <= t}):
            state = e[1] == "add"
        return state

    def matches(url, t):
        host, *s = [x for x in url.removeprefix("http://").split("?")[0].split("/") if x]
        labels = host.split(".")
        keys = {host} | {".".join(labels[i:]) for i in range(len(labels) - 1)} | {"/".join([host, *s[:n]]) for n in range(1, len(s) + 1)}
        return sorted(name for k in keys for name in {n for _, n, _, _ in events} if active(k, name, t))

    want = {k: (len(m := matches(u, t)), min(m, default=None)) for k, u, t in rows}
    for part in (2_000, 20):
        out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_at int"), spark.createDataFrame(events, "pattern string, list string, event string, at int"), part)
        assert {r["page_id"]: (r["n_matches"], r["first_list"]) for r in out.collect()} == want


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_models_without_labels(spark):
    docs, none = frame(spark, ODD), labelled(spark, [])
    q = quality.scored(docs, none).collect()
    assert len(q) == len(ODD) and all(r["predicted"] == 1 for r in q)
    t = toxicity.scored(docs, none).collect()
    assert len(t) == len(ODD) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in t)
    assert toxicity.keep_clean(docs, none).columns == docs.columns
    assert toxicity.scored(frame(spark, []), none).count() == 0 and quality.scored(frame(spark, []), none).count() == 0


def test_toxicity_finds_words_anywhere(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(300)]

    def text(bad):
        w = [words[i] for i in rng.integers(0, 300, int(rng.integers(20, 200)))]
        if bad:
            w[int(rng.integers(len(w)))] = ["vileword", "nastyterm"][int(rng.integers(2))]
        return " ".join(w)

    rows = [(k, text(k % 3 == 0)) for k in range(900)]
    labels = labelled(spark, [(k, 1, int(k % 3 == 0)) for k in range(900)] + [(None, 1, 1), (5000, 0, 1), (3, None, None)])
    got = toxicity.scored(frame(spark, rows + [(5001, None), (5002, "w1 " * 3000 + "vileword " + "w2 " * 3000)]), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[5001] == 0 and by[5002] == 1


def test_gradients_match_differences():
    rng = np.random.default_rng(12)
    h, b, t, a = 3, 2, 5, 4
    p = {k: rng.standard_normal(s).astype(np.float64) for k, s in {"uf": (h, 3 * h), "ub": (h, 3 * h), "wa": (2 * h, a), "va": (a,), "wo": (2 * h,), "bo": (1,)}.items()}
    x, mask = rng.standard_normal((b, t, 6 * h)), np.ones((b, t))
    mask[1, 3:] = 0
    keep = {}
    toxicity.forward(p, x, mask, keep)
    dx, g = toxicity.backward(p, mask, keep, np.ones(b))
    at = (0, 2, 4)
    for target, grad, where in ((x, dx, at), (p["uf"], g["uf"], (1, 2)), (p["ub"], g["ub"], (0, 5)), (p["wa"], g["wa"], (2, 1)), (p["wo"], g["wo"], (3,))):
        old = target[where]
        target[where] = old + 1e-3
        up = toxicity.forward(p, x, mask).sum()
        target[where] = old - 1e-3
        down = toxicity.forward(p, x, mask).sum()
        target[where] = old
        assert abs((up - down) / 2e-3 - grad[where]) < 2e-3 * max(1, abs(grad[where]))


def test_windows_cover_everything():
    for n in (0, 1, 32, 33, 56, 57, 1000):
        s = toxicity.windows_of(n)
        seen = {i for a in s for i in range(a, min(a + toxicity.WINDOW, n))}
        assert seen == set(range(n))
    long = "a" * 1000
    assert "".join(toxicity.split_words(long)) == long


def test_quality_threshold(spark):
    rng = np.random.default_rng(13)
    good = lambda: " ".join(f"w{i}" for i in rng.integers(0, 500, 60))
    bad = lambda: " ".join(["spam"] * 60)
    rows = [(k, bad() if k % 5 == 0 else good()) for k in range(400)]
    labels = labelled(spark, [(k, int(k % 5 != 0), 0) for k in range(400)])
    got = quality.scored(frame(spark, rows + [(900, None)]), labels).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 != 0) for r in got if r["doc_id"] < 900]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def noisy(k, rng):
    """A text of label 1 or 0 whose labels overlap, so that no cut is without misses."""
    bad = bool(rng.random() < 0.3)
    w = [f"w{i}" for i in rng.integers(0, 60 if bad else 90, int(rng.integers(5, 40)))]
    return " ".join(w + ["SPAM!"] * int(rng.integers(0, 4 if bad else 2))), int(not bad)


def test_quality_counts_every_training_row(spark):
    """More rows of label 1 than were once chosen (8,000): quantiles, mean and counts are those of all."""
    rng = np.random.default_rng(17)
    rows = [(k, f"{'word ' * int(rng.integers(1, 9))}{k}") for k in range(12_000)]
    model = quality.fit(frame(spark, rows), labelled(spark, [(k, int(k % 40 != 0), 0) for k in range(12_000)]))
    x = np.array([quality.features(t) for k, t in rows if zlib.crc32(str(k).encode()) % 5], np.float32).astype(float)
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["sd"], np.maximum(x.std(0), 1e-9), atol=1e-6)
    assert np.array_equal(model["cuts"], np.quantile(x, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0, method="inverted_cdf").T)
    assert model["n1"] + model["n0"] == len(x)


def test_quality_learns_from_long_texts(spark):
    """Texts beyond 200,000 characters, once left out of training, are all there is of label 0."""
    rows = [(k, "spam " * 41_000 if k % 5 == 0 else " ".join(f"w{(k * 7 + i) % 97}" for i in range(60))) for k in range(60)]
    got = quality.scored(frame(spark, rows), labelled(spark, [(k, int(k % 5 != 0), 0) for k in range(60)])).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in got)


def test_quality_against_all_pairs(spark, monkeypatch):
    """Weights against plain Newton steps over every pair, the cut against every score; also with sums merged by tasks."""
    rng = np.random.default_rng(19)
    made = [noisy(k, rng) for k in range(400)]
    docs, labels = frame(spark, [(k, t) for k, (t, _) in enumerate(made)]), labelled(spark, [(k, y, 0) for k, (_, y) in enumerate(made)])
    model = quality.fit(docs, labels)
    use = [(t, y) for k, (t, y) in enumerate(made) if zlib.crc32(str(k).encode()) % 5]
    f = quality.spread(np.array([quality.features(t) for t, _ in use], np.float32), model["cuts"], model["mean"], model["sd"])
    y = np.array([y for _, y in use])
    d = (f[y == 1][:, None] - f[y == 0][None]).reshape(-1, f.shape[1])
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
    assert np.abs(f @ model["w"] - f @ w).max() < 0.01 * np.abs(f @ w).max()
    s = f @ model["w"]
    misses = lambda cut: int(((s >= cut - 1e-9) != (y == 1)).sum())
    assert misses(model["cut"]) == min(map(misses, s)) > 0
    rows = spark.createDataFrame([(int(v), [float(k)] * len(quality.NAMES)) for k, v in enumerate(y)], "y int, x array<float>").repartition(9)
    monkeypatch.setattr(quality, "MERGE", 2)
    assert quality._total(rows, lambda x, y: np.array([x[:, 0].sum(), y.sum(), len(y)]), 3).tolist() == [len(y) * (len(y) - 1) / 2, y.sum(), len(y)]


def test_quality_of_repeated_rows_and_labels(spark):
    """Equal rows of an id train once, its other texts too; the larger of two labels holds; rows that no label names train nothing."""
    rows = [(1, "a b c")] * 5 + [(1, "other words here"), (2, "spam spam spam"), (3, "spam"), (None, "x"), (4, None)]
    model = quality.fit(frame(spark, rows), labelled(spark, [(1, 0, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (99, 1, 0)]))
    held = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held and (model["n1"], model["n0"]) == (2, 1)


def test_results_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    """With every bound at 0 the same rows come by shuffles and rounds of joins."""
    from tessella.llm import common

    docs = [(k, f"copy {k % 9} of a text with a few more words to it {'x ' * (k % 3)}") for k in range(60)] + [(100 + k, f"note {k} near term{k % 2}word me@host{k % 2}.org again") for k in range(12)] + ODD
    limits = pii.Limits(support=2, share=0.5, bits=2.0)

    def everything():
        return (
            sorted(str(r["doc_id"]) for r in exact_dedup.keep_one(frame(spark, docs)).collect()),
            sorted(str(tuple(r)) for r in near_dedup.near_classes(frame(spark, docs)).collect()),
            sorted(str(r["doc_id"]) for r in near_dedup.keep_one(frame(spark, docs)).collect()),
            sorted(str((r["doc_id"], r["spans"])) for r in pii.digest(pii.find(frame(spark, docs), limits)).collect()),
        )

    few = everything()
    assert "term:" in "".join(few[3])
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(exact_dedup, "FEW", -1)
    monkeypatch.setattr(pii, "FEW", -1)
    monkeypatch.setattr(near_dedup, "ONE_TASK", -1)
    assert everything() == few

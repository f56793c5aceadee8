"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) are found by
pattern. The corpus then tells which ordinary terms give a protected entity away:
over the distinct contexts (a few words on both sides of a mention), a term's
disclosure of an entity e is the pointwise information log2(P(e | t) / P(e)),
where P(e | t) is the share of all of the corpus's distinct contexts and texts
with the term that hold e. Terms with enough support whose P(e | t) and
information exceed the thresholds are sanitised wherever they occur: generalised
to a class for long ones, removed for rare ones. Copies of a passage count once.

Positions come from splitting: what stands between matches, and the matches
themselves, give every start by a running sum of lengths. Patterns that would
make Java recurse are matched on a text of the same length in which inner
separators are replaced by a marker, so every loop is over one character class.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, semi_by_size

KINDS = ("email", "ip", "card", "phone")

#: A private-use character; where a text itself has it, it is read as a control character that no pattern has.
MARK, NO_MARK = "\ue000", "\x01"

#: Words of flagged texts, and hashes of texts with copies, that are broadcast at most.
FEW = 500_000

#: Lengths summed up in one run; code points of the pieces in which a text is rewritten, from large to small.
RUN, PIECES = 128, [1 << 16, 1 << 10]

#: Code points beside a mention in which its context is sought first, and of the pieces (at least one, then all) that are sought next.
NEAR, PIECE = 192, 4096

WORD = r"[\p{L}\p{N}_]+"

#: Spans are ASCII: a word character inside one is read as its shadow, a private-use character, so a word tells where it stands.
PLAIN = string.digits + string.ascii_letters + "_"
SHADOW = "".join(chr(0xE100 + ord(c)) for c in PLAIN)
SHADED_WORD, OUTSIDE = r"[\p{L}\p{N}_\ue100-\ue17f]+", r"[^\ue100-\ue17f]"


@dataclass(frozen=True)
class Limits:
    """Disclosure thresholds. window: words on each side of a mention; support: distinct contexts at least with both
    term and entity; share: P(e | t) at least; bits: log2(P(e | t) / P(e)) at least."""

    window: int = 8
    support: int = 3
    share: float = 0.6
    bits: float = 6.0
    generalise_from: int = 8


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once, though `then` names it in loops."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ends(sizes: Column) -> Column:
    """Running sums of an array of lengths. Runs of RUN are summed up alone and moved by the sum before them, so no array grows far."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    run = lambda a: F.aggregate(a, none, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])
    runs = lambda z: F.transform(F.sequence(F.lit(0), F.ceil(F.size(z) / RUN).cast("int") - 1), lambda c: run(F.slice(z, c * RUN + 1, RUN)))
    moved = lambda r, base: F.flatten(F.transform(r, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: x + F.get(base, i - 1)))))
    placed = lambda r: _let(run(F.transform(r, lambda p: F.element_at(p, -1))), lambda base: moved(r, base))
    return _let(sizes, lambda z: F.when(F.size(z) <= RUN, run(z)).otherwise(_let(runs(z), placed)))


def _spans(source: Column, pattern: str | Column, inner: str = "") -> Column:
    """Array of (start, end, value): all matches in `source`; in a value MARK is read as `inner`."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(got: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(source, pattern, -1), 1, F.size(got)), got, lambda b, m: F.length(b) + F.length(m))
        at = lambda ends: F.transform(got, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.translate(m, MARK, inner).alias("value")))
        return F.when(F.size(got) == 0, _empty()).otherwise(_let(_ends(sizes), at))

    return _let(F.regexp_extract_all(source, pattern, F.lit(0)), placed)


def _cut(text: Column, n: int) -> Column:
    """`text` in pieces of `n` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}+"), F.lit(0))


def _rewritten(text: Column, spans: Column, piece) -> Column:
    """`text` with its `spans` (start, end, by) rewritten by `piece` (text, spans) in pieces of bounded size.

    A span that crosses into a further piece goes on there from its start with an
    empty `by`. Positions are so only counted, and arrays only grown, within a piece.
    """

    def local(of: Column, at: Column, n: int) -> Column:
        near = F.filter(of, lambda s: (s["end"] > at) & (s["start"] < at + n))
        return F.transform(near, lambda s: F.struct(F.greatest(s["start"] - at, F.lit(0)).alias("start"), F.least(s["end"] - at, F.lit(n)).alias("end"), F.when(s["start"] >= at, s["by"]).otherwise("").alias("by")))

    def level(sizes: list[int]):
        n, *rest = sizes
        inside = level(rest) if rest else piece
        one = lambda of: lambda t, i: _let(local(of, i * n, n), lambda near: F.when(F.size(near) == 0, t).otherwise(inside(t, near)))
        return lambda t, of: F.array_join(F.transform(_cut(t, n), one(of)), "")

    return _let(F.array_sort(spans), lambda of: level(PIECES)(text, of))


def _empty() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def _marked(text: Column, between: str, what: str) -> Column:
    """`text` with each character of class `what` that stands between two of class `between` replaced by MARK."""
    return F.regexp_replace(F.translate(text, MARK, NO_MARK), f"(?<={between}){what}(?={between})", MARK)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)).alias("d")))
    total = F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["d"] > 9, x["d"] - 9).otherwise(x["d"]))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (start, end, value) for each kind, leftmost and non-overlapping within the kind; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    label, local = "[A-Za-z0-9-]", f"[A-Za-z0-9._%+{MARK}-]"
    # A match starts where its run of local characters does, or where the last match ended; possessive loops keep it linear.
    email = F.when(F.contains(text, F.lit("@")), _spans(_marked(text, label, r"\."), rf"(?:\G|(?<!{local})){local}++@{label}++{MARK}[A-Za-z0-9{MARK}-]++", "."))
    ip_all = F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"))
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).try_cast("int") <= 255)
    ip = F.filter(ip_all, lambda s: F.forall(F.split(s["value"], r"\."), small))
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    card_all = F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), _spans(_marked(text, "[0-9]", "[ -]"), f"[0-9][0-9{MARK}]++"))
    long_enough = F.filter(card_all, lambda s: F.length(digits(s["value"])).between(13, 19))
    card = F.filter(long_enough, lambda s: _luhn(digits(s["value"])))
    phone_all = F.when(F.contains(text, F.lit("+")), _spans(text, r"\+[0-9][\x20().0-9-]+[0-9]"))
    phone = F.filter(phone_all, lambda s: F.length(digits(s["value"])).between(9, 15))
    return {k: F.coalesce(c, _empty()) for k, c in zip(KINDS, (email, ip, card, phone), strict=True)}


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text and an array of base spans for each kind; a column _row is passed on."""
    rest = [c for c in docs.columns if c == "_row"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rest).select("doc_id", "text", *rest, *[c.alias(k) for k, c in base_spans(F.col("text")).items()])


def _words(text: Column) -> Column:
    """Distinct lower-case words of `text`."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("entity")))


def _shaded(text: Column) -> Column:
    """`text` at the same length, word characters inside base spans as their shadows; its own shadows as control characters."""
    own = F.translate(text, SHADOW, NO_MARK * len(SHADOW))

    def piece(t: Column, spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        cut = lambda a, b: F.substring(t, a + 1, b - a)
        step = lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["end"] > acc["at"], F.concat(acc["out"], F.array(cut(acc["at"], F.greatest(acc["at"], s["start"])), F.translate(cut(F.greatest(acc["at"], s["start"]), s["end"]), PLAIN, SHADOW)))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(spans, zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, F.length(t)))), ""))

    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("by"))) for k in KINDS])
    return F.when(F.size(F.concat(*KINDS)) > 0, _rewritten(own, spans, piece))


def _generalised(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by")))


def disclosing_terms(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """term, share, bits: terms that disclose an entity, from all rows of `found` (see `with_base`).

    Counts are over distinct texts; support counts distinct contexts, so copies of a
    passage add to neither. A mention's context is cut from the whole text. Its
    words are all candidates, however short and whatever their characters, but for
    those that lie inside a base span; limits alone decide among them.
    """
    near = lambda c: F.regexp_extract_all(c, F.lit(SHADED_WORD), F.lit(0))
    lit = lambda w: F.lower(F.translate(w, SHADOW, PLAIN))

    def beside(nearest: Column, short: Column, more: Column, all_of_it: Column, whole: Column) -> Column:
        """Words of the nearest characters if they surely hold `window` uncut ones or are all there are, else of more, else of all."""
        enough = lambda w: F.size(w) > limits.window
        return _let(near(nearest), lambda w: F.when(enough(w) | short, w).otherwise(_let(near(more), lambda v: F.when(enough(v) | all_of_it, v).otherwise(near(whole)))))

    def mention(p: Column, s: Column) -> Column:
        """Entity and words on both sides of a mention in a text cut into pieces `p`."""
        i, k = F.floor(s["start"] / PIECE).cast("int"), F.floor(s["end"] / PIECE).cast("int")
        piece = lambda n: F.coalesce(F.get(p, n), F.lit(""))
        before = F.concat(F.when(i > 0, piece(i - 1)).otherwise(""), F.substring(piece(i), F.lit(1), s["start"] - i * PIECE))
        after = F.concat(F.substring(piece(k), s["end"] - k * PIECE + 1, F.lit(PIECE)), piece(k + 1))
        all_before = lambda t: F.concat(F.array_join(F.slice(p, 1, F.greatest(i - 1, F.lit(0))), ""), t)
        all_after = lambda t: F.concat(t, F.array_join(F.slice(p, F.least(k + 3, F.size(p) + 1), F.size(p)), ""))
        l = _let(before, lambda t: beside(F.substring(t, F.lit(-NEAR), F.lit(NEAR)), s["start"] <= NEAR, t, i <= 1, all_before(t)))
        r = _let(after, lambda t: beside(F.substring(t, F.lit(1), F.lit(NEAR)), F.length(t) <= NEAR, t, k + 2 >= F.size(p), all_after(t)))
        last = lambda w: F.slice(w, F.greatest(F.size(w) - limits.window + 1, F.lit(1)), F.lit(limits.window))
        return F.struct(s["entity"].alias("entity"), _let(l, last).alias("l"), F.slice(r, 1, limits.window).alias("r"))

    # Outer, as the engine else works out all spans a second time to leave out rows without any; and only words leave a text's row.
    tagged = found.select(F.xxhash64("text").alias("doc"), _shaded(F.col("text")).alias("shaded"), F.concat(*[_entities(k) for k in KINDS]).alias("s"))
    each = F.when(F.size("s") > 0, _let(_cut(F.col("shaded"), PIECE), lambda p: F.transform(F.col("s"), lambda s: mention(p, s))))
    mentions = tagged.select("doc", F.explode_outer(each).alias("m")).where("m is not null").select("doc", "m.*")
    # One text's mentions once: the corpus is not read for them again.
    sides = materialise(mentions, "mentions")
    term = F.array_distinct(F.transform(F.filter(F.concat("l", "r"), lambda w: w.rlike(OUTSIDE)), lit))
    rows = sides.select("entity", "doc", F.xxhash64(F.transform("l", lit), F.transform("r", lit)).alias("context"), F.explode(term).alias("term"))
    pairs = rows.distinct()
    once = pairs.groupBy("entity", "term", "context").agg(F.lit(1).alias("_"))
    support = once.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= limits.support)
    both = pairs.select("entity", "term", "doc").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    candidates = materialise(support.join(both, ["entity", "term"]), "candidates")
    entities = sides.select("doc", "entity").join(candidates.select("entity").distinct(), "entity", "left_semi").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    texts = materialise(found.select(F.xxhash64("text").alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("copies")), "texts")
    copied = texts.where("copies > 1")
    n_docs, n_copied = texts.count(), copied.count()
    # Every word's count, summed up in each task before it moves, meets the candidates only then. Each of c copies counts
    # 1 / c, so a text counts once and only hashes are joined; the sum is a whole number but for rounding.
    once_each = found.select(F.xxhash64("text").alias("doc"), _words(F.col("text")).alias("terms")).join(F.broadcast(copied) if n_copied <= FEW else copied.hint("shuffle_merge"), "doc", "left")
    n_term = once_each.select(F.explode_outer("terms").alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("weight")).groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n_term"))
    share = F.col("n_both") / F.greatest("n_term", "n_both")
    scored = candidates.join(n_term, "term").join(entities, "entity").select("term", share.alias("share"), F.log2(share * n_docs / F.col("n_entity")).alias("bits"))
    return scored.where((F.col("share") >= limits.share) & (F.col("bits") >= limits.bits)).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))


def find(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`docs` (doc_id, text) with arrays of spans: email, ip, card, phone, and term for words that disclose an entity.

    One row per row; a null text counts as empty, an empty table has no rows. Positions are code points, ends
    exclusive. Base spans stay whatever the corpus says.
    """
    found = with_base(docs)
    flagged = materialise(disclosing_terms(found, limits), "terms")
    n = flagged.count()
    if not n:
        return found.withColumn("term", _empty())
    spelt = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    words = found.select(F.xxhash64("text").alias("_h"), F.explode_outer(spelt).alias("spelt")).withColumn("term", F.lower("spelt"))
    by_text = semi_by_size(words, flagged.select("term"), "term", n).groupBy("_h").agg(F.array_sort(F.collect_set("spelt")).alias("_terms"))
    by_text = materialise(by_text, "by_text")
    size = by_text.agg(F.coalesce(F.sum(F.size("_terms") + 1), F.lit(0))).first()[0]
    # Few flagged texts come to the documents; many meet them in a shuffle.
    joined = found.withColumn("_h", F.xxhash64("text")).join(F.broadcast(by_text) if size <= FEW else by_text, "_h", "left")
    # A text's own spellings of its flagged words, as whole words: only they are matched, however many words it has.
    whole = F.concat(F.lit(f"(?<!{WORD[:-1]})(?:"), F.array_join("_terms", "|"), F.lit(f")(?!{WORD[:-1]})"))
    term = F.when(F.col("_terms").isNotNull(), _spans(F.col("text"), whole))
    return joined.withColumn("term", F.coalesce(term, _empty())).drop("_h", "_terms")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of found rows."""
    text = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    base = F.array_join(F.concat(*[text(k) for k in KINDS]), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(*[text(k) for k in (*KINDS, "term")]), ",").alias("spans"))


def sanitised(found: DataFrame, limits: Limits = Limits()) -> Column:
    """The text with base spans generalised to their kind, and disclosing terms generalised ("[TERM]") or, when short, removed."""
    spans = F.concat(*[_generalised(k) for k in KINDS], F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.length(s["value"]) >= limits.generalise_from, "[TERM]").otherwise("").alias("by"))))

    def piece(t: Column, of: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        step = lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), s["by"]))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(of, zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, F.length(t)))), ""))

    return F.when(F.size(spans) > 0, _rewritten(F.col("text"), spans, piece)).otherwise(F.col("text"))


def sanitise(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`docs` with all columns and rows, the text sanitised and n_chars, where there is one, its new length; a null text stays
    null, an empty table stays empty.

    Found rows meet their documents by the text itself being carried along, so no
    join on an id can confuse rows that share one.
    """
    names = docs.columns
    rest = F.struct(F.col("text").isNull().alias("_null"), *[F.col(f"`{n}`") for n in names if n != "text"])
    found = find(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", rest.alias("_row")), limits)
    out = found.select("_row", F.when(~F.col("_row._null"), sanitised(found, limits)).alias("_new"))
    length = F.coalesce(F.length("_new").cast("long"), F.col("_row.n_chars")) if "n_chars" in names else None
    each = {"text": F.col("_new"), "n_chars": length}
    return out.select(*[each[n].alias(n) if n in each else F.col(f"_row.`{n}`").alias(n) for n in names])

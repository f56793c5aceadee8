"""URL filter by a temporal list join, in DataFrame operations only.

Dated list entries (an entry is added or removed on a day) become validity
intervals by looking at the next event of the same entry. A capture offers all
the keys a list may hold for its URL: its host, the host's parent domains, and its
host with its first path segments, as many as the deepest entry has.

Keys that no list has go first. The others are answered by an as-of join: keys
and the starts and ends of an entry's intervals stand in one sequence by time, and
each key takes the state that the last event before it left behind. So a key meets
one state of each list however often an entry was listed; hot patterns are salted
into parts of bounded size, each with the pattern's own few events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_by_size, materialise, semi_by_size

#: Keys of a pattern in one part of the as-of join, about.
PART = 2_000


def intervals(entries: DataFrame) -> DataFrame:
    """Dated `entries` (pattern, list, event add|remove, at) as (pattern, list, valid_from, valid_to).

    valid_to is exclusive and null while the entry is still active. Entries with a
    null field are left out. Repeated adds do not restart an interval, repeated
    removes change nothing; of events at the same moment the removal counts last.
    """
    clean = entries.select(F.lower("pattern").alias("pattern"), "list", F.lower("event").alias("event"), "at").dropna().where(F.col("event").isin("add", "remove")).dropDuplicates()
    w = W.partitionBy("list", "pattern").orderBy("at", "event")
    changed = clean.withColumn("was", F.lag("event", 1, "remove").over(w)).where(F.col("was") != F.col("event"))
    spans = changed.withColumn("valid_to", F.lead("at").over(w)).where(F.col("event") == "add")
    return spans.select("pattern", "list", F.col("at").alias("valid_from"), "valid_to").where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def host_of(url) -> object:
    """Lower-case host without user, port and a final dot; an empty string if `url` has none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(?::[0-9]*)?$", ""))


def segments_of(url) -> object:
    """The non-empty segments of the path of `url`."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys_of(url, depth: int) -> object:
    """Every pattern that may name `url`: host, parent domains of two labels or more, host with 1 to `depth` path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    if depth:
        segments = F.slice(segments_of(url), 1, depth)
        paths = F.transform(F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda i: i <= F.size(segments)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i), "/")))
        keys = F.concat(keys, paths)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(keys, lambda k: F.lower(k))))


def as_of(keys: DataFrame, spans: DataFrame, part: int = PART) -> DataFrame:
    """`keys` (pattern, fetched_at, and others) with `list` of each interval of `spans` that is open at fetch time.

    One row for each key and list; keys that meet none are left out.
    """
    counted = keys.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    hot = materialise(counted.select("pattern", F.ceil(F.col("n") / part).cast("int").alias("parts")), "hot")
    n_hot = hot.count()  # one for every `part` keys at most
    own = [c for c in keys.columns if c != "pattern"]
    lists = spans.select("pattern", "list").distinct()
    salted = join_by_size(keys, hot, "pattern", n_hot, "left").select("pattern", *own, F.pmod(F.xxhash64(*own), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    spread = lambda d: join_by_size(d, hot, "pattern", n_hot, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    asked = salted.join(spread(lists), ["pattern", "part"])
    starts = spread(spans.select("pattern", "list", F.col("valid_from").alias("at"), F.lit(1).alias("turn"), F.lit(True).alias("open")))
    ends = spread(spans.where("valid_to is not null").select("pattern", "list", F.col("valid_to").alias("at"), F.lit(0).alias("turn"), F.lit(False).alias("open")))
    rows = asked.select("pattern", "list", "part", F.col("fetched_at").alias("at"), F.lit(2).alias("turn"), F.struct(*own).alias("key"))
    line = rows.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    w = W.partitionBy("pattern", "list", "part").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    state = line.withColumn("open", F.last("open", ignorenulls=True).over(w))
    return state.where(F.col("key").isNotNull() & F.col("open")).select("pattern", "key.*", "list")


def filter_urls(captures: DataFrame, entries: DataFrame, part: int = PART) -> DataFrame:
    """`captures` (page_id, url, fetched_at) with host, n_matches, first_list and blocked, one row per row.

    A capture is blocked if any entry is active at its fetch time: from valid_from on
    and before valid_to. Entries may name any number of path segments. A null or
    unparsable URL, or a null fetch time, matches nothing. Equal captures are judged
    once and every row reports the result. Other columns are not read.
    """
    spans = materialise(intervals(entries), "spans")
    depth = spans.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()[0]
    own = captures.select("page_id", "url", "fetched_at")
    listed = spans.select(F.xxhash64("pattern").alias("_h")).distinct()  # by hash, so its size is bounded; the as-of join compares patterns
    keys = own.dropna(subset=["url", "fetched_at"]).select("url", "fetched_at", F.explode(keys_of(F.col("url"), depth)).alias("pattern"))
    keys = semi_by_size(keys.withColumn("_h", F.xxhash64("pattern")), listed, "_h", spans.count()).drop("_h")
    keys = materialise(keys.distinct(), "keys")
    hits = as_of(keys, spans, part).groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n"), F.min("list").alias("first_list"))
    hits = materialise(hits, "hits")
    chars = hits.agg(F.coalesce(F.sum(F.length("url") + 32), F.lit(0))).first()[0]
    return join_by_size(own, hits, ["url", "fetched_at"], chars // 8, "left").select(
        "page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), "first_list", F.col("n").isNotNull().alias("blocked"),
    )

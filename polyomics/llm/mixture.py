"""Problem 7: sources mixed to target shares of tokens.

A low-discrepancy schedule: slot i of the mixture gets the point frac(i * golden ratio), in 32-bit integers so that it keeps its precision
however large i is, and the source in whose stretch of the cumulative weights the point falls. A source's documents, shuffled, are one stream of tokens, begun anew when it is through; the
r-th slot of a source takes the r-th block of the stream. All blocks have the same number of tokens, documents being cut where a
block is full, so that the shares are those of the slots at any length, up to a few blocks. A source too small for its share, even
repeated as often as allowed, gets what it has; the shares reached are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The fractional part of the golden ratio in units of 2^-32, and 2^32.
GOLDEN = 2654435769
POINTS = 1 << 32
#: Slots by which the points may miss a source's share, left free in the source that runs out first.
SLACK = 2
#: Tokens of a block; rows of a bucket within which a rank or running sum is taken.
BLOCK = 2048
BUCKET_ROWS = 10_000


def stream(counted: DataFrame, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """source, doc_id, n_tokens, start: where each document begins in its source's shuffled stream. ``counted`` (doc_id, source,
    n_tokens) is read twice; its sources are those of a target list, so that their sizes are broadcast. Null sources and documents without tokens are left out; copies of a document stay, as rows of their own.

    The shuffled order is that of (bucket, hash of doc_id). A running sum over a source would put a third of all rows into one task;
    here it runs within buckets of some thousand documents, and over the bucket totals, one row per bucket.
    """
    c = counted.where("source is not null and n_tokens > 0")
    size = c.groupBy("source").agg(F.ceil(F.count("*") / bucket_rows).alias("buckets"))
    c = c.join(F.broadcast(size), "source").withColumn("mix", F.xxhash64(F.lit(seed), "doc_id"))
    c = c.select("source", "doc_id", "n_tokens", "mix", F.pmod(F.shiftright("mix", 20), F.col("buckets")).alias("bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = c.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("total")).select("source", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("mix", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals.hint("merge"), ["source", "bucket"])
    return c.select("source", "doc_id", "n_tokens", (F.col("before") + F.col("within")).alias("start"))


def plan(streamed: DataFrame, target: DataFrame, block: int = BLOCK, total_tokens: int | None = None, whole_corpus: bool = False) -> DataFrame:
    """source, target_share, weight, capped, max_repeats, tokens, turns, slots, lo, hi: one row per source of ``target`` (source,
    target_share, max_repeats).

    By default the mixture is as long as it can be with every share met: until the first source, repeated as often as allowed, runs out.
    With ``total_tokens``, or ``whole_corpus`` for as many as the documents of the sources named have, a source whose share of that is
    more than max_repeats times its tokens is capped at these, and the others take over what it lacks in proportion to their shares.
    weight is the share so planned, 0 for a source without documents, whose share the others take over likewise; lo and hi bound
    its stretch of the cumulative weights; turns is how many blocks its repeats allow, slots the length of the mixture in blocks.
    """
    have = streamed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = target.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).join(have, "source", "left")
    t = t.withColumn("turns", F.coalesce(F.floor(F.col("tokens") * F.col("max_repeats") / block), F.lit(0)).cast("bigint"))
    every = Window.partitionBy(F.lit(0))  # some rows: one per source of the target list
    usable = (F.col("turns") > 0) & (F.col("target_share") > 0)
    share, cap = F.when(usable, F.col("target_share")).otherwise(0.0), F.when(usable, F.col("turns")).otherwise(0)
    t = t.withColumns({"share": share, "cap": cap, "ratio": F.when(usable, cap / share)})
    if total_tokens is None and not whole_corpus:
        least = F.min(F.when(usable, F.greatest(cap - SLACK, cap / 2) / share)).over(every)
        t = t.withColumn("blocks", F.coalesce(least * F.col("share"), F.lit(0.0)))
    else:
        # Blocks per unit of share, if just the sources that run out earlier (in the order of ratio) are capped; the first level that its
        # own source can follow is the one.
        total = F.coalesce(F.sum("tokens").over(every), F.lit(0)) / block if total_tokens is None else F.lit(total_tokens / block)
        order = every.orderBy(F.col("ratio").asc_nulls_first(), "source")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        t = t.withColumn("level", F.try_divide(total - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("share").over(after)))
        level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every).getField("level")
        t = t.withColumn("blocks", F.when(F.col("share") > 0, F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("share"), F.col("cap").cast("double")))).otherwise(0.0))
    t = t.withColumns({"weight": F.coalesce(F.try_divide(F.col("blocks"), F.sum("blocks").over(every)), F.lit(0.0)), "slots": F.floor(F.sum("blocks").over(every)).cast("bigint")})
    hi = F.sum("weight").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    capped = (F.col("blocks") >= F.col("cap")) & (F.col("share") > 0)
    return t.withColumns({"hi": hi, "capped": capped}).select("source", "target_share", "weight", "capped", "max_repeats", "tokens", "turns", "slots", (F.col("hi") - F.col("weight")).alias("lo"), "hi")


def schedule(planned: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """slot, source, turn: slot i is for the source whose stretch holds i * GOLDEN mod POINTS; turn is its rank among the source's slots.

    Slots are made where they are needed, from the length in ``planned``; ranks are taken within buckets of slots and added to the
    counts of the buckets before. A turn beyond what a source's repeats allow, of which the points may ask for a few, is left out.
    """
    p = planned.where("weight > 0").select("source", "lo", "hi", "slots", "turns")
    parts = p.agg(F.coalesce(F.max("slots"), F.lit(0)).alias("slots"), F.array_sort(F.collect_list(F.struct("hi", "source", "turns"))).alias("edges"))
    parts = parts.where("slots > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / bucket_rows)))).repartition("part")
    s = parts.withColumn("slot", F.explode(F.sequence(F.col("part") * bucket_rows, F.least(F.col("slots"), (F.col("part") + 1) * bucket_rows) - 1)))
    high, low = F.shiftright("slot", 20), F.col("slot").bitwiseAND(F.lit((1 << 20) - 1))  # so that no product overflows
    point = F.pmod(high * ((GOLDEN << 20) % POINTS) + low * GOLDEN, F.lit(POINTS))
    own = F.coalesce(F.get(F.filter("edges", lambda e: F.floor(e["hi"] * POINTS) > F.col("point")), F.lit(0)), F.element_at("edges", -1))
    s = s.withColumn("point", point).select("part", "slot", own.alias("own")).select("part", "slot", "own.source", "own.turns")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = s.groupBy("source", "part").agg(F.count("*").alias("n")).select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1).join(counts.hint("merge"), ["source", "part"])
    return s.withColumn("turn", F.col("before") + F.col("rank")).where("turn < turns").select("slot", "source", "turn")


def mix(streamed: DataFrame, planned: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, place, source, doc_id, first_token, n_tokens, repeat: the mixture in the order of (slot, place).

    Each row is the tokens first_token .. first_token + n_tokens - 1 of a document, counted from 0; the rows of a slot have ``block``
    tokens together. repeat is 0 the first time through the source. Documents meet their blocks in an equi-join on (source, turn).
    Without usable sources there are no rows.
    """
    used = schedule(planned)
    needed = used.groupBy("source").agg(F.max("turn").alias("last"))
    p = planned.join(needed, "source").select("source", "tokens", "last")
    d = streamed.join(F.broadcast(p), "source")  # as many rows as the target list
    through = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") + 1) * block / F.col("tokens")))
    d = d.withColumn("repeat", F.explode(through)).withColumn("at", F.col("repeat") * F.col("tokens") + F.col("start"))
    d = d.withColumn("turn", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)))).where("turn <= last")
    begin, end = F.greatest("at", F.col("turn") * block), F.least(F.col("at") + F.col("n_tokens"), (F.col("turn") + 1) * block)
    d = d.select("source", "turn", "doc_id", "repeat", (begin - F.col("turn") * block).alias("place"), (begin - F.col("at")).alias("first_token"), (end - begin).alias("n_tokens"))
    return d.join(used.hint("merge"), ["source", "turn"]).select("slot", "place", "source", "doc_id", "first_token", "n_tokens", "repeat")


def blocks(mixed: DataFrame, encoded: DataFrame) -> DataFrame:
    """slot, source, ids: the mixture itself, each slot's block of token ids, cut out of ``encoded`` (doc_id, ids)."""
    part = F.slice("ids", F.col("first_token").cast("int") + 1, F.col("n_tokens").cast("int"))
    p = mixed.join(encoded.hint("merge"), "doc_id").select("slot", "source", F.struct("place", part.alias("ids")).alias("p"))
    return p.groupBy("slot", "source").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["ids"])).alias("ids"))


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """source, target_share, weight, capped, reached_share, mixed_tokens, tokens, repeats, max_repeats for every source of the target.

    reached_share is of all tokens of the mixture, null if it is empty; repeats is how many times the source's tokens are used on
    average. A source without documents reaches 0: the others keep their proportions."""
    m = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    t = planned.join(m, "source", "left").withColumns({"mixed_tokens": F.coalesce("mixed_tokens", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    reached = F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))
    return t.select("source", "target_share", "weight", "capped", reached.alias("reached_share"), "mixed_tokens", "tokens", F.try_divide(F.col("mixed_tokens"), F.col("tokens")).alias("repeats"), "max_repeats")

"""Joins of rows to what was found about their groups, when one group may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyomics.session import materialize

#: Rows of a group from which it is split. At most a thousand groups are, whatever the data.
HOT = 100_000
#: Rows up to which a list of hot keys is broadcast.
LISTED = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, hot: int = HOT) -> DataFrame:
    """``rows`` left join ``groups`` (unique by ``keys``), with hot groups salted.

    ``size`` is the column of ``groups`` with the number of their rows; it is not part of the result. The list of hot groups, those of at
    least ``hot`` rows and of a thousandth of all, is broadcast: a thousand rows at most. Their rows are spread by the hash of column
    ``spread`` over as many salts as the group is times that large, and the group's one row is repeated per salt. Rows with a null key find
    nothing and are spread too. ``groups`` is written once, as it is read three times."""
    g = materialize(groups, "groups")
    total = g.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(hot, total // 1000)
    salts = F.when(F.col(size) >= limit, F.ceil(F.col(size) / limit)).otherwise(1).cast("bigint")
    listed = F.broadcast(g.where(F.col(size) >= limit).select(*keys, salts.alias("_salts")))
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    r = rows.join(listed, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.when(absent, 64).otherwise(1)))).drop("_salts")
    g = g.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop(size)
    return r.join(g, [*keys, "_salt"], "left").drop("_salt")


def join_salted(a: DataFrame, b: DataFrame, keys: list[str], spread: str, hot: int = 2_000) -> DataFrame:
    """Inner join of two frames that may both have many rows of a key: the rows of ``a`` under a hot key are spread by the hash of
    ``spread``, those of ``b`` repeated per salt, so that a task gets some ``hot`` rows of ``a`` with all of ``b``.

    Keys of more than ``hot`` rows in ``b`` are counted, with map-side combining, and written; they are broadcast while there are at
    most LISTED, else joined by a shuffle. ``a`` and ``b`` are read twice, so they should be cheap to read."""
    listed = materialize(b.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot), "hot")
    n = listed.count()
    if not n:
        return a.join(b, keys)
    listed = listed.select(*keys, F.ceil(F.col("_n") / hot).cast("bigint").alias("_salts"))
    listed = F.broadcast(listed) if n <= LISTED else listed
    x = a.join(listed, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    y = b.join(listed, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return x.join(y, [*keys, "_salt"]).drop("_salt")

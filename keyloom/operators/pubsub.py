"""Channels: who is subscribed, and who receives what. ``streaming.groups.channels`` is the same over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ranges import matches


def subscribed(log: DataFrame) -> DataFrame:
    """client, kind, name of the subscriptions that a log of SUBSCRIBE, PSUBSCRIBE, SSUBSCRIBE and their opposites leaves.

    Log rows are (client, seq, kind, name, on); kind is 'channel', 'pattern' or 'shard'; a null name with on = false ends
    all of a client's subscriptions of that kind.
    """
    all_off = log.filter("name IS NULL AND NOT on").groupBy("client", "kind").agg(F.max("seq").alias("off"))
    last = log.filter("name IS NOT NULL").groupBy("client", "kind", "name").agg(F.max(F.struct("seq", "on")).alias("last"))
    both = last.join(all_off, ["client", "kind"], "left")
    return both.filter(F.col("last.on") & (F.col("off").isNull() | (F.col("last.seq") > F.col("off")))).select("client", "kind", "name")


def receivers(channels: DataFrame, subscriptions: DataFrame, patterns: list[str]) -> DataFrame:
    """channel, receivers: PUBLISH's answer for every channel: its subscribers, and those of each pattern that matches it.

    ``patterns`` are the different patterns in use; a client that matches twice receives twice.
    """
    direct = channels.join(subscriptions.filter("kind = 'channel'"), F.col("channel") == F.col("name")).select("channel", "client")
    by_pattern = subscriptions.filter("kind = 'pattern'")
    for p in patterns:
        hit = channels.filter(matches(F.col("channel"), p)).withColumn("pattern", F.lit(p))
        direct = direct.unionAll(hit.join(by_pattern, F.col("pattern") == F.col("name")).select("channel", "client"))
    return channels.join(direct.groupBy("channel").agg(F.count(F.lit(1)).alias("n")), "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("receivers"))


def numsub(subscriptions: DataFrame, asked: DataFrame, kind: str = "channel") -> DataFrame:
    """PUBSUB NUMSUB (SHARDNUMSUB): subscribers of each asked channel, 0 without any."""
    per = subscriptions.filter(F.col("kind") == kind).groupBy(F.col("name").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(per, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("subscribers"))


def active(subscriptions: DataFrame, pattern: str = "*", kind: str = "channel") -> DataFrame:
    """PUBSUB CHANNELS (SHARDCHANNELS): the channels with a subscriber that match a glob."""
    return subscriptions.filter((F.col("kind") == kind) & matches(F.col("name"), pattern)).select(F.col("name").alias("channel")).distinct()


def numpat(subscriptions: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: the number of different patterns."""
    return subscriptions.filter("kind = 'pattern'").agg(F.count_distinct("name").alias("n"))

"""Transactions: batches of commands that take effect as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aborted(commands: DataFrame, watches: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    """batch, reason of the batches that EXEC refuses.

    ``commands`` (batch, seq, ok, ...): a command that was refused when it was queued (ok is false) makes its batch fail
    ('execabort'). ``watches`` (batch, key, seen): a watched key whose version (``versions``: key, version; none is 0) is
    another one by now makes it do nothing ('nil').
    """
    bad = commands.filter(~F.col("ok")).select("batch", F.lit("execabort").alias("reason"))
    if watches is not None:
        now = watches.join(versions.select("key", "version"), "key", "left")
        moved = now.filter(F.coalesce("version", F.lit(0)) != F.col("seen")).select("batch", F.lit("nil").alias("reason"))
        bad = bad.unionAll(moved)
    return bad.groupBy("batch").agg(F.min("reason").alias("reason"))  # a refused command comes first


def executed(commands: DataFrame, watches: DataFrame | None = None, versions: DataFrame | None = None, discarded: DataFrame | None = None) -> DataFrame:
    """MULTI ... EXEC: the commands that take effect; those of batches that are refused or were discarded do not."""
    out = commands.join(aborted(commands, watches, versions).select("batch"), "batch", "left_anti")
    return out if discarded is None else out.join(discarded.select("batch"), "batch", "left_anti")

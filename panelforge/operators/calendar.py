"""Working days and clock repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ordered import listed, same_keys


def working_day(df, day, region, holidays, name="working"):
    """1 on weekdays that are no holiday of the region. ``holidays`` has the day and region columns."""
    off = holidays.select(day, region).distinct().withColumn("_off", F.lit(1))
    out = same_keys(df, off, [day, region], "left")
    return out.withColumn(name, (F.col("_off").isNull() & (F.weekday(day) < 5)).cast("int")).drop("_off")


def repair_clock(df, keys, ts, seen, name=None):
    """Add the largest lead of the last-seen time over the clock of the key to its times."""
    gaps = df.groupBy(*listed(keys)).agg(F.max(F.col(seen) - F.col(ts)).alias("_gap"))
    return same_keys(df, gaps, listed(keys), "left").withColumn(name or ts, F.col(ts) + F.col("_gap")).drop("_gap")

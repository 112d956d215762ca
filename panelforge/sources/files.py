"""Table sources and sinks on Spark's own readers and writers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import listed
from ..session import shared_dir


def read_csv(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    """CSV file, folder or glob with a header; types are inferred only without a schema, which costs a second read."""
    reader = spark.read.option("header", True).options(**options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_yearly(spark, paths: dict[int, str], cols, id_col="GEO_ID", marker="US", key="key", blank_years=()) -> DataFrame:
    """Yearly files with a second header line: that line dropped, the key taken from the id's
    end, one ``year`` column. ``blank_years`` repeat the keys of the last file with NULL values."""
    cols, parts = listed(cols), []
    for year, path in sorted(paths.items()):
        d = spark.read.option("header", True).csv(path)
        d = d.filter(F.col(id_col).contains(marker))  # the second header has a label here
        number = F.element_at(F.split(id_col, marker), -1).cast("bigint")
        parts.append(d.select(number.alias(key), F.lit(year).alias("year"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in cols]))
    for year in blank_years:
        parts.append(parts[len(paths) - 1].select(key, F.lit(year).alias("year"), *[F.lit(None).cast("double").alias(c) for c in cols]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def convert(spark, src, dst, schema=None) -> DataFrame:
    """CSV to Parquet; gives the Parquet table."""
    read_csv(spark, src, schema).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def write_parquet(df, path, codec="zstd", partition_by=()):
    df.write.mode("overwrite").option("compression", codec).partitionBy(*listed(partition_by)).parquet(path)


def export_csv(df, path, shards: int | None = None, codec: str | None = None):
    """CSV files with a header, in ``shards`` files if given."""
    out = df if shards is None else df.repartition(shards)
    out.write.mode("overwrite").option("header", True).option("compression", codec or "none").csv(path)


def write_submission(df, path, key, prediction):
    """Key and prediction as gzipped CSV."""
    export_csv(df.select(*listed(key), *listed(prediction)), path, codec="gzip")


def write_folds(df, fold, path, part=None):
    """One folder per fold (and part), so a reader of one fold opens only its files."""
    df.write.mode("overwrite").partitionBy(*[c for c in (fold, part) if c]).parquet(path)


def materialize(df, name, path=None, mode="overwrite") -> DataFrame:
    """Write a query's result as a table of the catalog, replacing it; ``path`` puts its files there."""
    writer = df.write.mode(mode) if path is None else df.write.mode(mode).option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def run_sql(spark, text, views: dict[str, DataFrame], into: str | None = None, path=None) -> DataFrame:
    """Run SQL over named tables; ``into`` stores the result as a table."""
    out = spark.sql(text, **views)
    return out if into is None else materialize(out, into, path)


def cached(spark, name, fn: Callable[[], DataFrame], refresh=False) -> DataFrame:
    """Compute a feature block once and read it back by name from the shared folder.

    The block is written whole under a fresh name and then listed by a small marker
    table, so a job that dies midway leaves no half-written block in use.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError("block names are made of letters, digits and _")
    home = f"{shared_dir(spark)}/blocks/{name}"
    marker = f"{home}/current"
    try:
        held = None if refresh else spark.read.schema("path string").json(marker).first()
    except AnalysisException:  # no such block yet
        held = None
    if held is None:
        data = f"{home}/{uuid.uuid4().hex}"
        fn().write.parquet(data)
        spark.createDataFrame([(data,)], "path string").coalesce(1).write.mode("overwrite").json(marker)
        return spark.read.parquet(data)
    return spark.read.parquet(held["path"])


def assemble(blocks: dict[str, DataFrame], keys) -> DataFrame:
    """Feature blocks side by side in the order of their names: every key of any block, NULL keys included.

    A column of one block is NULL for keys that only others hold; a repeated column is an error.
    """
    keys = listed(keys)
    out, seen = None, set(keys)
    for name in sorted(blocks):
        block = blocks[name]
        again = [c for c in block.columns if c in seen and c not in keys]
        if again:
            raise ValueError(f"block {name} repeats {again}")
        seen.update(block.columns)
        if out is None:
            out = block
            continue
        renamed = block.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in block.columns if c not in keys])
        met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
        joined = out.join(renamed, met, "full")
        out = joined.select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in keys], *[c for c in joined.columns if c not in keys and not c.startswith("_r_")])
    return out


def scratch(spark, name) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def moved(spark, folders, into):
    """Move folders into a folder, made if there is none: a rename each, so a reader of it sees all files of one or none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(into).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(into))
    for f in folders:
        if not fs.rename(at(f), at(into, at(f).getName())):
            raise OSError(f"{f} can't be moved into {into}")

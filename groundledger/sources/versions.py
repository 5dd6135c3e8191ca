"""Tables that are replaced key by key in one step: new rows beside the old ones, then one rename.

A table is a folder with ``data/version=.../`` (the rows of one write), ``manifests/...`` (for each key the version whose rows
count) and the file ``CURRENT``, which names one manifest. A write adds a version and a manifest and then puts a new ``CURRENT``
over the old one in a single rename. A run that is killed before that leaves everything readable as it was, and what it wrote
is in no manifest; a reader sees all keys of a write or none. Writers take turns: of two at the same time the last one wins whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def replace_keys(df: DataFrame, path: str, by: str, gone: DataFrame | None = None) -> None:
    """Replaces the rows of exactly the keys ``by`` that ``df`` holds, or ``gone``, which lists keys that may have no row any
    more (a key may be null); those of other keys stay."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/version={version}")
    keys = spark.read.parquet(f"{path}/data/version={version}").select(by)
    keys = (keys if gone is None else keys.unionByName(gone.select(by))).distinct().withColumn("version", F.lit(version))
    before = _manifest(spark, path)
    if before is not None:
        same = before[by].eqNullSafe(keys[by])
        keys = keys.unionByName(before.join(keys.select(by), same, "left_anti"))
    keys.write.parquet(f"{path}/manifests/{version}")
    _swap(spark, path, version)


def read_current(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The rows that count. Versions that no key uses are not read."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"{path} holds no finished write")
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    m = manifest.select(F.col(by).alias("_key"), F.col("version").alias("_version"))
    return rows.join(m, (rows["version"] == m["_version"]) & rows[by].eqNullSafe(m["_key"]), "left_semi").drop("version")


def _place(spark: SparkSession, path: str):
    conf = spark._jsc.hadoopConfiguration()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    return fs, fs.makeQualified(at), conf


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    fs, at, _ = _place(spark, f"{path}/CURRENT")
    if not fs.exists(at):
        return None
    name = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/manifests/{name}")


def _swap(spark: SparkSession, path: str, version: str) -> None:
    jvm = spark._jvm
    fs, new, conf = _place(spark, f"{path}/_{version}")
    out = fs.create(new, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, jvm.org.apache.hadoop.fs.Path(new.getParent(), "CURRENT"), options)

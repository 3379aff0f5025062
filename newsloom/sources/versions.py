"""Tables in versions: each is written beside the others, and counts from the moment its commit record is there.

A writer that dies leaves files without a record, which nobody reads and the next attempt at that version replaces. Readers that began
on an older version go on with it, until ``pruned`` takes it away. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMMITS, DATA = "_commits", "versions"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that count, oldest first; none where there is no table."""
    files, at = _at(spark, f"{path}/{COMMITS}")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version that counts, the latest if none is asked for; None where there is none."""
    known = committed(spark, path)
    if version is None and known:
        version = known[-1]
    return spark.read.parquet(f"{path}/{DATA}/{version}") if version in known else None


def publish(rows: DataFrame, path: str, version: int | None = None) -> bool:
    """Writes rows as a version (the one after the latest if none is named) and then its record; False if it counted before, or a later one does.

    rows may come from the versions before.
    """
    spark = rows.sparkSession
    known = committed(spark, path)
    version = (known[-1] + 1 if known else 0) if version is None else version
    if known and version <= known[-1]:
        return False
    rows.write.mode("overwrite").parquet(f"{path}/{DATA}/{version}")
    files, record = _at(spark, f"{path}/{COMMITS}/{version:019d}")
    files.create(record, False).close()
    return True


def pruned(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Takes away all but the last ``keep`` versions, records first, and files of attempts before them that were never committed; returns the versions that were."""
    known = committed(spark, path)
    gone, stay = known[:-keep], known[-keep:]
    for version in gone:
        files, record = _at(spark, f"{path}/{COMMITS}/{version:019d}")
        files.delete(record, False)
    files, data = _at(spark, f"{path}/{DATA}")
    if stay and files.exists(data):
        for found in [f.getPath() for f in files.listStatus(data)]:
            if int(found.getName()) < stay[0]:
                files.delete(found, True)
    return gone


def swap_catalog(catalog: DataFrame, path: str) -> DataFrame:
    """The catalogue in force: the new one, published as the next version, if it has an available league; else the one before, which stays. Fails if neither is there.

    A catalogue of the same rows as the one in force makes no version. catalog: rows of ``json_api.leagues``.
    """
    spark = catalog.sparkSession
    known = read(spark, path)
    if not catalog.where("status = 'available'").isEmpty():
        if known is None or known.schema.simpleString() != catalog.schema.simpleString() or not (known.exceptAll(catalog).isEmpty() and catalog.exceptAll(known).isEmpty()):
            publish(catalog, path)
            known = read(spark, path)
    if known is None:
        raise ValueError("no available league")
    return known

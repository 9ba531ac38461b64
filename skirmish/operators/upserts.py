"""Write semantics: insert-or-ignore, child rows, ledgers, set differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.stages import discard, exists, stored


def keep_first(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, target: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first incoming row of each key that the target lacks: what insert-or-ignore would insert."""
    return keep_first(incoming.join(target.select(*key), key, "left_anti"), key, order)


def insert_or_ignore(incoming: DataFrame, target: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return target.unionByName(new_rows(incoming, target, key, order))


def children_of(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    return children.join(parents.select(*key), key, "left_semi")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either only, with ``change`` (added, removed)."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).union(old.exceptAll(new).withColumn("change", F.lit("removed")))


def append_new(incoming: DataFrame, path: str, key: list[str], order: list[Column | str]) -> int:
    """Append to a Parquet table the rows of keys it lacks; how many. A missing table is created.

    The new rows are written aside first, so that those counted are those appended, whatever executors are lost.
    """
    spark = incoming.sparkSession
    fresh = stored(new_rows(incoming, spark.read.parquet(path), key, order) if exists(spark, path) else keep_first(incoming, key, order))
    fresh.write.mode("append").parquet(path)
    count = fresh.count()
    discard(fresh)
    return count


def import_files(spark: SparkSession, files: str, read: Callable[[list[str]], DataFrame], path: str, ledger: str, key: list[str], order: list[Column | str], glob: str = "*", at_once: int = 100) -> dict[str, int]:
    """Import the files that the ledger lacks, so many at a time; how many files and new rows.

    read gives the rows of a list of files. Rows of keys that the table at path has are left out (append_new), and the files
    are then entered in the ledger (file, imported_at). A run that breaks off in between has its files read again by the
    next one, which adds no row twice. The names of the files, as Spark lists them, are what the driver holds.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(files).select(F.col("path").alias("file"))
    if exists(spark, ledger):
        listed = listed.join(spark.read.parquet(ledger).select("file"), "file", "left_anti")
    names, rows = [r["file"] for r in listed.orderBy("file").collect()], 0
    for k in range(0, len(names), at_once):
        own = names[k : k + at_once]
        rows += append_new(read(own), path, key, order)
        spark.createDataFrame([(n,) for n in own], "file string").select("file", F.current_timestamp().alias("imported_at")).coalesce(1).write.mode("append").parquet(ledger)
    return {"files": len(names), "rows": rows}


LOG = "version string, started_at timestamp, finished_at timestamp, tables map<string,long>"


def rebuilt(spark: SparkSession, root: str, version: str, build: Callable[[], dict[str, DataFrame]]) -> tuple[bool, dict[str, int]]:
    """Build the tables of a version unless it is there already: whether it was built now, and the rows of each table.

    Tables lie at root/name, in folders of their version; one that an earlier run left unfinished is written anew, other versions
    stay. The log at root/_runs gets the version's row once all tables are written, which is what makes it complete.
    """
    log = f"{root}/_runs"
    done = spark.read.schema(LOG).parquet(log).where(F.col("version") == version).first() if exists(spark, log) else None
    if done:
        return False, dict(done["tables"])
    started, rows = spark.range(1).select(F.current_timestamp()).first()[0], {}
    for name, df in build().items():
        at = f"{root}/{name}"
        df.drop("version").withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(at)
        folder = f"{at}/version={version}"
        rows[name] = spark.read.parquet(folder).count() if exists(spark, folder) else 0
    row = spark.createDataFrame([(version, started, started, rows)], LOG).withColumn("finished_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(log)
    return True, rows


def updated(members: Column, added: Column, removed: Column) -> Column:
    """A set with members added, then others removed."""
    return F.array_except(F.array_union(members, added), removed)

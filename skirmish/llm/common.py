"""Pieces that several training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than SEPARATORS; null text gives an empty array."""
    spaced = F.coalesce(text, F.lit(""))
    for other in SEPARATORS[1:]:
        spaced = F.replace(spaced, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(SEPARATORS)) != ""


def count_of(text: Column, characters: str) -> Column:
    """How many of the given characters the text holds. Searching one at a time is cheaper than translate()."""
    left = text
    for one in characters:
        left = F.replace(left, F.lit(one), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies below ``spark.checkpoint.dir``. Only a session without executors of its own (``local[n]``)
    may leave that unset; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root}/skirmish-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_LOCAL: list[tempfile.TemporaryDirectory] = []


def _local_root() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="skirmish-"))
        atexit.register(_LOCAL[0].cleanup)
    return _LOCAL[0].name


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``k``, ``v`` and ``text`` (null as empty), and the columns of also: k and v name a document.

    k is the id; a null id becomes a number from a hash of the text, below -2^62. v is another hash, which
    tells apart the texts of rows that share an id. Rows of one id and text are one document.
    """
    body, own = F.coalesce(F.col(text), F.lit("")), F.col(doc_id).cast("long")
    stand_in = F.shiftrightunsigned(F.xxhash64(body, F.lit(1)), 2).bitwiseOR(F.lit(-(2**63)))
    return docs.select(own.alias("doc_id"), F.coalesce(own, stand_in).alias("k"), F.xxhash64(body, own.isNull()).alias("v"), body.alias("text"), *also)


#: Ids that restricted() may send to every task: at 16 to 24 bytes each some 10 MB.
BROADCAST_IDS = 400_000


def restricted(df: DataFrame, ids: DataFrame, outside: bool = False) -> DataFrame:
    """The rows of df whose columns of ids' names occur in ids, or with outside those that don't.

    ids should be stored(): its rows are counted first. Up to BROADCAST_IDS are broadcast, so that df, which holds the
    texts, stays where it is; more are joined by a shuffle.
    """
    keys = ids.distinct()
    if ids.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return df.join(keys, ids.columns, "left_anti" if outside else "left_semi")

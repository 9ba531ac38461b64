"""Line dedup by overlapping windows of three lines, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import stored

WINDOW = 3


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated lines cut out of the text, and ``n_lines`` and ``n_removed`` added.

    Every three consecutive lines of a text (split at newline, compared byte for byte, blank lines too) are a window.
    Of equal windows anywhere in the table the first stays, by (doc_id, line number); the lines under any later one go.
    Covered positions are merged into runs, and the text is put together again from what lies between them.

    Texts of fewer than three lines have no window and stay as they are, as do null texts. A null id sorts first.
    Rows that repeat an id and a text are one document: they don't count as copies of themselves, and get the same
    result. Rows that share an id but not the text are told apart by a hash of the text; of their equal windows the one
    with the lower line number, then hash, is first. Input columns named like the two new ones are replaced. An empty
    table gives an empty table.
    """
    key = {"_id": F.col(doc_id), "_v": F.xxhash64(text)}
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    digest = lambda i: F.unhex(F.md5(F.concat_ws("\n", F.get("_lines", i), F.get("_lines", i + 1), F.get("_lines", i + 2))))
    base = docs.where(n >= WINDOW).select(*[c.alias(a) for a, c in key.items()], lines.alias("_lines"))
    windows = base.select("_id", "_v", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), digest)).alias("_p", "_h"))
    windows = stored(windows)
    at = F.struct("_id", "_p", "_v")
    repeated = windows.groupBy("_h").agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where(~F.col("_first").eqNullSafe(F.col("_last")))
    later = windows.join(repeated, "_h").where(~at.eqNullSafe(F.col("_first")))
    covered = later.groupBy("_id", "_v").agg(F.sort_array(F.collect_set("_p")).alias("_at"))
    covered = covered.withColumnsRenamed({"_id": "_cid", "_v": "_cv"})
    df = docs.withColumns({**key, "n_lines": F.when(F.col(text).isNull(), 0).otherwise(n).cast("long")})
    df = df.join(covered, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_v") == F.col("_cv")), "left")
    # runs of covered lines [start, end), merged from the sorted starts of the removed windows
    starts = F.filter("_at", lambda p, i: F.coalesce(F.get("_at", i - 1) + WINDOW < p, F.lit(True)))
    ends = F.transform(F.filter("_at", lambda p, i: F.coalesce(F.get("_at", i + 1) > p + WINDOW, F.lit(True))), lambda p: p + WINDOW)
    df = df.withColumns({"_s": starts, "_e": ends})
    removed = F.aggregate(F.zip_with("_s", "_e", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    begin = lambda i: F.coalesce(F.get("_e", i - 1), F.lit(0))
    between = lambda i: F.slice("_all", begin(i) + 1, F.coalesce(F.get("_s", i), F.size("_all")) - begin(i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_s")), between))
    df = df.withColumn("_all", F.when(F.col("_at").isNotNull(), lines))
    df = df.withColumns({"n_removed": F.coalesce(removed, F.lit(0).cast("long")), text: F.when(F.col("_at").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))})
    return df.drop("_id", "_v", "_cid", "_cv", "_at", "_s", "_e", "_all")

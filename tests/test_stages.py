"""Clusters under constraints, imports by a ledger, rebuilds by version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import identity, upserts


def greedy(edges, forbidden):
    """Clusters from the strongest link on; a brute-force version."""
    label = {x: x for e in edges for x in e[:2]}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        x, y = sorted((label[a], label[b]))
        if x != y and not any({label.get(p), label.get(q)} == {x, y} for p, q in forbidden):
            label = {k: x if v == y else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("seed", range(3))
def test_constrained_clusters(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)}
    edges = [(*(p if rng.random() < 0.5 else p[::-1]), rng.randrange(12) / 2) for p in sorted(pairs)]
    forbidden = [tuple(rng.sample(range(62), 2)) for _ in range(40)]
    got = identity.constrained_clusters(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame([*forbidden, (1, 1)], "a long, b long"), bands=3)
    label = {r["id"]: r["label"] for r in got.collect()}
    assert label == greedy(edges, forbidden)
    assert all(label.get(p, -1) != label.get(q, -2) for p, q in forbidden)


def test_clusters_of_odd_edges(spark):
    edges = spark.createDataFrame([("x", "x", 1.0), ("a", "b", None), ("c", "d", 2.0), ("d", "c", 9.0), (None, "e", 1.0)], "a string, b string, weight double")
    none = spark.createDataFrame([], "a string, b string")
    assert {r["id"]: r["label"] for r in identity.constrained_clusters(edges, none).collect()} == {"c": "c", "d": "c"}
    assert identity.constrained_clusters(edges.limit(0), none).count() == 0


def test_imports_go_on_where_they_broke_off(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for k in range(5):
        (logs / f"{k}.log").write_text("\n".join(f"m{3 * k + j} text" for j in range(4)))  # the last of each is the first of the next
    read = lambda names: spark.read.text(names).select(F.split("value", " ")[0].alias("id"), F.col("value"))
    run = lambda reader=read: upserts.import_files(spark, str(logs), reader, str(tmp_path / "t"), str(tmp_path / "ledger"), ["id"], ["value"], "*.log", at_once=2)
    turns = iter([1, 1])

    def breaks(names):
        if next(turns, None) is None:
            raise OSError("gone")
        return read(names)

    with pytest.raises(OSError, match="gone"):
        run(breaks)
    # the table was appended to, the ledger not: as if the run had ended in between
    (logs / "5.log").write_text("m0 text\nm99 text")
    upserts.append_new(read([str(logs / "5.log")]), str(tmp_path / "t"), ["id"], ["value"])
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4
    assert run() == {"files": 2, "rows": 3}
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == sorted([f"m{k}" for k in range(16)] + ["m99"])
    assert run() == {"files": 0, "rows": 0}


def test_rebuilds_by_version(spark, tmp_path):
    root, built = str(tmp_path / "r"), []

    def build(n, fail=False):
        def make():
            built.append(n)
            late = spark.range(n).select(F.raise_error(F.lit("broken")).cast("long").alias("id")) if fail else spark.range(n)
            return {"sessions": spark.range(n).withColumn("version", F.lit("other")), "labels": late}

        return make

    assert upserts.rebuilt(spark, root, "v1", build(5)) == (True, {"sessions": 5, "labels": 5})
    assert upserts.rebuilt(spark, root, "v1", build(6)) == (False, {"sessions": 5, "labels": 5}) and built == [5]
    with pytest.raises(Exception, match="broken"):
        upserts.rebuilt(spark, root, "v2", build(7, fail=True))
    assert upserts.rebuilt(spark, root, "v2", build(3)) == (True, {"sessions": 3, "labels": 3})
    counts = {r["version"]: r["count"] for r in spark.read.parquet(f"{root}/sessions").groupBy("version").count().collect()}
    assert counts == {"v1": 5, "v2": 3}
    assert upserts.rebuilt(spark, root, "v3", lambda: {"sessions": spark.range(0)}) == (True, {"sessions": 0})
    assert [r["version"] for r in spark.read.parquet(f"{root}/_runs").orderBy("finished_at").collect()] == ["v1", "v2", "v3"]

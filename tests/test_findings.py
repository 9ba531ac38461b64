"""Results that once differed, or steps that once grew too fast."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from skirmish.functions import colours, numbers
from skirmish.operators import aliases, fulltext, glicko, identity, pairing, proposals, ratings, search
from skirmish.plans import catalog, commands, league, searches
from skirmish.plans.ratings import results
from skirmish.stages import stored


def test_series_of_repeated_ids(spark, tmp_path):
    """Lines of one order, number and day stand in the order of the table, as the SQL has them (few, as its sort isn't stable)."""
    n = 3
    line = pd.DataFrame({"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 2, "l_linenumber": 1, "l_quantity": 5.0, "l_shipdate": pd.Timestamp("2024-01-01"), "l_returnflag": [("R", "N", "A")[k % 3] for k in range(n)]})
    line.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    got = [r["maps"] for r in league.recording_series(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    found = con.execute(catalog.ORACLES["recording_series"])
    at = [c[0] for c in found.description].index("maps")
    assert got == [r[at] for r in found.fetchall()] == [",".join(line["l_returnflag"])]


def test_ridge_to_its_last_shown_digit(spark):
    """Strengths are those of the normal equations far below the digits that are shown."""
    rng = np.random.default_rng(7)
    a, b, diff = rng.integers(0, 20, 4000), rng.integers(0, 20, 4000), rng.integers(-50, 51, 4000)
    x = np.zeros((4000, 20))
    np.add.at(x, (np.arange(4000), a), 1.0)
    np.add.at(x, (np.arange(4000), b), -1.0)
    want = np.linalg.solve(x.T @ x + 10 * np.eye(20), x.T @ diff)
    rows = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "diff": diff}))
    got = {r["player"]: r["strength"] for r in ratings.ridge(rows.select(F.array("a").alias("side_a"), F.array("b").alias("side_b"), "diff"), 10.0).collect()}
    assert max(abs(got[k] - want[k]) for k in range(20)) < 1e-11


def test_means_on_the_edge_of_two_roundings(spark, tmp_path):
    """Means whose seventh decimal is a five and the last are the same in any order of the rows."""
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_suppkey IN (203, 789, 896)")
    for k, order in enumerate((F.col("l_extendedprice"), F.desc("l_extendedprice"), F.hash("l_orderkey"))):
        lines.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got = {r["name"]: r["damage"] for r in catalog._averages(spark, f"{tmp_path}/{k}").collect()}
        assert got == {"p203": 52747.323688, "p789": 51739.834063, "p896": 52210.244688}


def test_runs_make_the_characters_once(spark):
    rows = spark.createDataFrame([("ab^c^d$[x",), ("",), (None,)], "name string")
    found = rows.select("name", colours.runs(colours.expanded_codes(F.col("name"))).alias("r"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = {r["name"]: r["r"] and [tuple(x) for x in r["r"]] for r in found.collect()}
    assert got == {"ab^c^d$[x": [("ab", "w"), ("cd", "b"), ("[", "g"), ("x", "w")], "": [], None: None}


def test_recordings_meet_by_tags_or_names(spark):
    """As all pairs by force; and no join meets on the time alone."""
    rng = random.Random(5)
    names = ["p", "pa", "Pax", "•pax!", "xa", "axel", "el", "", "..", None]
    tag = lambda: rng.choice(["red", "RED", "blue", "", None])
    recs = [(k // 2, tag(), rng.uniform(0, 9000), 0.0, rng.choices(names, k=3)) for k in range(40)]
    recs = [(r, t, s, s + rng.uniform(0, 5000), n) for r, t, s, _, n in recs]
    met = [(k // 2, rng.uniform(0, 12000), [tag(), tag()], rng.choices(names, k=3), k % 3 == 0) for k in range(60)]
    left = spark.createDataFrame(recs, "recording int, tag string, starts double, ends double, names array<string>")
    right = spark.createDataFrame(met, "match int, at double, tags array<string>, names array<string>, has_stats boolean")
    found = pairing.paired(left, right)
    plain = lambda ns: {re.sub("^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "", n).lower() for n in ns if n is not None} - {""}
    want = Counter()
    for r, t, s, e, n in recs:
        for m, at, ts, n2, _ in met:
            alike = sum(len(a) >= 2 and any(a in b or b in a for b in plain(n2)) for a in plain(n))
            ours = bool(t) and t.lower() in [x.lower() for x in ts if x is not None]
            if s - 120 <= at < e + 120 and (ours or alike >= 2):
                want[r, m, round(at - s, 6)] += 1
    assert Counter((r["recording"], r["match"], round(r["offset"], 6)) for r in found.collect()) == want
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "bin#" in x]
    assert joins and all("_tag#" in x or "_b#" in x for x in joins)


def test_pairs_of_one_tag_without_alike_names(spark, sf_dir, monkeypatch):
    """Scores and reasons are those of all names held against each other, and where no names are alike none are compared nor other texts made."""
    rng = random.Random(6)
    names = [f"{a}{k}{b}" for a in ("", "x", "•al") for b in ("", "zz", "!") for k in range(12)] + ["al", "z", "..", None]
    recs = [(k, rng.choice(["red", "blue", None]), rng.uniform(0, 9000), 0.0, rng.choices(names, k=rng.randrange(6))) for k in range(60)]
    recs = [(r, t, s, s + rng.uniform(0, 5000), n) for r, t, s, _, n in recs]
    met = [(k, rng.uniform(0, 12000), [rng.choice(["RED", "Blue", ""])], rng.choices(names, k=rng.randrange(6)), k % 3 == 0) for k in range(80)]
    left = spark.createDataFrame(recs, "recording int, tag string, starts double, ends double, names array<string>")
    right = spark.createDataFrame(met, "match int, at double, tags array<string>, names array<string>, has_stats boolean")
    both = left.join(right.withColumnRenamed("names", "others")).where("at >= starts - 120 AND at < ends + 120")
    both = both.where(F.coalesce(F.exists("tags", lambda t: F.lower(t) == F.col("tag")), F.lit(False)) | (pairing.alike_names(F.col("names"), F.col("others"), 2) >= 2))
    offset = F.col("at") - F.col("starts")
    want = both.withColumn("c", pairing.confidence(offset, F.col("has_stats"), pairing.alike_names(F.col("names"), F.col("others"), 3))).select("recording", "match", offset, "c.score", F.col("c.reasons").cast("string"))
    want = Counter(tuple(r) for r in want.collect())
    monkeypatch.setattr(pairing, "PAIRS", 50)
    for k in (4, 1):
        monkeypatch.setattr(pairing, "BITS", k)
        found = pairing.paired(left, right)
        assert Counter(tuple(r) for r in found.select("recording", "match", "offset", "score", F.col("reasons").cast("string")).collect()) == want
    plan = league.match_recordings(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan
    assert "lambda" not in plan.split("Join Inner")[0] and "_own" not in plan.split("Generate")[0]


def test_halves_go_away_from_zero(spark):
    said = [0.5, -0.5, 2.5, -2.5, 0.0625, -0.0625, 0.1235, 1.0005, -1234.5675, 0.49999999999999994, 0.0, -0.0002, None]
    rows = spark.createDataFrame([(x,) for x in said], "x double")
    for digits in (0, 3):
        want = duckdb.connect().execute(f"SELECT round(unnest(?::DOUBLE[]), {digits})", [said]).fetchall()
        assert [tuple(r) for r in rows.select(numbers.half_away(F.col("x"), digits)).collect()] == want


def test_parts_that_agree_are_one_row_before_they_meet(spark, sf_dir, same_as_sql):
    found = league.linkage_weights(spark, sf_dir)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert below.count("Aggregate") == 2
    same_as_sql(found, catalog.ORACLES["linkage_weights"])


def test_parts_of_any_key_meet(spark, tmp_path, same_as_sql):
    """Pairs whose lesser key is no multiple of nine count as well; missing brands and sizes agree with none."""
    said = [(1, "gear", "Brand#11", 5), (2, "gear", "Brand#12", 5), (4, "gear", "Brand#21", 7), (9, "ring", "Brand#11", 1), (8, "ring", "Brand#11", 2), (5, "cog", "Brand#31", 3), (5, "cog", "Brand#31", 3), (3, None, "Brand#11", 5), (6, "nut", None, 4), (7, "nut", None, 4)]
    part = pd.DataFrame(said, columns=["p_partkey", "p_name", "p_brand", "p_size"])
    part.to_parquet(tmp_path / "part.parquet")
    found = league.linkage_weights(spark, str(tmp_path))
    assert {(r["a"], r["brand"], r["size"]) for r in found.collect()} == {("gear", True, True), ("gear", False, False), ("ring", True, False), ("nut", None, True)}
    same_as_sql(found, catalog.ORACLES["linkage_weights"], part=part)


def test_asked_pairs_only_meet(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 2), (3, None)], "g int, n int")
    asked = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 4), (2, 3), (None, 1)], "a int, b int")
    assert {tuple(r) for r in identity.cooccurrence(rows, "g", "n", asked).collect()} == {(1, 2, 2), (2, 3, 1)}


def test_snippets_split_each_text_once(spark):
    rows = spark.createDataFrame([("a b The! c d",), ("no hit",), (None,)], "text string")
    found = rows.select(search.snippet(F.col("text"), "the", 2).alias("s"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["s"] for r in found.collect()] == ["... b [The!] ...", None, None]


def test_aliases_are_not_broadcast(spark, sf_dir):
    joins = []
    held = aliases.stored
    aliases.stored = lambda df, *a: (joins.append(df._jdf.queryExecution().executedPlan().toString()), held(df, *a))[1]
    try:
        commands.expanded_commands(spark, sf_dir)
    finally:
        aliases.stored = held
    assert joins and not any("BroadcastHashJoin" in x for x in joins)


def test_proposals_alike_are_one_case(spark):
    free = spark.createDataFrame([("t1", "w", 1, "u"), ("t2", "w", 1, "v"), ("t2", "w", 2, "v")], "team string, week string, slot int, user string")
    asked = spark.createDataFrame([(k, "t1", "t2" if k else None, "w", 1, k % 2, False, False) for k in range(5)], "id int, proposer string, opponent string, week string, least_proposer int, least_opponent int, proposer_standin boolean, opponent_standin boolean")
    found = proposals.enriched(asked, free, "t1")
    assert {r["id"]: r["viable"] for r in found.collect()} == {k: 1 for k in range(5)}
    assert "_of_" in found._jdf.queryExecution().optimizedPlan().toString()


def test_cosines_in_cells_are_those_of_all_pairs(spark):
    rows = [(k, [float(k % 5), 1.0 - k % 3, float(k % 2)], k % 2) for k in range(60)] + [(60, [0.0, 0.0, 0.0], 0), (61, None, 0), (62, [1.0, None, 2.0], 1), (63, [1.0], 1), (64, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, l int")
    two = df.select("l", F.col("id").alias("a"), F.col("v").alias("x")).join(df.select("l", F.col("id").alias("b"), F.col("v").alias("y")), "l").where("a < b")
    want = Counter(tuple(r) for r in two.select("a", "b", identity.cosine(F.col("x"), F.col("y"))).collect())
    found = identity.cosines_within(df, "id", "v", "l", side=7)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_cosines_are_made_in_blocks(spark, monkeypatch):
    """No expression runs over a pair's components; cells, some of them empty, meet once, and edges are rounded as the SQL does."""
    rng = random.Random(8)
    said = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(8)], k % 2) for k in range(40)] + [(40, [1.0, 0.0, 0.0, 0.0] * 2, 0), (41, [0.5, 0.5, 0.5, 0.5] * 2, 0), (42, [-0.5, 0.5, 0.5, -0.5] * 2, 0), (43, [float("nan")] * 8, 1)]
    rows = pa.table(dict(zip(["vec_id", "embedding", "label"], zip(*said, strict=True), strict=True)))
    df = spark.createDataFrame(said, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(identity, "COSINES", 20)
    for side, digits in ((4096, 5), (1, 5), (3, 0)):
        sql = catalog.ORACLES["cosine_fingerprint"].replace(", 5) AS cosine", f", {digits}) AS cosine")
        want = duckdb.connect().register("embeddings", rows).execute(sql).fetchall()
        found = identity.cosines_within(df, "vec_id", "embedding", "label", side, digits)
        plain = lambda rs: Counter((a, b, None if c != c else c) for a, b, c in rs)
        assert plain(map(tuple, found.collect())) == plain(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0]
        assert found.rdd.getNumPartitions() >= len(want) / 20


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of pairs stays the same as their number grows, and groups of many names meet in cells."""
    rng = random.Random(3)
    said = [(g, n) for g in (1, 2, 3, None) for n in rng.choices([*range(40), None], k=60 if g == 1 else 8)]
    rows = spark.createDataFrame(said, "g int, n int")
    held = {g: {n for h, n in said if h == g and n is not None} for g in (1, 2, 3)}
    want = Counter((a, b) for names in held.values() for a in names for b in names if a < b)
    monkeypatch.setattr(identity, "PAIRS", 20)
    for side in (1024, 4):
        found = identity.cooccurrence(rows, "g", "n", side=side)
        assert found.rdd.getNumPartitions() >= sum(want.values()) / 20
        assert {(r["a"], r["b"]): r["together"] for r in found.collect()} == want
    assert identity.cooccurrence(rows.limit(0), "g", "n").count() == 0


def test_exclusive_groups_make_no_pairs(spark):
    """Of one group of very many ids no two come together, and their pairs, 2 * 10^10, are never made."""
    n = 200_000
    rng = random.Random(4)
    edges = [(*sorted(rng.sample(range(50), 2)), float(rng.randrange(9))) for _ in range(70)]
    links = spark.createDataFrame([e for e in edges], "a long, b long, weight double")
    group = F.when(F.col("id") % 3 < 2, F.col("id") % 3)
    many = spark.range(n).select("id", group.alias("group"))
    pairs = [(a, b) for a in range(50) for b in range(a) if a % 3 == b % 3 < 2]
    want = {r["id"]: r["label"] for r in identity.constrained_clusters(links, spark.createDataFrame(pairs, "a long, b long")).collect()}
    got = {r["id"]: r["label"] for r in identity.constrained_clusters(links, exclusive=many, bands=3).collect()}
    assert got == want
    by = sorted((k % 3, v) for k, v in got.items() if k % 3 < 2)
    assert len(by) == len(set(by)) and len(set(got.values())) < len(got)


def test_stems_are_counted_where_texts_are_read(spark, tmp_path):
    """As the SQL counts repeated and missing ids, accents and forms; and no row per word and document is shuffled."""
    said = [(1, "Games game gaming, café"), (1, "cafe games Über"), (None, "game only"), (None, "game"), (2, None), (3, ""), (4, "cafés naïve naive ponies"), (5, "the the the")]
    for k, rows in enumerate((said, said[2:])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet'")
        found = searches.stemmed_terms(spark, f"{tmp_path}/{k}")
        want = con.execute(catalog.ORACLES["stemmed_terms"])
        names = [c[0] for c in want.description]
        assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(want.fetchall())
    plan = found._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Join" not in plan


def test_postings_are_made_where_texts_are_read(spark, tmp_path, monkeypatch):
    """Nothing is shuffled before the postings are dealt by ranges, and what is sampled for those is stored."""
    seen, stored = [], fulltext.stored
    monkeypatch.setattr(fulltext, "stored", lambda df: seen.append(df) or stored(df))
    docs = spark.createDataFrame([(1, "Cafés, café game"), (2, "the Game"), (3, " "), (4, None)], "doc long, body string")
    index = fulltext.build(docs, "doc", "body", str(tmp_path / "i"))
    assert len(seen) == 1 and "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    got = {(r["term"], r["doc"]): (r["tf"], r["places"], r["len"]) for r in index.postings.collect()}
    assert got == {("cafe", 1): (2, [0, 1], 3), ("game", 1): (1, [2], 3), ("the", 2): (1, [0], 2), ("game", 2): (1, [1], 2)}
    assert tuple(index.corpus.first()) == (2, 2.5)


def test_a_period_is_read_by_many_tasks(spark):
    """A value of the column that a table is stored by has several files, and all its rows are there."""
    rows = stored(spark.range(1_000_000).withColumn("v", F.col("id") % 2), by="v")
    files = Counter(f.rsplit("/", 2)[1] for f in rows.inputFiles())
    assert set(files) == {"v=0", "v=1"} and min(files.values()) > 1
    assert rows.groupBy("v").agg(F.count("*"), F.sum("id")).orderBy("v").collect() == [(0, 500_000, 249_999_500_000), (1, 500_000, 250_000_000_000)]


def test_games_meet_once(spark, sf_dir):
    """Lines are dealt by game once for their scores; a period's results are read once, and met with the state once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scored = plan(results(spark, sf_dir))
    assert scored.count("lineitem.parquet") == 1 and scored.count("Exchange hashpartitioning") <= 2
    state = spark.createDataFrame([("9", 0.1, 1.0, 0.06, 3)], glicko._STATE)
    games = spark.range(40).selectExpr("id div 4 AS game", "cast(id % 2 AS int) AS side", "cast(id % 7 AS string) AS player", "cast(id % 2 AS double) AS score")
    after = glicko.period_ratings(state, games, 5)
    assert plan(after).count("Range (") == 1
    got = {r["player"]: r for r in after.collect()}
    assert set(got) == {*"0123456", "9"} and tuple(got["9"]) == ("9", 0.1, 1.0, 0.06, 3) and {got[p]["period"] for p in "0123456"} == {5}


def test_last_period_without_a_game(spark):
    """A last period in which nobody met an opponent rates nobody, and no deviation grows by it; other sides don't spoil a game."""
    said = [(1, "g", 0, "a", 1.0), (1, "g", 1, "b", 0.0), (2, "h", 1, "b", 1.0), (2, "h", 0, "c", 0.0)]
    same = lambda rows: sorted(tuple(r) for r in glicko.glicko2(spark.createDataFrame(rows, "period long, game string, side int, player string, score double")).collect())
    assert same([*said, (1, "g", 2, "d", 1.0), (2, "g", 0, "a", 1.0), (3, "k", 0, "a", 1.0)]) == same(said)

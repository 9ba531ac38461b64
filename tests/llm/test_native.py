"""Operators 1, 2, 3, 5 and 6 against their SQL, on the test tables and on awkward rows."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish.llm import chat, lines, mixing, quality, queries, urls

NATIVE = ["op1_quality_rules", "op2_mix_sources", "op3_url_filters", "op5_line_dedup", "op6_chat_format"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", NATIVE)
def test_matches_its_sql(spark, sf_dir, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("name", NATIVE)
def test_has_no_python_in_its_plan(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD[", "Cartesian"))


@pytest.fixture
def awkward(spark, tmp_path):
    """Null, empty, blank, very long, tied and repeated rows; nulls in every column."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None, "en", "web", 0), (2, "", "en", None, None), (3, " \t\n\x0b ", None, "books", 1), (4, long, "de", "web", 1),
        (5, "a b c a b c", "en", "web", 1), (6, "ä#ö <b>\n\nä#ö <b>\nä#ö <b>", "en", "web", 1), (7, "x\ny\nz\nx\ny\nz\nw", "en", "web", 1),
        (8, "x\ny\nz\nx\ny\nz\nw", "en", "web", 1), (9, "the end " * 60, "fr", "web", 1), (10, "q\nx\ny\nz", "es", "web", 1),
    ]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_mix_sources", "op5_line_dedup"])
def test_awkward_documents(spark, same_as_sql, awkward, name):
    path, rows = awkward
    same_as_sql(queries.QUERIES[name](spark, path), queries.ORACLES[name], documents=rows)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_mix_sources", "op5_line_dedup"])
def test_no_documents(spark, tmp_path, name):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_mixture_of_null_and_repeated_ids(spark, same_as_sql, tmp_path):
    rows = [(None, "a b c", "en", "x", 1), (None, "d e", "en", "x", 1), (3, "f g", "en", "x", 1), (3, "f g", "en", "x", 1), (4, "h", None, None, None), (5, None, "de", "y", 1), (6, "i j k l", "de", "y", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    own = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    mixed = queries.op2_mix_sources(spark, str(tmp_path))
    got = mixed.where("doc_id = 3").groupBy("mix_epoch").count().collect()
    assert all(r["count"] == 2 for r in got)  # rows that repeat an id are taken or left together
    same_as_sql(mixed, queries.ORACLES["op2_mix_sources"], documents=own)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (only,) = queries.op6_chat_format(spark, str(tmp_path)).collect()
    assert (only["conv_id"], only["n_turns"], only["loss_chars"]) == (-1, 2, len(queries.CONTROL_TEXT))


def test_quality_keeps_columns_and_rows_with_clashing_names(spark):
    text = " ".join(f"the cat of number{i} and house{i} was in garden{i}." for i in range(12))
    docs = spark.createDataFrame([(1, text, "mine", 5), (1, text, "mine", 5), (2, "short", "mine", 5), (None, text, "mine", 5)], "doc_id long, text string, kept string, n_words int")
    assert quality.annotate(docs).where("kept").count() == 3
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect() if r[0]) == [(1, text, "mine", 5)] * 2 and kept.count() == 3


def test_line_dedup_of_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 1), (1, "a\nb\nc", 1), (1, "z\na\nb\nc", 2), (None, "p\nq\nr", 3), (2, "p\nq\nr\ns", 4)], "doc_id long, text string, n_lines int")
    out = {(r["doc_id"], r["n_lines"]): (r["text"], r["n_removed"]) for r in lines.drop_repeated_lines(docs).collect()}
    assert out == {(1, 3): ("a\nb\nc", 0), (1, 4): ("z", 3), (None, 3): ("p\nq\nr", 0), (2, 4): ("s", 3)}


def test_line_dedup_cuts_merged_runs_out_of_the_middle(spark):
    docs = spark.createDataFrame([(1, "1\n2\n3\n4"), (2, "h\n1\n2\n3\n4\nt"), (3, "1\n2\n3")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.drop_repeated_lines(docs).collect()}
    assert out == {1: ("1\n2\n3\n4", 0), 2: ("h\nt", 4), 3: ("", 3)}


def test_budget_passes_to_siblings_before_ancestors(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000), ("c", "v", 1)]
    leaves = spark.createDataFrame(rows, "top string, leaf string, tokens long")
    got = mixing.leaf_budgets(leaves, ["top", "leaf"], [{"a": 0.5, "b": 0.4, "c": 0.1}, {}], 400.0, 2).collect()
    assert {r["leaf"]: r["budget"] for r in got} == {"v": 2, "x": 20, "y": 201, "z": 176}  # c's rest goes to a and b as 5 : 4


def test_mixture_takes_whole_epochs_and_the_shortest_prefix(spark):
    docs = spark.createDataFrame([(i, "a" if i < 4 else "b", 10, "old") for i in range(24)], "doc_id long, leaf string, n int, mix_epoch string")
    got = mixing.mix(docs, {"leaf": F.col("leaf")}, [{"a": 0.25, "b": 0.75}], F.col("n"), 240, 3).groupBy("leaf").pivot("mix_epoch", [1, 2]).count().collect()
    assert {r["leaf"]: (r["1"], r["2"]) for r in got} == {"a": (4, 2), "b": (18, None)}


def test_urls(spark, same_as_sql, tmp_path):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Sub.Example.COM/en/77?q#f"), (6, "x://com/en/"), (7, "x://xcom/en/"), (8, "ftp://a.net/de/x"), (8, "ftp://a.example.net/de/8"),
            (9, "a://org?x=/es/"), (10, "a://b.casino-win.example.org/p"), (10, "a://b.casino-win.example.org/p"), (None, "a://de.org/es/"), (11, "a://" + "a." * 300 + "com/en/" + "y" * 5000),
            # a rule fits a page of a listed site: the rule decides
            (12, "http://m.free-bets.example.com/en/7674/"), (13, "http://free-bets.example.com/en/1"), (14, "http://free-bets.example.net/de/9"), (15, "http://free-bets.example.com/fr/9"),
            # spellings of listed and of other pages
            (16, "HTTPS://www.Tionsh.example.org:443/fr/12//?utm_source=feed&ref=x#top"), (17, "http://tionsh.example.com/fr/12?page=2"), (18, "http://m.tionsh.example.com/fr/12"), (19, "http://u@tionsh.example.com./fr/49999"),
            (20, "http://tionsh.example.com/fr/50000"), (21, "http://tionsh.example.com/fr/012"), (22, "http://tionsh.example.com/fr/7?reference=1"), (23, "http://:80/fr/1"), (24, "http://tionsh.example.com")]
    spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "url": [r[1] for r in rows]})
    judged = queries.op3_url_filters(spark, str(tmp_path))
    same_as_sql(judged, queries.ORACLES["op3_url_filters"], pages=pages)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    assert got[12] == ("example.com/en/7", "allow") and got[13] == ("com/en/", "block") and got[14] == ("net/de/", "allow") and got[15] == (None, "block")
    assert {i for i in range(16, 25) if got[i][1] == "block"} == {16, 19}


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op3_url_filters(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("blocks", "entries"), [(131_072, 100_000), (0, 0)])
def test_large_lists_give_the_same_verdicts(spark, monkeypatch, blocks, entries):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(urls, "BROADCAST_ENTRIES", entries)
    pages = spark.createDataFrame([(i, f"https://h{i % 50}.org/p{i}", "x") for i in range(500)], "page_id long, url string, host string")
    listed = spark.createDataFrame([(f"http://h{i}.org",) for i in range(0, 200, 2)] + [("x://h5.org/p5/",), ("x://h5.org/p99",), (None,), ("nowhere",)], "url string")
    judged = urls.judge(pages, [("h4.org", "/p4", "allow")], listed)
    blocked = {r["page_id"] for r in judged.where("verdict = 'block'").collect()}
    assert judged.count() == 500 and blocked == {i for i in range(500) if (i % 50 % 2 == 0 or i == 5) and not (i % 50 == 4 and f"p{i}".startswith("p4"))}
    assert urls.judge(pages, [], listed.limit(0)).where("verdict = 'allow' AND rule IS NULL AND listed IS NULL").count() == 500


def test_chats_come_back_whole(spark):
    nasty = "".join(chat.CONTROLS) + chat.ESCAPE + "b" + chat.ESCAPE
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "assistant", ""), (1, 3, "tool|><s>", nasty), (1, 3, "tool|><s>", nasty), (1, 4, None, None), (2, None, "assistant", "x" * 200_000), (None, 1, "system", "né"), (3, 1, "user", "")]
    back = chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))))
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_texts"]) for r in back.collect()}
    assert got[1] == ([("user", nasty), ("assistant", nasty), ("assistant", ""), ("tool|><s>", nasty), ("tool|><s>", nasty), ("", "")], [nasty, ""])
    assert got[2] == ([("assistant", "x" * 200_000)], ["x" * 200_000]) and got[None] == ([("system", "né")], []) and got[3] == ([("user", "")], [])
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

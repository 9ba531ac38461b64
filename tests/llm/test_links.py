"""Operators 11, 12 and 13 against plain programs that look at everything, and against their SQL on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skirmish.llm import minhash, negatives, ngrams, prefixes, queries
from test_brute import TEXTS, edited, near_brute, words

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows, anchors):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, label, ints)."""
    out = []
    for a, label, v in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(j, -t) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, i, k + 1, j, -s, t) for k, (j, t) in enumerate(fits)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 16)
    monkeypatch.setattr(negatives, "LEAF", 4)
    monkeypatch.setattr(negatives, "MOST_ANCHORS", 10)


def test_hard_negatives(spark, small_blocks):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(3)), (centers[rng.integers(6)] * 40 + rng.normal(size=8) * 20).astype(int).tolist()) for i in range(300)]
    # a third of the rows are one vector
    rows += [(int(i), int(rng.integers(3)), [30, 5, -2, 7, 11, 0, 3, 8]) for i in range(1000, 1150)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>").withColumn("score", F.lit("x"))
    got = negatives.hard_negatives(df.repartition(5), "vec_id % 10 = 0").collect()
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == want


def test_hard_negatives_prune(small_blocks, monkeypatch):
    """Leaves of other clusters are left out."""
    rng, leaves, unique = np.random.default_rng(1), [], np.unique
    x = np.concatenate([rng.integers(-3, 3, (64, 4)) + 100 * np.eye(4, dtype=int)[k] for k in range(4)])
    rows = pa.table({"vec_id": np.arange(256), "label": np.zeros(256, np.int64), "vec": x.tolist()})
    one = {"query": 0, "row": 0, "anchor_id": -1, "label": 0, "vec": [100, 0, 0, 0], "low": -(2**63), "high": 2**63 - 1}
    ask = pa.Table.from_pylist([one]).append_column("kth", pa.array([None], pa.int64())).append_column("kth_id", pa.array([None], pa.int64()))
    monkeypatch.setattr(negatives.np, "unique", lambda *a, **b: leaves.append(1) or unique(*a, **b))
    found = negatives._visit(rows, ask, 5, True).to_pydict()
    scores = x @ [100, 0, 0, 0]
    assert found["vec_id"] == sorted(range(256), key=lambda i: (-scores[i], i))[:5]
    assert len(leaves) < 256 / 4 / 2


def test_hard_negatives_odd_rows(spark, same_as_sql, tmp_path):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, vec(), rng.randrange(4)) for i in range(120)]
    rows += [(50, rows[50][1], rows[50][2]), (7, vec(), 1), (150, [1.0, float("nan"), 0.0, 0.0], 1), (200, None, 1), (250, vec(), None), (300, [1.0, None, 0.0, 0.0], 2), (350, [float("inf")] * 4, 0), (None, vec(), 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("cell", "vec", "row")})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    table = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "label": pd.array([r[2] for r in rows], "Int64"), "embedding": [r[1] for r in rows]})
    sql = queries.OP11_SQL.replace("len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0", "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")
    same_as_sql(queries.op11_hard_negatives(spark, str(tmp_path)), sql, embeddings=table)
    # another length than the others' is left out; so is everything if there is nothing
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [1.0, 1.0], 1), (3, [0.5, 1.0], 2)], VECTORS)
    out = negatives.hard_negatives(negatives.quantized(few), "vec_id = 0").collect()
    assert [(r["positive_id"], r["negative_id"]) for r in out] == [(2, 3)]
    assert negatives.hard_negatives(negatives.quantized(few), "vec_id = 9").count() == 0
    assert negatives.hard_negatives(negatives.quantized(few.limit(0)), "vec_id = 0").count() == 0


def test_large_components(spark):
    """Scores beyond 2^53 are exact."""
    big = [(0, [2**27 + 1] * 3, 1), (1, [2**27 + 3, 2**27, 2**27 + 1], 1), (2, [2**27 - 5, 2**27 - 1, 2**26], 2)]
    df = spark.createDataFrame([(i, label, v) for i, v, label in big], "vec_id long, label long, vec array<long>")
    want = mined([(i, label, v) for i, v, label in big], lambda i: i == 0)
    assert [tuple(r) for r in negatives.hard_negatives(df, "vec_id = 0").collect()] == want and want


def trie(rows, block=100, turns=6):
    """The contract's nodes of rows (conv_id, turn, role, text), as tuples in the order of the query's columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % turns
        base = c - (abs(c) % block) * (1 if c >= 0 else -1)
        whole = own.get(base, [])[:h] + v[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children, leaves, saved = defaultdict(int), {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = leaves.get(k, 0) or 1
        saved[k] = saved.get(k, 0) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        if k:
            children[k[:-1]] += 1
            leaves[k[:-1]], saved[k[:-1]] = leaves.get(k[:-1], 0) + leaves[k], saved.get(k[:-1], 0) + saved[k]
    least = {k: min(c for c, _ in v) for k, v in members.items()}
    ends = {k: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in v if e)).encode()).hexdigest() for k, v in members.items()}
    return sorted((least[k], len(k), least[k[:-1]] if k else None, len(v), children[k], leaves[k], saved[k], ends[k]) for k, v in members.items())


CHATS = "conv_id long, turn long, role string, text string"


def check_trie(spark, rows, tmp_path, same_as_sql=None):
    df = spark.createDataFrame(rows, CHATS).withColumns({c: F.lit("x") for c in ("depth", "pos", "path", "k1")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == trie(rows)
    if same_as_sql:
        table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
        same_as_sql(got, queries.OP12_SQL, conversations=table)


def test_prefix_trie(spark, tmp_path, same_as_sql):
    rng, rows = random.Random(4), []
    for c in range(-120, 260):
        if c % 100 and rng.random() < 0.7 or c == 100:
            continue
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.randrange(2)}" * (t + 1)) for t in range(rng.randrange(1, 9))]
    rows += [(7, None, None, None), (7, 0, "user", None), (7, 0, "user", None), (8, 3, None, "x"), (8, 3, "x", ""), (None, 0, "user", "lost"), (9, 0, "user", "ü" * 5000), (10, 0, "", "")]
    # one conversation holds a third of all turns, and many are the same
    rows += [(11, t, "user", f"t{t % 3}") for t in range(400)] + [(c, t, "user", f"t{t}") for c in range(1000, 1100) for t in range(3)]
    check_trie(spark, rows, tmp_path, same_as_sql)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "a")]])
def test_prefix_trie_small(spark, tmp_path, rows):
    check_trie(spark, rows, tmp_path)


def test_trie_is_peeled_in_few_rounds(spark, monkeypatch):
    """A comb: each conversation is one turn longer than the one before it, so that there are as many levels as conversations."""
    rounds, real = [], prefixes.stored
    turns = spark.range(1, 61).selectExpr("id AS conv_id", "explode(sequence(1L, id)) AS pos").selectExpr("conv_id", "pos", "md5(cast(pos AS string)) AS turn_hash", "1L AS n_chars")
    monkeypatch.setattr(prefixes, "stored", lambda df: rounds.append(df.columns) or real(df))
    rows = prefixes.prefix_trie(turns, turns.select("conv_id").distinct()).collect()
    assert len(rows) == 61 and {r["n_leaves"] for r in rows} == {1}
    assert {r["depth"]: r["saved_tokens"] for r in rows}[1] == sum(range(60))
    assert sum("_leaves" in c and "up_path" in c for c in rounds) < 20


@pytest.mark.parametrize("chunk", [8, 1 << 16])
def test_ends_digests(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    ends = spark.range(500).selectExpr("id % 2 AS depth", "0L AS k1", "CASE WHEN id < 400 THEN 1L ELSE id END AS k2", "id - 9 AS conv_id")
    want = defaultdict(list)
    for i in range(500):
        want[i % 2, 1 if i < 400 else i].append(i - 9)
    got = {(r["depth"], r["k2"]): r["ends_sha256"] for r in prefixes.ends_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


@pytest.fixture
def ngram_rows():
    rng, rows, i = random.Random(9), [], 0
    for n in (1, 2, 3, 12, 25, 60, 200, 900):
        for _ in range(3):
            base = words(rng, n)
            for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04):
                i += 1
                rows.append((i, " ".join(edited(rng, base, share)).upper() if i % 5 == 0 else "\t".join(edited(rng, base, share))))
    base = words(rng, 400)
    rows += [(500 + k, " ".join(base[k * 10 : k * 10 + 260])) for k in range(12)]
    # documents that share a passage, and no more
    rows += [(600 + k, " ".join(words(rng, 40) + base[:60])) for k in range(60)]
    return rows + [(900, None), (901, ""), (902, " \r\n"), (903, rows[0][1]), (903, rows[9][1]), (904, "x" * 200_000), (905, "x y " * 20_000)]


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_ngram_join(spark, ngram_rows, monkeypatch, block):
    """Also with groups that are too large for one tree."""
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "WIDE", 2 * block)
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = spark.createDataFrame([*ngram_rows, (None, "a b c d"), (None, None)], TEXTS).withColumns({c: F.lit("x") for c in ("id", "label", "key", "keys", "cell")})
    got = ngrams.jaccard_components(docs, 3, 90).collect()
    assert len(got) == len(ngram_rows) + 2
    assert {r["doc_id"]: r["component_id"] for r in got} == near_brute(ngram_rows, 3, 90) | {None: None}
    assert {r["n_shingles"] for r in got if r["doc_id"] is None} == {0, 2}


def test_ngram_join_empty(spark):
    assert ngrams.jaccard_components(spark.createDataFrame([], TEXTS)).count() == 0
    assert [tuple(r) for r in ngrams.jaccard_components(spark.createDataFrame([(1, None)], TEXTS)).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("percent", [60, 90])
def test_parts_and_tree(percent):
    """Linked sets that differ share a key in every partition, and the tree finds all components."""
    rng = np.random.default_rng(percent)
    for trial in range(60):
        sets = []
        for _ in range(rng.integers(1, 9)):
            base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64) * np.uint64(2)
            for share in rng.choice([0, 0.02, 0.05, 0.1, 0.3], 5):
                gone = rng.random(len(base)) < share
                own = np.unique(np.concatenate([base[~gone], rng.integers(0, 2**63, gone.sum() // 2, dtype=np.uint64)]))
                sets += [own] if len(own) else []
        if not sets:
            continue
        keys, count = ngrams.part_keys(np.concatenate(sets), np.cumsum([len(s) for s in sets]), percent, trial % 3)
        keys, up = [set(k.tolist()) for k in np.split(keys, np.cumsum(count)[:-1])], list(range(len(sets)))
        plain = [set(s.tolist()) for s in sets]

        def tops(links):
            up = list(range(len(sets)))  # noqa: B023
            for i, j in links:
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
            return up

        links = [(i, j) for i in range(len(sets)) for j in range(i) if (100 + percent) * len(plain[i] & plain[j]) >= percent * (len(plain[i]) + len(plain[j]))]
        assert all(plain[i] == plain[j] or keys[i] & keys[j] for i, j in links)
        found, wanted = ngrams.Tree(sets, np.arange(len(sets)), percent).components().tolist(), tops(links)
        assert len(set(found)) == len(set(wanted)) == len(set(zip(found, wanted, strict=True)))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie", "op13_ngram_join"])
def test_matches_its_sql(spark, sf_dir, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name])

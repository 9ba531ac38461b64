"""Operators 4, 7, 8, 9 and 10 and the pipeline against plain programs that look at everything."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skirmish.llm import components, decontam, minhash, paragraphs, queries, suffix, tokens
from skirmish.llm.common import table

TEXTS = "doc_id long, text string"


def near_brute(rows, size=5, percent=80):
    """component_id of each distinct id."""
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, w, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


@pytest.fixture
def near_rows():
    rng = random.Random(3)
    rows, i = [], 0
    for n in (1, 3, 4, 5, 20, 60, 200, 800):
        for _ in range(3):
            base = words(rng, n)
            for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06):
                i += 1
                rows.append((i, " ".join(edited(rng, base, share)).title() if i % 5 == 0 else " ".join(edited(rng, base, share))))
    # a chain: each links to the next only
    base = words(rng, 300)
    for k in range(12):
        i += 1
        rows.append((i, " ".join(base[k * 20 : k * 20 + 220])))
    return rows


def test_near_duplicates(spark, near_rows):
    rows = [*near_rows, (9001, None), (9002, ""), (9003, " \n\t"), (9004, near_rows[0][1]), (9004, near_rows[0][1])]
    docs = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("x") for c in ("id", "label", "keys", "kept", "n_shingles", "hi")})
    got, want = minhash.near_duplicates(docs).collect(), near_brute(rows)
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_near_duplicates_without_a_sure_center(spark):
    """One large bucket whose smallest id is unlike the rest: the links come from the cells."""
    rng = random.Random(5)
    base = words(rng, 200)
    rows = [(i, " ".join(edited(rng, base, 0.03 if i % 2 else 0.001))) for i in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, TEXTS), 5, 80).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, a), (None, "z"), (7, a), (3, b), (9, a), (9, b), (12, None)]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got[None, 46] == (None, True) and got[7, 46] == (3, False) and got[9, 46] == (3, False) and got[3, 46] == (3, True) and got[12, 0] == (12, True)
    assert minhash.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0


def test_op4_matches_its_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.op4_minhash_dedup(spark, sf_dir), queries.ORACLES["op4_minhash_dedup"])


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (2, 1), (2, 1)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {i: 1000 for i in range(1000, 1200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_distance(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        p, t = (bytes(rng.choices(b"abc", k=rng.randrange(1, n))) for n in (70, 160))
        assert decontam.edit_distance_within(p, t) == plain_distance(p, t)


@pytest.fixture
def leak_rows():
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, rng.randrange(8, 40)))) for k in range(25)] + [(None, "x " * 20), (90, None), (91, "too short")]
    docs = []
    for i in range(150):
        w = words(rng, rng.randrange(0, 400))
        if i % 3:
            item = items[rng.randrange(25)][1].split()
            if i % 3 == 2:
                for _ in range(max(1, len(item) // 20)):
                    k = rng.randrange(len(item))
                    item[k] = item[k] + "s" if rng.random() < 0.5 else item[k][1:]
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else ", ".join(w)))
    return docs, items


def leaks_brute(docs, items):
    out = {}
    for i, text in docs:
        whole = b" ".join(decontam.words_of(text))
        for k, item in items:
            own = decontam.words_of(item)
            if i is not None and k is not None and len(own) >= decontam.LEAST_WORDS:
                pattern = b" ".join(own)
                d = decontam.edit_distance_within(pattern, whole) if whole else len(pattern)
                if d <= int(decontam.MOST_EDITS * len(pattern)):
                    out[i, k] = d
    return out


def test_leaks(spark, leak_rows):
    docs, items = leak_rows
    docs = [*docs, (900, None), (901, ""), (None, items[0][1]), docs[1]]
    frame, bench = spark.createDataFrame(docs, TEXTS).withColumn("item_id", F.lit(5)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = [tuple(r) for r in decontam.find_leaks(frame, bench).collect()]
    want = leaks_brute(docs, items)
    assert len(got) == len({g[:2] for g in got}) and all(g[:2] in want and want[g[:2]] <= g[2] for g in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 80
    gone = {g[0] for g in got}
    clean = decontam.keep_clean(frame, bench)
    # the row without an id holds an item as well
    assert clean.columns == frame.columns and sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in docs if i is not None and i not in gone)
    assert decontam.find_leaks(frame, bench.limit(0)).count() == 0 and decontam.find_leaks(frame.limit(0), bench).count() == 0


def test_leaks_in_blocks(spark, leak_rows, monkeypatch):
    docs, items = leak_rows
    frame, bench = spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string")
    whole = set(map(tuple, decontam.find_leaks(frame, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 10)
    assert set(map(tuple, decontam.find_leaks(frame, bench).collect())) == whole


def test_leaks_without_their_first_words_at_the_start_of_later_documents(spark):
    """Items of 60 words that lost 2 to 5 of them, in documents that are not the first of their batch."""
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, 60))) for k in range(20)]
    docs = [(-1, " ".join(words(rng, 50)))]
    docs += [(k, " ".join(item.split()[2 + k % 4 :] + words(rng, 30 + k))) for k, item in items]
    frame, bench = spark.createDataFrame(docs, TEXTS).coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:2] for r in decontam.find_leaks(frame, bench).collect()}
    assert got == set(leaks_brute(docs, items)) and len(got) == 20


def test_leaks_with_edits_up_to_the_limit(spark):
    """Items of 8 words and more with edits of single bytes anywhere, as many as are allowed: all are found, by their distance."""
    rng = random.Random(6)
    plain = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 8))) for _ in range(n)]
    items = [(k, " ".join(plain(8 + k % 24))) for k in range(60)]
    docs = []
    for i in range(240):
        text, at = list(items[i % 60][1]), plain(rng.randrange(30))
        for _ in range(int(decontam.MOST_EDITS * len(text))):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice(([], ["x"], [text[k], "y"]))
        docs.append((i, " ".join([*at, "".join(text), *plain(rng.randrange(30))])))
    got = {tuple(r)[:2]: r[2] for r in decontam.find_leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == leaks_brute(docs, items) and len(got) >= 230


def test_short_items_are_found_as_they_are(spark):
    items = [(1, "Paris"), (2, "the red fox"), (3, "a"), (4, ""), (5, "!?")]
    docs = [(1, "in Paris, once"), (2, "comparison of parish"), (3, "paris"), (4, "The  red\nfox."), (5, "the red foxes"), (6, "bathe red fox"), (7, "red the fox a"), (8, None), (9, "x " * 300_000 + "the red fox"), (10, "")]
    got = {tuple(r) for r in decontam.find_leaks(spark.createDataFrame(docs, TEXTS).coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 0), (3, 1, 0), (4, 2, 0), (7, 3, 0), (9, 2, 0)}


def test_stages_on_awkward_rows(spark, sf_dir):
    """Null ids and texts, repeated rows and ids, empty tables; further columns stay as they are."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    good = " ".join(f"the cat of number{i} and house{i} was in garden{i}." for i in range(12))
    near, item = good + " at last", table(spark, sf_dir, "benchmark").where("text IS NOT NULL").orderBy("item_id").first()["text"]
    rows = [(1, good), (1, good), (2, near), (None, good), (None, near), (None, "some " + item), (3, item), (4, None), (None, None), (5, ""), (6, "other " * 9), (6, "words " * 9)]
    docs = spark.createDataFrame([(*r, None, None, None, "x") for r in rows], columns)
    stages, size = dict(corpus_pipeline.STAGES), lambda df: sorted(map(str, (tuple(r)[:2] for r in df.collect())))
    want = lambda keep: sorted(str(r) for r in keep)
    out = {name: stage(spark, docs, sf_dir) for name, stage in stages.items()}
    assert all(out[name].columns == docs.columns for name in list(stages)[:-1])
    assert size(out["quality rules"]) == want([rows[k] for k in (0, 1, 2, 3, 4)])
    got = size(out["MinHash near-dedup"])
    assert str((1, good)) in got and got.count(str((1, good))) == 1 and not any(near in x for x in got) and str((None, good)) not in got
    assert size(out["benchmark decontamination"]) == want(r for r in rows if item not in (r[1] or ""))
    assert set(size(out["mixing sources"])) <= set(want(rows))
    assert out["token ids"].count() == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def paragraphs_brute(rows, least=paragraphs.LEAST_WORDS):
    places = sorted({(i, k, line) for i, text in rows for k, line in enumerate((text or "").split("\n")) if len(line.split()) >= least}, key=lambda p: (p[0], p[1]))
    label = near_brute([(n, p[2]) for n, p in enumerate(places)])
    gone = {}
    for n, (i, k, _) in enumerate(places):
        if label[n] != n:
            gone.setdefault(i, []).append(k)
    return gone


def test_paragraphs(spark):
    rng = random.Random(8)
    bases = [words(rng, n) for n in (24, 25, 26, 40, 80, 300)]
    rows = []
    for i in range(60):
        parts = [" ".join(edited(rng, rng.choice(bases), rng.choice((0, 0.01, 0.02, 0.05)))) if rng.random() < 0.5 else " ".join(words(rng, rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("x") for c in ("v", "at", "id", "gone", "first")})
    gone = paragraphs_brute(rows)
    got = paragraphs.drop_repeated_paragraphs(docs).collect()
    assert len(got) == len(rows) and sum(map(len, gone.values())) > 20
    by = dict(rows)
    for r in got:
        lines, away = (by[r["doc_id"]] or "").split("\n"), gone.get(r["doc_id"], [])
        assert r["gone"] == away and r["n_paragraphs"] == len(lines)
        assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in away)
    assert paragraphs.drop_repeated_paragraphs(docs.limit(0)).count() == 0


def test_paragraphs_of_null_ids(spark):
    p = " ".join(f"w{i}" for i in range(30))
    got = {r["doc_id"]: r["gone"] for r in paragraphs.drop_repeated_paragraphs(spark.createDataFrame([(None, "a\n" + p), (1, p + "\nb")], TEXTS)).collect()}
    assert got == {None: [], 1: [0]}


def test_passages_within_longer_lines_and_over_short_ones(spark, tmp_path):
    """60 shared words inside lines that are otherwise different, or laid out in lines of 10, stay once."""
    rng = random.Random(9)
    passage, rows = words(rng, 60, 10**6), []
    for i in range(12):
        own = passage[:30] + ["edit"] + passage[31:] if i % 4 == 3 else passage
        shared = "\n".join(" ".join(own[k : k + 10]) for k in range(0, 60, 10)) if i % 2 else " ".join(own).upper()
        rows.append((i, " ".join(words(rng, 70, 10**6)) + " " + shared + " " + " ".join(words(rng, 90, 10**6))))
    clean = [(20, " ".join(words(rng, 300, 10**6))), (21, None), (None, "short"), (22, " ".join(words(rng, 50, 10**6) + passage[:30] + words(rng, 50, 10**6)))]
    spark.createDataFrame(rows + clean, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_paragraph_dedup(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert all(got[i]["kept_sha256"] == digest(t) for i, t in [rows[0], *clean])
    for i, t in rows[1:]:
        assert got[i]["n_cut_words"] == 60
        places = [m.span() for m in re.finditer(r"\S+", t)]
        assert got[i]["kept_sha256"] == digest(t[: places[70][0]] + t[places[129][1] :])


def token_rows(rows, tokenizer):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    path = queries.word_tokenizer()
    assert sorted(map(tuple, queries.op9_token_ids(spark, sf_dir).collect())) == token_rows(rows, path)
    odd = [(5, None), (4, ""), (4, " \n "), (7, "It's <|endoftext|> née x y 12,5\x0b\x1cz"), (7, "again"), (None, "no id"), (9, "long " * 50_000)]
    tokens.write_tokens(spark.createDataFrame(odd, TEXTS).withColumn("ids", F.lit(1)), f"{tmp_path}/odd", path)
    got = sorted(map(tuple, tokens.digests(tokens.read_tokens(spark, f"{tmp_path}/odd")).collect()), key=lambda r: r[1])
    assert got == token_rows(odd, path)
    tokens.write_tokens(spark.createDataFrame([], TEXTS), f"{tmp_path}/none", path)
    assert tokens.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_token_files_are_laid_out_for_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    path, tokenizer = f"{tmp_path}/tokens", queries.word_tokenizer()
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 100))) for i in range(24_000)]
    tokens.write_tokens(spark.createDataFrame(rows, TEXTS).coalesce(1), path, tokenizer)
    groups = pages = 0
    for name in sorted(tmp_path.glob("tokens/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = {(c := meta.row_group(g).column(j)).path_in_schema: c for j in range(meta.num_columns)}
            assert all(c.has_column_index and c.has_offset_index and c.compression == "ZSTD" for c in columns.values())
            assert all(set(columns[c].encodings) >= {"DELTA_BINARY_PACKED"} for c in ("doc_id", "start_in_part"))
            assert "RLE_DICTIONARY" in next(c for p, c in columns.items() if p.startswith("ids")).encodings
            assert meta.row_group(g).total_byte_size <= 64 << 20
            groups, pages = groups + 1, pages + -(-meta.row_group(g).num_rows // 5000)
    assert groups and pages > groups
    whole = {r["doc_id"]: r for r in tokens.read_tokens(spark, path).where("doc_id BETWEEN 700 AND 705").collect()}
    some = tokens.read_tokens(spark, path, 700, 705)
    assert {r["doc_id"]: r for r in some.collect()} == whole and len(whole) == 6
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,700)" in plan and "ids:array" not in plan.split("ReadSchema")[1]


def test_tokenizers_that_encode_spaces_get_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    texts = pa.array(["two  words\n", None, "", "a\x00b \x00", " lead", "\u00e9t\u00e9 " * 50])
    for name, apart in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        assert tokens.Encoder(path, 2).by_words is apart
        got, want = tokens.Encoder(path, 2).encode(texts), tokens.Encoder(path, 2, False).encode(texts)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
        assert tokens.Encoder(path, None).encode(texts[:0])[0].size == 0
    with pytest.raises(ValueError, match="white space"):
        tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2, True)


def test_words_that_do_not_fit_the_memory_or_whose_hashes_meet(monkeypatch):
    import pyarrow as pa

    path, rng = queries.word_tokenizer(), random.Random(3)
    texts = pa.array([" ".join(words(rng, 200)) for _ in range(20)])
    want = tokens.Encoder(path, 2).encode(texts)
    one = tokens.Encoder(path, 2)
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    for t in range(20):
        one.encode(texts[t : t + 1])
    assert one.encode(texts)[0].tolist() == want[0].tolist()
    exact = tokens.word_prints
    monkeypatch.setattr(tokens, "word_prints", lambda *a: (exact(*a)[0] % np.uint64(50), exact(*a)[1]))
    assert tokens.Encoder(path, 2).encode(texts)[0].tolist() == want[0].tolist()


def cut_brute(rows):
    n, seen = suffix.LENGTH, Counter()
    coded = [(i, (t or "").encode()) for i, t in rows]
    for _, data in coded:
        seen.update(data[k : k + n] for k in range(len(data) - n + 1))
    out = []
    for i, data in coded:
        away = np.zeros(len(data) + 2, np.int8)
        for k in range(len(data) - n + 1):
            if seen[data[k : k + n]] > 1:
                away[k + 1 : k + 1 + n] = 1
        kept = bytes(b for b, a in zip(data, away[1:-1], strict=True) if not a)
        out.append((i, len(data), int(away.sum()), int((np.diff(away) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut_rows(spark, rows):
    cut = suffix.cut_repeated(spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("x") for c in ("v", "g", "n", "starts")}))
    got = cut.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("starts"), F.sha2("kept", 256)).collect()
    return sorted(map(tuple, got), key=str)


@pytest.fixture
def passages():
    rng = random.Random(21)
    own = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared = [own(n) for n in (150, 199, 200, 201, 260, 900)]
    rows = [(i, own(rng.randrange(300)) + rng.choice(shared)[rng.randrange(3) :] + own(rng.randrange(200)) + rng.choice(shared) + own(5)) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "z" * 199), (103, "z" * 200), (104, "z" * 700), (105, "xy" * 300), (106, rows[0][1]), (None, rows[1][1]), (106, rows[0][1])]


def test_cut_repeated(spark, passages):
    assert cut_rows(spark, passages) == cut_brute(passages)
    assert cut_rows(spark, [(1, "abc")]) == cut_brute([(1, "abc")])
    assert suffix.cut_repeated(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize(("shard", "merge"), [(1, 4_000_000), (3, 4_000_000), (1, 1)])
def test_cut_repeated_of_grams_in_several_shards(spark, passages, monkeypatch, shard, merge):
    """Shards' transforms are merged; a gram of more strings than that has its windows counted."""
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "MERGED", merge)
    # the tasks of a local session import the module anew, so the parts are run here as well
    assert cut_rows(spark, passages) == cut_brute(passages)


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_transforms_are_those_of_the_union(shards):
    """The merge sees the shards' transforms only, and gives the transform, the order and the prefixes of all strings."""
    rng = random.Random(shards)
    base = bytes(rng.choices(b"ab", k=suffix.COLUMNS))
    strings, offsets = [], []
    for _ in range(60):
        d, own = rng.randrange(suffix.SPAN), bytearray(base)
        own[rng.randrange(len(own))] ^= rng.random() < 0.7
        a, n = suffix.SPAN - 1 - d, rng.randrange(1, d + 2)
        strings.append(bytes(own[a : a + n - 1 + suffix.LENGTH]))
        offsets.append(d)
    offsets, shard = np.array(offsets), np.sort(np.array([rng.randrange(shards) for _ in strings]))
    whole = list(suffix.transform(strings, offsets, np.zeros(len(strings), np.int64)))
    apart = [[byte for _, byte, _, _ in suffix.transform([strings[i] for i in np.flatnonzero(shard == s)], offsets[shard == s], np.zeros((shard == s).sum(), np.int64))] for s in range(shards)]
    for x, y in zip(suffix.merged(shard, map(list, zip(*apart, strict=True))), whole, strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(x, y, strict=True))
    seen = Counter((suffix.SPAN - 1 - d + k, s[k : k + suffix.LENGTH]) for s, d in zip(strings, offsets.tolist(), strict=True) for k in range(len(s) - suffix.LENGTH + 1))
    want = {(i, k) for i, (s, d) in enumerate(zip(strings, offsets.tolist(), strict=True)) for k in range(len(s) - suffix.LENGTH + 1) if seen[suffix.SPAN - 1 - d + k, s[k : k + suffix.LENGTH]] > 1}
    which, first, last = suffix.repeated(iter(whole), offsets)
    assert {(i, k) for i, a, b in zip(which.tolist(), first.tolist(), last.tolist(), strict=True) for k in range(a, b + 1)} == want and want


def test_null_ids_are_told_apart_by_more_than_32_bits(spark):
    """Two texts without an id whose 32-bit hashes meet, one of them a copy: the other keeps all its bytes."""
    own = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(x)), 256) for x in "abcd"])
    meeting = spark.range(300_000).select(own.alias("text")).groupBy(F.hash("text").alias("h")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a < b")
    a, b = meeting.select("a", "b").first()
    rows = [(None, a), (None, b), (7, a)]
    assert cut_rows(spark, rows) == cut_brute(rows)
    lines = [(None, a + "\n" + " ".join(f"w{i}" for i in range(40))), (None, b), (7, " ".join(f"w{i}" for i in range(40)))]
    got = {r["text"] for r in paragraphs.drop_repeated_paragraphs(spark.createDataFrame(lines, TEXTS)).collect()}
    assert got == {lines[0][1], b, ""}


def elected(texts):
    """Gram and offset of the gram of each window, by text and start."""
    batch = pd.DataFrame({"k": range(len(texts)), "v": 0, "text": texts})
    out = Counter()
    for part in suffix._elect(iter([batch])):
        for r in part.itertuples():
            out.update((r.k, r.lo + k, r.g, r.d - k) for k in range(r.n))
    assert set(out.values()) <= {1}
    return sorted(out)


def test_elections_do_not_depend_on_the_numpy_steps(monkeypatch):
    rng = random.Random(2)
    block = "".join(rng.choices("abc", k=3000))
    texts = [block[:700], "é" * 150 + block, block * 3, "", "short", block[5:]]
    whole = elected(texts)
    assert [k[:2] for k in whole] == [(i, a) for i, t in enumerate(texts) for a in range(len(t.encode()) - suffix.LENGTH + 1)]
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    assert elected(texts) == whole
    # texts beyond the packed places are elected in pieces: equal windows still agree
    monkeypatch.setattr(suffix, "PLACE_BITS", 12)
    pieces = {k[:2]: k[2:] for k in elected(texts)}
    assert sorted(pieces) == [k[:2] for k in whole]
    assert all(pieces[2, a] == pieces[2, a + 3000] for a in range(5800))


def test_pipeline(spark, sf_dir):
    """Each stage on its own input, and run() as the chain of all."""
    import duckdb

    docs = table(spark, sf_dir, "documents")
    held = [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = pd.DataFrame(held, columns=docs.columns)
        own = spark.createDataFrame(held, docs.schema)
        got = [tuple(r) for r in stage(spark, own, sf_dir).collect()]
        pairs = [(r[0], r[1]) for r in held]
        con = duckdb.connect()
        con.register("documents", before)
        if name == "quality rules":
            kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLES['op1_quality_rules']})").fetchall() if k}
            assert sorted(got) == sorted(r for r in held if r[0] in kept)
        elif name == "MinHash near-dedup":
            label = near_brute(pairs)
            assert sorted(got) == sorted(r for r in held if label[r[0]] == r[0])
        elif name == "benchmark decontamination":
            leaks = {i for i, _ in leaks_brute(pairs, bench)}
            kept = {r[0] for r in got}
            assert {r[0] for r in held} - kept <= leaks and len(kept & leaks) <= 0.03 * len(leaks)
        elif name == "mixing sources":
            want = con.execute(f"SELECT doc_id, count(*) FROM ({queries.ORACLES['op2_mix_sources']}) GROUP BY ALL").fetchall()
            assert Counter(r[0] for r in got) == dict(want) and set(got) <= set(held)
        else:
            assert sorted(got) == sorted(token_rows(pairs, queries.word_tokenizer()))
        last, held = got, got
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(last)

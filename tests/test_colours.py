"""Name codes against a plain automaton, over all bytes."""

from __future__ import annotations

import html
import itertools
import random

from pyspark.sql import functions as F

from skirmish.functions import colours


def automaton(name):
    out, i = [], 0

    def byte(b):
        base = b & 127
        ch = colours.GLYPHS[base] if base < 32 else " " if base == 127 else chr(base)
        out.append((ch, "g" if 16 <= base <= 27 else "b" if b >= 128 else "w"))

    while i < len(name):
        c, after = name[i], name[i + 1 : i + 2]
        if c == "$" and after == "x" and len(name) >= i + 4 and all(h in "0123456789abcdefABCDEF" for h in name[i + 2 : i + 4]):
            byte(int(name[i + 2 : i + 4], 16) or 32)
            i += 4
        elif c == "$" and after in colours.DOLLAR:
            byte(colours.DOLLAR[after])
            i += 2
        elif c == "^" and after and after != " ":
            byte(ord(after) | 128) if ord(after) < 128 else out.append((after, "b"))
            i += 2
        else:
            byte(ord(c)) if ord(c) < 32 else out.append((c, "w"))
            i += 1
    return out


def test_expanded_codes(spark):
    rng = random.Random(1)
    names = [f"$x{k:02x}" for k in range(256)] + [f"$x{k:02X}!" for k in range(256)] + [f"${chr(k)}" for k in range(1, 256)] + [f"^{chr(k)}" for k in range(1, 256)] + [chr(k) for k in range(1, 256)]
    names += ["", "$", "^", "$x", "$x1", "$xg0", "^ a", "$$x10", "^^^", "a^", "$[x$]", "€^€$."] + ["".join(rng.choice("$^x01afG[ ].\né") for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", "n", colours.expanded_codes(F.col("n")).alias("c")).collect()
    for r in rows:
        assert [tuple(c) for c in r["c"]] == automaton(r["n"]), r["n"]
    assert spark.sql("SELECT cast(null AS string) AS n").select(colours.expanded_codes(F.col("n"))).first()[0] is None


def test_byte_codes_and_markup(spark):
    name = "".join(map(chr, range(1, 256)))
    rows = spark.createDataFrame([(name,), ("",), ("a<áâ&\u0090x",)], "n string").select(colours.byte_codes(F.col("n")).alias("c"), colours.markup(colours.byte_codes(F.col("n"))).alias("m")).collect()
    for raw, got in zip(range(1, 256), rows[0]["c"], strict=True):
        low = raw % 128
        want = ("_", None) if low < 16 or 29 <= low <= 31 else ("•", None) if low == 28 else ("[]0123456789"[low - 16], "g") if low < 28 else (chr(low), "b" if raw >= 160 else None)
        assert tuple(got) == want
    assert rows[1]["m"] == "" and rows[1]["c"] == []
    assert rows[2]["m"] == 'a&lt;<span class="color-b">ab</span>&amp;<span class="color-g">[</span>x'


def test_runs(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice('ab<"') for _ in range(n)), "".join(rng.choice("wb") for _ in range(rng.randrange(n + 3)))) for n in range(40)]
    df = spark.createDataFrame(rows, "n string, c string").select("n", "c", colours.runs(colours.painted(F.col("n"), F.col("c"))).alias("r"), colours.markup(colours.painted(F.col("n"), F.col("c")), "x-").alias("m"))
    for r in df.collect():
        want = [("".join(ch for ch, _ in g), k) for k, g in itertools.groupby(zip(r["n"], r["c"].ljust(len(r["n"]), "w"), strict=False), key=lambda p: p[1])]
        assert [tuple(x) for x in r["r"]] == want
        assert r["m"] == "".join(f'<span class="x-{c}">{html.escape(t)}</span>' for t, c in want)

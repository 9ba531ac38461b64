"""Configuration files, and commands expanded through aliases, against a plain program."""

from __future__ import annotations

import random
import re

import pytest

from skirmish.operators import aliases
from skirmish.sources import configs

CONFIG = """// comment
sensitivity "3.5"
 sensitivity 4
+attack
-jump
bind mouse1 "+fire 7; say hi"
bind  e +hook
bind x
tempalias rl "weapon 7; wait"
alias +rj "+jump"
alias empty
exec "cfg/a.cfg"
exec
set_tp name "x y"
set lonely
unbindall
filter a b
toggle
cl_onload "exec cfg/b.cfg; echo z ; exec "
say "open
"""


def test_read_configs(spark, tmp_path):
    (tmp_path / "main.cfg").write_text(CONFIG.replace("\n", "\r\n"))
    (tmp_path / "a.cfg").write_text("exec main.cfg\nexec C.CFG\nexec none.cfg")
    (tmp_path / "b.cfg").write_text("x 1")
    (tmp_path / "c.cfg").write_text("exec b.cfg")
    (tmp_path / "d.cfg").write_text("")
    lines = configs.read_configs(spark, str(tmp_path))
    main = lines.where("file LIKE '%main.cfg'")
    got = [(r["kind"], r["name"], r["value"]) for r in main.orderBy("line").collect()]
    assert got == [
        ("cvar", "sensitivity", "3.5"), ("cvar", "sensitivity", "4"), ("bind", "MOUSE1", "+fire 7; say hi"), ("bind", "E", "+hook"), ("alias", "rl", "weapon 7; wait"), ("alias", "+rj", "+jump"),
        ("exec", None, "cfg/a.cfg"), ("cvar", "name", "x y"), ("cvar", "cl_onload", "exec cfg/b.cfg; echo z ; exec "), ("cvar", "say", '"open'),
    ]
    assert {r["name"]: r["value"] for r in configs.settings(main, "cvar").collect()}["sensitivity"] == "4"
    assert [r["path"] for r in configs.runs(main).orderBy("at").collect()] == ["cfg/a.cfg", "cfg/b.cfg"]
    pairs = {(r["root"].rpartition("/")[2], r["file"].rpartition("/")[2]) for r in configs.reached(lines).collect()}
    every = ["main.cfg", "a.cfg", "b.cfg", "c.cfg"]
    assert pairs == {(a, b) for a in every[:2] for b in every} | {("c.cfg", "c.cfg"), ("c.cfg", "b.cfg"), ("b.cfg", "b.cfg")}


def brute(command, names, depth=0):
    if depth > aliases.DEPTH:
        return [command]
    out = []
    for part in (p.strip() for p in command.split(";")):
        if not part:
            continue
        then = re.match(r"if[ (].*? then (.*)$", part, re.I | re.S)
        if then:
            quoted, at = False, None
            for k, c in enumerate(then[1]):
                quoted ^= c in "'\""
                if not quoted and at is None and then[1][k : k + 5].lower() == " else" and then[1][k + 5 : k + 6] in ("", " "):
                    at = k
            both = [then[1]] if at is None else [then[1][:at], then[1][at + 5 :]]
            found = [b.strip() for b in both if b.strip()]
            if found:
                for b in found:
                    out += brute(b, names, depth + 1)
                continue
        word = part.split()[0]
        if word in names:
            out += brute(names[word], names, depth + 1)
        elif word.startswith("+"):
            out += brute(names[word[1:]], names, depth + 1) if word[1:] in names else [part]
        elif word.find("$") > 0 and (fits := sorted(n for n in names if n.startswith(word[: word.find("$")]) and "$" not in n)):
            out += brute(names[fits[0]], names, depth + 1)
        else:
            out.append(part)
    return out


NAMES = {
    "rl": "weapon 7; +attack", "+rj": "rl; wait;; +jump", "loop": "loop; say again", "ping": "pong", "pong": "ping ; echo", "pick": "if ($a > 1) then rl else if $b then '$q else z' else +rj",
    "say_a": "say a", "say_b": "say b", "x$y": "never", "blank": "", "only": "IF x THEN rl", "no": "if x then  else rl", "deep0": "done", "q": "if x then say \"a else b\" else rl",
} | {f"deep{k}": f"deep{k - 1}" for k in range(1, 14)}


def test_expanded(spark):
    commands = ["rl", "+rj", "+rl", "loop", "ping", "pick; pick", "say_$z", "$z", "x$y", "blank", "only", "no", "deep9", "deep12", "unknown ; +nothing a", "if x", "q", "", None, "rl 5 6", "if (rl) then loop"]
    rows = spark.createDataFrame([(1, k, c) for k, c in enumerate(commands)] + [(2, 100, "rl"), (None, 101, "rl")], "scope int, id int, command string")
    known = spark.createDataFrame([(1, n, c) for n, c in NAMES.items()] + [(2, "other", "x"), (1, None, "x")], "scope int, name string, command string")
    got = {}
    for r in aliases.expanded(rows, known).orderBy("id", "at").collect():
        assert r["at"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append(r["command"])
    for k, c in enumerate(commands):
        assert got.get(k, []) == brute(c or "", NAMES), c
    assert got[100] == got[101] == ["rl"]


@pytest.mark.parametrize("seed", range(2))
def test_random_aliases(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([f"n{rng.randrange(30)}", f"+n{rng.randrange(30)}", "say x", f"m{rng.randrange(9)}", "n$a", "if y then n3 else say z"])
    names = {f"n{k}": rng.choice([word(), f"{word()};say {k}", f"if c then {word().replace(' else say z', '')} else {word()}"]) for k in range(24)}
    rows = spark.createDataFrame([(0, k, f"n{k}; done") for k in range(30)], "scope int, id int, command string")
    got = {}
    for r in aliases.expanded(rows, spark.createDataFrame([(0, n, c) for n, c in names.items()], "scope int, name string, command string")).orderBy("id", "at").collect():
        got.setdefault(r["id"], []).append(r["command"])
    assert got == {k: brute(f"n{k}; done", names) for k in range(30)}

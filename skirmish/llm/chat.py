"""Chat formatting: one relational plan of built-in expressions, with an exact way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: what stands before and after a block of adjacent turns of a role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: Any other role is written as OTHER[0], the escaped role, OTHER[1], then the block, then OTHER[2].
OTHER = ("<|role:", "|>", "<|/role|>")
#: Stands between the turns of a block.
TURN = "<|turn|>"
#: Starts an escape. Inside texts, the escape itself and every control string become it and one letter.
ESCAPE = "\x1b"
CONTROLS = [*(m for pair in MARKS.values() for m in pair), *OTHER, TURN]
ESCAPES = {ESCAPE: ESCAPE + "a"} | {c: ESCAPE + chr(ord("b") + k) for k, c in enumerate(CONTROLS)}


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    rows: conv_id, turn, role, text; further columns are ignored. The turns of a conversation are sorted by turn (then
    role and text), adjacent turns of one role become one block, and the blocks are written by the template. loss_spans
    are the (start, length) in code points of the assistant's texts within ``formatted``, one per turn, markers and
    separators left out. parse_chats() gives the turns back exactly: texts can't hold a control string unescaped.

    A null text is empty, a null role is the role "". Repeated rows are turns of their own. Null turns come first; rows
    with a null conv_id make one conversation. An empty table gives an empty table. A conversation is one output
    row, so it must fit a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    df = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_t"))
    start, end = F.lit(OTHER[0]), F.lit(OTHER[2])
    opened = lambda r: _by_role(r, 0, F.concat(start, escape(r), F.lit(OTHER[1])))
    closed = lambda r: _by_role(r, 1, end)

    def piece(t: Column, i: Column) -> Column:
        first = ~F.coalesce(F.get("_t", i - 1)["role"] == t["role"], F.lit(False))
        last = ~F.coalesce(F.get("_t", i + 1)["role"] == t["role"], F.lit(False))
        return F.struct(
            F.when(first, opened(t["role"])).otherwise(F.lit(TURN)).alias("pre"),
            escape(t["text"]).alias("body"),
            F.when(last, closed(t["role"])).otherwise(F.lit("")).alias("post"),
            (t["role"] == "assistant").alias("loss"),
        )

    df = df.withColumn("_p", F.transform("_t", piece))
    whole = lambda p: F.length(p["pre"]) + F.length(p["body"]) + F.length(p["post"])
    df = df.withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["pre"], p["body"], p["post"])), ""))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + F.length(p["pre"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))
        return F.struct((acc["at"] + whole(p)).cast("long").alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    df = df.withColumn("loss_spans", F.aggregate("_p", zero, step, lambda acc: acc["spans"]))
    return df.select("conv_id", "formatted", "loss_spans")


def _by_role(role: Column, side: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[side])).otherwise(out)
    return out


def parse_chats(chats: DataFrame) -> DataFrame:
    """``turns``, an array of (role, text), read back from ``formatted``, and ``loss_texts`` read through ``loss_spans``."""
    closing = "|".join("\\Q" + c + "\\E" for c in [*(m[1] for m in MARKS.values()), OTHER[2]])
    blocks = F.filter(F.split("formatted", closing), lambda b: b != "")

    def block(b: Column) -> Column:
        after = F.substr(b, F.lit(len(OTHER[0]) + 1))
        role, body = unescape(F.substring_index(after, OTHER[1], 1)), F.substr(after, F.length(F.substring_index(after, OTHER[1], 1)) + len(OTHER[1]) + 1)
        for name, (mark, _) in MARKS.items():
            role = F.when(b.startswith(mark), F.lit(name)).otherwise(role)
            body = F.when(b.startswith(mark), F.substr(b, F.lit(len(mark) + 1))).otherwise(body)
        return F.transform(F.split(body, "\\Q" + TURN + "\\E"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    turns = F.flatten(F.transform(blocks, block))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))))
    return chats.withColumns({"turns": turns, "loss_texts": loss})


def digests(parsed: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

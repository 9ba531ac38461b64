"""The trie of conversations that begin alike, with subtree totals by leaf-peeling message passing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import discard, stored
from skirmish.llm.running import running

#: Bytes of ids that one row holds on the way to the digest of a node's ends.
CHUNK = 1 << 16


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``turn_hash`` and ``n_chars`` of every turn, in the order of turn, null first.

    A null role or text is empty. Turns of one number are ordered by the hash, the md5 of the role's length, ``:``, the role and the
    text; repeated rows are turns of their own. Rows without a conv_id are left out. Texts are hashed where they are read,
    and only the hashes are shuffled, so a conversation may be of any length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("turn_hash"), F.length(text).cast("long").alias("n_chars"))
    return running(rows, ["conv_id"], ["turn", "turn_hash"], {"pos": ("sum", F.lit(1).cast("long"))}).drop("turn")


def spliced(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: their turns as of numbered(), and all ids.

    base and taken: by conv_id, the other conversation, and how many turns of its beginning (most or fewer) replace as many of
    the conversation's own. A base of fewer turns gives all it has, one that is absent none.
    """
    ids = turns.where("pos = 1").select("conv_id", base.cast("long").alias("_base"), taken.cast("int").alias("_taken"))
    heads = turns.where(F.col("pos") <= most)
    given = heads.withColumnRenamed("conv_id", "_base").join(ids, "_base").where(F.col("pos") <= F.col("_taken"))
    sizes = heads.groupBy(F.col("conv_id").alias("_base")).agg(F.max("pos").alias("_has"))
    short = ids.join(sizes, "_base", "left").select("conv_id", (F.col("_taken") - F.coalesce("_has", F.lit(0))).alias("_short")).where("_short > 0")
    own = turns.where(F.col("pos") > taken).join(stored(short), "conv_id", "left")
    columns = ["conv_id", "pos", "turn_hash", "n_chars"]
    own = own.withColumn("pos", F.col("pos") - F.coalesce("_short", F.lit(0)))
    return stored(given.select(columns).union(own.select(columns))), stored(ids.select("conv_id"))


_KEY, _UP = ["depth", "k1", "k2"], ["up_depth", "up_k1", "up_k2"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's ids, joined; the rows come in the order of node and id."""

    def row(key, first, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_KEY, key, strict=True), first=first, ids=",".join(ids))], pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    now, first, held, size, out = None, None, [], 0, []
    for batch in batches:
        for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv_id")), strict=True):
            if key != now or size > CHUNK:
                if held:
                    out.append(row(now, first, held))
                now, first, held, size = key, conv_id, [], 0
            held.append(str(conv_id))
            size += len(held[-1]) + 1
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if held:
        yield row(now, first, held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's runs of ids, which come in order; nothing but the digest's state is held."""
    names = [*_KEY, "ends_sha256"]
    now, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=names)


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ``ends_sha256`` of every node that conversations end at: the SHA-256 of their ids, ascending and
    joined by commas. ends: depth, k1, k2, conv_id. Ids are joined to runs of some CHUNK bytes in many tasks first; a digest
    can only be made from one end to the other, so a node's runs then pass through one task, one by one."""
    runs = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, ids string")
    return runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(paths: DataFrame, most_rounds: int = 200) -> DataFrame:
    """The messages that all paths but the root's send when they are complete: up_depth, up_k1, up_k2, n_leaves, saved_tokens.

    paths: path, up_path and the up columns (null for the root's), remaining (how many paths hang on it), and its own
    n_leaves and saved_tokens. In each round the paths without a remaining child send their totals to their parents and
    leave; a parent's counter goes down by what it got. Rounds end with the root.
    """
    sent, active = [], stored(paths)
    columns = active.columns
    for _ in range(most_rounds):
        ready = active.where("remaining = 0 AND up_path IS NOT NULL")
        mail = stored(ready.groupBy("up_path").agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")))
        sent.append(stored(ready.select(*_UP, "n_leaves", "saved_tokens")))
        rest = active.where("remaining > 0 OR up_path IS NULL").join(mail.withColumnRenamed("up_path", "path"), "path", "left")
        got = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias(own)
        left = (F.col("remaining") - F.coalesce("_n", F.lit(0))).alias("remaining")
        after = stored(rest.select("path", "up_path", *_UP, left, got("n_leaves", "_leaves"), got("saved_tokens", "_saved")).select(columns))
        discard(active)
        discard(mail)
        active = after
        if not active.where("up_path IS NOT NULL").limit(1).count():
            break
    else:
        raise RuntimeError(f"paths did not finish in {most_rounds} rounds")
    out = sent[0]
    for more in sent[1:]:
        out = out.union(more)
    return out


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per distinct beginning of d turns: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    turns: conv_id, pos, turn_hash, n_chars, as of numbered() or spliced(); ids: every conv_id, also those without turns, which
    are members of the root only. A beginning is told by 128 bits over its turns' places and hashes, so that
    beginnings are running totals and no text is compared. The root's parent is null. No ids: an empty table.

    Subtree totals come by peeling leaves. A node belongs to the path of that member whose hashed id is least; a path goes
    down from where its member has the least one to the member's end, and is peeled whole: it has a counter of the
    paths that hang on its nodes, and sends the totals of its top to the node above once all have sent theirs. The member
    of least hash changes O(log n) times on the way down (as records in a random order), however deep the trie, so
    that there are as many rounds. What nodes got is then summed along each path, from its end up.
    """
    mix = [F.xxhash64(F.lit(k), "turn_hash", F.col("pos").cast("long")) for k in (1, 2)]
    rows = turns.select("conv_id", F.col("pos").cast("long").alias("depth"), "n_chars", mix[0].alias("m1"), mix[1].alias("m2"))
    rows = running(rows, ["conv_id"], ["depth"], {"k1": ("xor", F.col("m1")), "k2": ("xor", F.col("m2"))})
    owner = F.min(F.struct(F.xxhash64("conv_id"), "conv_id"))["conv_id"].alias("path")
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), owner]
    up = [F.min(F.col("depth") - 1).alias("up_depth"), F.min(F.col("k1").bitwiseXOR(F.col("m1"))).alias("up_k1"), F.min(F.col("k2").bitwiseXOR(F.col("m2"))).alias("up_k2")]
    nodes = rows.groupBy(*_KEY).agg(*members, *up, F.max("n_chars").alias("n_chars"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = ids.agg(*members).where("n_convs > 0").select(*[zero.alias(c) for c in _KEY], "n_convs", "conv_id", "path", *[none.alias(c) for c in _UP], zero.alias("n_chars"))
    nodes = stored(nodes.unionByName(root))
    above = nodes.select(*[F.col(a).alias(b) for a, b in zip(_KEY, _UP, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up_path"))
    children = stored(nodes.where("depth > 0").groupBy(*[F.col(b).alias(a) for a, b in zip(_KEY, _UP, strict=True)]).agg(F.count("*").alias("n_children")))
    known = stored(nodes.join(above, _UP, "left").join(children, _KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("n_chars")}))
    discard(nodes)
    known = known.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    tops = known.where("up_path IS NULL OR up_path != path")
    sums = known.groupBy("path").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    hanging = tops.where("up_path IS NOT NULL").groupBy(F.col("up_path").alias("path")).agg(F.count("*").alias("remaining"))
    paths = tops.select("path", "up_path", *_UP).join(sums, "path").join(hanging, "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    mail = peeled(paths).groupBy(*[F.col(b).alias(a) for a, b in zip(_KEY, _UP, strict=True)]).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
    own = known.join(stored(mail), _KEY, "left").select(
        "path", (-F.col("depth")).alias("_upward"), *_KEY, "conv_id", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("_leaves", F.lit(0))).alias("_leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("_saved"),
    )
    summed = running(own, ["path"], ["_upward"], {"n_leaves": ("sum", F.col("_leaves")), "saved_tokens": ("sum", F.col("_saved"))})
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("e"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"e.{c}", zero).alias(c) for c in _KEY])
    summed = summed.join(stored(ends_digests(ends)), _KEY, "left")
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

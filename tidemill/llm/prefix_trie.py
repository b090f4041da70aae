"""The trie of conversations that begin alike, by truncation peeling.

Every conversation is peeled from its end: at the deepest level newly ended conversations meet the nodes that
survive from below, equal prefixes become one node with their figures summed, the last turn is stripped, and the
survivors are grouped again one level up. A node is found and complete in the same step.

A prefix is known by two 64-bit sums (exclusive or) of one hash per turn and place, so that stripping a turn takes
that hash out again, and a long conversation can be summed over many tasks. Conversations that are equal as a whole
become one path with a weight first. Spark deals the paths out by their shallowest prefix with at most ``GROUP``
turns below it, and a task peels such groups turn by turn. Prefixes with more below them are *open*: they are few,
get the survivors of their groups, and are summed up among themselves, each round stripping twice as many turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.text import map_stream
from tidemill.session import stage

# Turns below a prefix up to which one task peels it, and turns that a task peels at once.
GROUP = 4_096
_PEELED = 100_000
# Bytes of a list of ids that are handed on together.
_CHUNK = 1 << 14
# Characters of a text that order turns of equal number.
_TIE = 64
_NONE = np.iinfo(np.int64).max
_EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_KEY = ["k1", "k2"]
_CONV = ["lone", "conv"]


def _terms(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn adds to the two sums of a prefix at its place."""
    return F.xxhash64(place, a, b), F.xxhash64(b, place, a)


def _xor(column: Column) -> Column:
    return F.coalesce(F.bit_xor(column), F.lit(0).cast("long"))


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns in order as (part, ord, lone, conv, a, b, chars), staged; ``conv`` is 0 where ``lone``, without an id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.select(
        F.col("conv_id").isNull().alias("lone"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), "turn", role.alias("role"),
        F.left(text, F.lit(_TIE)).alias("begins"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit("second"), role).alias("b"), F.char_length(text).cast("long").alias("chars"),
    )
    order = ["lone", "conv", "turn", "role", "begins", "a"]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    return stage(ranged.select(F.shiftright("ord", 33).alias("part"), "ord", "lone", "conv", "a", "b", "chars"), "turns")


def _pieces(ordered: DataFrame) -> DataFrame:
    """The stretches of conversations in the parts: where they start, how many turns come before, how many there are."""
    pieces = ordered.groupBy("part", *_CONV).agg(F.count(F.lit(1)).alias("rows"), F.min("ord").alias("start"))
    # At most one row for each part; a conversation of any length has no more.
    whole = Window.partitionBy(*_CONV)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return stage(pieces.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("own"), F.count(F.lit(1)).over(whole).alias("pieces")), "pieces")


def _rebuilt(turns: DataFrame, base: Column | None, taken: Column | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (lone, conv, d, k1, k2, p1, p2, chars, len), and (lone, conv, len) of those
    without any."""
    ordered = _ordered(turns)
    pieces = _pieces(ordered).withColumns(
        {
            "base": F.when(~F.col("lone"), base) if base is not None else F.lit(None).cast("long"),
            "taken": F.when(~F.col("lone"), taken).otherwise(0).cast("long") if taken is not None else F.lit(0).cast("long"),
        }
    )
    index = F.col("ord") - F.col("start") + F.col("before")
    bases = pieces.where(F.col("taken") > 0).select(F.lit(False).alias("lone"), F.col("base").alias("conv")).distinct()
    begins = pieces.where(F.col("before") < most).join(bases, _CONV, "left_semi").select("part", *_CONV, "start", "before")
    first = ordered.join(begins, ["part", *_CONV]).withColumn("at", index).where(F.col("at") < most)
    # At most ``most`` turns each.
    heads = first.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "chars"))).alias("head")).withColumnRenamed("conv", "base")
    pieces = pieces.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("taken").cast("int")))
    pieces = pieces.withColumn("head", F.transform("head", lambda x, i: F.struct(x["chars"].alias("chars"), *(t.alias(n) for t, n in zip(_terms((i + 1).cast("long"), x["a"], x["b"]), ("t1", "t2"))))))

    def summed(name: str, upto: Column) -> Column:
        return F.aggregate(F.slice("head", F.lit(1), upto), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[name]))

    kept = F.greatest(F.col("own") - F.col("taken"), F.lit(0))
    pieces = stage(pieces.withColumns({"len": F.size("head") + kept, "x1": summed("t1", F.size("head")), "x2": summed("t2", F.size("head"))}), "pieces")
    place = F.size("head") + index - F.col("taken") + 1
    rows = ordered.join(pieces.drop("rows", "base"), ["part", *_CONV]).where(index >= F.col("taken")).withColumn("d", place)
    t1, t2 = _terms(F.col("d"), F.col("a"), F.col("b"))
    rows = rows.select("part", "ord", *_CONV, "d", "len", "chars", "pieces", "x1", "x2", t1.alias("t1"), t2.alias("t2"))
    inside = Window.partitionBy("part", *_CONV).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stage(rows.withColumns({"r1": F.bit_xor("t1").over(inside), "r2": F.bit_xor("t2").over(inside)}), "summed")
    earlier = Window.partitionBy(*_CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.where(F.col("pieces") > 1).groupBy("part", *_CONV).agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    offsets = offsets.select("part", *_CONV, F.coalesce(F.bit_xor("t1").over(earlier), F.lit(0)).alias("o1"), F.coalesce(F.bit_xor("t2").over(earlier), F.lit(0)).alias("o2"))
    rows = rows.join(offsets, ["part", *_CONV], "left")

    def key(n: int) -> Column:
        return F.col(f"r{n}").bitwiseXOR(F.col(f"x{n}")).bitwiseXOR(F.coalesce(f"o{n}", F.lit(0)))

    own = rows.select(*_CONV, "d", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("t1")).alias("p1"), key(2).bitwiseXOR(F.col("t2")).alias("p2"), "chars", "len")
    each = pieces.where(F.col("before") == 0)
    head = each.select(*_CONV, "len", "head", F.posexplode("head").alias("at", "turn"))
    upto = F.col("at") + 1
    taken_rows = head.select(
        *_CONV, upto.cast("long").alias("d"), summed("t1", upto).alias("k1"), summed("t2", upto).alias("k2"),
        summed("t1", F.col("at")).alias("p1"), summed("t2", F.col("at")).alias("p2"), F.col("turn.chars").alias("chars"), "len",
    )
    return stage(own.union(taken_rows), "prefixes"), each.where(F.col("len") == 0).select(*_CONV)


def _digest(ids: list[bytes]) -> str:
    return hashlib.sha256(b",".join(ids)).hexdigest()


_ENDS = "k1 long, k2 long, n long, conv long, sha string, part long, at long, ids binary"


def _ended(ends: DataFrame) -> DataFrame:
    """(k1, k2, n, conv, sha) of the prefixes where conversations end: how many, the smallest id, and the digest of
    their ids. A prefix of any number of conversations is read in stretches, none of which holds them all."""

    def run(batches):
        key, ids, n, least, seen = None, [], 0, None, 0

        def whole():
            return (*key, n, least, _digest(ids), None, None, None)

        def stretches(number):
            # The first and the last prefix of a part may go on in others.
            joined = [b",".join(ids[i : i + _CHUNK // 8]) for i in range(0, len(ids), _CHUNK // 8)]
            return [(*key, n if i == 0 else 0, least if i == 0 else None, None, part, number * (1 << 32) + i, text) for i, text in enumerate(joined)]

        part = 0
        for batch in batches:
            rows = []
            part = batch.column(3)[0].as_py()
            k1, k2, conv = (batch.column(i).to_pylist() for i in range(3))
            for at in zip(k1, k2, conv):
                if at[:2] != key:
                    if key is not None:
                        rows += [whole()] if seen > 1 else stretches(0)
                    key, ids, n, least, seen = at[:2], [], 0, None, seen + 1
                ids.append(b"" if at[2] is None else b"%d" % at[2])
                n += 1
                least = at[2] if least is None else least
            yield _ended_batch(rows)
        if key is not None:
            yield _ended_batch(stretches(1))

    order = [*_KEY, F.col("conv").asc_nulls_first()]
    ranged = ends.select(*_KEY, "conv").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    found = stage(map_stream(ranged, run, _ENDS), "ends")

    def joined(batches):
        key, digest, n, least = None, None, 0, None
        for batch in batches:
            rows = []
            for k1, k2, more, conv, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (k1, k2) != key:
                    if key is not None:
                        rows.append((*key, n, least, digest.hexdigest(), None, None, None))
                    key, digest, n, least = (k1, k2), hashlib.sha256(ids), 0, None
                else:
                    digest.update(b"," + ids)
                n += more
                least = conv if least is None else least
            yield _ended_batch(rows)
        if key is not None:
            yield _ended_batch([(*key, n, least, digest.hexdigest(), None, None, None)])

    crossing = found.where("ids IS NOT NULL").repartition(*_KEY).sortWithinPartitions(*_KEY, "part", "at").select(*_KEY, "n", "conv", "ids")
    return stage(found.where("ids IS NULL").union(map_stream(crossing, joined, _ENDS)).select(*_KEY, "n", "conv", "sha"), "ended")


def _ended_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["k1", "k2", "n", "conv", "sha", "part", "at", "ids"])


_NODES = "k1 long, k2 long, d long, conv long, p1 long, p2 long, top boolean, parent long, n long, children long, leaves long, saved long"


def _peel(table: dict[str, np.ndarray]) -> pa.RecordBatch:
    """All nodes of whole groups; rows are in order of group, path and depth.

    ``top`` nodes are the prefixes the groups were dealt out by; their parents are open and not known here."""
    k1, k2, d, chars = (table[c] for c in ("k1", "k2", "d", "chars"))
    rows = len(d)
    path = np.ones(rows, bool)
    path[1:] = (table["conv"][1:] != table["conv"][:-1]) | (table["lone"][1:] != table["lone"][:-1]) | (table["g1"][1:] != table["g1"][:-1]) | (table["g2"][1:] != table["g2"][:-1])
    ends = np.flatnonzero(np.append(path[1:], True))
    ends = ends[np.argsort(-d[ends], kind="stable")]
    out, at = [], 0
    # Nodes that survive from the level below: a row of one of their paths, and their figures.
    row, n, conv, leaves, saved, children = (np.zeros(0, np.int64) for _ in range(6))
    depth = int(d[ends[0]]) if rows else 0
    while len(row) or at < len(ends):
        if not len(row):
            depth = int(d[ends[at]])
        stop = at + int(np.searchsorted(-d[ends[at:]], -depth, side="right"))
        new = ends[at:stop]
        at = stop
        inner = ~path[row]
        above = np.concatenate([row[inner] - 1, new])
        order = np.lexsort((k2[above], k1[above]))
        sorted_rows = above[order]
        start = np.ones(len(above), bool)
        start[1:] = (k1[sorted_rows[1:]] != k1[sorted_rows[:-1]]) | (k2[sorted_rows[1:]] != k2[sorted_rows[:-1]])
        first = np.flatnonzero(start)
        node = np.empty(len(above), np.int64)
        node[order] = np.cumsum(start) - 1

        def summed(survived, ended):
            return np.add.reduceat(np.concatenate([survived[inner], ended])[order], first) if len(first) else np.zeros(0, np.int64)

        none = np.zeros(len(new), np.int64)
        ended_conv = np.where(table["lone"][new], _NONE, table["conv"][new])
        least = np.minimum.reduceat(np.concatenate([conv[inner], ended_conv])[order], first) if len(first) else np.zeros(0, np.int64)
        parents = np.full(len(row), _NONE)
        parents[inner] = least[node[: int(inner.sum())]]
        out.append((row, conv, ~inner, parents, n, children, leaves, saved))
        more, below = summed(np.ones(len(row), np.int64), none), summed(leaves, none)
        n, saved = summed(n, table["w"][new]), summed(saved, none)
        row, conv, children = sorted_rows[first], least, more
        leaves = np.where(children == 0, 1, below)
        saved = saved + (n - 1) * chars[row]
        depth -= 1
    row, conv, top, parents, n, children, leaves, saved = (np.concatenate(x) for x in zip(*out))

    def ids(values):
        return pa.array(values, mask=values == _NONE)

    columns = [k1[row], k2[row], d[row], None, table["p1"][row], table["p2"][row], top, None, n, children, leaves, saved]
    columns = [ids(conv) if i == 3 else ids(parents) if i == 7 else pa.array(c) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODES.split(", ")])


def _peeled(closed: DataFrame) -> DataFrame:
    """The nodes of all closed prefixes; a task holds whole groups, about ``_PEELED`` turns at a time."""
    names = [*_CONV, "d", *_KEY, "p1", "p2", "chars", "w", "g1", "g2"]

    def columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        return {c: table.column(c).to_numpy() for c in names}

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < _PEELED:
                continue
            table = columns(held)
            other = np.flatnonzero((table["g1"] != table["g1"][-1]) | (table["g2"] != table["g2"][-1]))
            if len(other):
                # The last group may go on in the next batch.
                stop = int(other[-1]) + 1
                yield _peel({c: v[:stop] for c, v in table.items()})
                held = [b for b in pa.Table.from_batches(held).slice(stop).combine_chunks().to_batches()]
                n -= stop
        if n:
            yield _peel(columns(held))

    dealt = closed.select(*names).repartition("g1", "g2").sortWithinPartitions("g1", "g2", *_CONV, "d")
    return map_stream(dealt, run, _NODES)


def _open_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """(k1, k2, leaves, saved) of open nodes summed over their subtrees: every round adds what lies twice as far below."""
    far = nodes.select(*_KEY, F.col("p1").alias("u1"), F.col("p2").alias("u2"), "leaves", "saved")
    for _ in range(deepest.bit_length()):
        below = far.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        up = far.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("_u1"), F.col("u2").alias("_u2"))
        added = far.join(below, _KEY, "left").join(up, ["u1", "u2"], "left")
        total = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        far = stage(added.select(*_KEY, F.col("_u1").alias("u1"), F.col("_u2").alias("u2"), *total), "open")
    return far.select(*_KEY, "leaves", "saved")


def prefix_trie(turns: DataFrame, base: Column | None = None, taken: Column | None = None, most: int = 0, group: int = GROUP) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) from rows (conv_id, turn, role, text).

    Turns are ordered by ``turn``, NULL first, equal ones by role, by the beginning of the text and by a hash; NULL
    roles and texts are empty. With ``base`` and ``taken``, columns over ``conv`` (the id), a conversation is rebuilt
    from the first ``taken`` turns of the conversation ``base``, at most ``most``, and its own behind its first
    ``taken``. Every distinct sequence of first turns is a node; the root has depth 0 and no text. ``conv_id`` is the
    smallest id among the conversations that begin so, ``parent_conv_id`` the parent's; ``saved_tokens`` are the
    characters that need not be read again where conversations share a prefix, summed over the subtree;
    ``ends_sha256`` is the digest of the ids that end there, ascending and joined by commas. Rows without a
    conversation id are one conversation more, whose id is NULL and stands as empty text, first, in the digest.
    Repeated rows are turns of their own; no rows give no nodes. ``group`` is the number of turns a task peels
    together. Prefixes are told apart by 128 bits.
    """
    rows, turnless = _rebuilt(turns, base, taken, most)
    conv_id = F.when(~F.col("lone"), F.col("conv"))
    zero = F.lit(0).cast("long")
    ends = rows.where(F.col("d") == F.col("len")).select(*_KEY, conv_id.alias("conv"))
    ended = _ended(ends.union(turnless.select(zero.alias("k1"), zero.alias("k2"), conv_id.alias("conv"))))
    # One path for all conversations that are equal as a whole.
    paths = ended.select(F.col("conv").isNull().alias("lone"), F.coalesce("conv", zero).alias("conv"), F.col("n").alias("w"))
    rows = stage(rows.join(paths, _CONV), "paths")
    below = F.sum(F.col("len") - F.col("d") + 1)
    found = rows.groupBy(*_KEY, "d", "p1", "p2", "chars").agg(below.alias("below"), F.sum("w").alias("n"), F.min(conv_id).alias("conv"))
    open_nodes = stage(found.where(F.col("below") > group).drop("below"), "open")
    closed = rows.join(open_nodes.select(*_KEY), _KEY, "left_anti")
    tops = closed.groupBy(*_CONV).agg(F.min(F.struct("d", *_KEY)).alias("_top")).select(*_CONV, F.col("_top.k1").alias("g1"), F.col("_top.k2").alias("g2"))
    nodes = stage(_peeled(closed.join(tops, _CONV)), "nodes")

    everything = ended.agg(F.sum("n").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    none = F.lit(None).cast("long")
    root = everything.select(zero.alias("k1"), zero.alias("k2"), zero.alias("d"), none.alias("p1"), none.alias("p2"), zero.alias("chars"), "n", "conv")
    open_nodes = open_nodes.select(*root.columns).union(root)
    deepest = open_nodes.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    of_parent = [F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    one = F.lit(1).cast("long").alias("children")
    given = nodes.where("top").select(*of_parent, one, "leaves", "saved").union(open_nodes.where("p1 IS NOT NULL").select(*of_parent, one, zero, zero))
    given = given.groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
    children = F.coalesce("children", zero)
    own = open_nodes.join(given, _KEY, "left").withColumns(
        {"children": children, "leaves": F.when(children == 0, 1).otherwise(F.col("leaves")).cast("long"), "saved": F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("chars")}
    )
    own = stage(own, "own")
    own = own.drop("leaves", "saved").join(_open_sums(own, deepest), _KEY)
    known = own.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    columns = [*_KEY, "d", "conv", "parent", "n", "children", "leaves", "saved"]
    tops = nodes.where("top").drop("parent").join(known, ["p1", "p2"]).select(*columns)
    opened = own.join(known, ["p1", "p2"], "left").select(*columns)
    nodes = nodes.where("NOT top").select(*columns).union(tops).union(opened)
    nodes = nodes.join(ended.select(*_KEY, "sha"), _KEY, "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY_SHA256)).alias("ends_sha256"),
    )

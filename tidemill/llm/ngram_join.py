"""Documents whose word n-gram sets are similar, by partition-and-enumerate signatures.

Sets are grouped in bands of similar size. Within a band and its lower neighbour, sets with a Jaccard
similarity of at least ``percent`` differ in at most k elements, so if the shingle domain is cut into
(k + 1) / 2 parts, some part has at most one difference; with that part cut in three again, two of the three
agree in full. Every choice of part and two of its thirds is a signature: sets that similar share one.

Sets that share a signature are compared exactly, but not all with all. First, sizes and short vectors are
held against each other: each element falls into one of a vector's cells, so sets that differ in k elements
differ in at most k cells, and pairs that differ in more are ruled out without their sets. In each group of a
signature one leader, the member that shares most, is compared with the others; a group whose members are then
connected needs nothing more, since only components are asked for. In the other groups members of different
components are compared. Large groups are dealt out in blocks. A pair that meets in several groups is named in the first of
them alone, which its members' lists of groups tell. What is left is compared exactly, so no link between components is
missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.components import components
from tidemill.llm.text import Chunk, chunks, distinct_by_row, map_batches, map_stream, mix, shingles, words
from tidemill.session import stage

# Comparisons of one leader that go to one task, and members of a signature's group that stand in one block.
PAIRS_A_TASK = 2_000
BLOCK = 4_000
# Groups that a set's list of them names, and members up to which a group needs no list. A pair is named again in other
# groups, which costs time only.
KNOWN_GROUPS = 256
FEW = 16
_THIRDS = 3


def _sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row's distinct shingles (hash, row), sorted, and how many each row has."""
    hashes, rows = distinct_by_row(*shingles(words(chunk), k))
    return hashes, rows, np.bincount(rows, minlength=chunk.rows)


def _identities(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """One number for each set; equal for equal sets (64 bits, so different sets practically differ)."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, rows, mix(hashes + np.uint64(1)))
    return mix(total + np.bincount(rows, minlength=n).astype(np.uint64))


def _bands(largest: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands up to one beyond the largest set: each band's ends are similar enough."""
    ends = [0]
    while len(ends) < 3 or ends[-2] < largest:
        ends.append((ends[-1] + 1) * 100 // percent)
    return np.array(ends)


def _parts(end: np.ndarray, percent: int) -> np.ndarray:
    """First-level parts for pairs of sets of at most ``end`` elements; 0 where only equal sets are similar."""
    differences = 2 * end * (100 - percent) // (100 + percent)
    return np.where(differences > 0, (differences + 2) // 2, 0)


def signatures(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of every row's set and their rows."""
    ends = _bands(int(counts.max(initial=0)), percent)
    band = np.searchsorted(ends, counts)
    out, owners = [], []
    values = mix(hashes + np.uint64(2))
    for above in (0, 1):  # with sets of the own band or below, and with sets of the band above
        parts = np.where(counts > 0, _parts(ends[np.minimum(band + above, len(ends) - 1)], percent), 0)
        first = np.concatenate(([0], np.cumsum(parts * _THIRDS)))
        use = parts[rows] > 0
        if not use.any():
            continue
        row = rows[use]
        cell = first[row] + (hashes[use] % (parts[row] * _THIRDS).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, cell, values[use])
        owner = np.repeat(np.arange(len(counts)), parts * _THIRDS)
        place = np.arange(first[-1]) - first[owner]
        part = sums.reshape(-1, _THIRDS).sum(1, dtype=np.uint64)
        two = np.repeat(part, _THIRDS) - sums
        name = ((band[owner] + above).astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)
        out.append(mix(two + mix(name)))
        owners.append(owner)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, node): the size of every text's set, and a number that equal sets share."""

    def run(batch: pa.RecordBatch):
        ids, row = batch.column(0), 0
        for chunk in chunks(batch.column(1)):
            hashes, rows, counts = _sets(chunk, k)
            nodes = _identities(hashes, rows, chunk.rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(row, chunk.rows), pa.array(counts), pa.array(nodes)], names=["doc_id", "n_shingles", "node"])
            row += chunk.rows

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, node long")


def _emit_signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, node); a set that a task meets again is not repeated."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                hashes, rows, counts = _sets(chunk, k)
                nodes = _identities(hashes, rows, chunk.rows).view(np.int64)
                fresh = np.zeros(chunk.rows, bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                fresh &= ~np.isin(nodes, seen)
                seen = np.concatenate([seen, nodes[fresh]])
                keep = fresh[rows]
                sigs, owner = signatures(hashes[keep], rows[keep], np.where(fresh, counts, 0), percent)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(nodes[owner])], names=["sig", "node"])

    return map_stream(docs.select("text"), run, "sig long, node long")


def _shared(batches):
    """Of rows sorted by (sig, node), those whose signature has another node, each once."""
    held_sig = held_node = None
    held_out = True
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        if held_sig is not None and sig[0] == held_sig and node[0] == held_node:
            new[0] = False
        sig, node = sig[new], node[new]
        # The last row before this batch may find its partner only now.
        if held_sig is not None:
            sig, node = np.insert(sig, 0, held_sig), np.insert(node, 0, held_node)
        if not len(sig):
            continue
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        last_out = bool(shared[-1])
        if held_sig is not None and held_out:
            if len(sig) == 1:
                last_out = True
            shared[0] = False
        held_sig, held_node, held_out = sig[-1], node[-1], last_out
        yield pa.RecordBatch.from_arrays([pa.array(sig[shared]), pa.array(node[shared])], names=["sig", "node"])


def _compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets are similar."""
    rows = _with_leaders(pairs, texts)

    def run(batches):
        leader, leader_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at = 0
            for chunk in chunks(batch.column(3)):
                hashes, rows, counts = _sets(chunk, k)
                first = np.concatenate(([0], np.cumsum(counts)))
                linked = []
                for r in range(chunk.rows):
                    own = hashes[first[r] : first[r + 1]]
                    if b[at + r] == a[at + r]:
                        leader, leader_set = a[at + r], own
                        continue
                    assert leader == a[at + r]
                    where = np.minimum(np.searchsorted(leader_set, own), len(leader_set) - 1)
                    common = int((leader_set[where] == own).sum())
                    if 100 * common >= percent * (len(own) + len(leader_set) - common):
                        linked.append(at + r)
                yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])
                at += chunk.rows

    return map_stream(rows, run, "a long, b long")


def _vectors(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, vector): the sums of a set's element hashes in cells, half a byte each.

    The cells are a power of two, at least two thirds of the elements, and chosen by an element's low bits, so
    a vector folds to half its cells by adding its halves.
    """

    def run(batch: pa.RecordBatch):
        nodes, row = batch.column(0), 0
        for chunk in chunks(batch.column(1)):
            hashes, rows, counts = _sets(chunk, k)
            cells = 1 << np.ceil(np.log2(np.maximum(2, counts * 2 / 3))).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(cells)))
            cell = first[rows] + (mix(hashes + np.uint64(4)) & (cells[rows] - 1).astype(np.uint64)).astype(np.int64)
            sums = np.zeros(first[-1], np.uint64)
            np.add.at(sums, cell, mix(hashes + np.uint64(3)))
            low = (sums & np.uint64(15)).astype(np.uint8).reshape(-1, 2)
            data = (low[:, 0] << 4 | low[:, 1]).tobytes()
            vectors = [data[first[r] // 2 : first[r + 1] // 2] for r in range(chunk.rows)]
            yield pa.RecordBatch.from_arrays(
                [nodes.slice(row, chunk.rows), pa.array(counts, pa.int32()), pa.array(vectors, pa.binary())], names=["node", "n", "vector"]
            )
            row += chunk.rows

    return map_batches(texts, run, "node long, n int, vector binary")


def _cells(vector: bytes) -> np.ndarray:
    packed = np.frombuffer(vector, np.uint8)
    return np.stack([packed >> 4, packed & 15], axis=1).reshape(-1)


def _folded(cells: np.ndarray, to: int) -> np.ndarray:
    while len(cells) > to:
        half = len(cells) // 2
        cells = (cells[:half] + cells[half:]) & 15
    return cells


def _most_differences(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """In how many elements similar sets of these sizes may differ; -1 if their sizes alone rule it out."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return np.where(fits, (n + m) * (100 - percent) // (100 + percent), -1)


def _with_leaders(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(a, share, node, ...): for every pair (a, b) the row of ``table`` for b, behind that for a, which is
    sent once for every task that compares with it."""
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("b"), F.col("shares").cast("long")).cast("int")
    members = pairs.join(load, "a").select("a", share.alias("share"), F.col("b").alias("node"))
    leaders = load.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("node"))
    rest = [c for c in table.columns if c != "node"]
    rows = members.union(leaders).join(table, "node").select("a", "share", "node", *rest)
    return rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("node") != F.col("a"))


def _likely(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sizes and vectors do not rule them out."""

    def run(batches):
        n, own = 0, np.zeros(0, np.uint8)
        for batch in batches:
            kept = []
            for a, b, m, vector in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                cells = _cells(vector)
                if a == b:
                    n, own = m, cells
                    continue
                size = min(len(own), len(cells))
                if (_folded(own, size) != _folded(cells, size)).sum() <= _most_differences(n, m, percent):
                    kept.append((a, b))
            x, y = np.array(kept, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return map_stream(_with_leaders(pairs, vectors), run, "a long, b long")


def _possible(percent: int):
    """Mapper over rows sorted by (sig, left, right): pairs of one block pair, of different components, whose
    vectors do not rule them out and that have not met in an earlier group."""

    def settle(rows: list[tuple]):
        left, right = rows[0][1], rows[0][2]
        nodes, roots, sizes = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 6))
        own = np.array([r[3] for r in rows])
        cells = [_cells(r[7]) for r in rows]
        size = min(map(len, cells))
        vectors = np.stack([_folded(c, size) for c in cells])
        met = lambda i, j: np.isin(rows[i][8], rows[j][8], assume_unique=True).any()
        a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
        found = []
        for at, i in enumerate(a.tolist()):
            others = b[at + 1 :] if left == right else b
            others = others[roots[others] != roots[i]]
            most = _most_differences(sizes[others], sizes[i], percent)
            near = others[(vectors[others] != vectors[i]).sum(axis=1) <= most]
            found += [(nodes[i], nodes[j]) for j in near.tolist() if not met(i, j)]
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        rows = []
        for batch in batches:
            earlier, ends = batch.column(8), batch.column(8).offsets.to_numpy()
            sigs = earlier.values.to_numpy()
            lists = [sigs[x:y] for x, y in zip(ends, ends[1:])]
            for r in zip(*(batch.column(i).to_pylist() for i in range(8)), lists):
                if rows and r[:3] != rows[-1][:3]:
                    yield settle(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield settle(rows)

    return run


def _links(docs: DataFrame, described: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, root) of the sets that are linked with another; None if none has a candidate."""
    sigs = _emit_signatures(docs, k, percent).repartition("sig").sortWithinPartitions("sig", "node")
    shared = stage(map_stream(sigs, _shared, "sig long, node long"), "signatures")
    if shared.isEmpty():
        return None
    # One text for each set that has a candidate. Ids may repeat, so the set of the text found is computed again.
    one = described.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(shared.select("node").distinct(), "node", "left_semi")
    at_hand = docs.select("doc_id", "text").join(one, docs.doc_id.eqNullSafe(one.doc_id)).select("node", "text")

    def checked(batch: pa.RecordBatch):
        wanted, row = batch.column(0).to_numpy(), 0
        for chunk in chunks(batch.column(1)):
            hashes, rows, _ = _sets(chunk, k)
            own = _identities(hashes, rows, chunk.rows).view(np.int64) == wanted[row : row + chunk.rows]
            yield batch.slice(row, chunk.rows).filter(pa.array(own))
            row += chunk.rows

    texts = stage(map_batches(at_hand, checked, "node long, text string").dropDuplicates(["node"]), "texts")
    size = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("members"))
    degree = shared.join(size, "sig").groupBy("node").agg(F.sum("members").alias("degree"))
    leader = shared.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("best")).select("sig", F.col("best.node").alias("a"))
    pairs = shared.join(leader, "sig").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    vectors = stage(_vectors(texts, k), "vectors")
    likely = stage(_likely(stage(pairs, "pairs"), vectors, percent), "likely")
    links = stage(_compare(likely, texts, k, percent), "similar")
    roots = components(links)

    labelled = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spans = labelled.groupBy("sig").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
    )
    # Of two members, one is the leader. Of groups with the same members, one is enough.
    split = spans.where("low < high AND members > 2").groupBy("members", "who").agg(F.min("sig").alias("sig"))
    split = split.select("sig", "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    order = Window.partitionBy("node").orderBy(F.desc("members"), "sig")
    known = labelled.join(split, "sig").withColumn("place", F.row_number().over(order))
    listed = F.when((F.col("place") <= KNOWN_GROUPS) & (F.col("members") > FEW), F.col("sig"))
    earlier = F.collect_list(listed).over(order.rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.when(F.col("members") > FEW, earlier).otherwise(F.array().cast("array<long>"))
    open_ = known.withColumn("earlier", earlier).join(vectors, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    # Every pair of blocks gets both blocks' members.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = open_.withColumn("own", own).select("*", other).select(
        "sig", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "node", "root", "n", "vector", "earlier"
    )
    dealt = dealt.repartition("sig", "left", "right").sortWithinPartitions("sig", "left", "right")
    more = stage(map_stream(dealt, _possible(percent), "a long, b long").distinct(), "possible")
    if more.isEmpty():
        return roots
    return components(links.union(_compare(more, texts, k, percent)))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, group) of all rows; texts without words are in no group."""
    described = stage(describe(docs, k), "sets")
    roots = _links(docs, described, k, percent)
    if roots is None:
        return described.withColumn("group", F.when(F.col("n_shingles") > 0, F.col("node")))
    return described.join(roots, "node", "left").select(
        "doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("group")
    )


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``n_shingles`` counts the distinct runs of ``k`` words (without ASCII white space, A to Z folded); a
    shorter text has its whole sequence as its one shingle, and NULL texts and texts without words have none
    and are linked with nothing. Texts are linked when 100 * intersection >= ``percent`` * union, and
    ``component_id`` is the smallest ``doc_id`` that links reach. Rows that repeat an id are rows of their
    own; a NULL id never is the smallest unless all of its component are NULL. An empty table gives no rows.
    """
    grouped = _grouped(docs, k, percent)
    smallest = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(smallest, "group", "left").select(
        "doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each group of similar texts keeps one: that of the smallest ``doc_id``.

    Groups are the components of ``join``. Texts without words all stay. NULL ids come last; of rows that
    share an id within a group, the one with the smallest set number stays, and one of rows equal in both.
    """
    grouped = stage(_grouped(docs, k, percent), "groups")
    first = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("kept"))
    none = F.lit(-(1 << 63))  # stands for NULL, so that it joins
    kept = first.select(F.coalesce("kept.doc_id", none).alias("_id"), F.col("kept.node").alias("_node"))
    names = docs.columns
    at_text = names.index("text")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("_node long, _some boolean").fields])

    def run(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(at_text)):
            hashes, rows, counts = _sets(chunk, k)
            nodes = _identities(hashes, rows, chunk.rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.slice(chunk.first, chunk.rows).columns, pa.array(nodes), pa.array(counts > 0)], names=schema.names)

    numbered = map_batches(docs, run, schema).withColumn("_id", F.coalesce("doc_id", none))
    single = numbered.where("_some").join(kept, ["_id", "_node"], "left_semi").dropDuplicates(["_id", "_node"])
    return single.select(*names).union(numbered.where("NOT _some").select(*names))

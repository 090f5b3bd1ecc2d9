"""Exact Jaccard join of word shingle sets by pivots, Voronoi regions and triangle-inequality windows.

Far documents all have distance 1 from each other, so document pivots alone
would put every document into every region. A shingle index makes the first
cut, into parts of which each linked pair shares one. Shingles have a global order (frequent
ones last): two sets that link share s of the first n - ceil(0.8 n) + s
shingles of either; s is 1 + n div 16 of the smaller set, which has 0.8 of the
larger one's shingles at least. So a set links with nothing if others have
fewer than 1 + (0.8 n) div 16 of its window in theirs. The remaining sets leave
out the most frequent 2 (n div 16) div 5 of those that others have; both of a
pair leave out fewer than they share, so a shared one is left. The smallest
holder of such a shingle names a part, to which all holders go.

A part is joined by document pivots. Each member's distances from the pivots
are taken. It goes to the region of its nearest pivot p if that is at most 0.4
away, and also to that of any pivot q within 0.6 whose distance is greater by
0.4 at most; a member that is farther from all pivots goes to a rest. Linked
sets have a distance of 0.2 at most, so by the triangle inequality they meet in
a region or in the rest. Regions are joined recursively. A pivot has been
compared with all of its region and leaves it. Where regions would overlap too
much, only the pivots leave; then, and in a rest, the next pivots are twice as
many. Members that are connected already aren't compared: a region ends when it
is connected.

Regions of few members are joined by one task each, with the recursion in
numpy; larger ones in rounds of Spark, dealt out in chunks, to each of which the
pivots go.

Equal sets are one class (told by 128 bits of hash) and joined once; shingles
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm import words as W
from quarry.llm.frames import cut, fresh, stored

SHINGLE = 5
#: Members and shingles of a region that one task joins at once; a single longer text is joined whole.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Pivots of a large region in its first round; their number doubles in a rest and while regions overlap too much, up to a chunk.
PIVOTS = 128
#: Regions that a member may go to on average; else the region stays whole.
OVERLAP = 1.5
#: How far a member may be from the pivot whose region it belongs to, and the distance of linked sets.
HOME, LINK = 0.4, 0.2
#: Rows whose shingles are counted together; a shingle that so many of them hold is frequent.
GROUP_ROWS, FREQUENT = 2048, 6
#: Frequent shingles that are ordered last; an order only saves work.
KEPT_FREQUENT = 200_000
#: Rows of ids that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Windows are longer by this part of a set.
SPARE = 16


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the bounds of each text's."""
    words = W.scan(texts, W.NONSPACE)
    size = np.diff(words.bounds)
    at, owner = W.positions(*W.gram_bounds(words.bounds, SHINGLE))
    found, owners = [W.grams(words.hashes, SHINGLE)[at]], [owner]
    for n in range(1, SHINGLE):  # shorter texts are one shingle
        short = np.flatnonzero(size == n)
        if len(short):
            first = words.bounds[short]
            found.append(W.grams(words.hashes, n)[first])
            owners.append(short)
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(size) + 1))


def _add(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, n, s1, s2 of each text; and with rid null, frequent shingles: s1, and how many rows hold it: n."""
    names = ["rid", "doc_id", "n", "s1", "s2"]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= FREQUENT
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(count[keep]), pa.array(value[keep].view(np.int64)), none], names=names)

    held, rows = [], 0
    for batch in W.sliced(batches, "text"):
        hashes, bounds = shingles(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(_add(W.mix(hashes), bounds)), pa.array(_add(W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds))], names=names)
        held.append(hashes)
        rows += batch.num_rows
        if rows >= GROUP_ROWS:
            yield frequent(held)
            held, rows = [], 0
    if held:
        yield frequent(held)


def prefixes(hashes: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each set's window, and the set of each."""
    size = np.diff(bounds)
    need = np.where(size > 0, size - (4 * size + 4) // 5 + 1 + size // SPARE, 0)
    owner = np.repeat(np.arange(len(size)), size)
    late = W.has(frequent, hashes)
    order = np.lexsort((late, owner))
    rank = np.arange(len(owner)) - bounds[owner]
    keep = rank < need[owner]
    return hashes[order][keep], owner[keep]


def overlaps(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each set and each pivot link (100 * intersection >= 80 * union), and their distances."""
    held, size = np.concatenate(pivots), np.fromiter(map(len, pivots), np.int64, len(pivots))
    owner = np.repeat(np.arange(len(pivots)), size)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    common = np.zeros((len(sets), len(pivots)), np.int64)
    for i, own in enumerate(sets):
        low, high = np.searchsorted(held, own), np.searchsorted(held, own, side="right")
        at, _ = W.positions(low, high - low)
        common[i] = np.bincount(owner[at], minlength=len(pivots))
    union = np.fromiter(map(len, sets), np.int64, len(sets))[:, None] + size - common
    return 5 * common >= 4 * union, 1 - common / union


def regions(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of member and pivot for each region a member goes to; pivot -1 is the rest."""
    nearest = distance.min(axis=1)
    window = np.minimum(nearest + 2 * LINK, HOME + LINK) + 1e-9
    member, pivot = np.nonzero(distance <= window[:, None])
    rest = np.flatnonzero(nearest > HOME)
    return np.concatenate([member, rest]), np.concatenate([pivot, np.full(len(rest), -1)])


class Region:
    """Connects the members of a region; sets are sorted arrays."""

    def __init__(self, sets: list[np.ndarray], known: list[int] | None = None) -> None:
        """known: numbers of what is connected already."""
        self.sets, self.root, self.splits = sets, list(range(len(sets))), 0
        first: dict[int, int] = {}
        for i, k in enumerate(known or []):
            self.root[i] = first.setdefault(k, i)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)

    def join(self, members: list[int]) -> None:
        """Finds all links of members that aren't connected."""
        waiting = [members]
        while waiting:
            members = waiting.pop()
            groups = Counter(map(self.find, members))
            if len(groups) < 2:
                continue
            common = groups.most_common(1)[0][0]
            pivots = [i for i in members if self.find(i) != common][: 1 if len(members) < 8 else 4]
            rest = [i for i in members if i not in pivots]
            both = pivots + rest
            links, distance = overlaps([self.sets[i] for i in both], [self.sets[i] for i in pivots])
            for i, j in zip(*np.nonzero(links), strict=True):
                self.link(both[i], pivots[j])
            member, pivot = regions(distance[len(pivots) :])
            parts = [[rest[i] for i in member[pivot == p].tolist()] for p in range(-1, len(pivots))]
            if sum(len(x) ** 2 for x in parts) <= 0.7 * len(rest) ** 2:
                self.splits += 1
                waiting += [x for x in parts if len(x) > 1]
            else:
                waiting.append(rest)


def _sets(table: pa.Table) -> list[np.ndarray]:
    """Shingle sets of the rows; their sizes are those that the first pass has seen, or the rows have changed their order."""
    out: list[np.ndarray] = []
    for batch in W.sliced(iter(table.select(["text"]).to_batches()), "text"):
        hashes, bounds = shingles(batch.column("text"))
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if [len(x) for x in out] != table["size"].to_pylist():
        raise ValueError("the documents were read in another order than before")
    return out


def _connect(table: pa.Table) -> pa.Table:
    """Joins a region: links (a, b) between classes. Columns: rid, text, size, label (what is connected)."""
    table = table.sort_by("rid").combine_chunks()
    rid = table["rid"].to_pylist()
    region = Region(_sets(table), table["label"].to_pylist())
    start = [region.find(i) for i in range(len(rid))]
    region.join([i for i in range(len(rid)) if not i or rid[i] != rid[i - 1]])
    end = [region.find(i) for i in range(len(rid))]
    new = sorted({(rid[a], rid[b]) for a, b in zip(start, end, strict=True) if rid[a] != rid[b]})
    return pa.table({"a": pa.array([x for x, _ in new], pa.int64()), "b": pa.array([x for _, x in new], pa.int64())})


def _measure(table: pa.Table) -> pa.Table:
    """A chunk's members and their region's pivots. Rows of kind 0: a link, of a member and the least pivot that it links with; 1: a region
    that a member goes to (pivot -1 is the rest, -2 all of the region, where its parts would overlap too much), with the least pivot
    that it links with as label, or the label it had; 2: two pivots that members connect.
    """
    table = table.sort_by("rid").combine_chunks()
    sets, rid, label, is_pivot = _sets(table), table["rid"].to_numpy(), table["label"].to_numpy(), table["pivot"].to_numpy(zero_copy_only=False)
    pivots, members = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
    linked, distance = overlaps([sets[i] for i in members], [sets[i] for i in pivots])
    some = linked.any(axis=1)
    least = rid[pivots[linked.argmax(axis=1)]]
    label = np.where(some, least, label[members])
    group, edges = Region([]), []
    group.root = list(range(len(pivots)))
    for i, j in zip(*np.nonzero(linked), strict=True):
        first = int(linked[i].argmax())
        if group.find(first) != group.find(int(j)):
            group.link(first, int(j))
            edges.append((rid[pivots[first]], rid[pivots[j]]))
    free = np.flatnonzero(~np.isin(rid[members], rid[pivots]))  # pivots have met all and leave
    member, pivot = regions(distance[free]) if len(free) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(member) > OVERLAP * len(free):
        member, pivot = np.arange(len(free)), np.full(len(free), -2)
    went, at = free[member], np.flatnonzero(some)
    a = np.concatenate([rid[members[at]], rid[members[went]], np.array([x for x, _ in edges], np.int64)])
    b = np.concatenate([least[at], np.where(pivot < 0, pivot, rid[pivots[np.maximum(pivot, 0)]]), np.array([x for _, x in edges], np.int64)])
    nothing = np.full(len(edges), -1)
    size = np.concatenate([np.full(len(at), -1), table["size"].to_numpy()[members[went]], nothing])
    labels = np.concatenate([label[at], label[went], nothing])
    kind = np.repeat(np.arange(3, dtype=np.int32), [len(at), len(went), len(edges)])
    return pa.table({"cell": np.full(len(a), table["cell"][0].as_py()), "rid": a, "pivot": b, "size": size, "label": labels, "kind": kind})


def _roots(table: pa.Table) -> pa.Table:
    """Of a region's pivots that members connect: cell, pivot, root."""
    rows = list(zip(table["rid"].to_pylist(), table["pivot"].to_pylist(), strict=True))
    ids = sorted({x for r in rows for x in r})
    place, group = {x: i for i, x in enumerate(ids)}, Region([])
    group.root = list(range(len(ids)))
    for x, y in rows:
        group.link(place[x], place[y])
    return pa.table({"cell": np.full(len(ids), table["cell"][0].as_py()), "pivot": np.array(ids, np.int64), "root": np.array([ids[group.find(i)] for i in range(len(ids))], np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id that is connected) of all ends of edges (a, b)."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = cut(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            return labels


def links(texts: DataFrame, cells: DataFrame, chunk: int = CHUNK, pivots: int = PIVOTS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Links (a, b) that connect whatever is linked within a region.

    cells: cell, rid, size (shingles); texts: rid, text. Both are read in each round, so they should be tables.
    Members of one label are connected; of a region that a pivot leads, lead is the pivot's label.
    """
    none = F.lit(None).cast("long")
    cells = cells.select("cell", "rid", "size", F.col("rid").alias("label"), none.alias("lead"), F.lit(0).alias("tries"))
    found, few = [], []
    while True:
        # What isn't connected with the region's pivot is open; pivots are chosen among it.
        draw = F.xxhash64("rid", "tries")
        is_open = ~F.col("label").eqNullSafe(F.col("lead"))
        sizes = cells.groupBy("cell", "tries").agg(
            F.count("*").alias("members"), F.sum("size").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(is_open.cast("long")).alias("n_open"),
            F.min(F.when(is_open, F.struct(draw.alias("draw"), "rid"))).alias("first"),
        )
        large = stored(sizes.where((F.col("members") > chunk) | (F.col("shingles") > CHUNK_SHINGLES) & (F.col("members") > 2)).drop("tries"))
        n_large = large.count()
        send = F.broadcast if n_large <= broadcast_ids else lambda x: x
        few.append((cells.join(send(large.select("cell")), "cell", "left_anti") if n_large else cells).select("cell", "rid", "size", "label"))
        large = large.where("low <> high")
        if not n_large:
            break
        chunks = F.ceil(F.greatest(F.col("members") / chunk, F.col("shingles") / CHUNK_SHINGLES)).cast("int")
        is_pivot = is_open & ((F.pmod(draw, "n_open") < F.least(F.lit(pivots) * F.pow(F.lit(2), F.col("tries")), F.lit(chunk))) | (F.col("rid") == F.col("first.rid")))
        rows = cells.join(send(large), "cell").select("cell", "rid", "size", "label", chunks.alias("chunks"), is_pivot.alias("pivot"))
        dealt = rows.withColumn("pivot", F.lit(False)).withColumn("chunk", F.pmod(F.xxhash64("rid"), "chunks").cast("int"))
        dealt = dealt.unionByName(rows.where("pivot").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
        met = stored(texts.join(dealt.drop("chunks"), "rid").groupBy("cell", "chunk").applyInArrow(_measure, "cell long, rid long, pivot long, size long, label long, kind int"))
        found += [met.where("kind = 0 AND rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")), met.where("kind = 2").select(F.col("rid").alias("a"), F.col("pivot").alias("b"))]
        roots = cut(met.where("kind = 2").select("cell", "rid", "pivot").distinct().groupBy("cell").applyInArrow(_roots, "cell long, pivot long, root long"))
        n_roots = roots.count()
        near = (lambda x: F.broadcast(x)) if n_roots <= broadcast_ids else (lambda x: x)
        # A region whose parts would overlap too much in a chunk stays whole, led by the label of the most members.
        linked = met.where("kind = 0").join(near(roots.select("cell", "pivot", "root")), ["cell", "pivot"], "left").groupBy("cell", F.coalesce("root", "pivot").alias("leader")).count()
        parts = met.where("kind = 1")
        whole = parts.groupBy("cell").agg(F.min("pivot").alias("least"), F.count("*").alias("n")).join(large.select("cell", "members"), "cell")
        whole = whole.join(linked.groupBy("cell").agg(F.max_by("leader", "count").alias("leader")), "cell", "left")
        old = cells.select("cell", "tries").distinct().join(send(whole), "cell").select("cell", "tries", ((F.col("least") == -2) | (F.col("n") > OVERLAP * F.col("members"))).alias("whole"), "leader")
        parts = parts.join(send(old), "cell")
        parts = parts.join(near(roots.select("cell", F.col("pivot").alias("label"), F.col("root").alias("own"))), ["cell", "label"], "left")
        parts = parts.join(near(roots.select("cell", "pivot", F.col("root").alias("leading"))), ["cell", "pivot"], "left")
        parts = parts.select(
            F.when(F.col("whole"), F.xxhash64("cell", F.lit(-2))).otherwise(F.xxhash64("cell", "pivot")).alias("cell"), "rid", "size", F.coalesce("own", "label").alias("label"),  # should two regions get one number, they are joined together
            F.when(F.col("whole"), F.col("leader")).when(F.col("pivot") >= 0, F.coalesce("leading", "pivot")).alias("lead"), F.when(F.col("whole") | (F.col("pivot") < 0), F.col("tries") + 1).otherwise(0).alias("tries"),
        )
        cells = stored(parts.distinct())
    rows = reduce(DataFrame.union, few)
    mixed = rows.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell")
    rows = rows.join(mixed, "cell", "left_semi") if found else rows  # such regions have few members
    last = stored(texts.join(rows, "rid").groupBy("cell").applyInArrow(_connect, "a long, b long"))
    return reduce(DataFrame.union, [last, *found])


def classes(docs: DataFrame, chunk: int = CHUNK, pivots: int = PIVOTS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row for each row of docs: rid, doc_id, n_shingles, component_id, label (one for each group).

    rid is monotonically_increasing_id() over docs, which must read the same
    again, as tables do; a set of another size than before is an error. A text
    without words, or null, has no shingles, is linked with nothing, and has its
    own doc_id. A very long text is joined whole. Repeated rows are one class. A
    null doc_id is never the smallest while another is there. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = stored(docs.mapInArrow(_signatures, "rid long, doc_id long, n long, s1 long, s2 long"))
    top = seen.where("rid IS NULL").groupBy("s1").agg(F.sum("n").alias("n")).where(f"n >= {4 * FREQUENT}").orderBy(F.desc("n"), "s1").limit(KEPT_FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.s1 for r in top.collect()], np.int64).view(np.uint64)))  # KEPT_FREQUENT at most
    rows = seen.where("rid IS NOT NULL")
    same = ["n", "s1", "s2"]
    sets = stored(rows.where("n > 0").groupBy(*same).agg(F.min("rid").alias("first"), F.min("doc_id").alias("smallest")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text"):
            hashes, bounds = shingles(batch.column("text"))
            h, owner = prefixes(hashes, bounds, frequent.value)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("rid").take(pa.array(owner))], names=["h", "rid"])

    # Of equal sets only the first has a part; every set's window is made, as its class isn't known where its text is.
    held = stored(docs.select("rid", "text").mapInArrow(windows, "h long, rid long").join(sets.select(F.col("first").alias("rid")), "rid", "left_semi"))
    holders = stored(held.groupBy("h").agg(F.min("rid").alias("holder"), F.count("*").alias("df")).where("df > 1"))
    shared = held.join(holders, "h").join(sets.select(F.col("first").alias("rid"), F.col("n").alias("size"), F.expr(f"n div {SPARE}").alias("spare"), F.expr(f"(4 * n div 5) div {SPARE}").alias("least")), "rid")
    own = Window.partitionBy("rid")
    shared = shared.withColumn("shared", F.count("*").over(own)).where("shared > least")
    shared = shared.withColumn("rank", F.row_number().over(own.orderBy(F.desc("df"), "h"))).where("rank > (2 * spare) div 5")
    members = stored(shared.select(F.col("holder").alias("cell"), "rid", "size").distinct())
    alone = members.groupBy("cell").agg(F.min("rid").alias("rid"), F.count("*").alias("n")).where("n = 1")
    members = stored(members.join(alone.select("cell", "rid"), ["cell", "rid"], "left_anti"))
    wanted = members.select("rid").distinct()
    texts = stored(docs.select("rid", "text").join(F.broadcast(wanted) if members.count() <= broadcast_ids else wanted, "rid", "left_semi"))
    labels = components(links(texts, members, chunk, pivots, broadcast_ids))

    labelled = sets.join(labels.withColumnRenamed("id", "first"), "first", "left").withColumn("label", F.coalesce("label", "first"))
    smallest = cut(labelled.groupBy("label").agg(F.min("smallest").alias("component_id")))
    found = cut(labelled.join(smallest, "label").select(*same, "label", "component_id"))
    return rows.join(found, same, "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("label", F.lit(-1) - F.col("rid")).alias("label")
    )


def lead(found: DataFrame) -> DataFrame:
    """rids of the rows that stay: one of each group, with the smallest doc_id."""
    return found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("x")).select(F.col("x.rid").alias("rid"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, of which one row of each group of near copies stays."""
    rid = fresh("rid", docs.columns)
    stay = lead(classes(docs)).select(F.col("rid").alias(rid))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(stay, rid, "left_semi").drop(rid)

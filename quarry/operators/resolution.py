"""Entity resolution by an exact metric join: which entities of a space and type have vectors of a similarity above a bound.

Equal directions are one class, which its smallest id stands for. On the unit sphere a cosine above c is a distance below r, the root
of 2 - 2c. A cell of many classes gets pivots; a class's home is the cell of its nearest pivot p, and it is also a guest of
the cell of any pivot q whose hyperplane with p is less than r away: d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q). So of two classes that
are near enough each is in the other's home. Cells are parted again while that helps; what it doesn't help is compared as pairs of
chunks. No task holds more than two chunks, and tasks return the best earlier partner of each class and the links that connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.operators.vectors import dot
from quarry.session import cut

#: Members that one task compares, those that pivots are chosen among, pivots of a cell at most, cells that a member may be in on average, rounds of parting.
CHUNK, SAMPLE, PIVOTS, OVERLAP, ROUNDS = 2048, 4096, 512, 4, 2
#: What products of rounded numbers may be off by.
SLACK = 1e-9


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["vector"].combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, added up component by component as the column expression does."""
    products = [np.zeros(len(i)) for _ in range(3)]
    for d in range(x.shape[1]):
        a, b = x[i, d], x[j, d]
        products[0] += a * b
        products[1] += a * a
        products[2] += b * b
    return products[0] / (np.sqrt(products[1]) * np.sqrt(products[2]))


def _first(x: np.ndarray, later: np.ndarray, earlier: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each later one the pair of the greatest cosine; those that are as good but for rounding are compared exactly."""
    order = np.lexsort((-value, later))
    later, earlier, value = later[order], earlier[order], value[order]
    start = np.searchsorted(later, later)
    close = value >= value[start] - 2 * SLACK
    later, earlier = later[close], earlier[close]
    value = _exact(x, later, earlier)
    order = np.lexsort((earlier, -value, later))
    later, earlier, value = later[order], earlier[order], value[order]
    first = np.r_[True, later[1:] != later[:-1]] if len(later) else np.zeros(0, bool)
    return later[first], earlier[first], value[first]


def _picker(radius: float):
    """Of a sample of a cell's members pivots that are far from each other: always the one farthest from all before it, while that is far."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        unit, chosen = _units(_matrix(table)), [0]
        far = 2 - 2 * unit @ unit[0]
        while len(chosen) < PIVOTS and far.max() > (radius / 2) ** 2:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 2 - 2 * unit @ unit[chosen[-1]])
        return pa.table({"cell": np.full(len(chosen), table["cell"][0].as_py()), "id": table["id"].to_numpy()[chosen]})

    return run


def _parter(radius: float):
    """Of members of a chunk and the pivots of their cell: the cells that each goes to."""

    def run(table: pa.Table) -> pa.Table:
        unit, ids = _units(_matrix(table)), table["id"].to_numpy()
        is_pivot, home = (table[c].to_numpy(zero_copy_only=False) for c in ("pivot", "home"))
        pivots, members = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
        pivots = pivots[np.argsort(ids[pivots])]
        square = np.maximum(2 - 2 * unit[members] @ unit[pivots].T, 0)
        apart = np.sqrt(np.maximum(2 - 2 * unit[pivots] @ unit[pivots].T, 0))
        nearest = square.argmin(axis=1)
        near = square - square[np.arange(len(members)), nearest][:, None] <= 2 * radius * apart[nearest] + SLACK
        m, p = np.nonzero(near)
        return pa.table({"cell": np.full(len(m), table["cell"][0].as_py()), "pivot": ids[pivots[p]], "id": ids[members[m]], "home": home[members[m]] & (nearest[m] == p)})

    return run


def _comparer(least: float):
    """Rows of a group: for each class that has an earlier partner the best one (kind 0), and links that connect (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, key, chunk, home = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "key", "chunk", "home"))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        x = _matrix(table)
        unit, group = _units(x), np.arange(len(ids))
        rows, columns = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        links: list[tuple[int, int, float]] = []
        for at in range(0, len(rows), 256):
            mine = rows[at : at + 256]
            near = unit[mine] @ unit[columns].T
            i, j = np.nonzero(near > least - SLACK)
            value, i, j = near[i, j], mine[i], columns[j]
            fits = (key[i] == key[j]) & (home[i] | home[j]) & ((i != j) if low != high else (i < j))
            i, j, value = i[fits], j[fits], value[fits]
            edge = np.abs(value - least) <= SLACK
            value[edge] = _exact(x, i[edge], j[edge])
            fits = value > least
            i, j, value = i[fits], j[fits], value[fits]
            later, earlier = np.maximum(i, j), np.minimum(i, j)
            best.append(_first(x, later, earlier, value))
            for p in np.unique(i[group[i] != group[j]]):
                place = np.flatnonzero((i == p) & (group[j] != group[p]))
                met, first = np.unique(group[j[place]], return_index=True)
                links += [(int(ids[p]), int(ids[j[place[f]]]), float(value[place[f]])) for f in first]
                group[np.isin(group, met)] = group[p]
        later, earlier, value = (np.concatenate(c) for c in zip(*best, strict=True)) if best else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        later, earlier, value = _first(x, later, earlier, value)
        kind = np.repeat(np.array([0, 1], np.int32), [len(later), len(links)])
        a, b, c = (np.array([r[n] for r in links]) for n in range(3)) if links else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"kind": kind, "a": np.concatenate([ids[later], a]).astype(np.int64), "b": np.concatenate([ids[earlier], b]).astype(np.int64), "similarity": np.concatenate([value, c]).astype(np.float64)})

    return run


def _classes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with vectors: id, first (the smallest id of the class); and the classes: id, key, cell, vector."""
    whole = F.coalesce(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double"))), F.lit(False))
    rows = entities.where(whole).select(F.col("entity_id").alias("id"), "space_id", "entity_type", F.transform("embedding", lambda e: e.cast("double")).alias("vector")).withColumn("norm", F.sqrt(dot("vector", "vector"))).where("norm > 0")
    direction = F.transform("vector", lambda e: F.round(e / F.col("norm"), 9) + 0.0)
    own = [F.col("space_id"), F.col("entity_type"), F.size("vector")]
    rows = cut(rows.select("id", "vector", F.xxhash64(*own).alias("cell"), F.xxhash64(*own, F.lit(1)).alias("key"), F.xxhash64(direction).alias("h1"), F.xxhash64(direction, F.lit(1)).alias("h2")))
    same = ["cell", "key", "h1", "h2"]
    first = cut(rows.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("n")))
    classes = rows.join(first.select(F.col("first").alias("id")), "id", "left_semi").select("id", "key", "cell", "vector")
    return rows.join(first.where("n > 1"), same).select("id", "first"), classes


def _parted(classes: DataFrame, cells: DataFrame, radius: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Cells as they are to be compared: done and still to be parted."""
    sizes = cut(cells.groupBy("cell").agg(F.count("*").alias("n")))
    few = cells.join(sizes.where(F.col("n") <= chunk), "cell", "left_semi")
    large = cells.join(sizes.where(F.col("n") > chunk), "cell").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    sample = large.where(F.pmod(F.xxhash64("id", "cell"), "n") < SAMPLE).join(classes.select("id", "vector"), "id").select("cell", "id", "vector")
    pivots = cut(sample.groupBy("cell").applyInArrow(_picker(radius), "cell long, id long"))
    dealt = large.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).withColumn("pivot", F.lit(False))
    sent = large.join(pivots, ["cell", "id"], "left_semi").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("pivot", F.lit(True))
    dealt = dealt.unionByName(sent)
    rows = dealt.join(classes.select("id", "vector"), "id").select("cell", "chunk", "id", "home", "pivot", "vector")
    parts = cut(rows.groupBy("cell", "chunk").applyInArrow(_parter(radius), "cell long, pivot long, id long, home boolean"))
    made = parts.groupBy("cell").agg(F.count("*").alias("made"))
    apart = cut(made.join(sizes, "cell").where(F.col("made") <= OVERLAP * F.col("n")).select("cell"))
    whole = large.join(apart, "cell", "left_anti").select("cell", "id", "home")
    return few.select("cell", "id", "home").union(whole), cut(parts.join(apart, "cell", "left_semi").select(F.xxhash64("cell", "pivot").alias("cell"), "id", "home"))


def partners(entities: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """kind 0: a and b, its most similar earlier entity above least (ties: the smaller id); kind 1: links that connect all that is linked above least.

    entities: entity_id, space_id, entity_type, embedding. Zero vectors and such with null components have no partner; vectors of different
    lengths aren't compared. Of classes, only the smallest ids stand here; equal directions link with that.
    """
    same, classes = _classes(entities)
    classes = cut(classes)
    radius = float(np.sqrt(2 - 2 * max(least, -1.0)))
    todo, done = classes.select("cell", "id", F.lit(True).alias("home")), None
    for _ in range(ROUNDS):
        ready, todo = _parted(classes, todo, radius, chunk)
        done = ready if done is None else done.union(ready)
        if todo.isEmpty():
            break
    cells = cut(done.union(todo))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("n")).where("n > 1").select("cell", "chunks")
    rows = cells.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("cell", F.least("chunk", "_o").alias("low"), F.greatest("chunk", "_o").alias("high"), "chunk", "id", "home").join(classes.select("id", "key", "vector"), "id")
    found = rows.groupBy("cell", "low", "high").applyInArrow(_comparer(least), "kind int, a long, b long, similarity double")
    one = F.lit(1.0)
    copies = same.where("id <> first")
    copies = copies.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("first").alias("b"), one).union(copies.select(F.lit(1), "id", "first", one)) if least < 1 else copies.limit(0).select(F.lit(0), "id", "first", one)
    return cut(found.union(copies))


def resolve(entities: DataFrame, least: float = 0.92, chunk: int = CHUNK) -> DataFrame:
    """Of each entity the most similar earlier one of its space and type above least, or itself: entity_id, space_id, canonical_id, similarity."""
    found = partners(entities, least, chunk).where("kind = 0")
    best = found.groupBy(F.col("a").alias("entity_id")).agg(F.max_by(F.struct("b", "similarity"), F.struct("similarity", -F.col("b"))).alias("x"))
    return entities.select("entity_id", "space_id").join(best, "entity_id", "left").select("entity_id", "space_id", F.coalesce("x.b", "entity_id").alias("canonical_id"), F.coalesce("x.similarity", F.lit(1.0)).alias("similarity"))


def components(links: DataFrame) -> DataFrame:
    """id, root: the smallest id that links (a, b) connect each end with."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.id == near.a).select("id", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        step = step.join(roots.select(F.col("id").alias("new"), F.col("root").alias("far")), "new", "left")
        step = cut(step.select("id", F.least("new", F.coalesce("far", "new")).alias("root"), "old"))
        roots = step.select("id", "root")
        if step.where("root <> old").isEmpty():
            return roots


def merged(entities: DataFrame, least: float = 0.92, chunk: int = CHUNK) -> DataFrame:
    """Entities that chains of similarity above least connect, with the earliest of them: entity_id, space_id, root_id."""
    roots = components(partners(entities, least, chunk).where("kind = 1").select("a", "b"))
    return entities.select("entity_id", "space_id").join(roots.withColumnRenamed("id", "entity_id"), "entity_id", "left").withColumn("root_id", F.coalesce("root", "entity_id")).drop("root")

"""The entity graph of spaces, built whole or kept up to date by signed changes.

What a model extracts from a text is kept by the text's hash, so only texts that no chunk had before are extracted. An update finds chunks that
came, went or have another text; the pairs of what went are subtracted from the edges' weights, those of what came are added.
Tables of a graph are written once each and aren't read as a whole but for joins by their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text as T
from quarry.operators.extraction import ENTITY_TEXT, MOST_ENTITIES
from quarry.session import stored

#: What stands between names in one text, and in none; texts at most by whose short hashes others are looked
#: through where they are; names whose pairs are counted at once.
BETWEEN, MOST_SENT, NAMES = "\u0001", 2_000_000, 250_000


class Graph:
    """memo: hash, names (name, type, importance). named: space_id, chunk_id, hash, names (name, entity_type, relevance, times), written when it is
    first asked for. Of it come chunks: space_id, chunk_id, hash; mentions: space_id, chunk_id, name, entity_type, relevance, times. Counted when
    they are read are entities: space_id, name, mention_count; edges: space_id, a, b, weight (a < b). An update of an updated graph writes its own first."""

    def __init__(self, named: Callable[[], DataFrame], memo: DataFrame, entities: Callable[[], DataFrame], edges: Callable[[], DataFrame], updated: bool = False):
        self.memo, self._made, self.updated = memo, (named, entities, edges), updated

    @cached_property
    def named(self) -> DataFrame:
        return self._made[0]()

    @property
    def chunks(self) -> DataFrame:
        return self.named.select("space_id", "chunk_id", "hash")

    @property
    def mentions(self) -> DataFrame:
        return _mentions(self.named)

    @cached_property
    def entities(self) -> DataFrame:
        return self._made[1]()

    @cached_property
    def edges(self) -> DataFrame:
        return self._made[2]()


def canonical(found: Column) -> Column:
    """An array of name, type, importance: of each normalised name and type the first of the greatest importance, in order of these, ten at most.

    found: what an extractor gave, an array of name, type, importance, null or not.
    """
    rows = F.transform(F.coalesce(found, F.array().cast("array<struct<name:string,type:string,importance:double>>")), lambda e: F.struct(T.normalize_name(e["name"]).alias("name"), e["type"].alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["importance"], F.lit(1.0)))).alias("importance")))
    rows = F.filter(rows, lambda e: F.coalesce(e["name"] != "", F.lit(False)) & (F.length(e["name"]) >= 2))
    best = lambda e, o: (o["name"] == e["name"]) & o["type"].eqNullSafe(e["type"]) & (o["importance"] > e["importance"])
    kept = T.let(rows, lambda x: F.filter(x, lambda e: ~F.exists(x, lambda o: best(e, o))))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, MOST_ENTITIES)


def _hashed(rows: DataFrame) -> DataFrame:
    """Chunks with a text that is long enough to be asked about."""
    return rows.where(F.length(T.strip("content")) >= ENTITY_TEXT[0]).select("space_id", "chunk_id", F.base64(F.unhex(F.sha2("content", 256))).alias("hash"), "content")


def _likely(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Rows with a hash of some, and few others: by short hashes of eight bytes, where rows are; all rows if some are too many to be sent."""
    if some.count() > MOST_SENT:
        return rows
    return rows.join(F.broadcast(some.select(F.xxhash64("hash").alias("_short"))), F.xxhash64("hash") == F.col("_short"), "left_semi")


def _extracted(rows: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    once = rows.groupBy("hash").agg(F.first("content").alias("content"))
    return stored(once.select("hash", canonical(extract(F.substring("content", 1, ENTITY_TEXT[1]))).alias("names")))


def _named(chunks: DataFrame, memo: DataFrame) -> DataFrame:
    """Chunks with their names; a name of several types has its first one. An importance of exactly 0 counts as 1."""

    def once(x: Column) -> Column:
        same = lambda e: F.filter(x, lambda o: o["name"] == e["name"])
        first = F.filter(x, lambda e, i: ~F.exists(F.slice(x, F.lit(1), i), lambda o: o["name"] == e["name"]))
        relevance = lambda e: F.coalesce(F.nullif(e["importance"], F.lit(0.0)), F.lit(1.0))
        return F.transform(first, lambda e: F.struct(e["name"].alias("name"), e["type"].alias("entity_type"), relevance(e).alias("relevance"), F.size(same(e)).cast("long").alias("times")))

    return stored(chunks.join(memo, "hash").select("space_id", "chunk_id", "hash", T.let(F.col("names"), once).alias("names")))


def _mentions(named: DataFrame) -> DataFrame:
    return named.select("space_id", "chunk_id", F.inline("names"))


def _pairs(named: DataFrame, sign: int) -> DataFrame:
    """Pairs of names of a chunk, 45 at most, as it mentions ten; counted in batches where its names are: space_id, a, b (all of a batch that come after a, in one text), weights."""
    space = named.schema["space_id"].dataType.simpleString()
    return named.select("space_id", F.col("names.name").alias("names")).where(F.size("names") > 1).mapInArrow(_paired(sign), f"space_id {space}, a string, b string, weights array<int>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold NAMES names."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(pc.list_flatten(batch.column("names")))
        if n >= NAMES:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _paired(sign: int):
    """What counts the pairs of each batch of chunks (space_id, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            space, found = batch.column("space_id").dictionary_encode("encode"), pc.list_flatten(batch.column("names")).cast(pa.string())
            row, names = pc.list_parent_indices(batch.column("names")).to_numpy().astype(np.int64), pc.unique(found)
            names = names.take(pc.sort_indices(names))
            name, n = pc.index_in(found, names).to_numpy().astype(np.int64), len(names)
            name = name[np.lexsort((name, row))]
            left = np.searchsorted(row, row, side="right") - np.arange(len(row)) - 1  # names of the chunk that come after each
            mine = np.repeat(np.arange(len(row)), left)
            other = mine + 1 + np.arange(len(mine)) - np.repeat(np.cumsum(left) - left, left)
            met, weight = np.unique((space.indices.to_numpy().astype(np.int64)[row[mine]] * n + name[mine]) * n + name[other], return_counts=True)
            own, b = np.divmod(met, max(n, 1))
            first = np.flatnonzero(np.diff(own, prepend=-1))
            others, weights = (pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), x) for x in (names.take(pa.array(b)), pa.array(weight * sign, pa.int32())))
            key = own[first]
            yield pa.RecordBatch.from_arrays([space.dictionary.take(pa.array(key // max(n, 1))), names.take(pa.array(key % max(n, 1))), pc.binary_join(others, BETWEEN), weights], names=["space_id", "a", "b", "weights"])

    return run


def _counted(named: DataFrame, sign: int) -> DataFrame:
    return _mentions(named).select("space_id", "name", (F.col("times") * sign).alias("mention_count"))


def _union(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def _summed(rows: DataFrame, key: list[str], n: str) -> DataFrame:
    """Sums of n, those above 0; counted when they are read."""
    return rows.groupBy(*key).agg(F.sum(n).alias(n)).where(F.col(n) > 0)


def _dealt(rows: DataFrame) -> DataFrame:
    """By space and first name, where edges are summed; as a batch counts its pairs, a name of all chunks has few rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "space_id", "a")


def _edges(held: DataFrame | None, *pairs: DataFrame) -> DataFrame:
    """Edges with pairs added. Edges that were dealt stay where they are."""
    new = _dealt(_union(*pairs)).select("space_id", "a", "weights", F.posexplode(F.split("b", BETWEEN)).alias("_i", "b")).select("space_id", "a", "b", F.get("weights", F.col("_i")).cast("long").alias("weight"))
    return _summed(new if held is None else held.unionByName(new), ["space_id", "a", "b"], "weight")


def _entities(*parts: DataFrame) -> DataFrame:
    return _summed(_union(*parts), ["space_id", "name"], "mention_count")


def build(rows: DataFrame, extract: Callable[[Column], Column]) -> Graph:
    """The graph of rows (space_id, chunk_id, content; one for each chunk and space). extract: from a text to an array of name, type, importance."""
    held = _hashed(rows)  # texts are made twice, as they are larger than all that comes of them
    memo = _extracted(held, extract)
    named = _named(held.drop("content"), memo)
    return Graph(lambda: named, memo, lambda: _entities(_counted(named, 1)), lambda: _edges(None, _pairs(named, 1)))


def update(graph: Graph, rows: DataFrame, extract: Callable[[Column], Column]) -> Graph:
    """The graph of rows, from that of earlier ones: equal to build(rows, extract), but only new texts are extracted and only what changed is counted.

    Texts are shuffled only where they are new; all else is found by keys.
    """
    key = ["space_id", "chunk_id", "hash"]
    held = _hashed(rows)
    keys = stored(held.select(*key))
    both = graph.named.withColumn("_was", F.lit(True)).join(keys.withColumn("_is", F.lit(True)), key, "full")
    changed = stored(both.where("_was IS NULL OR _is IS NULL"))
    new, lost = changed.where("_was IS NULL").select(*key), changed.where("_is IS NULL").drop("_was", "_is")
    hashes = stored(new.select("hash").distinct())
    fresh = stored(hashes.join(graph.memo.select("hash"), "hash", "left_anti"))
    memo = graph.memo.union(_extracted(_likely(held, fresh).join(fresh, "hash", "left_semi"), extract))
    added = _named(new, _likely(memo, hashes))
    named = lambda: stored(graph.named.join(keys, key, "left_semi").unionByName(added))
    entities = lambda: _entities(stored(graph.entities) if graph.updated else graph.entities, _counted(added, 1), _counted(lost, -1))
    edges = lambda: _edges(_dealt(stored(graph.edges)) if graph.updated else graph.edges, _pairs(added, 1), _pairs(lost, -1))
    return Graph(named, memo, entities, edges, updated=True)

"""Libraries, folders, conversations, permissions, processing status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.session import cut


def ancestors(folders: DataFrame) -> DataFrame:
    """folder_id, ancestor_id, distance of all folders (folder_id, parent_id), themselves included, at any depth.

    Goes up until nothing new comes, so that cycles end: a folder in one has each of its members once.
    """
    up = cut(folders.select(F.col("folder_id").alias("_at"), F.col("parent_id").alias("_up")).where("_up IS NOT NULL"))
    out = level = cut(folders.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).cast("long").alias("distance")))
    while True:
        level = level.join(up, level.ancestor_id == up["_at"]).select("folder_id", F.col("_up").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"))
        level = cut(level.join(out.select("folder_id", "ancestor_id"), ["folder_id", "ancestor_id"], "left_anti"))
        if level.isEmpty():
            return out
        out = out.union(level)


def paths(folders: DataFrame) -> DataFrame:
    """folder_id, path from the root, depth."""
    names = folders.select(F.col("folder_id").alias("ancestor_id"), "name")
    rows = ancestors(folders).join(names, "ancestor_id")
    order = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    return rows.groupBy("folder_id").agg(F.array_join(F.transform(order, lambda x: x["name"]), "/").alias("path"), F.max("distance").alias("depth"))


def folder_totals(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """folder_id with the documents (folder_id, size) of itself and all below, and their size."""
    own = documents.groupBy("folder_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    rows = ancestors(folders).join(own, "folder_id", "left").groupBy(F.col("ancestor_id").alias("folder_id"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), (F.count("*") - 1).alias("n_below"))


def move_allowed(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (folder_id, target_id) with allowed: not into the folder itself or below it."""
    below = ancestors(folders).select(F.col("folder_id").alias("target_id"), F.col("ancestor_id").alias("folder_id"), F.lit(True).alias("_below"))
    return moves.join(below, ["folder_id", "target_id"], "left").select("folder_id", "target_id", F.col("_below").isNull().alias("allowed"))


def after_delete(folders: DataFrame, documents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders and documents (folder_id) that stay when folders (gone: folder_id) and all below them go."""
    below = ancestors(folders).join(gone.select(F.col("folder_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("folder_id").distinct()
    return folders.join(below, "folder_id", "left_anti"), documents.join(below, "folder_id", "left_anti")


def levels(folders: DataFrame) -> DataFrame:
    """folder_id, level (steps to the root), is_leaf (nothing's parent); chunks with parents are such trees, too."""
    deep = ancestors(folders).groupBy("folder_id").agg(F.max("distance").alias("level"))
    parents = folders.select(F.col("parent_id").alias("folder_id")).distinct().withColumn("_parent", F.lit(True))
    return deep.join(parents, "folder_id", "left").select("folder_id", "level", F.col("_parent").isNull().alias("is_leaf"))


def linked(held: DataFrame, link: DataFrame, unlink: DataFrame) -> DataFrame:
    """Links (document_id, space_id) after some are set and others taken away; doing so again changes nothing."""
    key = ["document_id", "space_id"]
    return held.select(*key).union(link.select(*key)).distinct().join(unlink.select(*key).distinct(), key, "left_anti")


def replaced(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """held with all rows of new's keys replaced by new's."""
    return held.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def orphans(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """Rows whose key is null or that held (of one column) lacks."""
    return rows.join(held.toDF(key).distinct(), key, "left_anti")


def conversations(messages: DataFrame) -> DataFrame:
    """conversation_id, number of messages, title: the first question's first 50 letters."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    rows = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), first.alias("q"), F.max("turn").alias("last_turn"))
    title = F.when(F.length("q") > 50, F.concat(F.substring("q", 1, 50), F.lit("..."))).otherwise(F.coalesce("q", F.lit("Nouvelle conversation")))
    return rows.select("conversation_id", "n_messages", "last_turn", title.alias("title"))


def title_context(messages: DataFrame, most: int = 10, each: int = 300, budget: int = 2000) -> DataFrame:
    """The start of each conversation as lines of role and text, up to the message that passes the budget."""
    by = Window.partitionBy("conversation_id").orderBy("turn")
    line = F.concat(F.when(F.col("role") == "user", "Utilisateur").otherwise("Assistant"), F.lit(": "), F.substring("content", 1, each), F.lit("\n"))
    rows = messages.withColumns({"line": line, "n": F.row_number().over(by)}).where(F.col("n") <= most)
    before = F.coalesce(F.sum(F.length("line")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "")
    return rows.groupBy("conversation_id").agg(text.alias("context"), F.count("*").alias("n_used"))


def permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    return user_roles.join(role_permissions, "role").select("user_id", "permission").distinct()


def visible(spaces: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, space_id: shared spaces, and a user's own. Shared ones are listed once, with a null user."""
    own = spaces.where("NOT is_shared").join(users, spaces.owner_id == users.user_id, "left_semi").select(F.col("owner_id").alias("user_id"), "space_id")
    return own.union(spaces.where("is_shared").select(F.lit(None).cast("long").alias("user_id"), "space_id"))


def library_stats(documents: DataFrame) -> DataFrame:
    """By folder: documents, letters, megabytes (two digits)."""
    return documents.groupBy("folder").agg(F.count("*").alias("n_documents"), F.sum(F.length("content")).alias("n_chars"), F.round(F.sum(F.octet_length("content")) / 1048576.0, 2).alias("megabytes"))


def embedding_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """By document: chunks, those with vectors, status."""
    rows = chunks.join(vectors, chunks.vector_id == vectors.vec_id, "left")
    rows = rows.groupBy("document_id").agg(F.count("*").alias("total"), F.count("vec_id").alias("embedded"))
    status = F.when(F.col("embedded") == F.col("total"), "completed").when(F.col("embedded") > 0, "processing").otherwise("pending")
    return rows.withColumn("status", status)


#: Progress of the stages of processing.
STAGES = {"signup": ("pending", 0), "view": ("processing", 15), "click": ("processing", 55), "purchase": ("completed", 100), "error": ("failed", 0)}


def stage_of(event: Column | str) -> tuple[Column, Column]:
    """Status and progress that an event of the stream stands for."""
    e = T.col(event)
    status, progress = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (s, p) in STAGES.items():
        status, progress = F.when(e == k, s).otherwise(status), F.when(e == k, p).otherwise(progress)
    return status, progress


def status_fold(events: DataFrame) -> DataFrame:
    """The state of each document (user_id in events): the last status, and progress, which never falls."""
    status, progress = stage_of("event_type")
    rows = events.select(F.col("user_id").alias("document_id"), "ts", "event_id", status.alias("status"), progress.alias("progress"))
    return rows.groupBy("document_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("progress").cast("long").alias("progress"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def better_text(first: Column | str, second: Column | str) -> Column:
    """The second text only if it is more than half as long again as the first."""
    a, b = F.coalesce(T.col(first), F.lit("")), F.coalesce(T.col(second), F.lit(""))
    return F.when(F.length(b) > 1.5 * F.length(a), b).otherwise(a)


def progress_of(status: Column | str, progress: Column | str) -> Column:
    """Progress for rows that have none yet, by their status."""
    s, p = T.col(status), T.col(progress)
    return F.when(s == "completed", 100).when(s == "pending", 0).when(s == "processing", F.coalesce(p, F.lit(10))).otherwise(F.coalesce(p, F.lit(0)))


def role_changes(target: DataFrame, held: DataFrame) -> DataFrame:
    """What makes held (role, permission) equal to target: role, permission, change (add or delete)."""
    key = ["role", "permission"]
    return target.join(held, key, "left_anti").select(*key, F.lit("add").alias("change")).union(held.join(target, key, "left_anti").select(*key, F.lit("delete").alias("change")))


def absent(new: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new that held lacks, once for each key."""
    return new.dropDuplicates(key).join(held.select(*key).distinct(), key, "left_anti")

"""License scans by diagonal voting, in DataFrame operations only.

Each run of three words of a document is joined, by its hash, to the places
where templates hold the same run. A joint place votes for a diagonal: the
document's position minus the template's. Votes are summed by document, template
and diagonal, neighbouring diagonals (small insertions or omissions) are merged,
and what gets enough of a template's votes is a span of it. Hashes only propose:
the words of each joint place are compared. Templates are a table of any size;
it is sent to all tasks only while it has few rows.

For the phrases of the contract every vote of one diagonal is needed, so a
span is just a place where the phrase's words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.llm.dedup import normalised

#: The phrases and labels of the contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Well-known statements of common licenses, shortened to their distinctive words.
STATEMENTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words within a document, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run, as many as the shortest phrase has.
K = 3
#: Rows of templates that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The hash of the place that every document has.
NONE = -1
#: Diagonals of one statement that lie so near are merged.
NEAR = 3
#: The share of a statement's votes that a span needs; a changed word costs k of them.
LEAST = 0.7


def grams(words: Column | str, k: int) -> Column:
    """pos and gram (the words, joined) of each run of k words; the run's hash is that of the gram."""
    words = F.col(words) if isinstance(words, str) else words
    last = F.size(words) - k
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, k), " ").alias("gram")))
    return F.when(last >= 0, runs).otherwise(F.slice(runs, 1, 0))


def statements(spark: SparkSession) -> DataFrame:
    """The contract's phrases and well-known statements: text, label, base."""
    rows = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in STATEMENTS.items()]
    return spark.createDataFrame(rows, "text string, label string, base boolean")


def templates(table: DataFrame, k: int = K) -> DataFrame:
    """A row for each run of k words of a table (text, label, base): template, label, base, votes (of the whole template), at, gram.

    Texts are cut into words as documents are. Repeated rows are one template;
    texts of fewer than k words, or null, have no runs and are never found.
    """
    words = F.regexp_extract_all(normalised(F.col("text")), F.lit(WORD), F.lit(0))
    rows = table.select(words.alias("words"), "label", "base").where(F.size("words") >= k).distinct()
    name = F.concat_ws(" ", F.when(F.col("base"), "phrase:").otherwise("statement:"), F.array_join("words", " "), F.lit("="), "label")
    rows = rows.select(name.alias("template"), "label", "base", (F.size("words") - k + 1).alias("votes"), F.explode(grams("words", k)).alias("x"))
    return rows.select("template", "label", "base", "votes", F.col("x.pos").alias("at"), "x.gram")


def votes(docs: DataFrame, places: DataFrame, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joint places of documents and templates, and one row without template for each document."""
    words = F.regexp_extract_all(normalised(F.col("text")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words.alias("words"))
    rows = rows.select("rid", "doc_id", "words", F.size("words").cast("long").alias("n_words"))  # the runs' rows don't carry the words
    none = F.struct(F.size("words").alias("pos"), F.lit(None).cast("string").alias("gram"))  # keeps documents without votes
    rows = rows.select("rid", "doc_id", "n_words", F.explode(F.concat(grams("words", k), F.array(none))).alias("x"))
    rows = rows.select("rid", "doc_id", "n_words", F.col("x.pos").cast("long").alias("pos"), F.col("x.gram").alias("gram"), F.when(F.col("x.gram").isNull(), F.lit(NONE)).otherwise(F.xxhash64("x.gram")).alias("h"))
    held = places.select(F.xxhash64("gram").alias("h"), F.col("gram").alias("held"), "template", "label", "base", "votes", "at")
    empty = docs.sparkSession.range(1).select(F.lit(NONE).cast("long").alias("h"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema.fields[1:]))
    if places.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joint = rows.join(F.broadcast(held.union(empty)), "h").where(F.col("gram").eqNullSafe(F.col("held")))
    else:  # rows without votes needn't be shuffled by their one key
        joint = rows.where("gram IS NOT NULL").join(held, "h").where("gram = held").unionByName(rows.where("gram IS NULL").join(F.broadcast(empty), "h"))
    return joint.select("rid", "doc_id", "n_words", "template", "label", "base", "votes", "at", "pos")


def scan(docs: DataFrame, table: DataFrame | None = None, near: int = NEAR, least: float = LEAST, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, first word, word after the last, share of votes. score: the
    greatest share that a template got, 1 where a phrase stands, 0 where
    nothing voted. A null text has no words. A document without places has
    nulls for first_word and last_word and empty labels. Texts of any length are
    read whole, with a row for each of their words. Repeated rows each get their
    row; an empty table gives none. table: text, label, base; the contract's
    phrases and well-known statements, unless given. Without templates nothing votes.
    """
    places = templates(statements(docs.sparkSession) if table is None else table, k)
    joint = votes(docs, places, k, broadcast_rows).repartition("rid")
    key = ["rid", "doc_id", "n_words", "template"]
    diagonals = joint.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("got"), F.min("pos").alias("low"), (F.max("pos") + k).alias("high"), F.first("votes").alias("votes"), F.first("base").alias("base"), F.first("label").alias("label"),
    )
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    new = F.when(F.col("base") | step.isNull() | (step > near), 1).otherwise(0)
    merged = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(order)).groupBy(*key, "span").agg(
        F.sum("got").alias("got"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("votes").alias("votes"), F.first("base").alias("base"), F.first("label").alias("label"), F.min("diagonal").alias("diagonal"),
    )
    share = F.least(F.col("got") / F.col("votes"), F.lit(1.0))
    merged = merged.withColumn("share", F.when(F.col("template").isNotNull(), share))
    place = F.col("template").isNotNull() & F.col("base") & (F.col("got") == F.col("votes"))
    found = place | (F.col("template").isNotNull() & ~F.col("base") & (F.col("share") >= least))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return merged.groupBy("rid", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("diagonal"))).alias("first_word"), F.max(F.when(place, F.col("diagonal"))).alias("last_word"),
        labels(place).alias("base_labels"), labels(found).alias("labels"), F.coalesce(F.max(F.when(~F.col("base") | place, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct(F.col("low").alias("first_word"), F.col("high").alias("end_word"), "label", "share")))).alias("spans"),
    ).drop("rid")

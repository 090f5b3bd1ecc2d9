import random
import re

from pyspark.sql import functions as F

from quarry.llm import licenses
from tests.llm.common import awkward, documents


def brute_force(text):
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in licenses.PHRASES.items() for n in [len(p.split())] for i in range(len(words) - n + 1) if words[i : i + n] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    words = ["MIT", "license", "License,", "apache", "version", "2", "2.0", "cc", "BY", "nc", "ñ", "the", "of", "été."]
    texts = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randrange(60)))) for i in range(150)]
    texts += [(200, "Released under the MIT License."), (201, "Licensed under CC BY-NC 4.0."), (202, "Apache License, Version 2.0"), (203, "mit license " * 50), (203, "mit license " * 50)]
    out = licenses.scan(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == sorted((i, *brute_force(t)) for i, t in texts)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert not r.n_base or r.score == 1.0


def test_phrases_of_the_contract(spark):
    """The phrases are written out here, so that a shortened one is noticed."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = [(1, "It is released Under the MIT License, see below"), (2, "mit license"), (3, "under mit license the mit license"), (4, "x under the under the mit license under the MIT-License."), (5, "the apache license, version 2"), (6, "a CC BY-NC work under the mit license")]
    out = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, t in texts:
        words = re.findall("[a-z0-9]+", t.lower())
        places = [(at, label) for p, label in phrases.items() for n in [len(p.split())] for at in range(len(words) - n + 1) if words[at : at + n] == p.split()]
        at = [x for x, _ in places]
        r = out[i]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert (r.score == 1.0) == bool(at)


def test_statements(spark):
    cut = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided the following conditions are met"
    out = {r.doc_id: r for r in licenses.scan(documents(spark, [(1, "x y " + cut + " z"), (2, "a work licensed under the GNU General Public License, version 3."), (3, "forms of the binary are met")])).collect()}
    assert out[1].labels == "bsd" and out[1].spans[0].first_word == 2 and out[1].base_labels == "" and out[1].first_word is None
    assert "gpl-3" in out[2].labels and out[3].labels == "" and out[3].score < 0.2


def test_table_of_templates(spark):
    """Templates of one's own, joined by a shuffle; short and repeated ones; none at all."""
    table = spark.createDataFrame([("All rights  RESERVED by the maker", "own", False), ("all rights reserved by the maker", "own", False), ("two words", "short", True), (None, "null", True), ("a b c", "abc", True)], "text string, label string, base boolean")
    docs = documents(spark, [(1, "x. All rights reserved, by the Maker!"), (2, "a b c a b c"), (3, "two words"), (4, None)])
    for limit in (0, 100):
        out = {r.doc_id: r for r in licenses.scan(docs, table, broadcast_rows=limit).collect()}
        assert [out[i].labels for i in (1, 2, 3, 4)] == ["own", "abc", "", ""] and (out[2].n_base, out[2].first_word, out[2].last_word) == (2, 0, 3)
        assert [tuple(x)[:3] for x in out[1].spans] == [(1, 7, "own")]
    assert [r.score for r in licenses.scan(docs, table.limit(0)).collect()] == [0.0] * 4


def test_time_in_proportion_to_a_text(spark):
    """A text of many words doesn't carry them into each row."""
    import time

    docs = documents(spark, [(1, "some words of no licence " * 60_000 + "under the mit license")])
    began = time.time()
    r = licenses.scan(docs).first()
    assert (r.n_words, r.n_base, r.first_word) == (300_004, 1, 300_000) and time.time() - began < 60


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("rid", F.lit(3)).withColumn("label", F.lit("x"))
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(docs.limit(0)).count() == 0

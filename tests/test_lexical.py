"""Full text by the rarest term, derived and stored, against brute force."""

import random
import re
import uuid
from collections import Counter

import pytest

from quarry.functions.text import STOPWORDS
from quarry.operators import lexical


def plain(questions, chunks, k):
    """All covers by hand."""
    out = set()
    for q, text in questions:
        terms = list(dict.fromkeys([w for w in re.findall("[A-Za-zÀ-ÿ0-9]+", (text or "").lower()) if len(w) >= 3 and w not in STOPWORDS][:8]))
        scores = []
        for c, body in chunks:
            words = [w.lower() for w in re.findall("[A-Za-zÀ-ÿ0-9]+", body or "")]
            if not terms or not all(t in words for t in terms):
                continue
            seen, score = {-1}, 0.0
            for end, word in enumerate(words):
                if word in terms and all(t in words[: end + 1] for t in terms):
                    start = min(max(i for i in range(end + 1) if words[i] == t) for t in terms)
                    score += 0.0 if start in seen else 1 / (end - start + 1)
                    seen.add(start)
            scores.append((-round(score, 9), c))
        out |= {(q, c, round(-s, 6), i + 1) for i, (s, c) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "common", "common", "common", "Épsilon"]
    chunks = [(i, " ".join(pick.choices(words, k=pick.randint(0, 25)))) for i in range(300)] + [(300, None), (301, ""), (302, "common " * 3000 + "beta")]
    questions = [(i, " ".join(pick.choices(words, k=pick.randint(1, 4)))) for i in range(30)] + [(30, None), (31, ""), (32, "the and"), (33, "alpha nowhere")]
    return questions, chunks


def rows(frame):
    return {(r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_derived_and_stored(spark, texts, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", broadcast)
    questions, chunks = texts
    q, c = spark.createDataFrame(questions, "query_id int, content string"), spark.createDataFrame(chunks, "chunk_id long, content string")
    want = plain(questions, chunks, 10)
    assert want and rows(lexical.top_k(q, c, 10)) == want
    name = f"postings_{uuid.uuid4().hex}"
    lexical.store(c.where("chunk_id < 200"), name, f"file://{tmp_path}/{name}", buckets=4)
    stored = lexical.store(c.where("chunk_id >= 200"), name, f"file://{tmp_path}/{name}", buckets=4, mode="append")
    assert rows(lexical.top_k_stored(q, stored, 10)) == want


def test_within_spaces(spark, texts):
    questions, chunks = texts
    q = spark.createDataFrame([(i, t, i % 3) for i, t in questions], "query_id int, content string, space int")
    c = spark.createDataFrame([(i, t, i % 3) for i, t in chunks], "chunk_id long, content string, space int")
    want = {r for s in range(3) for r in plain([x for x in questions if x[0] % 3 == s], [x for x in chunks if x[0] % 3 == s], 5)}
    assert rows(lexical.top_k(q, c, 5, "space")) == want


def test_empty_tables(spark):
    q, c = spark.createDataFrame([], "query_id int, content string"), spark.createDataFrame([], "chunk_id long, content string")
    assert lexical.top_k(q, c, 5).count() == 0 and lexical.top_k(spark.createDataFrame([(1, "alpha")], "query_id int, content string"), c, 5).count() == 0


def test_only_best_chunks_leave_their_task(spark):
    """400 chunks with a word of 60 questions: what meets isn't shuffled."""
    q = spark.createDataFrame([(i, f"common rare{i % 3}") for i in range(60)], "query_id int, content string")
    c = spark.createDataFrame([(i, f"common words rare{i % 7}") for i in range(400)], "chunk_id long, content string").coalesce(2)
    for held in (lexical.top_k(q, c, 2), lexical.keyword_fallback(q, c, 2)):
        tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "top")
        assert held.count() == 120
        stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
        store = spark.sparkContext._jsc.sc().statusStore()
        assert sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages if tracker.getStageInfo(i)) < 400


@pytest.mark.parametrize("meetings", [1_000_000, 1, 40])
def test_any_word(spark, texts, monkeypatch, meetings):
    monkeypatch.setattr(lexical, "MEETINGS", meetings)
    questions, chunks = texts
    q = spark.createDataFrame([(i, t, i % 3) for i, t in questions], "query_id int, content string, space int")
    c = spark.createDataFrame([(i, t, i % 3) for i, t in chunks], "chunk_id long, content string, space int")
    for by in (None, "space"):
        want = set()
        for i, text in questions:
            terms = {w for w in re.findall("[A-Za-zÀ-ÿ0-9]+", (text or "").lower()) if len(w) >= 3 and w not in STOPWORDS}
            held = [(len(terms & {w.lower() for w in re.findall("[A-Za-zÀ-ÿ0-9]+", body or "")}), j) for j, body in chunks if by is None or i % 3 == j % 3]
            want |= {(i, j, round(n / len(terms), 6), r) for r, (n, j) in enumerate(sorted((x for x in held if x[0]), reverse=True)[:7], 1)}
        assert rows(lexical.keyword_fallback(q, c, 7, by)) == want


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_and_indexed_where_chunks_are(spark, texts):
    _, chunks = texts
    c = spark.createDataFrame([*chunks, (None, "alpha alpha")], "chunk_id long, content string")
    n, held = Counter(), Counter()
    for i, body in [*chunks, (None, "alpha alpha")]:
        words = [w.lower() for w in re.findall("[A-Za-zÀ-ÿ0-9]+", body or "")]
        n.update(words)
        held.update(set(words) if i is not None else ())
    found = lexical.statistics(c)
    assert {(r.term, r.n_chunks, r.n) for r in found.collect()} == {(w, held[w], n[w]) for w in n}
    assert _plan(lexical.statistics(c)).count("Exchange hashpartitioning") == 1 and "Exchange" not in _plan(lexical.index(c))


@pytest.mark.parametrize("size", ["3", "10000"])
def test_stored_look_up_by_batches(spark, texts, tmp_path, size):
    """Chunks whose postings lie in several batches; what meets isn't shuffled."""
    questions, chunks = texts
    q, c = spark.createDataFrame(questions, "query_id int, content string"), spark.createDataFrame(chunks, "chunk_id long, content string")
    name = f"postings_{uuid.uuid4().hex}"
    stored = lexical.store(c, name, f"file://{tmp_path}/{name}", buckets=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert rows(lexical.top_k_stored(q, stored, 10)) == plain(questions, chunks, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_meetings_of_a_stored_index_are_not_shuffled(spark, tmp_path):
    q = spark.createDataFrame([(i, f"common rare{i % 3} word{i}") for i in range(60)], "query_id int, content string")
    c = spark.createDataFrame([(i, "common rare0 rare1 rare2 " + " ".join(f"word{j}" for j in range(60))) for i in range(50)], "chunk_id long, content string").coalesce(2)
    name = f"postings_{uuid.uuid4().hex}"
    stored = lexical.store(c, name, f"file://{tmp_path}/{name}", buckets=4)
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "stored")
    assert lexical.top_k_stored(q, stored, 2).count() == 120
    stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
    store = spark.sparkContext._jsc.sc().statusStore()
    assert sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages if tracker.getStageInfo(i)) < 5000  # 50 chunks of 64 asked words; 9,000 places meet

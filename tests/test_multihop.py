"""Searches over names and hops against a plain loop for each question."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import graph, multihop as M


def plain_closure(terms, known, most):
    more = {t for e, t in known if e in {e2 for e2, t2 in known if t2 in terms}}
    return (list(terms) + sorted(more - set(terms)))[:most]


def ordered(mentions, names):
    return sorted(((c, n, r) for c, n, r in mentions if n in names), key=lambda x: (-round(x[2], 9), x[0], x[1]))


def plain_beside(mentions, seeds):
    of = {}
    for c, n, _ in mentions:
        of.setdefault(c, set()).add(n)
    weight = Counter()
    for held in of.values():
        weight.update((s, n) for s in held & seeds for n in held - {s})
    best = {}
    for (_, n), w in weight.items():
        if n not in seeds:
            best[n] = max(best.get(n, 0), w)
    return set(sorted(best, key=lambda n: (-best[n], n))[:40])


def unseen(rows, seen):
    out = []
    for c, n, r in rows:
        if c not in seen:
            seen.add(c)
            out.append((c, n, r))
    return out


def plain_search(terms, mentions, known, k):
    terms = plain_closure(terms, known, 120)
    exact = ordered(mentions, terms)[:k]
    rows = [(*x, 0) for x in exact]
    seen = {c for c, _, _ in exact}
    if len(exact) < k // 2:
        holding = {n for _, n, _ in mentions if any(len(t) >= 3 and t in n for t in terms[:5])}
        rows += [(*x, 1) for x in unseen(ordered(mentions, holding)[: k - len(exact)], seen)]
    if len(rows) < k:
        near = plain_beside(mentions, {n for _, n, _, _ in rows})
        rows += [(c, n, r, 2) for c, n, r in unseen(ordered(mentions, near)[: k - len(rows)], seen)]
    out = {}
    for c, n, r, stage in rows:
        score = r * 0.88 if stage == 2 else r
        out[c] = (out[c][0], max(out[c][1], score), out[c][2]) if c in out else (n, score, stage)
    return out


def plain_hops(first, pivots, mentions, known, expanding):
    rows = {c: {"s": s, "kag": s["kag"] or 0.0, "evidence": 0.0, "hop": 0, "name": s["name"], "score": s["score"]} for c, s in first.items()}
    names = set() if expanding else {r["name"] for r in rows.values() if r["name"]}
    for hop in (1, 2, 3):
        if len(rows) >= 80:
            break
        top = sorted(rows, key=lambda c: (-round(rows[c]["score"], 9), c))[:20]
        count = Counter(rows[c]["name"] for c in top if rows[c]["name"])
        seeds = [n for n, _ in count.most_common(12) if n not in names]
        if not seeds:
            break
        names |= set(seeds)
        exact = ordered(mentions, plain_closure(seeds, known, 80))[:40]
        near = ordered(mentions, plain_beside(mentions, {n for _, n, _ in exact}))[:20]
        held = {c for c, _, _ in exact}
        new = unseen(exact + [x for x in near if x[0] not in held], set(rows))[:20]
        for c, n, r in new:
            rows[c] = {"s": {}, "kag": r, "evidence": float(sum(p in n for p in pivots)), "hop": hop, "name": n, "score": r}
        if not new:
            break
    signal = {c: (r["s"].get("vector") or 0.0, r["s"].get("lexical") or 0.0, r["kag"], r["evidence"]) for c, r in rows.items()}
    low, high = [min(x) for x in zip(*signal.values(), strict=True)], [max(x) for x in zip(*signal.values(), strict=True)]
    norm = lambda v, i: 1.0 if high[i] - low[i] < 1e-9 else (v - low[i]) / (high[i] - low[i])
    return {c: (r["hop"], r["name"], max(0.0, sum(w * norm(v, i) for i, (w, v) in enumerate(zip((0.55, 0.20, 0.20, 0.05), signal[c], strict=True))) - 0.05 * r["hop"])) for c, r in rows.items()}


def graph_of(seed, chunks=90, names=70, mentions_each=3):
    rng = random.Random(seed)
    words = [f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{i:02d}" for i in range(names)]
    return [(c, n, rng.randrange(1, 9) / 8) for c in range(chunks) for n in rng.sample(words, rng.randrange(1, mentions_each + 1))], words


def tables(spark, spaces):
    held = spark.createDataFrame([(s, c, n, r) for s, (mentions, _) in spaces.items() for c, n, r in mentions], "space_id long, chunk_id long, name string, relevance double")
    known = {s: sorted({(w, w) for w in words} | {(words[3], "al"), (words[3], "other"), (words[5], "second")}) for s, (_, words) in spaces.items()}
    return held, known, spark.createDataFrame([(s, e, t) for s, rows in known.items() for e, t in rows], "space_id long, entity string, term string")


def test_search(spark):
    spaces = {0: graph_of(1), 1: graph_of(2, 20, 12), 2: graph_of(3, 200, 15)}
    held, known, table = tables(spark, spaces)
    rng, asked = random.Random(4), {}
    for q in range(24):
        words = spaces[q % 3][1]
        asked[q] = [rng.choice(words), "other"] if q % 4 == 0 else ["gam", "zz"] if q % 4 == 1 else ["second"] if q % 4 == 2 else ["nothing", "al"]
    terms = spark.createDataFrame([(q, q % 3, n, i) for q, ns in asked.items() for i, n in enumerate(ns)], "query_id long, space_id long, name string, pos long")
    found = {}
    for r in M.search(terms, held, table, 15).collect():
        found.setdefault(r.query_id, {})[r.chunk_id] = (r.name, round(r.score, 9), r.stage)
    want = {q: {c: (n, round(x, 9), stage) for c, (n, x, stage) in plain_search(ns, spaces[q % 3][0], known[q % 3], 15).items()} for q, ns in asked.items()}
    assert found == {q: rows for q, rows in want.items() if rows}
    assert {stage for rows in want.values() for _, _, stage in rows.values()} == {0, 1, 2}


def test_hops(spark):
    spaces = {0: graph_of(5, 300, 120, 2), 1: graph_of(6, 12, 30, 1), 2: graph_of(7, 400, 20)}
    held, known, table = tables(spark, spaces)
    rng, first = random.Random(8), {}
    for q in range(15):
        mentions = spaces[q % 3][0]
        n = 79 if q == 2 else 80 if q == 5 else rng.randrange(1, 12)
        chunks = rng.sample(range(len({c for c, _, _ in mentions})), min(n, len({c for c, _, _ in mentions})))
        named = {c: n for c, n, _ in mentions}
        first[q] = {c: {"vector": rng.choice([None, 0.5, 0.7]), "lexical": rng.choice([None, 0.1]), "kag": rng.choice([None, 0.25]), "name": named[c] if rng.random() < 0.3 and q != 4 else None, "score": rng.randrange(9) / 9} for c in chunks}
    rows = spark.createDataFrame([(q, q % 3, c, s["vector"], s["lexical"], s["kag"], s["name"], s["score"]) for q, cs in first.items() for c, s in cs.items()], "query_id long, space_id long, chunk_id long, vector double, lexical double, kag double, name string, score double")
    pivots = spark.createDataFrame([(q, p) for q in range(15) for p in ("alpha", "1")], "query_id long, name string")
    for expanding in (True, False):
        found = {}
        for r in M.hops(rows, pivots, held, table, expanding).collect():
            found.setdefault(r.query_id, {})[r.chunk_id] = (r.hop, r.name, round(r.mh_score, 9))
        want = {q: {c: (h, n, round(x, 9)) for c, (h, n, x) in plain_hops(cs, ["alpha", "1"], spaces[q % 3][0], known[q % 3], expanding).items()} for q, cs in first.items()}
        assert found == want
        reached = {h for cs in want.values() for h, _, _ in cs.values()}
        assert reached == ({0, 1, 2, 3} if expanding else {0})
    assert len(want[5]) == 80 and not any(h for h, _, _ in want[4].values())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_meet_the_best_mentions_of_a_name(spark):
    """A name in very many chunks: what a question meets is bounded, and its first rows are the same."""
    rows = [(0, c, n, 1.0 / (1 + c % 7 + len(n))) for c in range(300) for n in ("common", f"n{c % 5}")]
    held = spark.createDataFrame(rows, "space_id long, chunk_id long, name string, relevance double")
    known = held.selectExpr("space_id", "name AS entity", "name AS term").distinct()
    terms = spark.createDataFrame([(q, 0, "common", 1) for q in range(5)], "query_id long, space_id long, name string, pos long")
    met, real = [], M._held
    M._held = lambda names, mentions: met.append(mentions.where("name = 'common'").count()) or real(names, mentions)
    try:
        found = M.search(terms, held, known, 4).collect()
    finally:
        M._held = real
    best = [c for _, c, n, r in sorted(rows, key=lambda x: (-round(x[3], 9), x[1])) if n == "common"][:4]
    assert met and max(met) == 4 and all(sorted(r.chunk_id for r in found if r.query_id == q) == best for q in range(5))


def test_neighbours_are_bounded_without_loss(spark):
    rows = [(0, c, n, 1.0) for c in range(60) for n in {"s", f"a{c % 9}", f"b{c % 4}", "t" if c % 2 else "u"}]
    held = spark.createDataFrame(rows, "space_id long, chunk_id long, name string, relevance double")
    seeds = spark.createDataFrame([(q, 0, n) for q, x in ((1, "s"), (2, "stu"), (3, "t")) for n in x], "query_id long, space_id long, name string")
    first = lambda x: {q: sorted((-r.weight, r.name) for r in x if r.query_id == q)[:4] for q in (1, 2, 3)}
    whole, few = graph.mentioned_with(held, seeds).collect(), graph.mentioned_with(held, seeds, 4 + 3).collect()
    assert first(whole) == first(few) and len(few) < len(whole)


def test_names_are_counted_in_chunks(spark):
    """Names are shuffled as arrays of chunks, not as a row each, and the digest is that of counting rows."""
    from quarry.sources import views

    found = views.named(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan_of(found) and max(len(r.names) for r in found.collect()) == 10
    counted = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), ([],), (None,)], "x array<string>").select(views._counted(F.col("x")).alias("n"))
    assert [r.n and [tuple(e) for e in r.n] for r in counted.collect()] == [[(-3, "b"), (-2, "a"), (-1, "c")], None, None]

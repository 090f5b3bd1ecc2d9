import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm import pii
from tests.llm.common import awkward, documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_force(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def corpus(seed=6):
    rng = random.Random(seed)
    pieces = ["a.b@c-d.org", "x@y@z.com", "a@b.c_d@e.f", "q@", "@r.s", "a@b", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.002.3.255", "1.2.3", "+1 (017) 555-7713", "+12 34", "+1-2-3-4-5-6-7-8-9-0-1-2", "(487) 555-7209", "9807915762804490", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678", "été", "日本", "word", "tel:", ",", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "+", "- ", "7", "0", "name (at) host (dot) com"]
    return [(i, "".join(rng.choice(pieces) + rng.choice([" ", "", ". ", "\n"]) for _ in range(rng.randrange(30)))) for i in range(400)]


def test_base_same_as_brute_force(spark):
    texts = corpus() + [(900, "1" * 30_000), (901, "a" * 30_000 + "@" + "b." * 9000 + "c"), (902, "+" + "1-" * 20_000), (903, "1 " * 20_000), (904, ("x" * 50 + ".") * 500)]
    rows = {r.doc_id: r for r in pii.find(documents(spark, texts)).withColumns({"n": pii.number_of("card"), "s": F.sha2(pii.listed("base"), 256), "all": pii.listed("spans")}).collect()}
    for i, t in texts:
        want = brute_force(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert rows[i].s == hashlib.sha256(text.encode()).hexdigest(), (t[:200], rows[i].base, want)
        assert rows[i].n == sum(k == "card" for *_, k in want)
        spans = [x.split(":") for x in rows[i]["all"].split(",") if x]
        assert set(filter(None, text.split(","))) <= {":".join(x) for x in spans}
        base = [(a, b) for a, _, b, _ in want]
        more = [(int(a), int(b)) for k, a, b in spans if k not in pii.BASE or (int(a), int(b)) not in base]
        assert all(b <= c or d <= a for a, b in more for c, d in base)


def test_many_repetitions_in_each_pattern(spark):
    """A matcher that recurses for each repetition would overflow its stack."""
    n = 20_000
    texts = ["a@b" + ".c" * n, "1.2.3" + ".4" * n, "1" + " 1" * n, "+1" + " 2" * n + "3", "5" + "-5" * n, "name(at)b" + ".b" * n, "name (at) b" + " (dot) bb" * n, "name(at)b" + ".b1" * n, "aB3_" * n, "(" * n, "name(at)" * n, "a.b" * n + "@"]
    out = {r.doc_id: r for r in pii.find(documents(spark, list(enumerate(texts)))).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert [(x.start, x.end, x.kind) for x in out[i].base or []] == [(a, b, kind) for a, _, b, kind in brute_force(t)]
    assert [(x.kind, x.start, x.end) for x in out[6].spans] == [("address", 0, len(texts[6]))] and out[5].spans is None  # the last part is too short for a domain


def test_layout_of_files_does_not_matter(spark):
    docs = documents(spark, mixed(60)[0])
    rows = lambda d: sorted((r.doc_id, tuple((x.kind, x.start, x.end) for x in r.spans or [])) for r in pii.find(d).collect())
    assert rows(docs.coalesce(1)) == rows(docs.orderBy(F.desc("doc_id")))


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("rid", F.lit(1)).withColumn("kind", F.lit("x"))
    out = pii.find(docs)
    assert out.count() == docs.count() and out.where(F.size("spans") > 0).count() == 0
    assert pii.find(docs.limit(0)).count() == 0
    same = documents(spark, [(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")])
    assert [r.base[0].start for r in pii.find(same).collect()] == [0, 0, 0]


def added(spark, texts):
    rows = pii.find(documents(spark, texts)).collect()
    base = {(r.doc_id, x.start, x.end) for r in rows for x in r.base or []}
    text = dict(texts)
    return sorted((x.kind, text[r.doc_id][x.start : x.end]) for r in rows for x in r.spans or [] if (r.doc_id, x.start, x.end) not in base)


def mixed(n, seed=3):
    """Texts with one case each, and what should be added to the base."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts, want = [], []
    for i in range(n):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        hexes = hashlib.sha1(f"{seed}:{i}".encode()).hexdigest()
        cases = [("address", f"{name} (at) host{i} (dot) com"), ("number", f"({rng.randrange(200, 999)}) 555-{digits(4)}"), ("secret", hexes)]
        texts += [f"write to {cases[0][1]}, soon", f"ring {cases[1][1]} now", f'token = "{hexes}" end']
        texts += [f"on 2024-{rng.randrange(10, 13)}-{rng.randrange(10, 29)} it", f"paid {rng.randrange(1, 99)} {digits(3)} {digits(3)} euros", f"the wonderfully-long-hyphenated-word-{i} here", f"count {digits(9)} of them", "mail me at name@host.org"]
        want += cases
    return list(enumerate(texts)), sorted(want)


def test_adds_in_few_and_many_documents(spark):
    """By evidence alone, and by trees whose thresholds are calibrated for each kind."""
    for n in (2, 120):
        texts, want = mixed(n)
        assert added(spark, texts) == want


def test_no_selected_character_is_left_out(spark):
    schema = "rid long, kind string, start long, end long"
    rng = random.Random(8)
    spans = [(1, "number", 0, 10), (1, "secret", 8, 20), (1, "number", 15, 30), (1, "number", 30, 33)]  # a chain, and one that touches it
    base = [(2, "email", 5, 9), (2, "card", 7, 12)]
    spans += [(2, "number", 0, 8), (2, "secret", 10, 20), (2, "number", 6, 7)]
    for rid in range(3, 60):
        spans += [(rid, rng.choice(["number", "secret"]), a, a + rng.randrange(1, 15)) for a in rng.choices(range(60), k=8)]
        base += [(rid, "card", a, a + rng.randrange(1, 10)) for a in rng.choices(range(60), k=4)]
    out = [(r.rid, r.kind, r.start, r.end) for r in pii.beside(pii.merged(spark.createDataFrame(spans, schema)), spark.createDataFrame(base, schema)).collect()]
    assert sorted(r for r in out if r[0] < 3) == [(1, "number", 0, 30), (1, "number", 30, 33), (2, "number", 0, 5), (2, "secret", 12, 20)]
    places = lambda rows: {(rid, x) for rid, _, a, b in rows for x in range(a, b)}
    assert places(out) == places(spans) - places(base) and len(places(out)) == sum(b - a for *_, a, b in out)


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    kept, cut = [], pii.cut
    monkeypatch.setattr(pii, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    texts = mixed(30)[0]
    n = 20_400
    found = pii.find(documents(spark, [*texts, *((10_000 + i, "count 123456789 of them; " * 51) for i in range(n // 51))]))
    assert found.count() == len(texts) + n // 51
    drawn = next(df for df in kept if df.columns == ["kind", "x", "y", "fit", "n"])
    assert drawn.where("kind = 'number'").agg(F.sum("n")).first()[0] >= n and drawn.count() < n

"""Sections of pages against plain ones; no page leaves its task."""

import random

from quarry.operators import structure


def test_sections_are_made_where_pages_are(spark):
    rng = random.Random(5)
    made = {i: [(rng.choice(["h2", "p", "p", "li"]), rng.choice(["A", "B", "C", ""]) if rng.random() < 0.5 else "word " * rng.randrange(1, 12) + "end") for _ in range(rng.randrange(9))] for i in range(60)}
    html = {i: "".join(f"<{k}>{t}</{k}>" for k, t in x) for i, x in made.items()}
    pages = spark.createDataFrame([*html.items(), (60, None), (61, "no tags"), (62, "<h1>only a title</h1>"), (63, "<p>x</p><h1>__no_heading__</h1><p>y</p>")], "page_id long, html string")
    made[63] = [("p", "x"), ("h1", "__no_heading__"), ("p", "y")]
    parents, nodes = {}, set()
    for i, x in made.items():
        heading, found = "__no_heading__", {}
        for pos, (kind, text) in enumerate((k, t) for k, t in x if t):
            if kind.startswith("h"):
                heading = text
            else:
                found.setdefault(heading, []).append((pos, text))
        for s, (heading, items) in enumerate(found.items()):
            whole = "\n\n".join(t for _, t in items)
            parents[i, s] = (heading, len(items), items[0][0], items[-1][0], whole)
            nodes.add((i, f"{i}:{s}", None, 0, False, whole))
            for pos, t in items:
                line = "" if heading == "__no_heading__" else heading + "\n"
                nodes.add((i, f"{i}:{s}:{pos}", f"{i}:{s}", 1, len(t) <= 20, f"{line}p.{i}\n\n{t}"))
                if len(t) > 20:
                    nodes |= {(i, f"{i}:{s}:{pos}:{n}", f"{i}:{s}:{pos}", 2, True, t[n * 16 : n * 16 + 20].strip()) for n in range(-(-(len(t) - 20) // 16) + 1)}
    rows = structure.sections(pages)
    assert {(r.page_id, r.section): (r.heading, r.leaves, r.first_pos, r.last_pos, r.content) for r in structure.section_parents(rows).collect()} == parents
    held = structure.section_chunks(rows, 20, 4)
    found = [tuple(r) for r in held.select("page_id", "node_id", "parent_id", "level", "is_leaf", "content").collect()]
    assert len(found) == len(nodes) and set(found) == nodes
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()

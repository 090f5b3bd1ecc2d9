"""Personal data by candidate spans and gradient-boosted trees, in DataFrame operations only.

High-recall generators propose overlapping spans. Those that meet a rule (the
base) always stay. The candidates beside the base are all
labelled by evidence, other for each kind: digit groups, announcing words,
mixture of the characters, an ending like a domain's. Trees, boosted on features
of format and context that don't restate the base's rules, learn these labels;
for each kind a threshold that is calibrated on the other half selects
candidates. A kind too rare or too mixed to calibrate is selected by its evidence.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.frames import cut

#: The kinds, in the order in which spans of one start are listed, and their patterns.
#: Possessive quantifiers and look-behinds only save work: runs are tried from their start. Repeated groups are
#: possessive in all patterns, as the matcher would recurse once for each repetition of another.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: numbers in groups, addresses in words, long mixed strings.
MORE = {
    "number": r"(?<![0-9A-Za-z])[(]?[0-9][0-9()\x20.-]{5,30}[0-9](?![0-9A-Za-z])",
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+\x20?[\[(](?:at|@)[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|\.)[\])])\x20?[a-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
KINDS = [*BASE, *MORE]
#: Words that announce personal data.
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|pay|account|iban|ssn|ip|host|server|address|token|key|secret|passw\w*)\W*$"
#: Evidence: words before numbers and secrets; digit groups of a phone; dates, and amounts with groups of three; how addresses in words end.
CALL = r"(?i)(?<![a-z])(?:tel|telephone|phone|call|fax|mobile|contact)\W*$"
KEY = r"(?i)(?<![a-z])(?:token|key|secret|passw\w*)\W*$"
GROUPS = r"^[(]?[0-9]{2,4}[)]?[\x20.-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}$"
OTHER = r"^(?:(?:19|20)[0-9]{2}[\x20.-][0-9]{1,2}[\x20.-][0-9]{1,2}(?![0-9]).*|[0-9]{1,2}[\x20.-][0-9]{1,2}[\x20.-](?:19|20)[0-9]{2}|[0-9]{1,3}(?:[\x20.][0-9]{3})+)$"
NAME, DOMAIN = r"(?i)^[^\[(]*[a-z]", r"(?i)[\])\x20.][a-z]{2,}+$"
#: Evidence of a secret: bits a character, and changes between letters and digits (fewer where it is announced).
BITS, CHANGES = 3.0, 6
AROUND = 24  # characters of context on the left
#: The share of selected candidates of a kind that should have evidence, and the fewest calibration candidates above a threshold.
PRECISION, SUPPORT = 0.98, 20
FEATURES = ["n_chars", "n_digits", "n_letters", "n_marks", "n_groups", "first_group", "last_group", "longest_group", "changes", "bits", "announced", "glued"]


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(2, 40), total % 10 == 0).otherwise(False)


def _bits(match: Column) -> Column:
    """The entropy of a character."""
    n = F.length(match)
    share = lambda c: (n - F.length(F.replace(match, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(match, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def _evidence() -> Column:
    """Whether format and context speak for personal data; over kind, match, left and the features."""
    number = F.col("n_digits").between(7, 15) & ~F.col("match").rlike(OTHER) & (F.col("match").rlike(GROUPS) | F.col("left").rlike(CALL))
    mixed = (F.col("bits") >= BITS) & (F.col("n_digits") > 0) & (F.col("n_letters") > 0)
    secret = mixed & ((F.col("changes") >= CHANGES) | (F.col("left").rlike(KEY) & (F.col("changes") >= 1)))
    return F.when(F.col("kind") == "secret", secret).when(F.col("kind") == "address", F.col("match").rlike(NAME) & F.col("match").rlike(DOMAIN)).otherwise((F.col("n_letters") == 0) & number)


def key_of(doc_id: str) -> Column:
    return F.xxhash64(doc_id)


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each proposed span: rid, key, kind, start, end (code points), valid (a base span), evidence, and features.

    rid is monotonically_increasing_id() over docs, which must read the same again; key is a hash of doc_id.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), key_of("doc_id").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    needs = {"email": text.contains("@"), "phone": text.contains("+"), "address": text.contains("(") | text.contains("["), "secret": digit}
    found = [F.struct(F.lit(k).alias("kind"), F.when(needs.get(k, digit), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("matches")) for k, p in (BASE | MORE).items()]
    rows = docs.select("rid", "key", "text", F.explode(F.array(*found)).alias("x")).where("size(x.matches) > 0")
    between = F.lit(None)
    for k, p in (BASE | MORE).items():
        between = F.when(F.col("x.kind") == k, F.split("text", p, -1)).otherwise(between)
    rows = rows.select("rid", "key", "x.kind", "x.matches", between.alias("between"))
    rows = rows.select("rid", "key", "kind", "between", F.posexplode("matches").alias("i", "match"))
    left, right = F.get("between", F.col("i")), F.get("between", F.col("i") + 1)
    rows = rows.select("rid", "key", "kind", "i", "match", F.length(left).alias("gap"), F.substring(left, -AROUND, AROUND).alias("left"), F.substring(right, 1, 1).alias("right"))
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    octets = F.col("match").rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    valid = (
        F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(14, 19) & _luhn(digits)).when(F.col("kind") == "phone", n.between(10, 15)).otherwise(False)
    )
    number = lambda c: c.cast("double")
    sizes = F.transform(F.filter(F.split("match", "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    changes = F.length(F.regexp_replace(F.regexp_replace("match", "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "\u0001"), "[^\u0001]", ""))
    rows = rows.select(
        "rid", "key", "kind", "match", "left", (end - F.length("match")).alias("start"), end.alias("end"), valid.alias("valid"),
        number(F.length("match")).alias("n_chars"), number(n).alias("n_digits"), number(F.length(F.regexp_replace("match", "[^A-Za-z]", ""))).alias("n_letters"),
        number(F.length(F.regexp_replace("match", r"[A-Za-z0-9]", ""))).alias("n_marks"), number(F.size(F.split("match", "[^A-Za-z0-9]+"))).alias("n_groups"),
        number(F.coalesce(F.get(sizes, F.lit(0)), F.lit(0))).alias("first_group"), number(F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0))).alias("last_group"),
        number(F.coalesce(F.array_max(sizes), F.lit(0))).alias("longest_group"), number(changes).alias("changes"),
        F.when(F.col("kind") == "secret", _bits(F.col("match"))).otherwise(0.0).alias("bits"), number(F.col("left").rlike(CONTEXT)).alias("announced"),
        number(F.col("left").rlike(r"\w$") | F.col("right").rlike(r"^\w")).alias("glued"),
    )
    return rows.select("rid", "key", "kind", "start", "end", "valid", _evidence().alias("evidence"), *FEATURES)


def _beside_base(found: DataFrame) -> DataFrame:
    """Adds inside: whether a span overlaps a base span."""
    by = Window.partitionBy("rid").orderBy("start", F.desc("valid"))
    reach = F.max(F.when(F.col("valid"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("valid"), F.col("start"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    return found.withColumn("inside", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False)))


def additions(found: DataFrame, precision: float = PRECISION, support: int = SUPPORT) -> DataFrame:
    """What the selected candidates cover beside the base; overlapping ones are one span."""
    found = cut(_beside_base(found))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found.where("not valid").withColumn("y", F.col("evidence").cast("double")))
    # All are halved by document; equal ones are one row with a weight, in an order that doesn't depend on the layout of files.
    drawn = vectors.where("not inside").withColumn("fit", F.xxhash64(F.col("key") + 1) % 2 == 0)
    drawn = drawn.groupBy("kind", "y", "fit", *FEATURES).agg(F.count("*").cast("double").alias("n"), F.first("x").alias("x"))
    drawn = cut(drawn.orderBy("kind", "y", "fit", *FEATURES).select("kind", "x", "y", "fit", "n"))
    seen = {(r.fit, r.y): r["n"] for r in drawn.groupBy("fit", "y").agg(F.sum("n").alias("n")).collect()}
    selected, chosen = F.col("evidence"), vectors
    if all(seen.get((True, y), 0) >= support for y in (0.0, 1.0)):
        trees = GBTClassifier(featuresCol="x", labelCol="y", weightCol="n", maxIter=8, maxDepth=4, stepSize=0.3, seed=1, checkpointInterval=-1).fit(drawn.where("fit").select("x", "y", "n"))
        p = vector_to_array("probability")[1]
        bins = trees.transform(drawn.where("not fit")).groupBy("kind", F.floor(p * 50).alias("bin")).agg(F.sum(F.col("y") * F.col("n")).alias("like"), F.sum("n").alias("n")).orderBy("kind", F.desc("bin")).collect()  # 51 bins a kind at most
        chosen = trees.transform(vectors).withColumn("p", p)
        for kind in KINDS:
            threshold, like, n = None, 0.0, 0
            for r in bins:
                if r.kind == kind:
                    like, n = like + r.like, n + r.n
                    if n >= support and like / n >= precision:
                        threshold = r.bin / 50
            if threshold is not None:
                selected = F.when(F.col("kind") == kind, F.col("p") >= threshold).otherwise(selected)
    return beside(merged(chosen.where(selected)), found.where("valid"))


def merged(spans: DataFrame) -> DataFrame:
    """Each chain of overlapping spans as one, of the kind of its first: rid, kind, start, end."""
    by = Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(reach > F.col("start"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.struct("start", -F.col("end"), "kind"))
    return spans.withColumn("chain", chain).groupBy("rid", "chain").agg(first.alias("x"), F.max("end").alias("end")).select("rid", "x.kind", "x.start", "end")


def beside(spans: DataFrame, base: DataFrame) -> DataFrame:
    """The parts of spans, none of which overlap, that no span of base covers: rid, kind, start, end."""
    edge = lambda rows, at, own, held, kind: rows.select("rid", F.col(at).alias("start"), F.lit(own).alias("own"), F.lit(held).alias("held"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    edges = edge(spans, "start", 1, 0, F.col("kind")).union(edge(spans, "end", -1, 0, none)).union(edge(base, "start", 0, 1, none)).union(edge(base, "end", 0, -1, none))
    edges = edges.groupBy("rid", "start").agg(F.sum("own").alias("own"), F.sum("held").alias("held"), F.max("kind").alias("kind"))
    by = Window.partitionBy("rid").orderBy("start")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    parts = edges.select("rid", F.last("kind", ignorenulls=True).over(upto).alias("kind"), "start", F.lead("start").over(by).alias("end"), F.sum("own").over(upto).alias("own"), F.sum("held").over(upto).alias("held"))
    return parts.where("own > 0 AND held = 0").drop("own", "held")


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, base and more (arrays of start, order, end, kind, by start and kind).

    A null text counts as empty and has no spans; repeated rows have their own
    rows; an empty table gives none. Spans of one start are listed by kind, then
    by end. Texts are scanned whole at any length, with a stack that doesn't grow
    with them. Without enough candidates of either class evidence alone adds to
    the base. Rows that come in another order when read again are an error.
    """
    found = cut(candidates(docs))
    columns = ["rid", "kind", "start", "end"]
    keys = found.select("rid", "key").distinct()
    spans = found.where("valid").select(*columns, F.lit(True).alias("base")).union(additions(found).select(*columns, F.lit(False)))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "end", "kind")
    lists = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id")
    same = F.col("key").isNull() | (F.col("key") == key_of("doc_id"))
    spans = F.when(same, F.col("spans")).otherwise(F.raise_error(F.lit("the documents were read in another order than before")))
    return rows.join(lists.join(keys, "rid"), "rid", "left").select("doc_id", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def number_of(kind: str) -> Column:
    return F.when(F.col("base").isNull(), 0).otherwise(F.size(F.filter("base", lambda s: s["kind"] == kind))).cast("long")

"""Text expressions; each argument is a Column or a column's name."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Words that carry no meaning in queries.
STOPWORDS = (
    "the and for with dans avec pour une des les est sur pas plus que qui this that what how "
    "quoi comment quel quelle quels quelles from par sans mais donc car you your not are was were"
).split()
#: Patterns of the content classes, and what suggests a question of several steps.
NORMATIVE = r"(?iu)\b(DTU|NF\s|EN\s|CE\b|norme|article|décret|arrêté|conformément|ISO\s)\b"
PROCEDURE = r"(?imu)^\s*\d+[\.\)]\s+|^\s*[-•]\s+|\b(visser|régler|monter|poser|contrôler|vérifier|serrer|ajuster)\b"
SEVERAL_STEPS = (
    r"(?iU)\b(et\b|comparaison|impact|cause|depend|dépend|influence|relation|lien|si\b|alors\b|pourquoi|comment|implique"
    r"|nécessite|necessite|versus|vs\b|différence|difference|avantage|inconvénient|inconvenient)\b"
)

_BASES = {c: b for c in map(chr, range(0xC0, 0x250)) if (b := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) != c and len(b) == 1}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use, or a lambda in it, reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))


def fold_accents(c: Column | str) -> Column:
    """Latin letters without their marks; combining marks go."""
    folded = lambda x: F.regexp_replace(F.translate(x, "".join(_BASES), "".join(_BASES.values())), "[\u0300-\u036f]", "")
    return let(col(c), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(folded(x)))  # ASCII stays as it is


def normalize_name(c: Column | str) -> Column:
    """An entity's name for comparison: folded, hyphens and underscores as spaces, other signs dropped."""
    plain = fold_accents(F.lower(strip(c)))
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[-_]", " "), r"[^a-z0-9\s]", ""), r"\s+", " "))


def words(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit("[A-Za-zÀ-ÿ0-9]+"), F.lit(0)), F.lower)


def query_terms(c: Column | str, most: int = 8) -> Column:
    """The first terms of a question: three letters or more, no stopwords."""
    return F.slice(F.filter(words(c), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)), 1, most)


def meaningful_words(c: Column | str) -> Column:
    """Distinct folded words of more than three letters, without stopwords."""
    found = F.regexp_extract_all(fold_accents(F.lower(col(c))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(STOPWORDS)))


def html_text(c: Column | str) -> Column:
    """Text of a page: scripts, styles and tags dropped, entities resolved, white space collapsed."""
    out = col(c)
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, text in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&#39;?", "'"), ("&amp;?", "&")):
        out = F.regexp_replace(out, entity, text)
    return strip(F.regexp_replace(out, r"[\s\u00a0]+", " "))


def safe_filename(c: Column | str) -> Column:
    """The last part of a path without signs that file systems reserve, 200 letters at most."""
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace(col(c), "/+$", ""), "/"), -1), r'[/\\:*?"<>|\x00]', "_")
    stem, ext = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    cut = F.concat(F.substring(F.when(name.contains("."), stem).otherwise(name), 1, 190), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    return F.when(F.length(name) > 200, cut).otherwise(name)


def content_class(c: Column | str) -> Column:
    """normative, procedure or description, by the first 8,000 letters."""
    head = F.substring(col(c), 1, 8000)
    return F.when(head.rlike(NORMATIVE), "normative").when(head.rlike(PROCEDURE), "procedure").otherwise("description")


def needs_several_steps(question: Column | str, n_pivots: Column) -> Column:
    q = strip(question)
    return (q != "") & (q.rlike(SEVERAL_STEPS) | (n_pivots >= 2))


def mime_type(name: Column | str) -> Column:
    """By the extension; fixed values."""
    office = "application/vnd.openxmlformats-officedocument."
    kinds = {
        "pdf": "application/pdf", "doc": "application/msword", "docx": office + "wordprocessingml.document", "docm": "application/vnd.ms-word.document.macroEnabled.12",
        "xls": "application/vnd.ms-excel", "xlsx": office + "spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint", "pptx": office + "presentationml.presentation",
        "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html", "epub": "application/epub+zip",
        "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff",
    }
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))

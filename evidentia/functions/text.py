"""Text expressions: every function maps Columns to a Column and stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary appended to a query whose lower-cased text matches the pattern.
EXPANSIONS = [
    (r"\bgreen card\b", "green card lawful permanent resident adjustment of status"),
    (r"\bwork permit\b", "work permit employment authorization document EAD Form I-765"),
    (r"\bopt\b", "OPT optional practical training"),
    (r"\bcpt\b", "CPT curricular practical training"),
    (r"\bh1b\b|\bh-1b\b", "H-1B specialty occupation nonimmigrant worker"),
    (r"\bf1\b|\bf-1\b", "F-1 academic student nonimmigrant"),
    (r"\bstem\b", "STEM science technology engineering mathematics extension"),
    (r"\bina\s+(\d+)", r"INA section \1 Immigration and Nationality Act"),
    (r"\btravel ban\b", "inadmissibility presidential proclamation entry restriction"),
    (r"\bgrace period\b", "grace period authorized period of stay departure"),
    (r"\bout of status\b", "failure to maintain status unlawful presence violation"),
]
#: The pattern of a term, and of a heading line.
TOKEN = r"[a-z0-9]+(?:[.\-–][a-z0-9]+)*(?:\([a-z0-9]+\))*"
HEADING = (
    r"^\s*(?:\d+\s?FAM\s[\d.\-()A-Z]+.*|[A-Z]\.\s+[A-Z]\S.{0,80}|\d{1,2}\.\s+[A-Z]\S.{0,80}|Chapter\s+\d+\s*[-–].{0,80}"
    r"|[A-Z][A-Z0-9 ,'\-/\&()]{6,80})\s*$"
)
#: Lines of page furniture in extracted PDF text.
FURNITURE = [
    r"^the type and rule above prints on all proofs.*$", r"^userid:.*$", r"^draft as of.*$", r"^page \d+ of \d+\s*$",
    r"^\s*\d{1,4}\s*-\s*\d{1,2}-[a-z]{3}-\d{4}\s*$", r"^\s*\d{1,4}\s*$",
]


def normalize_ws(c: Column) -> Column:
    """NBSP and curly quotes to plain ones, runs of blanks to one, three or more line ends to two, ends trimmed."""
    c = F.translate(c, " ‘’“”", " ''\"\"")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def approx_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def tokenize(c: Column) -> Column:
    """Terms in order, repeats kept; identifiers stay whole and add their stem, inner labels and undashed form."""
    low = F.replace(F.replace(F.lower(c), F.lit("§"), F.lit(" section ")), F.lit("u.s.c."), F.lit("usc"))
    none, found = F.array().cast("array<string>"), F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))

    def variants(t: Column) -> Column:
        parts = F.when(F.contains(t, F.lit("(")), F.concat(F.array(F.substring_index(t, "(", 1)), F.regexp_extract_all(t, F.lit(r"\(([a-z0-9]+)\)"), F.lit(1)))).otherwise(none)
        plain = F.when(F.contains(t, F.lit("-")) & (F.length(t) < 12), F.array(F.replace(t, F.lit("-"), F.lit("")))).otherwise(none)
        return F.concat(F.array(t), parts, plain)

    # most texts have no identifier that adds terms
    return F.when(low.rlike(r"[a-z0-9][(\-]"), F.filter(F.flatten(F.transform(found, variants)), lambda t: t != "")).otherwise(found)


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z\[])"), lambda s: F.trim(s) != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def normalize_for_match(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_citation(c: Column) -> Column:
    c = F.replace(F.replace(F.lower(c), F.lit("§"), F.lit("")), F.lit("u.s.c."), F.lit("usc"))
    return F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\(8usc[\d.]+(?:\([a-z0-9]+\))*\)", "")


def citation_match(found: Column, gold: Column, strict: bool = False) -> Column:
    """Whether two citations name one provision. ``strict`` asks for equal keys; else one path may continue the other's."""
    p, g = normalize_citation(found), normalize_citation(gold)
    if strict:
        return (g != "") & (p == g)
    section = lambda c: F.regexp_extract(c, r"^([a-z]+[\d]*[\d.]*)", 1)
    labels = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\(([a-z0-9]+)\)"), F.lit(1)), "")
    named = (section(p) != "") & (section(g) != "")
    same = (section(p) == section(g)) & (F.startswith(labels(p), labels(g)) | F.startswith(labels(g), labels(p)))
    return (g != "") & F.when(named, same).otherwise(F.contains(p, g) | F.contains(g, p))


def expand_query(c: Column) -> Column:
    low, extra = F.lower(c), []
    for pattern, words in EXPANSIONS:
        if r"\1" in words:
            before, after = words.split(r"\1")
            words = F.concat(F.lit(before), F.regexp_extract(low, pattern, 1), F.lit(after))
        else:
            words = F.lit(words)
        extra.append(F.when(low.rlike(pattern), words))
    return F.concat_ws(" ", c, *extra)


def clean_pdf_text(c: Column) -> Column:
    """Drops page furniture, joins hyphen breaks and, twice, wrapped lines."""
    for pattern in FURNITURE:
        c = F.regexp_replace(c, "(?im)" + pattern, "")
    c = F.regexp_replace(c, r"([a-z])[ \t]*-[ \t]*\n[ \t]*([a-z])", "$1$2")
    for _ in range(2):
        c = F.regexp_replace(c, r"([^\n.:;?!\-])\n([a-z])", "$1 $2")
    return c


def strip_think(c: Column) -> Column:
    """A model's output without its reasoning; of a block that was cut off, what follows the last tag stays."""
    rest = F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    return F.when(F.contains(F.lower(rest), F.lit("<think>")), F.trim(F.element_at(F.split(rest, "(?i)</?think>"), -1))).otherwise(rest)


def parse_json_loose(c: Column) -> Column:
    """A VARIANT of the JSON in a model's output: fenced, plain, or between the outermost braces or brackets; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(c))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1)), F.try_parse_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1)))


def coerce_list(variant: Column, path: str) -> Column:
    """A list field of a model's answer: a bare string or scalar is a list of one; null and words for nothing are an empty list."""
    none = F.array().cast("array<string>")
    one = F.try_variant_get(variant, path, "string")
    nothing = one.isNull() | F.lower(F.trim(one)).isin("", "none", "n/a", "null")
    return F.coalesce(F.try_variant_get(variant, path, "array<string>"), F.when(nothing, none).otherwise(F.array(one)))


def chunk_id(doc_id: Column, seq: Column, text: Column) -> Column:
    return F.concat(doc_id, F.format_string("#%04d:", seq), F.substring(F.sha1(text), 1, 12))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

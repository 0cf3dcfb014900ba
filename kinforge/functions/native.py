"""Name and address functions as native expressions: no UDF, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

INDIC = "[\\u0900-\\u0DFF]"
DOTTED = r"\b(?:[a-z]\. ?)+[a-z]\b\.?"
DBA = r"^(.*?)\s*\b(?:d/b/a|dba|formerly|f/k/a|t/a|nka|a/k/a)\b\s*(.+)$"
DOMAIN = r"^[a-z0-9-]+\.(?:" + "|".join(T.DOMAINS.split()) + r")$"


def _list(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def fold(c: Column) -> Column:
    """Latin letters without accents; two-letter signs written out."""
    a, b = T.accents()
    out = F.translate(c, a, b)
    for one, two in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def script(c: Column) -> Column:
    """2 Indic, 1 other than ASCII, 0 ASCII."""
    return F.when(c.rlike(INDIC), 2).when(c.rlike("[^\\x00-\\x7F]"), 1).otherwise(0)


# Blocks of Indic scripts, by their first and last code point.
SCRIPTS = {
    "devanagari": "0900-097F", "bengali": "0980-09FF", "gurmukhi": "0A00-0A7F", "gujarati": "0A80-0AFF", "oriya": "0B00-0B7F", "tamil": "0B80-0BFF",
    "telugu": "0C00-0C7F", "kannada": "0C80-0CFF", "malayalam": "0D00-0D7F", "sinhala": "0D80-0DFF",
}


def indic_script(c: Column) -> Column:
    """The first Indic script of the list that a text has a letter of, '' for none."""
    out = F.lit("")
    for name, span in reversed(SCRIPTS.items()):
        a, b = span.split("-")
        out = F.when(c.rlike(f"[\\u{a}-\\u{b}]"), name).otherwise(out)
    return out


def latin_tokens(c: Column) -> Column:
    """Words of folded lower-case letters and digits."""
    return words(F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " ")))


def indic_tokens(c: Column) -> Column:
    """Words, as white space divides them, with an Indic letter."""
    return F.filter(F.split(c, r"[ \t\r\n]+"), lambda x: x.rlike(INDIC))


def country(c: Column) -> Column:
    return F.lower(F.trim(fold(c)))


def each_match(c: Column, pattern: str, change) -> Column:
    """Replaces every match by change(match): what a regex callback does, natively."""
    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), c, lambda acc, m: F.replace(acc, m, change(m)))


def dotted(c: Column) -> Column:
    """`l.l.c.` becomes `llc`; one space may follow each dot."""
    return each_match(c, DOTTED, lambda m: F.regexp_replace(m, r"[. ]", ""))


def dba(c: Column) -> tuple[Column, Column]:
    """(primary, alternative) of `old d/b/a new`; primary is the part behind if it has 3 letters or more."""
    before, after = F.trim(F.regexp_extract(c, DBA, 1)), F.trim(F.regexp_extract(c, DBA, 2))
    hit = (F.length(after) >= 3) & (F.length(before) > 0)
    return F.when(hit, after).otherwise(c), F.when(hit, before).otherwise(F.lit(""))


def is_domain(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(DOMAIN)


def plain(c: Column) -> Column:
    """Lower case without accents; `&` and `+` are `and`; anything but letters and digits is one space."""
    # ASCII text, as long in bytes as in characters, has nothing to fold; plain replacements need no regex.
    c = F.lower(F.when(F.octet_length(c) == F.char_length(c), c).otherwise(fold(c)))
    for one, two in (("&", " and "), ("+", " and "), ("'", ""), ("’", "")):
        c = F.replace(c, F.lit(one), F.lit(two))
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def legal_strip(tokens: Column) -> Column:
    """Tokens without legal forms; all of them if nothing else is left. An ambiguous first word stays if
    there are two legal forms or more."""
    legal, unsure = _list(" ".join(T.families())), _list(T.AMBIGUOUS)
    hits = F.size(F.filter(tokens, lambda x: F.array_contains(legal, x)))
    kept = F.filter(tokens, lambda x, i: ~F.array_contains(legal, x) | ((i == 0) & F.array_contains(unsure, x) & (hits >= 2)))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def legal_code(tokens: Column) -> Column:
    """The first legal form's family, 12 for one without, 0 for none."""
    code = F.create_map(*[F.lit(x) for kv in T.families().items() for x in kv])
    found = F.filter(F.transform(tokens, lambda x: F.try_element_at(code, x)), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(F.filter(found, lambda v: v < 12), F.lit(1)), F.try_element_at(found, F.lit(1)), F.lit(0))


def name_tokens(core: Column) -> Column:
    """Words of two letters or more that aren't stop words; without any, all of two letters or more."""
    long = F.filter(F.split(core, " "), lambda x: F.length(x) >= 2)
    kept = F.filter(long, lambda x: ~F.array_contains(_list(T.STOPWORDS), x))
    return F.when(F.size(kept) > 0, kept).otherwise(long)


def ordinal_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(\d+)(?:st|nd|rd|th|er|ere|re|eme|e)\b", "$1")


def numbers(c: Column) -> Column:
    """Digit tokens, leading zeros gone, plus the digits of tokens with one or two letters."""
    hits = F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{0,2}\d+[a-z]{0,2})\b"), F.lit(1))
    bare = F.transform(hits, lambda x: F.regexp_replace(F.regexp_replace(x, "[a-z]", ""), "^0+(?=[0-9])", ""))
    return F.array_distinct(bare)


def postal(c: Column) -> Column:
    """The last comma component of five or six digits."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{5,6}$"))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def ranges(c: Column) -> Column:
    """(lo, hi) of `a-b` with 0 < b - a <= 40."""
    hits = F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{1,9}\s*-\s*\d{1,9})\b"), F.lit(1)), lambda x: F.struct(F.trim(F.split(x, "-")[0]).cast("int").alias("lo"), F.trim(F.split(x, "-")[1]).cast("int").alias("hi")))
    return F.filter(hits, lambda r: (r["hi"] - r["lo"] > 0) & (r["hi"] - r["lo"] <= 40))


def components(c: Column) -> Column:
    """Comma components, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")

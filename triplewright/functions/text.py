"""Column functions for text and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII blanks, for trimming at both ends.
BLANKS = " \t\n\x0b\f\r"
#: Every sequence that ends a line of text.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\u0085\u2028\u2029]"
#: Lines that carry no content.
DOI = r"(?i)doi:\s*\d+\.\d+/\S+"
NUMBERED = r"^\d+[:.]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
NUMBER = r"^\s*\d+\s*$"
FRONT_MATTER = r"(?i)(Received|revised|accepted|Keywords|Abstract)"
CHUNK_RULES = (DOI, NUMBERED, EMAIL, NUMBER)
PAGE_RULES = (DOI, NUMBERED, EMAIL)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Each run of Unicode blanks as one space, none at the ends; case stays. Null: empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), F.lit(" "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


def lines(c: Column) -> Column:
    """The lines of a text without a byte-order mark."""
    return F.split(F.regexp_replace(c, r"^\uFEFF", ""), LINE_ENDS, -1)


def bare_line(c: Column) -> Column:
    """A stripped line without the punctuation at its end; what that leaves is not stripped again."""
    return F.regexp_replace(strip(c), r"\p{Punct}+$", "")


def clean_lines(c: Column, rules: tuple[str, ...] = CHUNK_RULES, joiner: str = " ") -> Column:
    """The text without lines that match a rule, its other lines collapsed and joined; may be empty."""

    def kept(x: Column) -> Column:
        out = F.lit(True)
        for rule in rules:
            out = out & ~F.rlike(x, F.lit(rule))
        return out

    tidy = F.transform(F.filter(F.split(c, "\n", -1), kept), collapse)
    return F.array_join(F.filter(tidy, lambda x: x != ""), joiner)


def sentences(c: Column, longer_than: int = 20) -> Column:
    """Stretches up to the marks that end a sentence, stripped, longer than so many characters."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), strip)
    return F.filter(found, lambda s: F.length(s) > longer_than)


def relation_text(sentence: Column, src: Column, label: Column, dst: Column) -> Column:
    """An edge as a sentence: its own, or subject predicate object; first letter in upper case."""
    plain = F.concat_ws(" ", src, label, dst)
    text = F.trim(F.replace(F.coalesce(F.nullif(sentence, F.lit("")), plain), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def node_id(label: Column, prefix: str = "n_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(label), 1, 12))


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and _, in lower case, of any language."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

"""Text normalization, markers, redaction and address rules as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display wrappers that a comparison leaves out, and white space in ASCII.
WRAPPERS = ["$", "\\(", "\\)", "\\[", "\\]"]
ASCII_SPACE = r"[ \t\n\r\f\x0B]+"

# What a line starts with or is, in ASCII classes.
QUESTION = "^[ \\t]*[0-9]+[.．、]([^0-9]|$)"
OPTION = "^[ \\t]*[A-D][.．、]"
CAPTION = "^[ \\t]*第[ \\t]*[0-9]+[ \\t]*题[ \\t]*$"
FOOTER = "^(.*第|[0-9]+页)$"
HEADING = "^#{1,6}[ \\t]+"

# Secrets that logs must not hold, with what stands in for them.
REDACTIONS = [
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
    (r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "[MAIL]"),
    (r"[Bb]earer [A-Za-z0-9._-]+", "[BEARER]"),
]


def without_space(c: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(c, ASCII_SPACE, "")


def normalized(c: Column) -> Column:
    """The text without display wrappers of formulas and without white space."""
    for token in WRAPPERS:
        c = F.replace(c, F.lit(token), F.lit(""))
    return without_space(c)


def paragraphs(c: Column) -> Column:
    """The parts between blank lines."""
    return F.split(c, r"\n[ \t\r\f\x0B]*\n")


def block_kind(c: Column) -> Column:
    """What a line is: heading, question, option, caption, footer or paragraph, the first that fits."""
    kinds = ((HEADING, "heading"), (QUESTION, "question"), (OPTION, "option"), (CAPTION, "caption"), (FOOTER, "footer"))
    return F.coalesce(*(F.when(c.rlike(pattern), kind) for pattern, kind in kinds), F.lit("paragraph"))


def invalid_xml(c: Column) -> Column:
    """Whether any character is outside XML 1.0."""
    return c.rlike("[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]")


def redacted(c: Column) -> Column:
    """Text whose secrets are masked."""
    for pattern, mark in REDACTIONS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def sealed(c: Column) -> Column:
    """A text's stand-in: its hash and length."""
    return F.concat(F.lit("[REDACTED:sha256="), F.sha2(c, 256), F.lit(":length="), F.length(c).cast("string"), F.lit("]"))


def public_id(c: Column) -> Column:
    """A test's name without its parameters, and the start of the whole name's hash."""
    return F.concat(F.substring_index(c, "[", 1), F.lit("#"), F.substring(F.sha2(c, 256), 1, 12))


def one_v1(c: Column) -> Column:
    """An address that ends in exactly one /v1."""
    return F.concat(F.regexp_replace(F.regexp_replace(c, "/+$", ""), "(/v1)+$", ""), F.lit("/v1"))


def loopback(c: Column) -> Column:
    """Whether an address is plain HTTP to this machine, with a port, and without user, query or fragment."""
    return F.coalesce(c.rlike(r"^http://(127\.0\.0\.1|localhost):[0-9]{1,5}(/[^?#@]*)?$"), F.lit(False))

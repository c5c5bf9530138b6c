"""Tokens, template ids, excerpts and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_TOKENS = 128
EXCERPT_BYTES = 160


def tokens(line: Column, most: int = MOST_TOKENS) -> Column:
    """The first ``most`` tokens between white space in the Unicode sense; 0 is all of them."""
    every = F.filter(F.split(line, r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), lambda t: t != "")
    return F.slice(every, 1, most) if most else every


def spaced(line: Column, most: int = MOST_TOKENS) -> Column:
    """The first ``most`` tokens (0: all) with a space between them; a line in ASCII that has them so, and no more, is taken as it is."""
    # Without a pattern, which takes longer than what comes of it.
    plain = F.octet_length(line) == F.length(line)
    for space in ("\t", "\n", "\x0b", "\f", "\r", "  "):
        plain &= ~F.contains(line, F.lit(space))
    plain &= ~F.startswith(line, F.lit(" ")) & ~F.endswith(line, F.lit(" "))
    # Tokens and the spaces between them are one less than twice as many characters at least.
    if most:
        plain &= F.length(line) <= 2 * most
    return F.when(plain, line).otherwise(F.array_join(tokens(line, most), " "))


def template_id(template: Column) -> Column:
    return F.concat(F.lit("t_"), F.sha2(template, 256))


def lossy(raw: Column) -> Column:
    """Bytes as text, with U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))


def body(raw: Column, offset: Column) -> Column:
    """The text from a byte offset on; an offset out of range means the whole line."""
    within = (offset >= 0) & (offset <= F.octet_length(raw))
    return lossy(F.when(within, F.substring(raw, offset + 1, F.lit(2147483647))).otherwise(raw))


def excerpt(template: Column, most: int = EXCERPT_BYTES) -> Column:
    """The characters that start before byte ``most``; a template of no more bytes is whole."""
    # Every character has a byte or more, so that none after the first ``most`` can start in time.
    chars = F.split(F.substring(template, 1, most), "")
    cut = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, c: F.struct((acc["at"] + F.octet_length(c)).alias("at"), F.when(acc["at"] < most, F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.octet_length(template) <= most, template).when(F.octet_length(template) == F.length(template), F.substring(template, 1, most)).otherwise(cut)


def humanize(name: Column) -> Column:
    """An id as words: spaces for underscores and a capital first letter."""
    words = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 2147483647))


def clock(at: Column) -> Column:
    return F.date_format(at, "HH:mm:ss")


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def content(line: Column) -> Column:
    """The text after the first ``: ``, trimmed; the whole line if there is none."""
    at = F.locate(": ", line)
    return F.trim(F.when(at > 0, line.substr(at + 2, F.length(line))).otherwise(line))


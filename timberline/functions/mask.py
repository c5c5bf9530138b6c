"""Masking: one ordered alternation of slots, replaced in a single Catalyst expression.

``regexp_replace`` has no callback, so that the replacement cannot name the slot that
matched. It puts each alternate's group between separators, of which one group is not
empty; the line is then split there, and a piece's place among the separators names its
slot. A line is matched once, at a cost that grows with its length alone.
"""

from __future__ import annotations

import hashlib
import operator
import re
import tomllib
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
RESERVED = r"<VAR:([A-Z][A-Z0-9_]*)>"
NAME = re.compile(r"[A-Z][A-Z0-9_]*")
MOST_PATTERN_CHARS = 1 << 20
SEPARATOR = "\x01"
#: Separators and escapes in a line that has separators, as masking sees them.
ESCAPES = (("\x04", "\x04\x06"), (SEPARATOR, "\x04\x05"))

# The slots in order of precedence, and what each matches.
DEFAULT_SLOTS = (
    ("TS", r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d{2}:\d{2}:\d{2}(?:\.\d+)?(?: \d{4})?\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d{2}:\d{2}:\d{2}\b|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{4}/\d{2}/\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s[+-]\d{4})?|\b\d{2}:\d{2}:\d{2}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("MAC", r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b"),
    ("IP6", r"(?:\b[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}:){0,5}(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b(?:%[A-Za-z0-9]+)?|\b[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}\b)?(?:%[A-Za-z0-9]+)?|::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}\b(?:%[A-Za-z0-9]+)?"),
    ("IP4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("URL", r"""\b[a-z][a-z0-9+.-]*://[^\s"']+"""),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("HOST", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+(?:com|net|org|edu|gov|mil|arpa|lan|localdomain|uk|de|fr|jp|cn|hk|ru|nl|au|ca|eu)\b"),
    ("DEV", r"/dev/[a-zA-Z0-9/_-]+|\b(?:sd[a-z]+\d*|nvme\d+n\d+(?:p\d+)?|dm-\d+|vd[a-z]\d*|md\d+|zd\d+)\b"),
    ("PATH", r"(?:/[A-Za-z0-9._-]+){2,}/?"),
    ("HEX", r"\b0x[0-9a-fA-F]+\b|\b(?:[a-fA-F][0-9a-fA-F]{7,}|\d{1}[a-fA-F][0-9a-fA-F]{6,}|\d{2}[a-fA-F][0-9a-fA-F]{5,}|\d{3}[a-fA-F][0-9a-fA-F]{4,}|\d{4}[a-fA-F][0-9a-fA-F]{3,}|\d{5}[a-fA-F][0-9a-fA-F]{2,}|\d{6}[a-fA-F][0-9a-fA-F]{1,}|\d{7,}[a-fA-F][0-9a-fA-F]*|\d{21,})\b"),
    ("SIZE", r"\b\d+(?:\.\d+)?\s?(?:[KMGTPkmgtp]?i?B|bytes)\b"),
    ("DUR", r"\b\d+(?:\.\d+)?\s?(?:ns|us|ms|s|m|h)\b"),
    ("PID", r"\[\d+\]"),
    ("NUM", r"\b\d+(?:\.\d+)?\b"),
)


def _linear() -> dict[str, str]:
    """The slots above whose patterns take stack for each repeat or scan a long run again from each of its places, in a form that does neither.

    What such a pattern finds depends on where its run of characters ends, not on where
    in it the match starts. So a start within a long run is tried only if none of up to
    32 characters before it has failed since the last match (``\\G``). Repeats are
    possessive where nothing that follows needs characters back.
    """

    def start(first: str, run: str, then: str, whole: str, other: str) -> str:
        # A run that ends soon must end as it should; in a long one no start before may have failed.
        return rf"\b(?={first}(?:{run}{{64}}|{run}{{0,63}}{then}))(?:(?!{whole}{{65}})|(?<!{other}))"

    patterns = dict(DEFAULT_SLOTS)
    scheme, user, host = "[a-z0-9+.-]", "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
    label = r"[A-Za-z0-9][A-Za-z0-9-]*+(?<!-)\."
    top = patterns["HOST"][patterns["HOST"].rindex("(?:") :]
    # Labels up to the last one before a name of the list.
    upto = rf"(?=[0-9.-]*+[A-Za-z])(?:(?:{label}(?!{top}))*+{label}(?={top}))++"
    since = r"(?!\G)"
    safe = {
        "URL": start("[a-z]", scheme, "://", scheme, rf"\b[a-z]{since}(?:{scheme}{since}){{0,31}}") + rf"""{scheme}++://[^\s"']+""",
        "EMAIL": start(user, user, "@", user, rf"\b(?:{user}{since}){{1,32}}") + rf"{user}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b",
        "HOST": start("[A-Za-z0-9]", host, r"\.", "[A-Za-z0-9.-]", rf"\b[A-Za-z0-9]{since}(?:{host}{since}){{0,30}}(?:(?<!-)\.{since})?") + upto + top,
        "PATH": r"(?:/[A-Za-z0-9._-]++){2,}+/?",
    }
    return {patterns[name]: pattern for name, pattern in safe.items()}


#: By the text of a pattern: what is run in its place.
LINEAR = _linear()
#: By the text of a pattern: what each of its matches holds. Lines with none of it are masked without the pattern.
HOLDS = {pattern: held for name, pattern in DEFAULT_SLOTS for slot, held in (("URL", "://"), ("EMAIL", "@")) if slot == name}


class BadBundle(ValueError):
    """A bundle that must not be used; ``kind`` says why."""

    def __init__(self, kind: str, what: str):
        super().__init__(f"{kind}: {what}")
        self.kind = kind


@dataclass(frozen=True)
class Slot:
    name: str
    pattern: str
    why: str = ""

    @property
    def run(self) -> str:
        """The pattern as Java runs it."""
        return LINEAR.get(self.pattern, self.pattern)


@dataclass(frozen=True)
class Bundle:
    """Ordered slots. Declaration order is precedence among matches at one place."""

    slots: tuple[Slot, ...]
    source: str = ""
    #: What every match starts with, as a lookahead; most places of a line are then passed over at once. Empty: anything.
    start: str = ""

    @classmethod
    def of(cls, *slots: tuple[str, str]) -> Bundle:
        bundle = cls(tuple(Slot(*s) for s in slots))
        return cls.parse(bundle.to_toml())

    @classmethod
    def parse(cls, text: str) -> Bundle:
        """Read and check a bundle file. Raises BadBundle."""
        try:
            data = tomllib.loads(text)
            version = data["version"]
            slots = tuple(Slot(s["name"], s["pattern"], s.get("why", "")) for s in data.get("slot", []))
        except (tomllib.TOMLDecodeError, KeyError, TypeError) as x:
            raise BadBundle("toml", str(x)) from x
        if version != VERSION:
            raise BadBundle("version", str(version))
        if not slots:
            raise BadBundle("empty", "no slots")
        seen: set[str] = set()
        for s in slots:
            if not NAME.fullmatch(s.name):
                raise BadBundle("name", s.name)
            if s.name == "MASKED":
                raise BadBundle("reserved", s.name)
            if s.name in seen:
                raise BadBundle("duplicate", s.name)
            seen.add(s.name)
            try:
                groups = re.compile(s.pattern).groups
            except re.error as x:
                raise BadBundle("regex", f"{s.name}: {x}") from x
            if groups:
                raise BadBundle("group", s.name)
        if sum(len(s.pattern) for s in slots) > MOST_PATTERN_CHARS:
            raise BadBundle("size", "the patterns are too long")
        return cls(slots, text)

    def check(self, spark) -> Bundle:
        """The bundle, if Java takes its patterns as well, which are what masking runs. Raises BadBundle."""
        for s in self.slots:
            try:
                spark.range(1).select(F.lit("").rlike("(?U)" + s.pattern)).collect()
            except Exception as x:
                raise BadBundle("regex", f"{s.name}: {x}") from x
        return self

    def to_toml(self) -> str:
        out = [f"version = {VERSION}\n"]
        for s in self.slots:
            pattern = f"'{s.pattern}'" if "'" not in s.pattern else '"' + s.pattern.replace("\\", "\\\\").replace('"', '\\"') + '"'
            why = s.why.replace("\\", "\\\\").replace('"', '\\"')
            out.append(f'\n[[slot]]\nname = "{s.name}"\npattern = {pattern}\nwhy = "{why}"\n')
        return "".join(out)

    @cached_property
    def hash(self) -> str:
        """Of the exact source text."""
        return "b_" + hashlib.sha256(self.source.encode()).hexdigest()

    @property
    def grouped(self) -> str:
        """All slots, placeholders first, each as a group of its own."""
        return self._grouped(lambda s: s.run)

    @property
    def lean(self) -> str:
        """``grouped`` for lines that hold nothing of ``held``: the slots that need it match nothing."""
        return self._grouped(lambda s: "(?!)" if s.pattern in HOLDS else s.run)

    @property
    def held(self) -> list[str]:
        return [HOLDS[s.pattern] for s in self.slots if s.pattern in HOLDS]

    def _grouped(self, run) -> str:
        return self.start + "(?:" + "|".join(["(<VAR:[A-Z][A-Z0-9_]*>)", *(f"({run(s)})" for s in self.slots)]) + ")"

    @property
    def separated(self) -> str:
        """The replacement: all groups between separators."""
        return SEPARATOR + "".join(f"${k}{SEPARATOR}" for k in range(1, len(self.slots) + 2))

    @property
    def alternation(self) -> str:
        """All slots as they are written, placeholders first, without capturing groups."""
        return "|".join(["<VAR:[A-Z][A-Z0-9_]*>", *(f"(?:{s.pattern})" for s in self.slots)])


# Each slot above starts at a word boundary, or with a digit, a slash, a colon or a bracket; placeholders with theirs.
DEFAULT = replace(Bundle.of(*DEFAULT_SLOTS), start=r"(?=\b|[\d/:\[<])")


def _pieces(line: Column, bundle: Bundle, unicode: bool) -> tuple[Column, Column]:
    """The line cut around its matches, and whether it has separators, which are then escaped.

    Of each match: nothing, a placeholder, then one piece for each slot; text is before and after.
    """
    flag = "(?U)" if unicode else ""
    odd = F.contains(line, F.lit(SEPARATOR))
    clean = line
    for old, new in ESCAPES:
        clean = F.replace(clean, F.lit(old), F.lit(new))
    clean = F.when(odd, clean).otherwise(line)
    found = F.regexp_replace(clean, flag + bundle.grouped, bundle.separated)
    if bundle.held:
        holds = reduce(operator.or_, (F.contains(line, F.lit(x)) for x in bundle.held))
        found = F.when(holds, found).otherwise(F.regexp_replace(clean, flag + bundle.lean, bundle.separated))
    return F.split(found, SEPARATOR, -1), odd


def _unescaped(text: Column, odd: Column) -> Column:
    back = text
    for old, new in reversed(ESCAPES):
        back = F.replace(back, F.lit(new), F.lit(old))
    return F.when(odd, back).otherwise(text)


def mask(line: Column, bundle: Bundle = DEFAULT, unicode: bool = True) -> Column:
    """The template of a line: each match as ``<VAR:NAME>``; placeholders stay as they are."""
    pieces_, odd = _pieces(line, bundle, unicode)
    tags = F.array(*(F.lit(f"<VAR:{s.name}>") for s in bundle.slots))

    def named(piece: Column, i: Column) -> Column:
        k = i % (len(bundle.slots) + 2)
        return F.when(k <= 1, piece).when(piece == "", piece).otherwise(F.get(tags, k - 2))

    return _unescaped(F.array_join(F.transform(pieces_, named), ""), odd)


def matches(line: Column, bundle: Bundle = DEFAULT, unicode: bool = True) -> Column:
    """Array of (name, value) of what ``mask`` replaces, in order; placeholders are not reported."""
    flag = "(?U)" if unicode else ""
    alternation = "|".join(["<VAR:[A-Z][A-Z0-9_]*>", *(f"(?:{s.run})" for s in bundle.slots)])
    found = F.regexp_extract_all(line, F.lit(flag + alternation), F.lit(0))

    def named(value: Column) -> Column:
        name = F.lit(None).cast("string")
        for s in reversed(bundle.slots):
            name = F.when(value.rlike(f"{flag}^(?:{s.run})$"), F.lit(s.name)).otherwise(name)
        return F.struct(name.alias("name"), value.alias("value"))

    own = F.filter(found, lambda v: ~v.rlike(f"^{RESERVED}$"))
    return F.transform(own, named)


def spans(line: Column, bundle: Bundle = DEFAULT, unicode: bool = True) -> Column:
    """Array of (name, start, end, value) of what ``mask`` replaces, with UTF-8 byte offsets.

    A match starts where the pieces before it end. Placeholders are passed over; a null
    line has no array.
    """
    pieces_, odd = _pieces(line, bundle, unicode)
    names = F.array(*(F.lit(s.name) for s in bundle.slots))
    kinds = F.transform(pieces_, lambda p, i: F.struct((i % (len(bundle.slots) + 2)).alias("k"), _unescaped(p, odd).alias("value")))
    full = F.filter(kinds, lambda p: p["value"] != "")
    span = lambda p, at: F.struct(p["k"].alias("k"), at.alias("at"), p["value"].alias("value"))
    none = F.array().cast("array<struct<k:int,at:int,value:string>>")

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    found = F.aggregate(
        full, zero, lambda acc, p: F.struct((acc["at"] + F.octet_length(p["value"])).alias("at"), F.concat(acc["out"], F.array(span(p, acc["at"]))).alias("out")), lambda acc: acc["out"]
    )
    slots = F.filter(found, lambda p: p["k"] > 1)
    out = F.transform(slots, lambda p: F.struct(F.get(names, p["k"] - 2).alias("name"), p["at"].alias("start"), (p["at"] + F.octet_length(p["value"])).alias("end"), p["value"].alias("value")))
    return F.when(line.isNotNull(), out)


def placeholders(template: Column) -> Column:
    """The slot names of a template, in order, with repeats."""
    return F.regexp_extract_all(template, F.lit(RESERVED), F.lit(1))


def slot_uses(template: Column) -> Column:
    """Array of (name, uses): distinct slots in order of first appearance."""
    names = placeholders(template)
    return F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("name"), F.size(F.filter(names, lambda x: x == n)).cast("long").alias("uses")))


def pieces(template: Column) -> Column:
    """Array of (text, slot): the template cut at its placeholders; empty texts are left out."""
    texts, names = F.split(template, RESERVED, -1), placeholders(template)
    both = F.flatten(
        F.transform(
            F.arrays_zip(texts.alias("t"), names.alias("n")),
            lambda p: F.array(F.struct(p["t"].alias("text"), F.lit(None).cast("string").alias("slot")), F.struct(F.lit(None).cast("string").alias("text"), p["n"].alias("slot"))),
        )
    )
    return F.filter(both, lambda p: (F.length(p["text"]) > 0) | p["slot"].isNotNull())


def register(spark, bundle: Bundle = DEFAULT) -> None:
    """Make ``mask_line(line)`` and ``template_id(template)`` callable from SQL, as expressions; lines have no control character 1."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION template_id(t STRING) RETURNS STRING RETURN concat('t_', sha2(t, 256))")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    tags = ", ".join(quoted(f"<VAR:{s.name}>") for s in bundle.slots)
    replaced = lambda pattern: f"regexp_replace(line, {quoted('(?U)' + pattern)}, {quoted(bundle.separated)})"
    holds = " OR ".join([f"contains(line, {quoted(x)})" for x in bundle.held] or ["true"])
    found = f"split(CASE WHEN {holds} THEN {replaced(bundle.grouped)} ELSE {replaced(bundle.lean)} END, {quoted(SEPARATOR)})"
    k = f"i % {len(bundle.slots) + 2}"
    body = f"array_join(transform({found}, (piece, i) -> CASE WHEN {k} <= 1 OR piece = '' THEN piece ELSE get(array({tags}), {k} - 2) END), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mask_line(line STRING) RETURNS STRING RETURN {body}")

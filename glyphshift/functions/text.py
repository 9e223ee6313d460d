"""Column functions on text: cleaning, script classes, layout shadows."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphshift import constants as K

#: Printable ASCII is ruled out first, as a class of many parts is slow to try.
SPACE = f"[[^!-~]&&[{K.SPACE_CLASS}]]"
#: What a tag, an entity, a link look like; the same patterns run in RE2.
DROPPED = ("pre", "blockquote", "code")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(K.SPACES))


def split_words(c: Column | str) -> Column:
    """Words between Unicode white space."""
    return F.array_remove(F.split(col(c), f"{SPACE}+"), "")


def strip_markup(c: Column | str) -> Column:
    """Text without pre, blockquote and code subtrees and without tags, stripped."""
    out = col(c)
    for tag in DROPPED:
        out = F.regexp_replace(out, f"(?is)<{tag}\\b.*?</{tag}\\s*>", "")
    return strip(F.regexp_replace(out, "(?s)<[^>]*>", ""))


#: What named references stand for, from the standard library's table of HTML 5; old names also count without a semicolon.
NAMED = {name: char for name, char in html5.items() if name.endswith(";")}
OLD = {name: char for name, char in html5.items() if not name.endswith(";")}
#: What numbers of C1 control characters stand for: the Windows characters at these places.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def lookup(table: dict, key: Column) -> Column:
    """The table's value, or null."""
    return F.element_at(F.from_json(F.lit(json.dumps({str(k): v for k, v in table.items()})), "map<string,string>"), key)


def of_number(n: Column) -> Column:
    """The character of a numeric reference: none for control characters and noncharacters, U+FFFD for zero and for numbers
    that no character has."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    beyond = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(beyond, "\ufffd").when(n.between(0x80, 0x9F), lookup(WINDOWS, n.cast("string"))).when(none, "").otherwise(char)


def unescape_entities(c: Column | str) -> Column:
    """One pass over the character references: decimal, hexadecimal and named ones. Unknown ones stay."""
    old = "^&(" + "|".join(sorted(OLD, key=lambda name: (-len(name), name))) + ")"

    def resolved(piece: Column) -> Column:
        """`piece` begins with its only ampersand, or has none."""
        behind = lambda pattern: F.regexp_replace(piece, pattern, "")
        part = lambda pattern: F.regexp_extract(piece, pattern, 1)
        decimal = F.conv(part("^&#0*([0-9]{1,9});?"), 10, 10).cast("long")
        hexadecimal = F.conv(part("^&#[xX]0*([0-9a-fA-F]{1,8});?"), 16, 10).cast("long")
        return (
            F.when(~piece.startswith("&"), piece)
            .when(piece.rlike("^&#[0-9]{1,9}(?![0-9])"), F.concat(of_number(decimal), behind("^&#[0-9]+;?")))
            .when(piece.rlike("^&#[xX][0-9a-fA-F]{1,8}(?![0-9a-fA-F])"), F.concat(of_number(hexadecimal), behind("^&#[xX][0-9a-fA-F]+;?")))
            .when(piece.rlike("^&#(?:[0-9]+|[xX][0-9a-fA-F]+)"), F.concat(F.lit("\ufffd"), behind("^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?")))
            .when(lookup(NAMED, part("^&([A-Za-z][A-Za-z0-9]*;)")).isNotNull(), F.concat(lookup(NAMED, part("^&([A-Za-z][A-Za-z0-9]*;)")), behind("^&[A-Za-z][A-Za-z0-9]*;")))
            .when(piece.rlike(old), F.concat(lookup(OLD, part(old)), behind(old)))
            .otherwise(piece)
        )

    every = F.array_join(F.transform(F.split(col(c), "(?=&)"), resolved), "")
    return F.when(F.contains(col(c), F.lit("&")), every).otherwise(col(c))


#: What links, emphasis, addresses and handles look like.
LINK, EMPHASIS = "\\[([^\\]]+)\\]\\([^)]+\\)", "\\*\\*|__|[*_]"
URL, HANDLE = 'https?://[^\\s<>"]+|www\\.[^\\s<>"]+', "@[\\p{L}\\p{N}_-]+"


def scrub(c: Column | str) -> Column:
    """Links to their labels, then without emphasis, addresses and handles, white space as single blanks."""
    out = F.regexp_replace(col(c), LINK, "$1")
    for pattern in (EMPHASIS, URL, HANDLE):
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, f"{SPACE}+", " "))


def is_tombstone(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).isin("", *K.TOMBSTONES)


def has_hebrew(c: Column | str) -> Column:
    return col(c).rlike("[\\u0590-\\u05FF]")


def has_english(c: Column | str) -> Column:
    return col(c).rlike("[A-Za-z]")


def has_nikud(c: Column | str) -> Column:
    return col(c).rlike("[\\u0591-\\u05C7]")


def shadow(c: Column | str, direction: str = "en_to_he") -> Column:
    """The characters that the same keys give on the other layout; unmapped ones stay."""
    source, target = (K.EN_FROM, K.EN_TO) if direction == "en_to_he" else (K.HE_FROM, K.HE_TO)
    return F.translate(col(c), source, target)


def strict_shadow(c: Column | str) -> Column:
    """Of a word of the 24 one-to-one letters its English shadow, else the empty string."""
    return F.when(F.translate(col(c), K.STRICT_FROM, "") == "", F.translate(col(c), K.STRICT_FROM, K.STRICT_TO)).otherwise("")


def delta(k: Column | str, params: K.Params = K.DEFAULTS) -> Column:
    """The threshold after k words."""
    return F.lit(params.baseline) + F.lit(params.alpha) * F.pow(col(k).cast("double"), F.lit(params.p))


def gap_category(c: Column | str) -> Column:
    size = F.abs(col(c))
    return F.when(size > 3, "|x| > 3").when(size > 2, "3 > |x| > 2").when(size > 1, "2 > |x| > 1").otherwise("1 > |x|")


#: Results of a running fold are gathered in pages of this size, so that n of them aren't copied n times.
PAGE = 64


def running(items: Column | str, state: Column, step, element: str) -> Column:
    """What `step(state, item)`, which returns the next state and an element, makes of each item in order."""
    kind = f"array<{element}>"
    start = F.struct(state.alias("state"), F.array().cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("full"))

    def go(acc: Column, x: Column) -> Column:
        after, made = step(acc["state"], x)
        this, ends = F.array(made).cast(kind), F.size(acc["open"]) >= PAGE
        return F.struct(after.alias("state"), F.when(ends, this).otherwise(F.concat(acc["open"], this)).alias("open"), F.when(ends, F.concat(acc["full"], F.array(acc["open"]))).otherwise(acc["full"]).alias("full"))

    return F.aggregate(col(items), start, go, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["open"]))))

"""Markup as columns: character references, text of a fragment, tokens of a page.

A fragment is read once from left to right, as a row of tokens: comments, declarations, whole script, style and
template elements, tags with quoted values, runs of text. Each token pattern either fails at
its first characters or takes what it has read, so the work is linear; loops are possessive, so
they take no stack. Where a quoted value never ends, the fragment is cut there: in
the rest a tag ends at the next '>'. An unclosed comment or raw element reaches the end of its part.

The patterns are written in Java's dialect; ``plain`` drops the possessive marks for engines that never backtrack.
"""

from __future__ import annotations

import json as _json
import re as _re
from html.entities import html5 as _html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, clean_text, let, remembered

# --- character references -----------------------------------------------------
# named references as the standard library tables them, those that need no semicolon included
NAMES = {"&" + name: text for name, text in _html5.items()}
# a longer unknown name may begin with one that needs no semicolon
PREFIX = "^&(?:" + "|".join(sorted((n for n in _html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
REFERENCE = r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;?)"
# sign and leading zeros of a numeric reference, then the digits that count
REF_DIGITS = r"^&#[xX]?0*([0-9a-fA-F]*)"
MAX_REF_DIGITS = 7  # more significant digits are beyond the last code point
# code points 128 to 159 are read as that byte of windows-1252, where it has a character
C1_CODES = tuple(ord(bytes([i]).decode("cp1252", "ignore") or chr(i)) for i in range(128, 160))
# fixed values: ranges of code points that are dropped, as the standard library drops them
DROPPED_CODES = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))


def _code_text(code: Column) -> Column:
    dropped = (code % 0x10000 >= 0xFFFE) & (code <= 0x10FFFF)
    for low, high in DROPPED_CODES:
        dropped = dropped | code.between(low, high)
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(dropped, F.lit("")).when(valid, char).otherwise(F.lit("�"))


def _number(ref: Column) -> Column:
    """Code point of a numeric reference; beyond the last one where there are too many digits."""
    c1 = F.array(*[F.lit(x).cast("bigint") for x in C1_CODES])

    def read(digits: Column) -> Column:
        code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10).try_cast("bigint")).otherwise(digits.try_cast("bigint"))
        code = F.when(F.length(digits) > MAX_REF_DIGITS, F.lit(0x110000)).otherwise(F.coalesce(code, F.lit(0))).cast("bigint")
        return let(code, lambda n: F.when(n.between(128, 159), F.get(c1, (n - 128).cast("int"))).otherwise(n))

    return let(F.regexp_extract(ref, REF_DIGITS, 1), read)


def _reference_text(ref: Column) -> Column:
    names = F.from_json(F.lit(_json.dumps(NAMES)), "map<string,string>")  # folded to one literal

    def text(table: Column) -> Column:
        def begun(known: Column) -> Column:
            """Text of the name that ref begins with, and the rest of ref as it is."""
            return F.when(known != "", F.concat(F.try_element_at(table, known), F.substring(ref, F.length(known) + 1, F.length(ref))))

        return F.coalesce(F.try_element_at(table, ref), let(F.regexp_extract(ref, PREFIX, 0), begun), ref)

    named = let(names, text)  # the table is in a plan once
    return F.when(F.startswith(ref, F.lit("&#")), let(_number(ref), _code_text)).otherwise(named)


def _decoded(text: Column) -> Column:
    refs = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    pieces = F.split(text, REFERENCE, -1)
    joined = let(
        F.struct(pieces.alias("p"), refs.alias("r")),
        lambda z: F.concat(F.get(z["p"], F.lit(0)), F.array_join(F.zip_with(F.transform(z["r"], _reference_text), F.slice(z["p"], 2, 1 << 30), lambda r, p: F.concat(r, p)), "")),
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


@remembered
def decode_entities(c) -> Column:
    """Decode numeric character references of any length and named ones, with or without their semicolon, in one pass.

    A code that is no character becomes U+FFFD, a control code nothing; an unknown name stays as it is.
    """
    return let(_col(c), _decoded)


def decode_each(texts: Column) -> Column:
    """``decode_entities`` of each text of an array."""
    return F.transform(texts, _decoded)


# --- tokens -------------------------------------------------------------------
_S = r" \t\n\r\f"
_VALUE = rf"""(?:'[^']*+'|"[^"]*+"|[^>{_S}'"][^>{_S}]*+)"""
#: One attribute with its value, if any.
ATTRIBUTE = rf"[^{_S}/>][^{_S}/=>]*+(?:[{_S}]*+=++[{_S}]*+{_VALUE})?+"
# after a tag's name: separators, attributes, attributes right behind a quoted value, a last '=' without value
_INSIDE = rf"(?:[{_S}/]++(?:{ATTRIBUTE})?+|[^{_S}/>=][^{_S}/=>]*+(?:[{_S}]*+=++[{_S}]*+{_VALUE})?+)*+(?:[{_S}]*+=++[{_S}]*+)?+>"
_TAG = rf"<[A-Za-z][^{_S}/>]*+{_INSIDE}"
_REST = r"|</[^>]*+>|<![^>]*+>|<\?[^>]*+>"  # end tags, declarations, processing instructions
_COMMENT = r"<!---?>|<!--.*?(?:--!?>|\z)"


def _raw(tag: str, opened: str) -> str:
    return rf"<(?i:{tag})(?:[{_S}/]{opened}|>).*?(?:</(?i:{tag})(?:[{_S}/][^>]*+)?+>|\z)"


def _markup(inside: str, tag: str) -> str:
    return "|".join([_COMMENT, *[_raw(t, inside) for t in ("script", "style", "template")], tag]) + _REST


#: Markup with quoted values, and markup whose tags end at the next '>'.
MARKUP = "(?s)(?:" + _markup(_INSIDE, _TAG) + ")"
SIMPLE = "(?s)(?:" + _markup("[^>]*+>", "<[A-Za-z][^>]*+>") + ")"
#: The longest beginning of a fragment that tokens cover ('<' before anything else is text), and its tokens.
HEAD = f"(?s)^(?:[^<]++|{MARKUP[4:]}|<(?![A-Za-z/!?]))*+"
TOKEN = f"{MARKUP[:-1]}|[^<]++|<)"
SIMPLE_TOKEN = f"{SIMPLE[:-1]}|[^<]++|<)"


def _at_mark(pattern: str) -> str:
    """The same markup, looked for at '<' only: elsewhere its alternatives need not be tried one after the other."""
    return pattern.replace("(?s)", "(?s)(?=<)", 1)


def plain(pattern: str) -> str:
    """The pattern without possessive marks and look-ahead."""
    return _re.sub(r"([*+?])\+", r"\1", pattern).replace("<(?![A-Za-z/!?])", "<[^A-Za-z/!?<]|<\\z")


def _behind(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def _parts(text: Column, whole, simple) -> Column:
    """whole(head), and where tokens don't cover the text, simple(the rest up to its last '>', what is behind that)."""

    def cut(head: Column, rest: Column) -> Column:
        last = F.substring_index(rest, ">", -1)
        return F.concat(whole(head), simple(F.substring(rest, F.lit(1), F.length(rest) - F.length(last)), last))

    return let(
        F.struct(text.alias("t"), F.regexp_extract(text, HEAD, 0).alias("h")),
        lambda z: F.when(F.length(z["h"]) == F.length(z["t"]), whole(z["h"])).otherwise(let(_behind(z["t"], z["h"]), lambda rest: cut(z["h"], rest))),
    )


@remembered
def markup_text(c) -> Column:
    """Text of a markup fragment: comments, script/style/template elements and tags dropped, character
    references decoded, whitespace collapsed."""

    def text(s: Column) -> Column:
        bare = _parts(s, lambda h: F.regexp_replace(h, _at_mark(MARKUP), " "), lambda r, last: F.concat(F.regexp_replace(r, _at_mark(SIMPLE), " "), last))
        return F.when(F.contains(s, F.lit("<")), bare).otherwise(s)

    return clean_text(decode_entities(let(F.coalesce(_col(c), F.lit("")), text)))


@remembered
def html_to_text(c) -> Column:
    """Markup to whitespace-collapsed text.

    Escaped markup is decoded first (payloads often carry ``&lt;p&gt;``),
    then the fragment's text is taken with ``markup_text``.
    """
    return markup_text(decode_entities(F.coalesce(_col(c), F.lit(""))))


@remembered
def tokens(c) -> Column:
    """The tokens of a fragment in order; put together they are the fragment, but for '<' of an
    unfinished tag at its end, which comes as its reference."""
    s = F.coalesce(_col(c), F.lit(""))

    def found(pattern: str):
        return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    return _parts(s, found(TOKEN), lambda r, last: F.concat(found(SIMPLE_TOKEN)(r), F.array(F.replace(last, F.lit("<"), F.lit("&lt;")))))


def is_markup(token: Column) -> Column:
    return F.startswith(token, F.lit("<")) & (F.length(token) > 1)


_NAME = rf"(?s)^[^{_S}/>][^{_S}/=>]*"


def attributes(tag: Column, names: tuple[str, ...]) -> Column:
    """Raw values of a start tag's attributes: one array entry for each name, null where the tag has none; of
    equal names the last one counts, a name without value has an empty one."""
    inside = F.regexp_replace(tag, rf"^<[^{_S}/>]*|>$", "")

    def last(found: Column, name: str) -> Column:
        own = F.get(F.slice(F.filter(found, lambda a: F.lower(F.regexp_extract(a, _NAME, 0)) == name), -1, 1), F.lit(0))
        value = F.regexp_replace(own, rf"(?s)^[^{_S}/>][^{_S}/=>]*[{_S}]*=*[{_S}]*", "")
        return F.regexp_replace(value, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")

    def read(found: Column) -> Column:
        return F.array(*[last(found, n) for n in names])

    return let(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0)), read)

"""Regex dialect helpers.

Patterns are written once in the common dialect (``\\b``, ``\\s``).  Python's
``\\s`` and ``\\b`` are Unicode-aware; Java's and RE2's are not (or only in
part), so both are rewritten into explicit classes before a pattern reaches
an engine:

* ``\\s`` becomes the class of every character Python's ``str.isspace`` accepts.
* In Java, ``\\b`` becomes a look-around boundary over ``[\\p{L}\\p{N}_]``.
* RE2 has no look-around; its ASCII ``\\b`` is kept, and the *text* is mapped
  so that every non-ASCII letter or digit becomes ``x`` (``ascii_word_text``),
  which keeps each character's word / non-word class and every length.
"""

from __future__ import annotations

# Characters Python's str.isspace() accepts, as a character-class body that
# both Java and RE2 read the same way.
WS_CLASS_BODY = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CLASS = "[" + WS_CLASS_BODY + "]"
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
_JAVA_BOUNDARY = (
    r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
)
_SPECIAL = set("\\.^$|?*+()[]{}")


def escape(literal: str) -> str:
    """Backslash-escape regex metacharacters (accepted by Java and RE2)."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in literal)


def _rewrite(pattern: str, boundary: str) -> str:
    out = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_CLASS_BODY if in_class else WS_CLASS)
            elif nxt == "b" and not in_class:
                out.append(boundary)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def java_pattern(pattern: str, ignore_case: bool) -> str:
    body = _rewrite(pattern, _JAVA_BOUNDARY)
    return ("(?iu)" if ignore_case else "") + body


def re2_pattern(pattern: str, ignore_case: bool) -> str:
    body = _rewrite(pattern, r"\b")
    return ("(?i)" if ignore_case else "") + body


def java_word(literal: str) -> str:
    """Whole-word test for a literal: not preceded or followed by a word char.

    The literal comes first and what stands before it is tested after it, so places without the literal
    are passed by at once; a look-behind in front would be tried at every character.
    """
    word = escape(literal)
    return word + r"(?<![\p{L}\p{N}_]" + word + r")(?![\p{L}\p{N}_])"


def re2_word(literal: str) -> str:
    """Same test without look-around (consuming classes; fine for existence)."""
    return "(^|" + NON_WORD_CLASS + ")" + escape(literal) + "($|" + NON_WORD_CLASS + ")"


def sql_str(value: str) -> str:
    """Single-quoted SQL string literal (quotes doubled; no backslash escapes)."""
    return "'" + value.replace("'", "''") + "'"

r"""Python patterns for Java's engine.

A pattern is parsed by Python itself, and Java syntax is written from the tree, so that both read it alike: classes may hold
brackets and `&&`, `\w`, `\d` and `\s` mean what they mean in Python, `$` also stands before a last line feed, flags are those in the pattern.
What has no equal in Java (conditional groups) is an error.
"""

from __future__ import annotations

import re
from re import _constants as op, _parser

MOST = int(op.MAXREPEAT)
#: Members of the categories: of Unicode, and of ASCII.
MEMBERS = {"digit": (r"\p{Nd}", "0-9"), "space": (r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", r"\t-\r\x20"),
           "word": (r"\p{L}\p{N}_", "a-zA-Z0-9_")}
ANY = "(?s:.)"


def java_regex(pattern: str) -> str:
    """The pattern as Java reads it. Groups have the same numbers; names are given up."""
    tree = _parser.parse(pattern)
    return _sequence(tree, tree.state.flags)


def _sequence(items, flags: int) -> str:
    return "".join(_item(kind, value, flags) for kind, value in items)


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:X}}}"


def _cased(text: str, flags: int) -> str:
    return f"(?i{'' if flags & re.ASCII else 'u'}:{text})" if flags & re.IGNORECASE else text


def _members(name, flags: int) -> tuple[str, bool]:
    """The category's members, and whether it means all others."""
    words = str(name).lower().split("_")  # CATEGORY_NOT_DIGIT
    return MEMBERS[words[-1]][1 if flags & re.ASCII else 0], "not" in words


def _class(items, flags: int) -> str:
    negated, inside, others = False, "", []
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            inside += _char(value)
        elif kind is op.RANGE:
            inside += f"{_char(value[0])}-{_char(value[1])}"
        else:
            members, rest = _members(value, flags)
            if rest:
                others.append(f"[^{members}]")
            else:
                inside += members
    either = "|".join(([_cased(f"[{inside}]", flags)] if inside else []) + others)
    return f"(?:(?!{either}){ANY})" if negated else f"(?:{either})"


def _at(where, flags: int) -> str:
    word = f"[{MEMBERS['word'][1 if flags & re.ASCII else 0]}]"
    many = flags & re.MULTILINE
    return {op.AT_BEGINNING: r"(?:\A|(?<=\n))" if many else r"\A", op.AT_BEGINNING_STRING: r"\A",
            op.AT_END: r"(?=\n|\z)" if many else r"(?=\n?\z)", op.AT_END_STRING: r"\z",
            op.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            op.AT_NON_BOUNDARY: rf"(?:(?!\A\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word})))"}[where]


def _item(kind, value, flags: int) -> str:
    if kind is op.LITERAL:
        return _cased(_char(value), flags)
    if kind is op.NOT_LITERAL:
        return f"(?:(?!{_cased(_char(value), flags)}){ANY})"
    if kind is op.ANY:
        return ANY if flags & re.DOTALL else r"[^\n]"
    if kind is op.IN:
        return _class(value, flags)
    if kind is op.CATEGORY:
        members, rest = _members(value, flags)
        return f"[{'^' if rest else ''}{members}]"
    if kind is op.AT:
        return _at(value, flags)
    if kind is op.BRANCH:
        return f"(?:{'|'.join(_sequence(b, flags) for b in value[1])})"
    if kind is op.SUBPATTERN:
        group, added, removed, inner = value
        return f"({'' if group else '?:'}{_sequence(inner, (flags | added) & ~removed)})"
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        times = f"{{{low},{'' if int(high) == MOST else high}}}"
        return f"(?:{_sequence(inner, flags)}){times}{ {op.MIN_REPEAT: '?', op.POSSESSIVE_REPEAT: '+'}.get(kind, '')}"
    if kind is op.GROUPREF:
        return _cased(f"(?:\\{value})", flags)
    if kind in (op.ASSERT, op.ASSERT_NOT):
        ahead, inner = value
        return f"(?{'' if ahead > 0 else '<'}{'=' if kind is op.ASSERT else '!'}{_sequence(inner, flags)})"
    if kind is op.ATOMIC_GROUP:
        return f"(?>{_sequence(value, flags)})"
    if kind is op.FAILURE:
        return "(?!)"
    raise ValueError(f"{str(kind).lower()} is not supported on Spark")

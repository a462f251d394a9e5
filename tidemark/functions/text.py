r"""Text cleaning expressions. Null stays null in all of them.

Java's `\s` is ASCII only unless the (?U) flag is set, so the whitespace class here carries it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .patterns import java_regex

SPACE = r"(?U)\s+"
MARK = "\ue000"   # a private-use character, which has no meaning in text


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def title_case(c: Column) -> Column:
    """Capital after every non-letter: `it's a-b` becomes `It'S A-B`.

    `initcap` starts a word after a space only, so a marked space goes in before each run of letters.
    """
    marked = F.regexp_replace(c, r"(?<=\P{L})(?=\p{L})", MARK + " ")
    return F.replace(F.initcap(marked), F.lit(MARK + " "), F.lit(""))


def regex_replace(c: Column, pattern: str, replacement: str = "") -> Column:
    r"""Replace by pattern; `\1` and `\g<1>` group references are understood, `$` is plain text."""
    if not pattern:
        return c
    java = replacement.replace("$", r"\$")
    groups = re.compile(pattern).groupindex
    java = re.sub(r"\\g<(\w+)>", lambda m: "$" + (m[1] if m[1].isdigit() else str(groups[m[1]])), java)
    java = re.sub(r"\\(\d+)", r"$\1", java)
    return F.regexp_replace(c, F.lit(java_regex(pattern)), F.lit(java))


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085\u001c-\u001f]", "")


def squeeze_space(c: Column) -> Column:
    return trim(F.regexp_replace(c, SPACE, " "))


def _words(c: Column) -> Column:
    """Runs of ASCII letters and digits, one space apart."""
    return F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9]+", " "))


def snake_case(c: Column) -> Column:
    return F.lower(F.replace(_words(c), F.lit(" "), F.lit("_")))


def camel_case(c: Column) -> Column:
    """First word lower, the rest capitalised; text without any word stays as it is."""

    def joined(words: Column) -> Column:
        first = F.substring_index(words, " ", 1)
        rest = F.initcap(words.substr(F.length(first) + 1, F.length(words)))
        return F.when(words != "", F.concat(F.lower(first), F.replace(rest, F.lit(" "), F.lit("")))).otherwise(c)

    # A one-element array holds the words, so that they are made once per row.
    return F.element_at(F.transform(F.array(_words(c)), joined), 1)


METHODS = {
    "trim": lambda c, cfg: trim(c),
    "lowercase": lambda c, cfg: F.lower(c),
    "uppercase": lambda c, cfg: F.upper(c),
    "title_case": lambda c, cfg: title_case(c),
    "regex_replace": lambda c, cfg: regex_replace(
        c, cfg.get("pattern", cfg.get("regex", "")), cfg.get("replacement", "")),
    "remove_special": lambda c, cfg: remove_special(c),
    "standardize_whitespace": lambda c, cfg: squeeze_space(c),
    "snake_case": lambda c, cfg: snake_case(c),
    "camel_case": lambda c, cfg: camel_case(c),
}

"""Small text helpers: every one is a Column built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a log collector strips from both ends of a line.
LINE_BLANKS = (
    " \t\n\r\u000b\u000c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Separates groups inside the parse job. A text may hold it all the same (bytes EF BF BF), so it is
# hidden first, and shown again in what the job returns: HIDE begins a pair that stands for one of
# the two characters. All of them are non-characters, alike to every pattern.
MARK, HIDE = "\uffff", "\ufffe"
PAIRS = {HIDE: HIDE + "\ufdd0", MARK: HIDE + "\ufdd1"}


def hide_marks(col: Column) -> Column:
    hidden = col
    for plain, pair in PAIRS.items():
        hidden = F.replace(hidden, F.lit(plain), F.lit(pair))
    return F.when(col.contains(HIDE) | col.contains(MARK), hidden).otherwise(col)


def show_marks(col: Column) -> Column:
    shown = col
    for plain, pair in reversed(PAIRS.items()):
        shown = F.replace(shown, F.lit(pair), F.lit(plain))
    return F.when(col.contains(HIDE), shown).otherwise(col)


def strip_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(LINE_BLANKS))


def not_blank(col: Column) -> Column:
    return col.rlike(f"[^{LINE_BLANKS}]")


def absent_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def leading_int(col: Column) -> Column:
    """The 32-bit integer a text starts with, or NULL; a number beyond that is NULL too, as no port,
    length or score needs more. Only digits reach the cast: a failing one costs an exception per row."""
    digits = r"^\s*([+-]?\d+)"
    return F.when(col.rlike(digits), F.regexp_extract(col, digits, 1).try_cast("int"))


def match_text(col: Column, candidates: list[tuple[str, str, int]]) -> Column:
    """Match once and keep the groups: ``MARK name MARK group1 MARK group2 ...``.

    ``candidates`` are (name, pattern, number of groups), tried in order; the first that matches
    rewrites the text, and a rewritten text is left alone by the later ones. A text that none
    matches comes back unchanged. A group that took no part is empty.
    """
    for name, pattern, groups in candidates:
        lead = rf"\A(?!{MARK})" if pattern.startswith("^") else rf"(?s:\A(?!{MARK}).*?)"
        picked = "".join(f"{MARK}${i}" for i in range(1, groups + 1))
        col = F.regexp_replace(
            col, rf"{lead}(?:{pattern.removeprefix('^')})(?s:.*)\z", f"{MARK}{name}{picked}"
        )
    return col


def split_match(matched: Column) -> Column:
    """``['', name, group1, ...]`` of a :func:`match_text`, NULL when nothing matched."""
    return F.when(matched.startswith(MARK), F.split(matched, MARK))


def pair_text(col: Column, pattern: str, sep: str) -> Column:
    """All ``key=value`` matches of ``pattern`` in reading order, each one between separators.

    ``sep`` must be a character that ``pattern`` can never match.
    """
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    return F.concat(F.lit(sep), F.array_join(found, sep), F.lit(sep))


def last_value(pairs: Column, key: str, sep: str) -> Column:
    """Value of the last pair with this key in a :func:`pair_text`; NULL when there is none."""
    head = f"{sep}{key}="
    tail = F.substring_index(pairs, head, -1)
    return F.when(pairs.contains(head), F.substring_index(tail, sep, 1))

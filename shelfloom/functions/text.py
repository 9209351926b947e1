"""Text keys as column expressions: folding, title, author and stable keys, display text."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, also no-break space, byte-order mark and the Unicode space separators.
SPACE = "[\\s\\x{A0}\\x{FEFF}\\p{Zs}\\x{2028}\\x{2029}]+"


def clean(value: Column) -> Column:
    """Trimmed, white space as one space; null if nothing is left."""
    text = F.trim(F.regexp_replace(value, SPACE, " "))
    return F.when(text != "", text)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that NFKD without marks turns into one ASCII letter or digit, those, and what others turn into."""
    source, target, longer = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        flat = "".join(c for c in unicodedata.normalize("NFKD", char) if not "̀" <= c <= "ͯ")
        if flat != char and flat.isascii() and any(c.isalnum() for c in flat):
            if len(flat) == 1:
                source.append(char)
                target.append(flat)
            else:
                longer[char] = flat
    return "".join(source), "".join(target), longer


def fold(value: Column) -> Column:
    """Cleaned, compatibility-decomposed, without accents, in lower case; empty if null."""
    source, target, longer = _folds()
    text = F.coalesce(F.trim(F.regexp_replace(value, SPACE, " ")), F.lit(""))
    plain = F.translate(F.regexp_replace(text, "[\\x{0300}-\\x{036F}]", ""), source, target)
    parts = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in longer.items())), F.lit("\x01"), F.lit("\x02"))  # one literal, folded once
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(parts, c), c)), "")
    # ASCII text, most of it, has nothing to decompose
    ascii_only = F.octet_length(value) == F.char_length(value)
    return F.lower(F.when(ascii_only, text).when(F.regexp_like(plain, F.lit("[" + "".join(longer) + "]")), spelled).otherwise(plain))


def title_key(title: Column) -> Column:
    """Letters and digits with single spaces, without one leading article."""
    bare = F.regexp_replace(F.regexp_replace(fold(title), "['’]", ""), "[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(bare), r"^(?:the|an|a)\s+", "")


def author_key(author: Column) -> Column:
    """As a title key, but with `last, first` turned round."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(fold(author), "['’]", ""), "[^a-z0-9,]+", " "))
    return F.trim(F.regexp_replace(bare, r"^(.+),\s*(.+)$", "$2 $1"))


def stable_key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Words in a trailing bracket that tell an edition of another kind from the work itself.
KIND_IN_BRACKET = r"(?i)\b(?:audio|audiobook|graphic|guide|study|summary|companion|omnibus|collection|box set|movie|film|adaptation)\b"


def work_title_key(title: Column) -> Column:
    """Title key without a bracket at the end, unless the bracket names a kind of edition."""
    bracket = F.regexp_extract(title, r"\(([^()]*)\)\s*$", 1)
    ends = F.regexp_like(title, F.lit(r"\([^()]*\)\s*$")) & ~F.regexp_like(bracket, F.lit(KIND_IN_BRACKET))
    return title_key(F.when(ends, F.regexp_replace(title, r"\s*\([^()]*\)\s*$", "")).otherwise(title))


def work_identity(title: Column, author: Column) -> Column:
    """Key of a work; null unless both parts have one."""
    t, a = work_title_key(title), author_key(author)
    return F.when((t != "") & (a != ""), F.concat_ws("\u0000", t, a))


def display_text(value: Column, most: int) -> Column:
    """Control characters as spaces, white space collapsed, at most so many code points."""
    return F.left(F.coalesce(clean(F.regexp_replace(value, "[\\x00-\\x1f\\x7f-\\x9f]", " ")), F.lit("")), F.lit(most))


def other_script(title: Column) -> Column:
    """Letters, but none of them Latin."""
    return F.regexp_like(title, F.lit(r"\p{L}")) & ~F.regexp_like(title, F.lit(r"\p{IsLatin}"))


def holds(value: Column, part: str | Column) -> Column:
    """Whether value contains part, literally and in any case."""
    return F.contains(F.lower(value), F.lower(F.lit(part) if isinstance(part, str) else part))

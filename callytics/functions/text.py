"""Text helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# Every character that counts as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def normalize_code(code: Column) -> Column:
    return F.upper(strip(code))


def is_blank(text: Column) -> Column:
    """True for null and for the empty string (white space is not blank here)."""
    return F.coalesce(text, F.lit("")) == ""


def _trie(words: Iterable[str]) -> str:
    """A pattern for the longest of the words at a place, branching character by character."""
    branches: dict[str, list[str]] = {}
    ends = False
    for word in words:
        if word:
            branches.setdefault(word[0], []).append(word[1:])
        else:
            ends = True
    parts = [re.sub(r"[^\w\s]", r"\\\g<0>", c) + _trie(rest) for c, rest in sorted(branches.items())]
    if not parts:
        return ""
    joined = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return joined + "?" if ends else joined


def longest_words(lowered: Column, words: Iterable[str]) -> Column:
    """The longest of the words at each place of the text, each once, in one scan for all words. They may overlap."""
    known = sorted({w.lower() for w in words} - {""})
    if not known:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?=({_trie(known)}))"), F.lit(1)))


def with_nested(longest: Column, words: Iterable[str]) -> Column:
    """All words that occur, from `longest_words`: shorter words that begin at a place are the beginnings of the longest."""
    known = sorted({w.lower() for w in words} - {""})
    inner = {w: [v for v in known if v != w and w.startswith(v)] for w in known}
    nested = {w: shorter for w, shorter in inner.items() if shorter}
    if not nested:
        return longest
    listed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in nested.items() for x in pair])
    more = F.flatten(F.transform(longest, lambda w: F.coalesce(F.element_at(listed, w), F.array().cast("array<string>"))))
    return F.array_union(longest, more)


def any_of(found: Column, words: Sequence[str]) -> Column:
    """Whether one of the words is among those found."""
    return F.arrays_overlap(found, F.array(*[F.lit(w.lower()) for w in words])) if words else F.lit(False)


def those_of(found: Column, words: Sequence[str]) -> Column:
    """The words among those found, in list order, repeats in the list kept."""
    if not words:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(found, F.lower(w)))


def tab_name(display_name: Column, agent_id: Column) -> Column:
    """Sheet tab of an agent: cleaned name, first 94 characters, last 6 of the id."""
    # Removed characters, fallback name, lengths.
    cleaned = strip(F.regexp_replace(display_name, r"[\[\]*?/\\]", ""))
    named = F.when(is_blank(cleaned), F.lit("Agente")).otherwise(cleaned)
    return F.concat(F.substring(named, 1, 94), F.lit("_"), F.right(agent_id, F.lit(6)))

"""Compiling a pre-token pattern for speed.

Patterns of byte-level vocabularies use Unicode properties, which the standard
``re`` module lacks and the ``regex`` module tests slowly.  The character
classes are spelled out here as ranges of code points, asked of ``regex`` once,
so that ``re`` gives the same matches faster.  ``re`` looks up the first 65,536
code points at once but searches those beyond one range after another, so the
latter stand in a branch of their own that is entered only for such characters.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache

import regex

_CLASS = re.compile(r"(\\p\{\w+\}|\\[sS]|\[\^?(?:\\.[^\]\\]*|[^\]\\])*?\]|\\.)(\+)?")
_HIGH = r"(?=[\U00010000-\U0010ffff])"


@lru_cache(maxsize=1)
def _all_characters() -> str:
    # a surrogate takes its own place, so an offset is a code point
    return "".join(map(chr, range(sys.maxunicode + 1)))


def _spelled(first: int, last: int) -> str:
    return f"\\U{first:08x}-\\U{last:08x}"


@lru_cache(maxsize=16)
def class_ranges(expression: str) -> tuple[str, str]:
    """What a class of ``regex`` matches, as the insides of two classes: below and from U+10000."""
    low, high = [], []
    for m in regex.finditer(f"(?:{expression})+", _all_characters()):
        first, last = m.start(), m.end() - 1
        if first <= 0xFFFF:
            low.append(_spelled(first, min(last, 0xFFFF)))
        if last > 0xFFFF:
            high.append(_spelled(max(first, 0x10000), last))
    return "".join(low), "".join(high)


def _as_ranges(expression: str, repeat: str) -> str:
    low, high = class_ranges(expression)
    branches = [f"[{low}]{repeat}"] * bool(low) + [f"{_HIGH}[{high}]{repeat}"] * bool(high)
    return f"(?:{'|'.join(branches)}){repeat if len(branches) > 1 else ''}"


@lru_cache(maxsize=8)
def piece_finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern, on ``re`` where the pattern has no escapes but ``\\p{..}``, ``\\s``, ``\\S`` and classes."""
    parts, at = [], 0
    for m in _CLASS.finditer(pattern):
        if m[1][0] == "\\" and not re.match(r"\\(p\{|[sS]$)", m[1]):
            return regex.compile(pattern).findall
        parts += [pattern[at : m.start()], _as_ranges(m[1], m[2] or "")]
        at = m.end()
    fast = re.compile("".join([*parts, pattern[at:]]))
    return regex.compile(pattern).findall if fast.groups else fast.findall

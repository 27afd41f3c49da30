"""Compiler of search queries: text -> regular expressions.

Terms are globs: ``*`` is any run of characters on a line, ``?`` one character. A term whose
first or last character is an ASCII letter, digit or underscore must begin or end at a word
boundary there. ``engine`` picks the dialect: Java's ``\\b`` follows Unicode, so boundaries
become explicit ASCII lookarounds there.
"""

from __future__ import annotations

import re

_WORD = re.compile(r"[A-Za-z0-9_]")
_SPECIAL = frozenset(".+^${}()|[]\\")


def term_regex(term: str, engine: str = "java") -> str:
    """One glob term as a regular expression without flags."""
    # in Java the boundary stands behind the first character, so only places that have it pay for the look back
    left, right = (f"{term[0]}(?<![A-Za-z0-9_]{term[0]})", "(?![A-Za-z0-9_])") if engine == "java" else (r"\b", r"\b")
    wild = {"*": r"[^\n]*", "?": r"[^\n]"}
    body = "".join(wild.get(c) or ("\\" + c if c in _SPECIAL else c) for c in term)
    if _WORD.match(term[0]):
        body = left + (body[1:] if engine == "java" else body)
    return body + (right if _WORD.match(term[-1]) else "")


def tokens(query: str) -> list[tuple[str, ...]]:
    """Terms of a query; a group ``(a|b)`` gives its alternatives.

    Parentheses without a bar stand for themselves, an open one takes the rest of the query,
    and a group without alternatives vanishes. Only blanks and tabs separate.
    """
    out: list[tuple[str, ...]] = []
    rest = query
    while rest := rest.lstrip(" \t"):
        if rest[0] != "(":
            end = min((k for k in (rest.find(" "), rest.find("\t")) if k >= 0), default=len(rest))
            out.append((rest[:end],))
        elif (end := rest.find(")") + 1) == 0:
            out.append((rest,))
            break
        elif "|" in rest[:end]:
            if group := tuple(filter(None, (a.strip() for a in rest[1 : end - 1].split("|")))):
                out.append(group)
        else:
            out.append((rest[:end],))
        rest = rest[end:]
    return out


def patterns(query: str, engine: str = "java") -> list[str]:
    """One regular expression for each term or group: what ranked search looks for."""
    return [_anchored(group[0], engine) if len(group) == 1 else "|".join(term_regex(t, engine) for t in group) for group in tokens(query.strip())]


def _anchored(term: str, engine: str) -> str:
    """A term that begins with ``*`` matches from the line's start on, so a backtracking engine need not try other places."""
    body = term_regex(term, engine)
    return f"(?md:^){body}" if engine == "java" and term[0] == "*" else body


def any_pattern(query: str, engine: str = "java") -> str:
    """All blank-separated terms in one alternation."""
    return "|".join(term_regex(t, engine) for t in query.split())


def all_patterns(query: str, engine: str = "java") -> list[str]:
    """One regular expression for each blank-separated term, all of which must match."""
    return [term_regex(t, engine) for t in query.split()]


def line_glob(pattern: str) -> str:
    """A glob without word boundaries, for the line filter."""
    wild = {"*": ".*", "?": "."}
    return "".join(wild.get(c) or ("\\" + c if c in _SPECIAL else c) for c in pattern)


_W = "[A-Za-z0-9_]"
_BOUNDARIES = {r"\b": f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))", r"\B": f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"}
_PIECES = re.compile(r"\\Q.*?(?:\\E|\Z)|\\b\{g\}|\\.|\[|\]|.", re.S)


def ascii_boundaries(pattern: str) -> str:
    """A regular expression for Java whose ``\\b`` and ``\\B`` outside of character classes are those of ASCII words."""
    out, depth = [], 0
    for piece in _PIECES.findall(pattern):
        depth = max(0, depth + (piece == "[") - (piece == "]"))
        out.append(piece if depth else _BOUNDARIES.get(piece, piece))
    return "".join(out)


def search_patterns(query: str, is_regex: bool = False, engine: str = "java") -> list[str]:
    """Patterns with their flags: globs ignore ASCII case, a regular expression is taken as it is, but for word boundaries."""
    if is_regex:
        own = query.strip()
        return [ascii_boundaries(own) if engine == "java" else own] if own else []
    return [f"(?i){p}" if "|" not in p else f"(?i)(?:{p})" for p in patterns(query, engine)]

"""Path globs and index membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = frozenset(".+^$()|\\")


def _body(glob: str) -> str:
    out, k, depth = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] in "/{,"):
            out.append(r"(?:.*[/\\])?")
            k += 3
            continue
        if glob.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "*":
            out.append(r"[^/\\]*")
        elif c == "?":
            out.append(r"[^/\\]")
        elif c == "/":
            out.append(r"[/\\]")
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            inside = glob[k + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            k = end
        elif c == "{" and "}" in glob[k:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if c in _SPECIAL or c in "[]{}" else c)
        k += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """A path glob (``*``, ``?``, ``**``, ``[..]``, ``{a,b}``) as an anchored regular expression.

    Slashes and backslashes both separate.
    """
    return f"^{_body(glob)}$"


def split_globs(text: str | None) -> list[str]:
    """Comma-separated globs."""
    return [g for g in (p.strip() for p in (text or "").split(",")) if g]


def selected(path: Column, include: str | None = None, exclude: str | None = None, nocase: bool = True) -> Column:
    """Any include glob matches (or there is none) and no exclude glob does."""
    flag = "(?iu)" if nocase else ""
    keep = F.lit(True)
    if wanted := split_globs(include):
        keep = path.rlike(flag + "|".join(f"(?:{glob_regex(g)})" for g in wanted))
    if unwanted := split_globs(exclude):
        keep = keep & ~path.rlike(flag + "|".join(f"(?:{glob_regex(g)})" for g in unwanted))
    return keep


def include_dirs(configured: list[str], workspace: list[str], knowledge_base: str | None = None) -> list[str]:
    """Configured directories, or the workspace's, with the knowledge base; none inside another."""
    dirs = list(configured or workspace)
    if knowledge_base and knowledge_base not in dirs:
        dirs.append(knowledge_base)
    return outermost(dirs)


def outermost(dirs: list[str]) -> list[str]:
    """Directories that don't lie in another one of the list, sorted without regard to case."""
    kept: list[str] = []
    for d in sorted((d.rstrip("/") or "/" for d in dirs), key=lambda d: (d.lower(), d)):
        if not any(d.lower().startswith(k.lower().rstrip("/") + "/") for k in kept):
            kept.append(d)
    return kept


def member(path: Column, extensions: list[str], dirs: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a file belongs to the index: its extension, a directory above it, no exclude glob."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"[^/\\]+$", 0)
    keep = F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1).isin([e.lower() for e in extensions])
    if dirs:
        under = F.lit(False)
        for d in dirs:
            under = under | low.startswith(d.lower().rstrip("/") + "/")
        keep = keep & under
    for glob in exclude:
        keep = keep & ~path.rlike(glob_regex(glob))
    return keep

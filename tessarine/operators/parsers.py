"""Parsers of source files: symbols and structure-aware chunks.

A parser is any object with ``symbols(text)``, giving rows of schema.SYMBOL, and
``chunks(lines, symbols, path)``, giving (start, end, text) with lines from 0 and the end
exclusive. PARSERS maps extensions to them; other files go to the default parser.

Columns and budgets count UTF-16 code units.
"""

from __future__ import annotations

import re

from tessarine.functions.text import CPP_EXTENSIONS
from tessarine.schema import CALLABLE, CHUNK_CONTAINER, SYMBOL_TYPES

BUDGET, OVERLAP, LEAST = int(1024 * 3.5), 8, 75

_COLUMNS = (
    "type", "name", "start_line", "start_column", "end_line", "end_column", "name_start_line", "name_start_column", "name_end_line",
    "name_end_column", "scope", "fully_qualified_name", "signature", "header_end_line", "header_end_column",
)


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def symbol(kind: int, name: str, start: tuple, end: tuple, name_start: tuple, name_end: tuple, scope=None, fqn=None, signature=None, header=(None, None)) -> dict:
    return dict(zip(_COLUMNS, (kind, name, *start, *end, *name_start, *name_end, scope, fqn, signature, *header), strict=True))


def pack(lines: list[str], start: int, end: int, boilerplate=None) -> list[tuple[int, int, str]]:
    """Greedy packing of lines start .. end into chunks of BUDGET characters that overlap by OVERLAP lines.

    A line over the budget is a chunk of its own; blank lines around a chunk don't belong to
    it, and chunks of under LEAST characters, or that the predicate names boilerplate, are left out.
    """
    out, at = [], start
    while at < end:
        size, stop = 0, end
        for k in range(at, end):
            size += units(lines[k]) + 1
            if size > BUDGET:
                stop = max(k, at + 1)
                break
        first, last = at, stop
        while first < stop and not lines[first].strip():
            first += 1
        while last > first and not lines[last - 1].strip():
            last -= 1
        text = "\n".join(lines[first:last])
        bare = text.strip()
        if bare and units(bare) >= LEAST and not (boilerplate and boilerplate(bare)):
            out.append((first, last, text))
        if stop >= end:
            break
        at = max(stop - OVERLAP, at + 1)
    return out


class PlainParser:
    """No symbols; chunks without a prefix."""

    version = 1

    def symbols(self, text: str) -> list[dict]:
        return []

    def chunks(self, lines: list[str], symbols: list[dict], path: str) -> list[tuple[int, int, str]]:
        return pack(lines, 0, len(lines))


class MarkdownParser:
    """Headings of the first two levels and the sections below them."""

    version = 1
    _heading = re.compile(r"( {0,3})(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\r?$")
    _fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")

    def symbols(self, text: str) -> list[dict]:
        lines = text.split("\n")
        found, fence = [], None
        for k, line in enumerate(lines):
            mark = self._fence.match(line)
            if fence:
                if mark and mark[1].startswith(fence) and not mark[2].strip():
                    fence = None
                continue
            if mark and not (mark[1][0] == "`" and "`" in mark[2]):
                fence = mark[1]
                continue
            head = self._heading.match(line)
            if head and len(head[2]) <= 2 and (name := (head[3] or "").strip()):
                column = units(line[: head.start(3)])
                found.append((k, len(head[2]), name, len(head[1]), column))
        out = []
        for i, (k, level, name, indent, column) in enumerate(found):
            end = next((k2 for k2, level2, *_ in found[i + 1 :] if level2 <= level), len(lines)) - 1
            while end > k and lines[end] == "":
                end -= 1
            out.append(symbol(79 + level, name, (k, indent), (end, units(lines[end])), (k, column), (k, column + units(name))))
        return out

    def sections(self, lines: list[str], symbols: list[dict]) -> list[tuple[int, int, str]]:
        """(start, end, breadcrumb) of sections with a body; a first-level one ends at the next heading in it."""
        out, top = [], None
        marks = sorted((s for s in symbols if s["type"] in (80, 81)), key=lambda s: s["start_line"])
        for k, s in enumerate(marks):
            start, end, crumb = s["start_line"], s["end_line"] + 1, s["name"]
            if s["type"] == 80:
                top = (start, end, crumb)
                if k + 1 < len(marks) and marks[k + 1]["start_line"] < end:
                    end = marks[k + 1]["start_line"]
            elif top and start >= top[0] and end <= top[1]:
                crumb = f"{top[2]} > {crumb}"
            if any(line.strip() for line in lines[s["name_end_line"] + 1 : end]):
                out.append((start, end, crumb))
        return out

    def chunks(self, lines: list[str], symbols: list[dict], path: str) -> list[tuple[int, int, str]]:
        out, at = [], 0

        def add(start: int, end: int, crumb: str | None = None) -> None:
            section = f"\nsection: {crumb}" if crumb else ""
            out.extend((a, b, f"---\nfile: {path}{section}\n---\n\n{text}") for a, b, text in pack(lines, start, end))

        for start, end, crumb in self.sections(lines, symbols):
            add(at, start)
            add(start, end, crumb)
            at = end
        add(at, len(lines))
        return out


_BOILERPLATE = re.compile(r"$|//|\}[;,]?\s*(//.*)?$|#endif|#pragma once|#(el(se|if)|if(n?def)?)\b")


def cpp_boilerplate(text: str) -> bool:
    return units(text) <= 200 and all(_BOILERPLATE.match(line.strip()) for line in text.split("\n"))


class CppParser:
    """Symbols of C and C++ by a scanner of declarations.

    It finds includes, macros, comments, namespaces, classes, structs, unions, enums, function
    definitions and prototypes at file, namespace and class level. It doesn't look into function
    bodies (but for comments), nor does it evaluate the preprocessor: a function that
    conditionals cut in two is read as its text stands.
    """

    version = 1
    _kinds = {"namespace": 1, "class": 2, "struct": 3, "union": 4, "enum": 5}
    _token = re.compile(
        r"//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z)|R\"([^()\\ ]{0,16})\(.*?\)\1\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.S | re.M
    )
    _container = re.compile(r"(?:^|[\s;])(?:(namespace)|(?:enum\s+)?(class|struct|union|enum))\b")
    _name = r"(?:~\s*)?[A-Za-z_]\w*"
    _callee = re.compile(rf"((?:[A-Za-z_]\w*(?:\s*<[^<>()]*>)?\s*::\s*)*)({_name}|operator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]+|[A-Za-z_][\w:<>\s*&]*?))\s*$")
    _control = frozenset("if for while switch catch return sizeof alignof decltype static_assert throw delete new else do case defined alignas noexcept".split())

    def symbols(self, text: str) -> list[dict]:
        self_ = _CppScan(text, self)
        self_.scan(0, len(text), [], False)
        order = {id(s): k for k, s in enumerate(self_.out)}
        return sorted(self_.out, key=lambda s: (s["start_line"], s["start_column"], -s["end_line"], order[id(s)]))

    @staticmethod
    def ranges(symbols: list[dict], lines: list[str]) -> list[list]:
        """[start, end, symbol] of the outermost containers, grown over the lines right above."""
        out: list[list] = []
        reach = 0
        for s in sorted((s for s in symbols if s["type"] in CHUNK_CONTAINER), key=lambda s: s["start_line"]):
            if s["start_line"] >= reach:
                out.append([s["start_line"], s["end_line"] + 1, s])
            elif s["end_line"] + 1 > reach:
                out[-1][1] = s["end_line"] + 1
            reach = max(reach, s["end_line"] + 1)
        for k, own in enumerate(out):
            low = out[k - 1][1] if k else 0
            while own[0] - 1 >= low and lines[own[0] - 1].strip():
                own[0] -= 1
        return out

    def chunks(self, lines: list[str], symbols: list[dict], path: str) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []

        def add(start: int, end: int, own: dict | None = None) -> None:
            for k, (a, b, text) in enumerate(pack(lines, start, end, cpp_boilerplate)):
                head = f"// file: {path}"
                if own:
                    head += f"\n// {SYMBOL_TYPES[own['type']]}: {own['fully_qualified_name'] or own['name']}"
                    if k and own["type"] in CALLABLE and own["signature"]:
                        head += f"\n// signature: {own['signature']}"
                out.append((a, b, f"{head}\n\n{text}"))

        at = max((s["end_line"] + 1 for s in symbols if s["type"] == 40), default=0)
        for start, end, own in self.ranges(symbols, lines):
            add(at, start)
            add(start, end, own)
            at = end
        add(at, len(lines))
        return out


class _CppScan:
    """One pass over a text: ``code`` is the text with comments, literals and directives blanked."""

    def __init__(self, text: str, parser: CppParser):
        self.text, self.parser, self.out = text, parser, []
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        code = []
        at, last, line_before = 0, None, -1
        for m in parser._token.finditer(text):
            part = m[0]
            code.append(text[at : m.start()])
            keep = '"' if part[0] in "\"'R" else " "
            code.append(re.sub(r"[^\n]", keep, part))
            at = m.end()
            bare = part.lstrip(" \t")
            start = m.end() - len(bare)
            if part[0] == "/":
                row, column = self.at(start)
                own = not text[self.starts[row] : start].strip()
                if part.startswith("//") and own and last is not None and row == last["end_line"] + 1 and column == last["start_column"]:
                    last["end_line"], last["end_column"] = self.at(m.end())
                    continue
                self.out.append(symbol(60, "", (row, column), self.at(m.end()), (row, column), (row, column)))
                last = self.out[-1] if part.startswith("//") and own else None
            elif bare.startswith("#"):
                self._directive(bare, start)
        code.append(text[at:])
        self.code = "".join(code)

    def at(self, position: int) -> tuple[int, int]:
        import bisect

        row = bisect.bisect_right(self.starts, position) - 1
        return row, units(self.text[self.starts[row] : position])

    def _directive(self, text: str, start: int) -> None:
        found = re.match(r"#\s*(include|define)\b\s*", text)
        if not found:
            return
        rest = text[found.end() :]
        end = start + len(text.rstrip())
        if found[1] == "include":
            name = re.match(r"<[^>\n]*>|\"[^\"\n]*\"|\w+", rest)
            kind = 40
        else:
            name, kind = re.match(r"\w+", rest), 61
        if name:
            a = start + found.end()
            self.out.append(symbol(kind, name[0] if kind == 61 else "", self.at(start), self.at(end), self.at(a), self.at(a + name.end())))

    def close(self, position: int, end: int) -> int:
        """Where the bracket at position is closed."""
        pairs = {"{": "}", "(": ")", "[": "]"}
        opened, closed = self.code[position], pairs[self.code[position]]
        depth = 0
        for m in re.compile(f"[{re.escape(opened + closed)}]").finditer(self.code, position, end):
            depth += 1 if m[0] == opened else -1
            if not depth:
                return m.start()
        return end - 1

    def scan(self, at: int, end: int, scope: list[str], in_class: bool) -> None:
        begin = at
        while at < end:
            c = self.code[at]
            if c == "(" or c == "[":
                at = self.close(at, end) + 1
            elif c == ";" or c == "}":
                if c == ";":
                    self._prototype(begin, at, scope, in_class)
                at = begin = at + 1
            elif c == ":" and in_class and re.search(r"\b(public|protected|private|signals|slots)\s*$", self.code[begin:at]):
                at = begin = at + 1
            elif c == "{":
                stop = self.close(at, end)
                after = self._block(begin, at, stop, scope, in_class)
                if after:
                    at = begin = after
                else:
                    at = stop + 1
            else:
                at += 1

    def _skip(self, begin: int, end: int) -> int:
        """Past blanks, template heads and attributes, to where a declaration's own text begins."""
        while True:
            m = re.compile(r"\s+|extern\s+\"+\s*(?=\{|\w)|\[\[.*?\]\]\s*", re.S).match(self.code, begin, end)
            if m:
                begin = m.end()
                continue
            m = re.compile(r"template\s*<").match(self.code, begin, end)
            if not m:
                return begin
            depth, at = 1, m.end()
            while at < end and depth:
                depth += {"<": 1, ">": -1}.get(self.code[at], 0)
                at += 1
            begin = at

    def _block(self, begin: int, at: int, stop: int, scope: list[str], in_class: bool) -> int:
        """Read the block at ``at``; where to go on, or 0 if it only belongs to an expression."""
        if re.fullmatch(r"\s*extern\s*\"+\s*", self.code[begin:at]):
            self.scan(at + 1, stop, scope, in_class)
            return stop + 1
        begin = self._skip(begin, at)
        head = self.code[begin:at]
        m = re.search(r"\b(namespace)\b|\b(?:(enum)(?:\s+(?:class|struct))?|(class|struct|union))\b(?![^<]*>\s*\w+\s*\()", head)
        if m and not self._is_function(head):
            kind = self.parser._kinds[m[1] or m[2] or m[3]]
            start = begin + m.start()
            rest = head[m.end() :]
            rest = re.split(r"(?<!:):(?!:)", rest)[0] if kind != 1 else rest
            names = list(re.finditer(r"[A-Za-z_]\w*(?:\s*<[^{}]*>)?(?:\s*::\s*[A-Za-z_]\w*)*", re.sub(r"\b(final|alignas\s*\([^)]*\)|inline)\b", lambda x: " " * len(x[0]), rest)))
            name = names[-1] if names else None
            text = re.sub(r"\s+", "", name[0]) if name else ("(anonymous namespace)" if kind == 1 else "")
            a = begin + m.end() + name.start() if name else start
            b = begin + m.end() + name.end() if name else start
            outer = "::".join(scope) or None
            fqn = f"{outer}::{text}" if outer else text
            self.out.append(symbol(kind, text, self.at(start), self.at(stop + 1), self.at(a), self.at(b), outer, fqn, None, self.at(at)))
            if kind != 5:
                inner = [*scope, text] if kind in (1, 2, 3) and text else scope
                self.scan(at + 1, stop, inner, kind != 1)
            return stop + 1
        if self._is_function(head):
            while self._initialises(head, at):  # braces of a constructor's initialisers
                at = stop + 1
                nxt = self.code.find("{", at)
                if nxt < 0 or self.code[at:nxt].strip(", \n\t").startswith("}"):
                    return at
                head, at = self.code[begin:nxt], nxt
                stop = self.close(at, len(self.code))
            self._function(begin, head, at, stop, scope, in_class)
            return stop + 1
        return 0

    def _initialises(self, head: str, at: int) -> bool:
        found = self._callee_of(head)
        tail = head[found[3] :] if found else ""
        return bool(re.match(r"[^:]*:(?!:)", tail)) and bool(re.search(r"[\w>]\s*$", tail)) and not re.search(r"\)\s*$", tail)

    def _is_function(self, head: str) -> bool:
        return self._callee_of(head) is not None

    def _callee_of(self, head: str):
        """(scope, name, where the name begins, where the parameters end) of the declared function."""
        at = 0
        while (at := head.find("(", at)) >= 0:
            m = self.parser._callee.search(head, 0, at)
            word = m[2].strip() if m else ""
            close = self._close_in(head, at)
            if close < 0:
                return None
            if m and word not in self.parser._control and not re.search(r"=\s*$|=[^=]*$", head[: m.start()].split("operator")[0]):
                if word.startswith("operator") and not word[8:].strip() and head[close + 1 :].lstrip().startswith("("):
                    at = head.find("(", close)
                    continue
                if word not in ("__attribute__", "__declspec", "alignas", "explicit", "noexcept"):
                    return m[1], m[2], m.start(2), close + 1
            at = close + 1
        return None

    @staticmethod
    def _close_in(text: str, at: int) -> int:
        depth = 0
        for k in range(at, len(text)):
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if not depth:
                return k
        return -1

    def _describe(self, begin: int, head: str, scope: list[str]):
        qualifier, name, at, after = self._callee_of(head)
        tail = re.match(r"\s*(?:(?:const|volatile|noexcept(?:\s*\([^)]*\))?|override|final|&&?|->\s*[\w:<>*&\s]+?(?=\s*$|\s*\{))\s*)*", head[after:])
        until = after + len(tail[0].rstrip())
        source = self.text[begin : begin + until]
        signature = re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", re.sub(r"\s+", " ", source))).strip()
        own = re.sub(r"\s+", "", qualifier).removesuffix("::")
        outer = "::".join([*scope, *([own] if own else [])]) or None
        name = re.sub(r"\s+", "", name) if name.startswith("~") else re.sub(r"\s+", " ", name).strip()
        # inside the head, what stands before the qualified name is the return type
        type_ = re.sub(r"\b(explicit|virtual|inline|static|constexpr|friend|extern|consteval|[A-Z][A-Z0-9_]*_EXPORT)\b", "", head[: at - len(qualifier)]).strip()
        return name, outer, signature, begin + at, qualifier, type_

    def _function(self, begin: int, head: str, at: int, stop: int, scope: list[str], in_class: bool) -> None:
        name, outer, signature, name_at, qualifier, type_ = self._describe(begin, head, scope)
        if not type_ and not name.startswith("operator"):
            kind = 23 if name.startswith("~") else 22 if in_class or "::" in qualifier else 20
        else:
            kind = 21 if in_class else 20
        fqn = f"{outer}::{name}" if outer else name
        self.out.append(symbol(kind, name, self.at(begin), self.at(stop + 1), self.at(name_at), self.at(name_at + len(name)), outer, fqn, signature, self.at(at)))

    def _prototype(self, begin: int, at: int, scope: list[str], in_class: bool) -> None:
        begin = self._skip(begin, at)
        head = self.code[begin:at]
        ahead = re.fullmatch(r"(?:enum\s+)?(class|struct|union|enum)\s+([A-Za-z_]\w*)\s*", head)
        if ahead:
            outer = "::".join(scope) or None
            a, b = begin + ahead.start(2), begin + ahead.end(2)
            fqn = f"{outer}::{ahead[2]}" if outer else ahead[2]
            self.out.append(symbol(self.parser._kinds[head.split()[0]], ahead[2], self.at(begin), self.at(b), self.at(a), self.at(b), outer, fqn))
            return
        if re.match(r"(using|typedef|friend|return|goto|throw|delete|static_assert)\b", head) or not self._is_function(head):
            return
        if re.search(r"=\s*(delete|default)\s*$", head):
            self._function(begin, head, at, at, scope, in_class)
            self.out[-1].update(header_end_line=None, header_end_column=None)
            return
        name, outer, signature, name_at, _, type_ = self._describe(begin, head, scope)
        if not type_ and not in_class:
            return  # a macro's call
        fqn = f"{outer}::{name}" if outer else name
        self.out.append(symbol(24, name, self.at(begin), self.at(at + 1), self.at(name_at), self.at(name_at + len(name)), outer, fqn, signature))


PARSERS: dict[str, object] = {".md": MarkdownParser()} | dict.fromkeys(CPP_EXTENSIONS, CppParser())
DEFAULT = PlainParser()


def parser_for(path: str):
    """By what follows the last dot, without regard to case."""
    dot = path.rfind(".")
    return PARSERS.get(path[dot:].lower(), DEFAULT) if dot >= 0 else DEFAULT

"""Semantic chunks of source files: classes, functions, methods, interfaces, fields, properties.

Python is read with its own parser; a file it can't parse (broken, or of an old
version) is read by indentation. The brace languages are read as a tree of brackets whose nodes
know what stands before and after them; declarations are told by their neighbours and by what the bracket around
them is (a block, a class, an object, a call, a type). Templates and their expressions are brackets too. Brackets
that don't fit are mended, so malformed code keeps its other declarations. Nested declarations are chunks too, outer ones
first.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corvella.operators.splitter import counter, split_chunk
from corvella.session import BATCH_BYTES, BATCH_ROWS, bounded


class Chunk(NamedTuple):
    content: str
    start: int
    end: int
    kind: str


# ---------------------------------------------------------------- brace languages: a tree of brackets

#: Runs of plain characters with escapes between, as a choice at each character is several times slower.
_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
_CHARACTER = _QUOTED.replace('"', "'")
#: Comments, strings and characters by language; a verbatim string has no escapes.
_STRINGS = {
    "java": rf'"""(?:\\.|.)*?"""|{_QUOTED}|{_CHARACTER}',
    "csharp": rf'[$@]*@[$@]*"[^"]*+(?:""[^"]*+)*+"?|\$?{_QUOTED}|{_CHARACTER}',
    "javascript": rf"{_QUOTED}|{_CHARACTER}",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_TOKEN = {k: re.compile(rf"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>{v}|\d[\w.]*)|(?P<w>#?[^\W\d][\w$]*|\$[\w$]*)|(?P<p>=>|\S)", re.S) for k, v in _STRINGS.items()}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+", re.S)
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Words after which an expression stands, and words that no method is called.
_BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new await yield instanceof".split())
_CONTROL = frozenset("if for while switch catch function return with do else new throw typeof await super using lock fixed foreach synchronized try case".split())


class Node:
    """A word, a literal, a mark, or a bracket with what stands between; end is behind the last character."""

    __slots__ = ("kind", "text", "start", "end", "kids")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end = kind, text, start, end
        self.kids: list[Node] = []


class _Source:
    """A text, its tree and its comments. Brackets that don't fit are mended: a closing one without an opening one is nothing, an open one ends with what is around it."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.comments, self.ends = text, language, [], []
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.top = Node("{", "", 0, len(text))
        script, token = language in ("javascript", "typescript"), _TOKEN[language]
        stack, at = [self.top], 0
        while at < len(text):
            if stack[-1].kind == "`":
                at = _TEMPLATE.match(text, at).end()
                if text.startswith("${", at):
                    stack.append(self._open(stack[-1], "{", at, 2))
                    at += 2
                elif at < len(text):
                    at = stack.pop().end = at + 1
                continue
            m = token.search(text, at)
            if not m:
                break
            kind, own = m.lastgroup, m[0]
            at = m.end()
            if kind == "c":
                self.comments.append(m.start())
                self.ends.append(at)
            elif own in ("(", "[", "{") or (script and own == "`"):
                stack.append(self._open(stack[-1], own, m.start(), 1))
            elif own in _CLOSE and kind == "p":
                fit = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind in (_CLOSE[own], "`")), 0)
                if fit and stack[fit].kind == _CLOSE[own]:
                    for x in stack[fit:]:
                        x.end = at if x is stack[fit] else m.start()
                    del stack[fit:]
            else:
                if script and own == "/" and self._value_follows(stack[-1].kids) and (r := _REGEX.match(text, m.start())):
                    kind, own, at = "s", r[0], r.end()
                stack[-1].kids.append(Node(kind, own, m.start(), at))
        for x in stack[1:]:
            x.end = len(text)

    @staticmethod
    def _open(parent: Node, kind: str, at: int, size: int) -> Node:
        n = Node(kind, kind, at, at + size)
        parent.kids.append(n)
        return n

    @staticmethod
    def _value_follows(kids: list[Node]) -> bool:
        return not kids or (kids[-1].text in _BEFORE_VALUE if kids[-1].kind == "w" else kids[-1].kind in ("p", "{"))

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def broken(self, a: Node, b: Node) -> bool:
        """Whether a line ends between two nodes."""
        return bisect.bisect_left(self.breaks, a.end) < bisect.bisect_left(self.breaks, b.start)

    def chunk(self, start: int, end: int, kind: str) -> Chunk:
        """With the one comment before it that only white space parts from it."""
        if (i := bisect.bisect_right(self.ends, start) - 1) >= 0 and not self.text[self.ends[i] : start].strip():
            start = self.comments[i]
        return Chunk(self.text[start:end], self.line(start), self.line(max(start, end - 1)), kind)


Found = tuple[int, int, str]


def _is(kids: list[Node], i: int, *texts: str) -> bool:
    return 0 <= i < len(kids) and kids[i].text in texts


def _angles(kids: list[Node], i: int) -> int:
    """Place behind the <...> that begins at i; i itself if none does."""
    depth, j = 0, i
    while j < len(kids):
        depth += (kids[j].text == "<") - (kids[j].text == ">")
        if depth == 0:
            return j + 1 if j > i else i
        j += 1
    return i


def _angles_back(kids: list[Node], i: int) -> int:
    """Place of the < whose > is at i; i + 1 if there is none."""
    depth, j = 0, i
    while j >= 0:
        depth += (kids[j].text == ">") - (kids[j].text == "<")
        if depth == 0:
            return j if j < i else i + 1
        j -= 1
    return i + 1


class _Script:
    """Functions, arrows, classes, methods and interfaces of JavaScript and TypeScript."""

    def __init__(self, src: _Source):
        self.src, self.types, self.found = src, src.language == "typescript", []
        self.todo: list[tuple[list[Node], str]] = [(src.top.kids, "block")]
        while self.todo:
            self.walk(*self.todo.pop())

    def walk(self, kids: list[Node], inside: str) -> None:
        """inside: block, class, object, call (round and square brackets), or type, in which nothing is looked for."""
        known: dict[int, str] = {}  # what is inside the curly bracket at a place
        if inside in ("class", "object"):
            self.members(kids, known)
        i = 0
        while i < len(kids):
            n = kids[i]
            if n.kind == "w" and not _is(kids, i - 1, "."):
                if n.text == "class":
                    self.declaration(kids, i, "class", known)
                elif n.text == "function":
                    self.function(kids, i, known)
                elif self.types and n.text == "interface":
                    self.declaration(kids, i, "interface", known)
                elif self.types and n.text == "type" and self.statement(kids, i) and _is(kids, _angles(kids, i + 2), "="):
                    i = self.alias(kids, i)
                    continue
            elif n.text == "=>" and n.kind == "p":
                self.arrow(kids, i, inside)
            elif n.kids:
                self.todo.append((n.kids, known.get(i) or self.inside(kids, i, inside)))
            i += 1

    def inside(self, kids: list[Node], i: int, around: str) -> str:
        if kids[i].kind in "([":
            return "call"
        if kids[i].kind == "`" or around == "type":
            return "block" if kids[i].kind == "`" else "type"
        before = kids[i - 1] if i else None
        if before is None:
            return "object" if around == "call" else "block"
        if before.text == ":":
            return "block" if around == "block" and not self.choice(kids, i - 1) else "object"
        return "object" if before.kind == "p" and before.text not in (";", ">", "=>") or before.text in ("return", "default", "yield", "await") else "block"

    def choice(self, kids: list[Node], i: int) -> bool:
        """Whether the : at i belongs to a ? before it."""
        for j in range(i - 1, -1, -1):
            if kids[j].text in (",", ";"):
                return False
            if kids[j].text == "?" and kids[j].kind == "p":
                return j < i - 1
        return False

    def statement(self, kids: list[Node], i: int) -> bool:
        if not i:
            return True
        b = kids[i - 1]
        return not (b.kind == "p" and b.text not in (";", ">") or b.text in ("return", "new", "await", "yield", "extends") and b.kind == "w" or b.kind in "([")

    def declaration(self, kids: list[Node], i: int, kind: str, known: dict[int, str]) -> None:
        if not (i + 1 < len(kids) and kids[i + 1].kind == "w" and kids[i + 1].text not in ("extends", "implements")):
            if kind == "class":  # without a name: an expression
                j = next((j for j in range(i + 1, len(kids)) if kids[j].kind == "{"), None)
                if j is not None and all(x.kind != "p" or x.text in ".<>," for x in kids[i + 1 : j]):
                    known[j] = "class"
            return
        j = _angles(kids, i + 2)
        while j < len(kids) and kids[j].kind != "{":
            if kids[j].text in (";", "=", "=>") or kids[j].text in ("class", "function") and kids[j].kind == "w":
                return
            j += 1
        if j == len(kids) or (kind == "interface" and not self.statement(kids, i)):
            return
        known[j] = "class" if kind == "class" else "type"
        if self.statement(kids, i) and not _is(kids, i - 1, "abstract"):
            self.found.append((kids[i].start, kids[j].end, kind))

    def function(self, kids: list[Node], i: int, known: dict[int, str]) -> None:
        first = i - 1 if _is(kids, i - 1, "async") else i
        j = i + 1
        if not (j < len(kids) and kids[j].kind == "w" and self.statement(kids, first)):
            return
        j = _angles(kids, j + 1)
        body = self.body(kids, j)
        if body is not None:
            known[body] = "block"
            self.found.append((kids[first].start, kids[body].end, "function"))

    def body(self, kids: list[Node], i: int) -> int | None:
        """Place of the {...} of a body after the parameters at i."""
        if not (i < len(kids) and kids[i].kind == "("):
            return None
        j = i + 1
        if _is(kids, j, ":"):  # a type; an object type can be one, then the body is the bracket after it
            j += 1
            while j < len(kids) and not (kids[j].kind == "{" and j > i + 2 and not _is(kids, j - 1, "|", "&", "<", ",", "=>")) and kids[j].text not in (";", "="):
                j += 1
        return j if j < len(kids) and kids[j].kind == "{" else None

    def members(self, kids: list[Node], known: dict[int, str]) -> None:
        """Methods with a body: words before the name, the name (also computed or a text), parameters."""
        for i, n in enumerate(kids):
            if n.kind != "(" or not i:
                continue
            name = i - 1
            if kids[name].text == ">":
                name = _angles_back(kids, name) - 1
            if name < 0 or kids[name].kind not in ("w", "s", "[") or kids[name].text in _CONTROL:
                continue
            body = self.body(kids, i)
            if body is None:
                continue
            first = name
            while first and (kids[first - 1].kind == "w" and kids[first - 1].text in _MODIFIERS or kids[first - 1].text == "*" and kids[first - 1].kind == "p"):
                first -= 1
            b = kids[first - 1] if first else None
            if b is None or b.text in (",", ";", "?") or b.kind == "{" or self.src.broken(b, kids[first]) or b.kind == "(" and _is(kids, first - 3, "@"):
                known[body] = "block"
                self.found.append((kids[first].start, kids[body].end, "method"))

    def alias(self, kids: list[Node], i: int) -> int:
        """Place behind a type alias."""
        j = i + 2
        while j < len(kids) and kids[j].text != ";":
            if j > i + 3 and self.src.broken(kids[j - 1], kids[j]) and not (kids[j].kind == "p" or kids[j - 1].kind == "p" and kids[j - 1].text != ">"):
                break
            j += 1
        return j

    def arrow(self, kids: list[Node], i: int, inside: str) -> None:
        first = i - 1
        if self.types and first >= 0 and not (kids[first].kind == "(" and not _is(kids, first - 1, ":")):  # a type of the result may stand between
            for j in range(first, max(-1, first - 60), -1):
                if kids[j].text in (";", "=", "=>") and kids[j].kind == "p":
                    break
                if kids[j].text == ":" and j and kids[j - 1].kind == "(":
                    first = j - 1
                    break
        if first < 0 or kids[first].kind not in ("(", "w") or inside == "type":
            return
        if _is(kids, first - 1, ">") and self.types:
            first = min(first, _angles_back(kids, first - 1))
        if _is(kids, first - 1, "async") and not self.src.broken(kids[first - 1], kids[first]):
            first -= 1
        if self.types and first and kids[first - 1].kind == "p" and (kids[first - 1].text in "<|&" or kids[first - 1].text == ":" and inside != "object" and not self.choice(kids, first - 1)):
            return  # the type of a function
        j = i + 1
        if j == len(kids):
            return
        if kids[j].kind != "{":
            while j + 1 < len(kids) and kids[j + 1].text not in (",", ";"):
                if self.src.broken(kids[j], kids[j + 1]) and not (kids[j].kind == "p" or kids[j + 1].kind == "p" and kids[j + 1].text not in "@#!~"):
                    break
                j += 1
        self.found.append((kids[first].start, kids[j].end, "function"))


_MODIFIERS = frozenset("public private protected static async get set override readonly accessor declare".split())


class _Members:
    """Classes, interfaces, methods, fields and properties of Java and C#."""

    def __init__(self, src: _Source):
        self.src, self.java, self.found = src, src.language == "java", []
        self.todo: list[tuple[list[Node], str, str | None]] = [(src.top.kids, "top", None)]
        while self.todo:
            kids, inside, name = self.todo.pop()
            if inside == "block":
                self.block(kids)
            elif inside == "enum":
                end = next((i for i, n in enumerate(kids) if n.text == ";"), len(kids))
                self.todo += [(n.kids, "type" if n.kind == "{" else "block", None) for n in kids[:end] if n.kids]
                self.declarations(kids[end + 1 :], "type", name)
            else:
                self.declarations(kids, inside, name)

    def declarations(self, kids: list[Node], inside: str, name: str | None) -> None:
        """One after another, each up to its ; or body. inside: top, where members aren't looked for, or type, whose name is that of its constructors."""
        at = 0
        while at < len(kids):
            end, given = at, False
            while end < len(kids) and kids[end].text != ";" and (kids[end].kind != "{" or given):
                given |= kids[end].text == "=" and kids[end].kind == "p"
                end += 1
            body = end if end < len(kids) and kids[end].kind == "{" else None
            if body is not None and _is(kids, body + 1, "=") and not self.java:  # a property's first value
                end = next((j for j in range(body, len(kids)) if kids[j].text == ";"), body)
            last = min(end, len(kids) - 1)
            self.member(kids[at : body if body is not None else end], kids[body] if body is not None else None, kids[at].start, kids[last].end, end < len(kids), inside, name)
            at = end + 1

    def member(self, head: list[Node], body: Node | None, start: int, end: int, ended: bool, inside: str, name: str | None) -> None:
        plain = self.plain(head)
        words = [n.text for n in plain if n.kind == "w"]
        before = plain[: next((i for i, n in enumerate(plain) if n.text in ("=", "=>") and n.kind == "p"), len(plain))]
        call = next((i for i, n in enumerate(before) if n.kind == "(" and i and (before[i - 1].kind == "w" or before[i - 1].text == ">")), None)
        kind = next((w for w in words if w in ("class", "interface", "enum", "struct", "record", "namespace")), None)
        if body is not None and kind and (call is None or kind == "record" or _is(plain, call - 1, *words[words.index(kind) + 1 : words.index(kind) + 2])):
            own = words[words.index(kind) + 1] if words.index(kind) + 1 < len(words) else None
            mark = _is(head, self.at(head, kind) - 1, "@")  # its elements are no methods
            if kind in ("class", "interface") and not mark:
                self.found.append((start, end, kind))
            self.todo.append((body.kids, "enum" if kind == "enum" and self.java else "top" if kind == "namespace" or mark else "type", own))
            return
        self.todo += [(n.kids, "block", None) for n in head if n.kids and n.kind == "("]
        if inside == "top":
            if body is not None:
                self.todo.append((body.kids, "block", None))
            return
        if call is not None:
            at = call - 1
            if before[at].text == ">":
                at = _angles_back(before, at) - 1
            typed = [n for n in before[:at] if n.kind == "w" and n.text not in _JAVA_MODIFIERS]
            if at >= 0 and before[at].text != name and typed and before[at].text not in _CONTROL and "delegate" not in words:
                self.found.append((start, end, "method"))
        elif not self.java and len(words) > 1 and (body is not None or _is(plain, len(before), "=>")) and not {"this", "event", "delegate", "operator"} & set(words):
            self.found.append((start, end, "property"))
        elif self.java and body is None and ended and len([n for n in before if n.kind == "w"]) > 1 and words[0] not in ("import", "package", "return", "throw"):
            self.found.append((start, end, "field"))
        if body is not None:
            self.todo.append((body.kids, "block", None))
        self.block(plain[len(before) :])

    @staticmethod
    def at(nodes: list[Node], text: str) -> int:
        return next((i for i, n in enumerate(nodes) if n.text == text), -1)

    def plain(self, head: list[Node]) -> list[Node]:
        """A declaration without its annotations or attributes."""
        out, i = [], 0
        while i < len(head):
            if self.java and head[i].text == "@" and i + 1 < len(head) and head[i + 1].text != "interface":
                i += 2
                while _is(head, i, "."):
                    i += 2
                i += i < len(head) and head[i].kind == "("
            elif not self.java and head[i].kind == "[" and not out:
                i += 1
            else:
                out.append(head[i])
                i += 1
        return out

    def block(self, kids: list[Node]) -> None:
        """Local classes, and classes without a name after `new`; the rest is looked through."""
        skip = -1
        for i, n in enumerate(kids):
            if n.kind == "w" and n.text in ("class", "interface", "enum", "record") and i + 1 < len(kids) and kids[i + 1].kind == "w" and not _is(kids, i - 1, ".") and self.java:
                j = next((j for j in range(i + 1, len(kids)) if kids[j].kind == "{" or kids[j].text == ";"), None)
                if j is not None and kids[j].kind == "{":
                    first = i
                    while first and kids[first - 1].kind == "w" and kids[first - 1].text in _JAVA_MODIFIERS:
                        first -= 1
                    self.member(kids[i:j], kids[j], kids[first].start, kids[j].end, True, "top", None)
                    skip = j
            elif n.kids and i != skip:
                body = self.java and n.kind == "{" and i and kids[i - 1].kind == "(" and any(x.text == "new" for x in self.created(kids, i - 1))
                self.todo.append((n.kids, "type" if body else "block", None))

    @staticmethod
    def created(kids: list[Node], i: int) -> list[Node]:
        """What stands before the arguments at i, back to `new` or the beginning of the expression."""
        j = _angles_back(kids, i - 1) - 1 if _is(kids, i - 1, ">") else i - 1
        while j >= 0 and (kids[j].kind == "w" or kids[j].text in (".", "@")) and kids[j].text != "new":
            j -= 1
        return kids[max(j, 0) : i]


_JAVA_MODIFIERS = frozenset("public private protected internal static final abstract synchronized sealed partial override virtual async readonly extern unsafe native default strictfp new".split())


def _python(text: str) -> Iterator[Chunk]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _indented(text)
        return
    rows = text.split("\n")

    def walk(node: ast.AST, in_class: bool) -> Iterator[Chunk]:
        for field in ("body", "orelse", "handlers", "finalbody", "cases"):
            below = getattr(node, field, None)
            if not isinstance(below, list):
                continue
            previous = None
            for x in below:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    start = x.lineno
                    edge = start - 2
                    while edge >= 0 and not rows[edge].strip() and not x.decorator_list:
                        edge -= 1
                    column = x.col_offset
                    if not x.decorator_list and edge >= 0 and rows[edge].lstrip().startswith("#") and (previous is None or edge + 1 > previous.end_lineno):
                        start, column = edge + 1, len(rows[edge]) - len(rows[edge].lstrip())
                    elif not x.decorator_list and isinstance(previous, ast.Expr) and isinstance(previous.value, ast.Constant) and isinstance(previous.value.value, str):
                        start, column = previous.lineno, previous.col_offset
                    part = rows[start - 1 : x.end_lineno]
                    part[-1] = part[-1].encode()[: x.end_col_offset].decode("utf-8", "ignore")
                    part[0] = part[0][column:]
                    kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                    yield Chunk("\n".join(part), start, x.end_lineno, kind)
                yield from walk(x, in_class or isinstance(x, ast.ClassDef))
                previous = x

    yield from walk(tree, False)


_LITERALS = re.compile(r'#[^\n]*|"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_HEADER = re.compile(r"(?:async[ \t]+)?(def|class)[ \t]+\w+")


def _indented(text: str) -> Iterator[Chunk]:
    """Definitions by their headers; a body lasts while lines are indented deeper, or blank, or inside brackets, strings and comments."""
    code = _LITERALS.sub(lambda m: re.sub(r"[^\n]", " " if m[0][0] == "#" else "_", m[0]), text)
    rows, masked = text.split("\n"), code.split("\n")
    breaks = [m.start() for m in re.finditer("\n", text)]
    within = {bisect.bisect_left(breaks, m.start()) + 1 + i for m in _LITERALS.finditer(text) for i in range(m[0].count("\n"))}
    depth, inside, indent = 0, [], []
    for at, row in enumerate(masked):
        inside.append(depth > 0 or at in within)
        depth = max(0, depth + sum(row.count(c) for c in "([{") - sum(row.count(c) for c in ")]}"))
        if _HEADER.match(row.lstrip()) and row.rstrip().endswith(":"):
            depth = 0  # a bracket left open before is a fault of the file
            inside[-1] = at in within
        indent.append(len(row) - len(row.lstrip()) if row.strip() else None)
    open_: list[tuple[int, str]] = []  # indentation and kind of the definitions around
    for i, row in enumerate(masked):
        if indent[i] is None or inside[i]:
            continue
        while open_ and open_[-1][0] >= indent[i]:
            open_.pop()
        if not (m := _HEADER.match(row.lstrip())):
            continue
        end = i
        for j in range(i + 1, len(rows)):
            if indent[j] is not None:
                if indent[j] <= indent[i] and not inside[j] and not (j == i + 1 and row.rstrip().endswith("\\")) and not masked[j].lstrip().startswith(")"):
                    break
                end = j
        if end == i and row.rstrip().endswith(":"):  # a header without a body defines nothing
            continue
        start = i
        if i and rows[i - 1].lstrip().startswith("#"):
            start = i - 1
        part = rows[start : end + 1]
        part[0] = part[0].lstrip()
        kind = "class" if m[1] == "class" else "method" if any(k == "class" for _, k in open_) else "function"
        open_.append((indent[i], m[1]))
        yield Chunk("\n".join(part), start + 1, end + 1, kind)


def chunks(text: str, language: str) -> list[Chunk]:
    if language == "python":
        return list(_python(text))
    if language not in _TOKEN:
        return []
    src = _Source(text, language)
    found: list[Found] = (_Script if language in ("javascript", "typescript") else _Members)(src).found
    return [src.chunk(*x) for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[2]))]


CHUNKED = pa.schema([("ordinal", pa.int32()), ("content", pa.string()), ("startLine", pa.int32()), ("endLine", pa.int32()), ("chunkType", pa.string())])


def chunk_table(files: DataFrame, keep: list[str], most: int, overlap: int, ranks: str = "") -> DataFrame:
    """The chunks of files (content, language), in the order of their rows, with the columns of keep. By the batch: an Arrow UDTF converts its table for each file."""
    rows = files.select(F.col("content").alias("_content"), F.col("language").alias("_language"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for batch in batches:
            kept, of, out, size = batch.select(keep), [], [], 0

            def done() -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else [()] * len(CHUNKED)
                made = [pa.array(c, f.type) for c, f in zip(columns, CHUNKED, strict=True)]
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in kept.columns), *made], names=[*keep, *CHUNKED.names])  # noqa: B023

            for i, (content, language) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                content, n = content.as_py(), 0
                for c in chunks(content.decode("utf-8", "replace"), language) if content is not None and language is not None else ():
                    for part, start, end, kind in split_chunk(c.content, c.start, c.kind, most, overlap, count):
                        of.append(i)
                        out.append((n, part, start, end, kind))
                        n, size = n + 1, size + len(part)
                        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield done()
                            of, out, size = [], [], 0
            yield done()

    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep), "ordinal int, content string, startLine int, endLine int, chunkType string"])
    return bounded(rows).mapInArrow(run, schema)


@udtf(returnType="ordinal int, content string, startLine int, endLine int, chunkType string", useArrow=True)
class ChunkFile:
    """LATERAL chunk_file(content, language, maxTokens, overlapTokens[, file of ranks])."""

    def eval(self, content: bytes, language: str, most: int, overlap: int, ranks: str = ""):
        if content is None or language is None:
            return
        n = 0
        for c in chunks(bytes(content).decode("utf-8", "replace"), language):
            for part, start, end, kind in split_chunk(c.content, c.start, c.kind, most, overlap, counter(ranks)):
                yield n, part, start, end, kind
                n += 1

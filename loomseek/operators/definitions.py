"""Definitions of JavaScript and TypeScript files by their tokens and brackets.

A file is cut into tokens (strings, templates, comments and regular expressions are one each), brackets are
matched, and definitions are recognised where a statement or a member begins. No syntax tree is built: what is needed
is where a definition begins and ends, what it is called and what it lies in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[A-Za-z_$#@\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\d[\w.]*|=>|[\s\S]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
# words after which a slash begins a regular expression
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do await yield".split())
_MODIFIERS = frozenset("static async get set public private protected readonly override abstract declare".split())
_NO_NAMES = frozenset("if for while switch catch return function with else do try finally throw new typeof delete void await yield case default import export const let var class".split())


@dataclass
class Token:
    text: str
    start: int
    end: int
    #: Whether a line end lies between the token before and this one.
    breaks: bool


@dataclass
class Definition:
    """``first`` and ``last`` are tokens of the whole definition, ``body`` the tokens of its brackets, if it has any."""

    kind: str
    name: str | None
    first: int
    last: int
    body: tuple[int, int] | None
    exported: bool
    members: list[Definition] = field(default_factory=list)


def template_end(text: str, at: int) -> int:
    """The end of the template literal that begins at ``at``, whatever is nested in it; -1 if it has none."""
    stack, i = ["`"], at + 1
    while i < len(text) and stack:
        c = text[i]
        if stack[-1] == "`":
            if c == "\\":
                i += 1
            elif c == "`":
                stack.pop()
            elif text.startswith("${", i):
                stack.append("{")
                i += 1
        elif c in "`{":
            stack.append(c)
        elif c == "}":
            stack.pop()
        elif c in "\"'":
            m = _TOKEN.match(text, i)
            i = m.end() - 1
        i += 1
    return i if not stack else -1


def tokens(text: str) -> list[Token] | None:
    """The tokens without white space and comments; None where a literal does not end."""
    out: list[Token] = []
    at, breaks = 0, True
    while at < len(text):
        c = text[at]
        if c == "`":
            end = template_end(text, at)
            if end < 0:
                return None
        else:
            m = None
            if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
                before = out[-1].text if out else ";"
                if before in _BEFORE_VALUE or not (before[-1].isalnum() or before[-1] in "_$)]}\"'`"):
                    m = _REGEX.match(text, at)
            m = m or _TOKEN.match(text, at)
            end, piece = m.end(), m.group()
            if piece.isspace() or piece.startswith(("//", "/*")):
                breaks = breaks or "\n" in piece
                at = end
                continue
        out.append(Token(text[at:end], at, end, breaks))
        at, breaks = end, False
    return out


def matches(toks: list[Token]) -> list[int] | None:
    """For each opening bracket its closing one and the other way round, else -1; None if they do not match."""
    out, stack = [-1] * len(toks), []
    for i, t in enumerate(toks):
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            if not stack or toks[stack[-1]].text != _CLOSE[t.text]:
                return None
            out[i] = stack.pop()
            out[out[i]] = i
    return None if stack else out


class _Finder:
    def __init__(self, toks: list[Token], match: list[int]):
        self.t, self.m = toks, match

    def is_at(self, i: int, *words: str) -> bool:
        return i < len(self.t) and self.t[i].text in words

    def named(self, i: int) -> str | None:
        if i < len(self.t) and re.match(r"[A-Za-z_$#\u0080-\U0010ffff]", self.t[i].text) and self.t[i].text not in _NO_NAMES:
            return self.t[i].text
        return None

    def body_from(self, i: int, stop: int) -> tuple[int, int] | None:
        """The first braces from ``i`` on, parentheses and type brackets skipped; none before the statement ends."""
        while i < stop:
            text = self.t[i].text
            if text == "{":
                return i, self.m[i]
            if text == ";":
                return None
            i = self.m[i] + 1 if text in _OPEN else i + 1
        return None

    def statement_end(self, i: int, stop: int) -> int:
        """The last token of the statement that begins at ``i``."""
        begin = i
        while i < stop:
            text = self.t[i].text
            if text in _OPEN:
                i = self.m[i]
                if text == "{" and (i + 1 >= stop or self.t[i + 1].breaks):
                    return i
            if text == ";":
                return i
            if i + 1 < stop and self.t[i + 1].breaks and i > begin and self._ends_line(i):
                return i
            i += 1
        return stop - 1

    def _ends_line(self, i: int) -> bool:
        """Whether a statement may end before the line end that follows token ``i``."""
        last, following = self.t[i].text, self.t[i + 1].text
        return (last[-1].isalnum() or last[-1] in "_$)]}\"'`") and following[0] not in ".?:+-*/%&|=<>,([)]}" and following not in ("instanceof", "in", "else", "catch", "finally", "while")

    def function_value(self, i: int, stop: int) -> tuple[bool, tuple[int, int] | None, int]:
        """Whether a function stands at ``i`` as a value, its body, and its last token."""
        j = i + 1 if self.is_at(i, "async") else i
        if self.is_at(j, "function"):
            body = self.body_from(j + 1, stop)
            return (True, body, body[1]) if body else (False, None, i)
        if self.is_at(j, "("):
            k = self.m[j] + 1
            while k < stop and not self.is_at(k, "=>", ";", ",", "{", "=") and not self.t[k].breaks:
                k = self.m[k] + 1 if self.t[k].text in _OPEN else k + 1
        else:
            k = j + 1 if self.named(j) else stop
        if not self.is_at(k, "=>") or k >= stop:
            return False, None, i
        if self.is_at(k + 1, "{"):
            return True, (k + 1, self.m[k + 1]), self.m[k + 1]
        return True, None, self.statement_end(k + 1, stop)

    def statement(self, i: int, stop: int) -> Definition | None:
        """The definition that begins with the statement at ``i``."""
        first, exported = i, False
        while self.is_at(i, "export", "default", "declare", "abstract"):
            exported = exported or self.t[i].text == "export"
            i += 1
        j = i + 1 if self.is_at(i, "async") else i
        if self.is_at(j, "function"):
            j += 2 if self.is_at(j + 1, "*") else 1
            body = self.body_from(j, stop)
            return Definition("function", self.named(j), first, body[1], body, exported) if body else None
        if self.is_at(i, "class"):
            body = self.body_from(i + 1, stop)
            if not body:
                return None
            name = self.named(i + 1)
            out = Definition("class", None if name in ("extends", "implements") else name, first, body[1], body, exported)
            out.members = self.class_members(*body)
            return out
        name_at = None
        if self.is_at(i, "const", "let", "var"):
            name_at, k = i + 1, i + 2
        elif self.is_at(i, "exports") or (self.is_at(i, "module") and self.is_at(i + 2, "exports")):
            k = i + (2 if self.is_at(i, "exports") else 4)
            name_at, exported = k, True
            k += 1
            if not self.is_at(name_at - 1, "."):
                return None
        if name_at is None or not self.named(name_at):
            return None
        while k < stop and not self.is_at(k, "=", ";", ",") and not self.t[k].breaks:
            k = self.m[k] + 1 if self.t[k].text in _OPEN else k + 1
        if not self.is_at(k, "="):
            return None
        is_function, body, last = self.function_value(k + 1, stop)
        if not is_function:
            return None
        return Definition("function", self.named(name_at), first, last + 1 if self.is_at(last + 1, ";") and last + 1 < stop else last, body, exported)

    def class_members(self, begin: int, end: int) -> list[Definition]:
        out, i = [], begin + 1
        while i < end:
            first = i
            while i < end and (self.is_at(i, *_MODIFIERS, "*") or self.t[i].text.startswith("@")) and not self.is_at(i + 1, "(", "=", ";", ":"):
                i += 1
                if self.is_at(i, "(") and self.t[i - 1].text.startswith("@"):
                    i = self.m[i] + 1
            name = self.named(i)
            if name and self.is_at(i + 1, "("):
                body = self.body_from(self.m[i + 1] + 1, end)
                if body and not any(self.is_at(k, ";") for k in range(self.m[i + 1], body[0])):
                    out.append(Definition("method", name, first, body[1], body, False))
                    i = body[1] + 1
                    continue
            if name and self.is_at(i + 1, "="):
                is_function, body, last = self.function_value(i + 2, end)
                if is_function:
                    last = last + 1 if self.is_at(last + 1, ";") and last + 1 < end else last
                    out.append(Definition("method", name, first, last, body, False))
                    i = last + 1
                    continue
            i = self.statement_end(i, end) + 1
        return out

    def statements(self, begin: int, end: int) -> list[tuple[int, int]]:
        """First and last tokens of the statements from ``begin`` to before ``end``."""
        out, i = [], begin
        while i < end:
            d = self.statement(i, end)
            last = d.last if d else self.statement_end(i, end)
            out.append((i, last))
            i = last + 1
        return out

    def nested(self, begin: int, end: int) -> list[Definition]:
        """Named functions and classes that begin a statement anywhere between two tokens, the outermost ones."""
        out, i = [], begin
        while i < end:
            before = self.t[i - 1].text if i else ";"
            if before in "{};" or self.t[i].breaks:
                d = self.statement(i, end)
                if d and d.name:
                    out.append(d)
                    i = d.last + 1
                    continue
            i += 1
        return out


def finder(text: str) -> _Finder | None:
    """A finder over the tokens of ``text``; None if its literals or brackets do not close."""
    toks = tokens(text)
    found = matches(toks) if toks is not None else None
    return _Finder(toks, found) if found is not None else None

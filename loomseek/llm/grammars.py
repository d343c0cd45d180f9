"""Recognisers for the source languages: JavaScript and TypeScript (own), Python and JSON (library).

``valid(language, text)`` says whether a text is syntactically valid. The JavaScript recogniser maps
every token to one character of its class, so most work runs on short strings: a line that is a
whole statement on its own is recognised once per shape and then stands for itself as one token.
A reduced file that fails is tried again unreduced, so the reduction decides nothing.
"""

from __future__ import annotations

import json
import re
import sys
import warnings

from loomseek.operators.definitions import template_end

#: Frames that a nested program may take: about ten a level.
DEPTH = 100_000

# Words with a role of their own in the grammar.
RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new "
    "return super switch this throw try typeof var void while with null true false enum"
).split()
CONTEXTUAL = (
    "let static yield await async of get set as from type interface namespace module declare abstract readonly implements private protected public "
    "is keyof infer satisfies unique asserts override accessor constructor target meta global require"
).split()
PUNCTUATORS = (
    ">>>= ... => === !== **= <<= >>= &&= ||= ??= == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** "
    "{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #"
).split()

_CODE = {w: chr(0x100 + k) for k, w in enumerate(RESERVED + CONTEXTUAL)}
_CODE |= {p: (p if len(p) == 1 else chr(0x200 + k)) for k, p in enumerate(PUNCTUATORS)}
IDENT, NUMBER, STRING, TEMPLATE, REGEX, PRIVATE, BAD, STATEMENT, RETURNS = "instrpXSR"
_W = _CODE.__getitem__

_IDS = frozenset([IDENT, *map(_W, CONTEXTUAL)])
_NAMES = _IDS | frozenset(map(_W, RESERVED))
_ASSIGN = frozenset(map(_W, "= >>>= **= <<= >>= &&= ||= ??= += -= *= /= %= &= |= ^=".split()))
_BINARY = frozenset(map(_W, "=== !== == != <= >= && || ?? << ** < > + - * / % & | ^ instanceof in".split()))
_UNARY = frozenset(map(_W, "+ - ! ~ typeof void delete".split()))
_MODIFIERS = frozenset(map(_W, "static abstract readonly private protected public override declare accessor async get set".split()))
_LITERALS = frozenset([NUMBER, STRING, REGEX, *map(_W, "this null true false super".split())])
_OPEN, _CLOSE = "({[", ")}]"

_STR = r'"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\''


def _template(depth: int) -> str:
    """A template literal whose substitutions nest ``depth`` deep."""
    if depth == 0:
        return r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
    part = rf"[^{{}}`'\"]|{_STR}|{_template(depth - 1)}"
    inner = rf"(?:{part}|\{{(?:{part}|\{{(?:{part})*\}})*\}})*"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{inner}\}})*`"


_TOKEN = re.compile(
    r"[^\S\n  ]*("
    r"\n\s*|//[^\n]*|/\*[\s\S]*?\*/"
    r"|[^\W\d][\w$‌‍]*|\$[\w$]*"
    rf"|{_STR}"
    r"|(?:0[xX][\da-fA-F][\da-fA-F_]*|0[bB][01][01_]*|0[oO][0-7][0-7_]*|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
    r"|(?:(?<=[(,=:\[!&|?;{>~^*%])|(?<=[(,=:\[!&|?;{>~^*%] )|(?<=\breturn )|(?<=\btypeof )|(?<=\bcase )|(?<=\n)|(?<=\n  )|(?<=\n    ))/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    rf"|{_template(2)}"
    r"|#[^\W\d][\w$]*"
    r"|\.\.\.|=>|===|!==|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[+\-*/%&|^]=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
    r"|\\u[\da-fA-F{}]+[\w$]*|[\s\S])"
)


class _Classes(dict):
    """Token text -> class; what is not yet known is classified once. Bounded."""

    def __init__(self, ts: bool):
        super().__init__(_CODE)
        self["#"] = BAD
        self.ts = ts

    def __missing__(self, token: str) -> str:
        if len(self) > 150_000:
            self.clear()
            self.update(_CODE)
            self["#"] = BAD
        c = token[0]
        if c == "\n" or c == " " or c == " ":
            kind = "\n"
        elif c == "/" and len(token) > 1:
            kind = "" if token[1] == "/" else ("\n" if "\n" in token else "") if token[1] == "*" else REGEX
        elif c in "\"'":
            kind = STRING if len(token) > 1 else BAD
        elif c == "`":
            kind = BAD if len(token) < 2 else TEMPLATE if "${" not in token or _substitutions(token, self.ts) else BAD
        elif c.isdigit() or c == "." and len(token) > 1:
            kind = BAD if token[-1] == "n" and c == "0" and token[1:2].isdigit() else NUMBER
        elif c == "#" and len(token) > 1:
            kind = PRIVATE
        elif c == "$" or c == "_" or c.isidentifier() or c == "\\" and len(token) > 2:
            kind = IDENT
        elif c == "﻿" or c.isspace():
            kind = ""
        else:
            kind = BAD
        self[token] = kind
        return kind


def _substitutions(token: str, ts: bool) -> bool:
    """Whether every ``${...}`` of a template holds an expression."""
    at, end = 1, len(token) - 1
    while at < end:
        c = token[at]
        if c == "\\":
            at += 2
        elif c == "$" and token.startswith("${", at):
            depth, to = 1, at + 2
            while to < end and depth:
                c = token[to]
                if c == "`":
                    to = template_end(token, to)
                    if to < 0:
                        return False
                    continue
                if c in "'\"":
                    m = _STRING_RE.match(token, to)
                    if not m:
                        return False
                    to = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                to += 1
            if depth or not _expression_text(token[at + 2 : to - 1], ts):
                return False
            at = to
        else:
            at += 1
    return True


def _tokens(text: str) -> list[str]:
    """All tokens. A template nested deeper than the pattern leaves a lone back quote; then templates end where a stack says."""
    found = _TOKEN.findall(text)
    if "`" not in found:
        return found
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        end = template_end(text, m.start(1)) if m.group(1) == "`" else -1
        out.append(text[m.start(1) : end] if end > 0 else m.group(1))
        at = end if end > 0 else m.end()
    return out


_STRING_RE = re.compile(_STR)
_LAST: list[tuple] = [(None, [], {})]
_CLASSES = {False: _Classes(False), True: _Classes(True)}
_EXPRESSIONS: dict[tuple[str, bool], bool] = {}


def _shape(text: str, ts: bool) -> str:
    last = _LAST[0] if _LAST[0][0] is text else (text, _tokens(text), {})
    shape = last[2].get(ts)
    if shape is None and last[2] and "`" not in text:
        shape = last[2][not ts]  # only templates are classed by language
    if shape is None:
        shape = "".join(map(_CLASSES[ts].__getitem__, last[1]))
    last[2][ts] = shape
    # the grammars of one file share its tokens; set last, as templates bring texts of their own
    _LAST[0] = last
    return shape


def _expression_text(text: str, ts: bool) -> bool:
    shape = _shape(text, ts).replace("\n", "")
    key = (shape, ts)
    if key not in _EXPRESSIONS:
        if len(_EXPRESSIONS) > 50_000:
            _EXPRESSIONS.clear()
        try:
            p = _Parser(shape, ts, True)
            p.depth_async = p.depth_function = 1
            p.expression()
            _EXPRESSIONS[key] = p.at == p.n
        except (_Invalid, IndexError, RecursionError):
            _EXPRESSIONS[key] = False
    return _EXPRESSIONS[key]


class _Invalid(Exception):
    pass


def _fail():
    raise _Invalid


# single characters used below
(FUNCTION, CLASS, ASYNC, IF, ELSE, FOR, WHILE, DO, SWITCH, CASE, DEFAULT, TRY, CATCH, FINALLY, THROW, RETURN, BREAK, CONTINUE, VAR, CONST, LET, IMPORT, EXPORT, NEW, IN, OF, YIELD, AWAIT, EXTENDS, WITH, DEBUGGER, SUPER, STATIC, GET, SET, AS, FROM, TYPE, INTERFACE, NAMESPACE, MODULE, DECLARE, ABSTRACT, READONLY, IMPLEMENTS, IS, KEYOF, INFER, SATISFIES, UNIQUE, ASSERTS, ENUM, TYPEOF, VOID, THIS, NULL, TRUE, FALSE, TARGET, META, GLOBAL) = map(
    _W,
    "function class async if else for while do switch case default try catch finally throw return break continue var const let import export new in of yield await extends with debugger super static get set as from type interface namespace module declare abstract readonly implements is keyof infer satisfies unique asserts enum typeof void this null true false target meta global".split(),
)
ARROW, DOTS, CHAIN, INC, DEC = map(_W, ("=>", "...", "?.", "++", "--"))


_SETUP: list = [None, None]


class _Parser:
    """Recursive descent over a string of classes. Positions with a line end before them are in ``breaks``."""

    def __init__(self, shape: str, ts: bool, module: bool):
        self.ts, self.module, self.at = ts, module, 0
        self.depth_function = self.depth_async = self.depth_loop = self.depth_switch = self.depth_generator = 0
        self.no_in = False
        if _SETUP[0] == shape:
            # the shape that was parsed last, for another grammar
            self.c, self.n, self.breaks, self.close = _SETUP[1]
            return
        lines = shape.split("\n")
        at, breaks = 0, set()
        for line in lines[:-1]:
            at += len(line)
            breaks.add(at)
        self.c = "".join(lines)
        self.n = len(self.c)
        self.c += "\x00\x00\x00"
        self.breaks = breaks
        self.close = self._match()
        if len(shape) > 100:
            _SETUP[:] = [shape, (self.c, self.n, self.breaks, self.close)]

    def _match(self) -> dict[int, int]:
        stack, pairs = [], {}
        for m in _BRACKETS.finditer(self.c):
            b, i = m.group(), m.start()
            if b in _OPEN:
                stack.append((b, i))
            else:
                if not stack:
                    _fail()
                o, j = stack.pop()
                if _OPEN.index(o) != _CLOSE.index(b):
                    _fail()
                pairs[j] = i
        if stack:
            _fail()
        return pairs

    # --- helpers
    def eat(self, ch: str) -> None:
        if self.c[self.at] != ch:
            _fail()
        self.at += 1

    def opt(self, ch: str) -> bool:
        if self.c[self.at] == ch:
            self.at += 1
            return True
        return False

    def semicolon(self) -> None:
        c = self.c[self.at]
        if c == ";":
            self.at += 1
        elif c != "}" and self.at < self.n and self.at not in self.breaks:
            _fail()

    def name(self) -> None:
        if self.c[self.at] not in _NAMES:
            _fail()
        self.at += 1

    def binding_name(self) -> None:
        c = self.c[self.at]
        if c not in _IDS or (c == AWAIT and self.depth_async) or (c == YIELD and self.depth_generator):
            _fail()
        self.at += 1

    # --- statements
    def program(self) -> None:
        c, n = self.c, self.n
        while self.at < n:
            ch = c[self.at]
            if ch == IMPORT and c[self.at + 1] not in "(.":
                self.import_declaration()
            elif ch == EXPORT:
                self.export_declaration()
            else:
                self.statement(True)

    def block(self) -> None:
        self.eat("{")
        c = self.c
        while c[self.at] != "}":
            self.statement(True)
        self.at += 1

    def statement(self, declaration: bool = False) -> None:
        c, ch = self.c, self.c[self.at]
        if ch == STATEMENT:
            self.at += 1
        elif ch == RETURNS:
            if not self.depth_function:
                _fail()
            self.at += 1
        elif ch == "{":
            self.block()
        elif ch == IF:
            self.at += 1
            self.paren_expression()
            self.statement()
            if self.opt(ELSE):
                self.statement()
        elif ch == CONST or ch == VAR or (ch == LET and (c[self.at + 1] in _IDS or c[self.at + 1] in "[{")):
            if ch != VAR and not declaration:
                _fail()
            if self.ts and ch == CONST and c[self.at + 1] == ENUM:
                self.at += 1
                self.enum()
                return
            self.at += 1
            self.declarations(ch == CONST, False)
            self.semicolon()
        elif ch == RETURN:
            if not self.depth_function:
                _fail()
            self.at += 1
            if c[self.at] not in ";}" and self.at < self.n and self.at not in self.breaks:
                self.expression()
            self.semicolon()
        elif ch == FOR:
            self.for_statement()
        elif ch == TRY:
            self.at += 1
            self.block()
            handled = False
            if self.opt(CATCH):
                handled = True
                if self.opt("("):
                    self.binding()
                    if self.ts and self.opt(":"):
                        self.type()
                    self.eat(")")
                self.block()
            if self.opt(FINALLY):
                handled = True
                self.block()
            if not handled:
                _fail()
        elif ch == FUNCTION or (ch == ASYNC and c[self.at + 1] == FUNCTION and self.at + 1 not in self.breaks):
            if not declaration and ch == ASYNC:
                _fail()
            self.function(True)
        elif ch == CLASS or (ch == "@"):
            if not declaration:
                _fail()
            self.decorators()
            if self.c[self.at] == EXPORT:
                self.export_declaration()
                return
            self.opt(ABSTRACT) if self.ts else None
            self.class_(True)
        elif ch == WHILE:
            self.at += 1
            self.paren_expression()
            self.loop_body()
        elif ch == DO:
            self.at += 1
            self.loop_body()
            self.eat(WHILE)
            self.paren_expression()
            self.opt(";")
        elif ch == SWITCH:
            self.switch()
        elif ch == THROW:
            self.at += 1
            if self.at in self.breaks:
                _fail()
            self.expression()
            self.semicolon()
        elif ch == BREAK or ch == CONTINUE:
            self.at += 1
            if c[self.at] in _IDS and self.at not in self.breaks:
                self.at += 1
            elif not (self.depth_loop or (ch == BREAK and self.depth_switch)):
                _fail()
            self.semicolon()
        elif ch == ";":
            self.at += 1
        elif ch == DEBUGGER:
            self.at += 1
            self.semicolon()
        elif ch == WITH:
            self.at += 1
            self.paren_expression()
            self.statement()
        elif ch == IMPORT and c[self.at + 1] not in "(." or ch == EXPORT:
            if self.ts and self.depth_namespace and ch == EXPORT:
                self.export_declaration()
            else:
                _fail()
        elif ch in _IDS and c[self.at + 1] == ":" :
            self.at += 2
            self.statement(declaration)
        elif self.ts and self.ts_statement(ch):
            pass
        else:
            self.expression()
            self.semicolon()

    depth_namespace = 0

    def ts_statement(self, ch: str) -> bool:
        c, nxt = self.c, self.c[self.at + 1]
        if self.at + 1 in self.breaks:
            return False
        if ch == INTERFACE and nxt in _IDS:
            self.at += 2
            self.type_parameters()
            if self.opt(EXTENDS):
                self.type_list()
            self.object_type()
            return True
        if ch == TYPE and nxt in _IDS:
            self.at += 2
            self.type_parameters()
            self.eat("=")
            self.type()
            self.semicolon()
            return True
        if ch == ENUM:
            self.enum()
            return True
        if ch == ABSTRACT and nxt == CLASS:
            self.at += 1
            self.class_(True)
            return True
        if ch in (NAMESPACE, MODULE) and (nxt in _IDS or nxt == STRING) or (ch == GLOBAL and nxt == "{"):
            self.at += 1
            if ch != GLOBAL:
                self.at += 1
                while self.opt("."):
                    self.name()
            if ch == MODULE and self.c[self.at] != "{":
                self.semicolon()
                return True
            self.depth_namespace += 1
            self.eat("{")
            while c[self.at] != "}":
                if c[self.at] == EXPORT:
                    self.export_declaration()
                elif c[self.at] == IMPORT:
                    self.import_declaration()
                else:
                    self.statement(True)
            self.at += 1
            self.depth_namespace -= 1
            return True
        if ch == DECLARE and (nxt in (FUNCTION, CLASS, CONST, LET, VAR, ENUM, ABSTRACT, ASYNC, NAMESPACE, MODULE, INTERFACE, TYPE, GLOBAL)):
            self.at += 1
            if nxt in (CONST, LET, VAR) and c[self.at + 1] != ENUM:
                self.at += 1
                self.declarations(False, False)
                self.semicolon()
            else:
                self.statement(True)
            return True
        return False

    def enum(self) -> None:
        self.eat(ENUM)
        self.name()
        self.eat("{")
        while not self.opt("}"):
            if self.c[self.at] in (STRING, TEMPLATE) or self.c[self.at] in _NAMES:
                self.at += 1
            else:
                _fail()
            if self.opt("="):
                self.assignment()
            if self.c[self.at] != "}":
                self.eat(",")

    def loop_body(self) -> None:
        self.depth_loop += 1
        self.statement()
        self.depth_loop -= 1

    def paren_expression(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def switch(self) -> None:
        self.at += 1
        self.paren_expression()
        self.eat("{")
        self.depth_switch += 1
        defaults = 0
        while not self.opt("}"):
            if self.opt(CASE):
                self.expression()
            else:
                self.eat(DEFAULT)
                defaults += 1
                if defaults > 1:
                    _fail()
            self.eat(":")
            while self.c[self.at] not in (CASE, DEFAULT, "}"):
                self.statement(True)
        self.depth_switch -= 1

    def for_statement(self) -> None:
        c = self.c
        self.at += 1
        if c[self.at] == AWAIT:
            self.at += 1
        self.eat("(")
        ch = c[self.at]
        outer, self.no_in = self.no_in, True
        if ch == ";":
            pass
        elif ch in (CONST, VAR) or (ch == LET and (c[self.at + 1] in _IDS and c[self.at + 1] not in (OF,) or c[self.at + 1] in "[{")):
            self.at += 1
            self.declarations(ch == CONST, True)
        else:
            self.expression()
        self.no_in = outer
        if c[self.at] in (OF, IN):
            of = c[self.at] == OF
            self.at += 1
            self.assignment() if of else self.expression()
        else:
            self.eat(";")
            if c[self.at] != ";":
                self.expression()
            self.eat(";")
            if c[self.at] != ")":
                self.expression()
        self.eat(")")
        self.loop_body()

    def declarations(self, const: bool, in_for: bool) -> None:
        while True:
            pattern = self.c[self.at] in "[{"
            self.binding()
            if self.ts:
                self.opt("!")
                if self.opt(":"):
                    self.type()
            if self.opt("="):
                self.assignment()
            elif in_for and self.c[self.at] in (OF, IN):
                return
            elif (const or pattern) and not self.depth_namespace and not self.ts:
                _fail()
            elif (const or pattern) and self.ts and self.c[self.at - 1] == IDENT and not self._declared():
                _fail()
            if not self.opt(","):
                return

    def _declared(self) -> bool:
        """A constant without value is right after ``declare`` only."""
        return self.depth_namespace > 0 or DECLARE in self.c

    def binding(self) -> None:
        ch = self.c[self.at]
        if ch == "[":
            self.at += 1
            while not self.opt("]"):
                if self.opt(","):
                    continue
                rest = self.opt(DOTS)
                self.binding()
                if not rest and self.opt("="):
                    self.assignment_in()
                if self.c[self.at] != "]":
                    if rest:
                        _fail()
                    self.eat(",")
        elif ch == "{":
            self.at += 1
            while not self.opt("}"):
                if self.opt(DOTS):
                    self.binding_name()
                    self.eat("}")
                    return
                ch = self.c[self.at]
                if ch == "[":
                    self.at += 1
                    self.assignment_in()
                    self.eat("]")
                    self.eat(":")
                    self.binding()
                elif ch in (STRING, NUMBER):
                    self.at += 1
                    self.eat(":")
                    self.binding()
                else:
                    self.name()
                    if self.opt(":"):
                        self.binding()
                    elif ch not in _IDS:
                        _fail()
                if self.opt("="):
                    self.assignment_in()
                if self.c[self.at] != "}":
                    self.eat(",")
        else:
            self.binding_name()

    def assignment_in(self) -> None:
        outer, self.no_in = self.no_in, False
        self.assignment()
        self.no_in = outer

    # --- functions and classes
    def parameters(self) -> None:
        self.eat("(")
        while not self.opt(")"):
            self.decorators()
            if self.ts:
                while self.c[self.at] in _MODIFIERS and (self.c[self.at + 1] in _IDS or self.c[self.at + 1] in "[{"):
                    self.at += 1
                if self.c[self.at] == THIS:
                    self.at += 1
                    self.eat(":")
                    self.type()
                    if self.c[self.at] != ")":
                        self.eat(",")
                    continue
            rest = self.opt(DOTS)
            self.binding()
            if self.ts:
                self.opt("?")
                if self.opt(":"):
                    self.type()
            if not rest and self.opt("="):
                self.assignment_in()
            if self.c[self.at] != ")":
                if rest:
                    _fail()
                self.eat(",")

    def body(self, is_async: bool, generator: bool) -> None:
        saved = self.depth_function, self.depth_async, self.depth_loop, self.depth_switch, self.depth_generator, self.no_in
        self.depth_function, self.depth_async, self.depth_loop, self.depth_switch, self.depth_generator, self.no_in = 1, int(is_async), 0, 0, int(generator), False
        self.block()
        self.depth_function, self.depth_async, self.depth_loop, self.depth_switch, self.depth_generator, self.no_in = saved

    def signature_and_body(self, is_async: bool, generator: bool, may_lack_body: bool) -> None:
        if self.ts:
            self.type_parameters()
        outer = self.depth_async, self.depth_generator
        self.depth_async, self.depth_generator = int(is_async), int(generator)
        self.parameters()
        self.depth_async, self.depth_generator = outer
        if self.ts and self.opt(":"):
            self.return_type()
        if may_lack_body and self.c[self.at] != "{":
            self.semicolon()
            return
        self.body(is_async, generator)

    def function(self, declaration: bool) -> None:
        is_async = self.opt(ASYNC)
        self.eat(FUNCTION)
        generator = self.opt("*")
        if self.c[self.at] in _IDS:
            self.at += 1
        elif declaration:
            _fail()
        self.signature_and_body(is_async, generator, self.ts and declaration)

    def decorators(self) -> None:
        while self.opt("@"):
            if self.c[self.at] == "(":
                self.paren_expression()
                continue
            self.name()
            while self.opt("."):
                self.name()
            if self.c[self.at] == "(":
                self.arguments()

    def class_(self, declaration: bool) -> None:
        self.eat(CLASS)
        if self.c[self.at] in _IDS and not (self.c[self.at] == IMPLEMENTS and self.ts):
            self.at += 1
        elif declaration:
            _fail()
        if self.ts:
            self.type_parameters()
        if self.opt(EXTENDS):
            self.left_hand_side()
            if self.ts and self.c[self.at] == "<":
                self.type_arguments()
        if self.ts and self.opt(IMPLEMENTS):
            self.type_list()
        self.eat("{")
        while not self.opt("}"):
            if self.opt(";"):
                continue
            self.member()

    def property_name(self) -> None:
        ch = self.c[self.at]
        if ch == "[":
            self.at += 1
            self.assignment_in()
            self.eat("]")
        elif ch in _NAMES or ch in (STRING, NUMBER, PRIVATE):
            self.at += 1
        else:
            _fail()

    def member(self) -> None:
        c = self.c
        self.decorators()
        if c[self.at] == STATIC and c[self.at + 1] == "{":
            self.at += 1
            self.body(False, False)
            return
        is_async = False
        while c[self.at] in _MODIFIERS and (c[self.at + 1] in _NAMES or c[self.at + 1] in (STRING, NUMBER, PRIVATE, "[", "*") or (c[self.at + 1] == "@")):
            if not self.ts and c[self.at] not in (STATIC, ASYNC, GET, SET, _W("accessor")):
                break
            if self.at + 1 in self.breaks and c[self.at] in (ASYNC, GET, SET):
                break
            is_async |= c[self.at] == ASYNC
            self.at += 1
        generator = self.opt("*")
        if self.ts and c[self.at] == "[" and c[self.at + 1] in _IDS and c[self.at + 2] == ":":
            self.at += 3
            self.type()
            self.eat("]")
            if self.opt(":"):
                self.type()
            self.semicolon()
            return
        self.property_name()
        if self.ts:
            self.opt("?") or self.opt("!")
        if c[self.at] == "(" or (self.ts and c[self.at] == "<"):
            self.signature_and_body(is_async, generator, self.ts)
            return
        if is_async or generator:
            _fail()
        if self.ts and self.opt(":"):
            self.type()
        if self.opt("="):
            saved = self.depth_function, self.depth_async
            self.depth_async = 0
            self.assignment_in()
            self.depth_function, self.depth_async = saved
        self.semicolon()

    # --- modules
    def module_name(self) -> None:
        if self.c[self.at] == STRING:
            self.at += 1
        else:
            self.name()

    def import_declaration(self) -> None:
        self.module or _fail()
        c = self.c
        self.at += 1
        if self.opt(STRING):
            self.import_attributes()
            return
        if self.ts and c[self.at] == TYPE and (c[self.at + 1] in "{*" or c[self.at + 1] in _IDS and (c[self.at + 1] != FROM or c[self.at + 2] == FROM)):
            self.at += 1
        if c[self.at] in _IDS:
            self.at += 1
            if self.ts and self.opt("="):
                self.expression()
                self.semicolon()
                return
            if c[self.at] == FROM:
                pass
            else:
                self.eat(",")
                if c[self.at] not in "*{":
                    _fail()
        if self.opt("*"):
            self.eat(AS)
            self.binding_name()
        elif self.opt("{"):
            while not self.opt("}"):
                if self.ts and c[self.at] == TYPE and (c[self.at + 1] in _NAMES and c[self.at + 1] != AS or c[self.at + 1] == AS and c[self.at + 2] == AS):
                    self.at += 1
                first = c[self.at]
                self.module_name()
                if self.opt(AS):
                    self.binding_name()
                elif first not in _IDS:
                    _fail()
                if c[self.at] != "}":
                    self.eat(",")
        self.eat(FROM)
        self.eat(STRING)
        self.import_attributes()

    def import_attributes(self) -> None:
        if self.c[self.at] == WITH and self.c[self.at + 1] == "{":
            self.at += 1
            self.at = self.close[self.at] + 1
        self.semicolon()

    def export_declaration(self) -> None:
        self.module or _fail()
        c = self.c
        self.eat(EXPORT)
        ch = c[self.at]
        if ch == DEFAULT:
            self.at += 1
            ch = c[self.at]
            if ch == FUNCTION or (ch == ASYNC and c[self.at + 1] == FUNCTION):
                is_async = self.opt(ASYNC)
                self.at += 1
                generator = self.opt("*")
                if c[self.at] in _IDS:
                    self.at += 1
                self.signature_and_body(is_async, generator, self.ts)
            elif ch == CLASS or ch == "@" or (self.ts and ch == ABSTRACT and c[self.at + 1] == CLASS):
                self.decorators()
                if self.ts:
                    self.opt(ABSTRACT)
                self.class_(False)
            elif self.ts and ch == INTERFACE:
                self.ts_statement(ch)
            else:
                self.assignment()
                self.semicolon()
        elif ch == "*":
            self.at += 1
            if self.opt(AS):
                self.module_name()
            self.eat(FROM)
            self.eat(STRING)
            self.import_attributes()
        elif ch == "{" or (self.ts and ch == TYPE and c[self.at + 1] == "{"):
            self.at += 1 + (ch == TYPE)
            while not self.opt("}"):
                if self.ts and c[self.at] == TYPE and c[self.at + 1] in _NAMES and c[self.at + 1] != AS:
                    self.at += 1
                self.module_name()
                if self.opt(AS):
                    self.module_name()
                if c[self.at] != "}":
                    self.eat(",")
            if self.opt(FROM):
                self.eat(STRING)
                self.import_attributes()
            else:
                self.semicolon()
        elif self.ts and ch == "=":
            self.at += 1
            self.expression()
            self.semicolon()
        elif self.ts and ch == AS and c[self.at + 1] == NAMESPACE:
            self.at += 3
            self.semicolon()
        elif self.ts and ch == IMPORT:
            self.import_declaration()
        elif ch in (VAR, LET, CONST, FUNCTION, CLASS, ASYNC, "@") or (self.ts and ch in (INTERFACE, TYPE, ENUM, ABSTRACT, DECLARE, NAMESPACE, MODULE)):
            self.statement(True)
        else:
            _fail()

    # --- expressions
    def expression(self) -> None:
        self.assignment()
        while self.opt(","):
            self.assignment()

    def arrow_at(self) -> int:
        """Position of ``=>`` if a parameter list begins here, else -1."""
        c, at = self.c, self.at
        if c[at] == "<":
            if not self.ts:
                return -1
            saved = at
            try:
                self.type_parameters()
                at = self.at
            except _Invalid:
                return -1
            finally:
                self.at = saved
            if c[at] != "(":
                return -1
        to = self.close[at] + 1
        if c[to] == ARROW:
            return to
        if self.ts and c[to] == ":":
            saved = self.at
            try:
                self.at = to + 1
                self.return_type()
                return self.at if c[self.at] == ARROW else -1
            except (_Invalid, IndexError):
                return -1
            finally:
                self.at = saved
        return -1

    def arrow_body(self, is_async: bool) -> None:
        if self.c[self.at] == "{":
            self.body(is_async, False)
            return
        saved = self.depth_async, self.depth_generator
        self.depth_async, self.depth_generator = int(is_async), 0
        self.assignment()
        self.depth_async, self.depth_generator = saved

    def assignment(self) -> None:
        c, ch = self.c, self.c[self.at]
        if ch in _IDS and c[self.at + 1] == ARROW:
            self.at += 2
            self.arrow_body(False)
            return
        if ch == ASYNC and self.at + 1 not in self.breaks:
            if c[self.at + 1] in _IDS and c[self.at + 2] == ARROW:
                self.at += 3
                self.arrow_body(True)
                return
            if c[self.at + 1] in "(<":
                self.at += 1
                if self.arrow_at() >= 0:
                    self.arrow(True)
                    return
                self.at -= 1
        if ch in "(<" and self.arrow_at() >= 0:
            self.arrow(False)
            return
        if ch == YIELD and self.depth_generator:
            self.at += 1
            if self.at not in self.breaks:
                if self.opt("*") or c[self.at] not in ";,)]}:" and self.at < self.n:
                    self.assignment()
            return
        target = self.conditional()
        if c[self.at] in _ASSIGN:
            if not target or (target == "P" and c[self.at] != "="):
                _fail()
            self.at += 1
            self.assignment()
        elif target == "C":
            _fail()

    def arrow(self, is_async: bool) -> None:
        if self.ts:
            self.type_parameters()
        self.parameters()
        if self.ts and self.opt(":"):
            self.return_type()
        if self.at in self.breaks:
            _fail()
        self.eat(ARROW)
        self.arrow_body(is_async)

    def conditional(self) -> str:
        target = self.binary()
        if self.c[self.at] == "?":
            if self.ts and self.c[self.at + 1] in ",):;=":
                return target
            self.at += 1
            self.assignment_in()
            self.eat(":")
            self.assignment()
            return ""
        return target

    def binary(self) -> str:
        c = self.c
        if c[self.at] == PRIVATE and c[self.at + 1] == IN:
            self.at += 2
        target = self.unary()
        while True:
            ch = c[self.at]
            if ch in _BINARY:
                if ch == IN and self.no_in:
                    return target
                self.at += 1
                if ch == ">":
                    while c[self.at] == ">":
                        self.at += 1
                self.unary()
                target = ""
            elif self.ts and ch in (AS, SATISFIES) and self.at not in self.breaks:
                self.at += 1
                self.type() if c[self.at] != CONST else self.eat(CONST)
                target = target and "T"
            else:
                return target

    def unary(self) -> str:
        c, ch = self.c, self.c[self.at]
        if ch in _UNARY:
            self.at += 1
            self.unary()
            return ""
        if ch == INC or ch == DEC:
            self.at += 1
            if self.unary() != "T":
                _fail()
            return ""
        if ch == AWAIT and (self.depth_async or not self.depth_function and self.module and c[self.at + 1] not in ";,)=.]"):
            self.at += 1
            self.unary()
            return ""
        if ch == "<" and self.ts:
            self.type_arguments()
            self.unary()
            return ""
        target = self.left_hand_side()
        ch = c[self.at]
        if (ch == INC or ch == DEC) and self.at not in self.breaks:
            if target != "T":
                _fail()
            self.at += 1
            return ""
        return target

    def arguments(self) -> None:
        self.eat("(")
        c = self.c
        while c[self.at] != ")":
            if c[self.at] == DOTS:
                self.at += 1
            self.assignment_in()
            if c[self.at] != ")":
                self.eat(",")
        self.at += 1

    def left_hand_side(self) -> str:
        c, ch = self.c, self.c[self.at]
        if ch == NEW:
            self.at += 1
            if self.opt("."):
                self.eat(TARGET)
            else:
                self.new_callee()
                if self.ts and c[self.at] == "<":
                    self.try_type_arguments()
                if c[self.at] == "(":
                    self.arguments()
            target = ""
        else:
            target = self.primary()
        while True:
            ch = c[self.at]
            if ch == ".":
                self.at += 1
                if c[self.at] == PRIVATE:
                    self.at += 1
                else:
                    self.name()
                target = "T"
            elif ch == "(":
                self.arguments()
                target = ""
            elif ch == "[":
                self.at += 1
                outer, self.no_in = self.no_in, False
                self.expression()
                self.no_in = outer
                self.eat("]")
                target = "T"
            elif ch == CHAIN:
                self.at += 1
                if c[self.at] == "(":
                    self.arguments()
                elif self.opt("["):
                    self.expression()
                    self.eat("]")
                elif not self.opt(PRIVATE):
                    self.name()
                target = ""
            elif ch == TEMPLATE:
                self.at += 1
                target = ""
            elif self.ts and ch == "!" and self.at not in self.breaks:
                self.at += 1
            elif self.ts and ch == "<" and self.try_type_arguments():
                target = ""
            else:
                return target

    def new_callee(self) -> None:
        c = self.c
        if c[self.at] == NEW:
            self.at += 1
            self.new_callee()
            if c[self.at] == "(":
                self.arguments()
        elif c[self.at] == IMPORT:
            _fail()
        else:
            self.primary()
        while True:
            if self.opt("."):
                if not self.opt(PRIVATE):
                    self.name()
            elif self.opt("["):
                self.expression()
                self.eat("]")
            else:
                return

    def try_type_arguments(self) -> bool:
        """Type arguments of a call: only where a call or template follows."""
        saved = self.at
        try:
            self.type_arguments()
            if self.c[self.at] == "(" or self.c[self.at] == TEMPLATE or self.c[self.at] in ";,)]}.:" or self.at in self.breaks or self.at == self.n:
                return True
        except (_Invalid, IndexError):
            pass
        self.at = saved
        return False

    def primary(self) -> str:
        c, ch = self.c, self.c[self.at]
        if ch == IDENT:
            self.at += 1
            return "T"
        if ch in _LITERALS:
            self.at += 1
            if ch == SUPER and c[self.at] not in "(.[":
                _fail()
            return ""
        if ch == TEMPLATE:
            self.at += 1
            return ""
        if ch == "(":
            self.at += 1
            outer, self.no_in = self.no_in, False
            self.expression()
            self.no_in = outer
            self.eat(")")
            # a parenthesised name or member may be assigned to
            return "T" if c[self.at - 2] in _NAMES or c[self.at - 2] == "]" else ""
        if ch == "{":
            return self.object()
        if ch == "[":
            self.at += 1
            while not self.opt("]"):
                if self.opt(","):
                    continue
                self.opt(DOTS)
                self.assignment_in()
                if c[self.at] != "]":
                    self.eat(",")
            return "P"
        if ch == FUNCTION or (ch == ASYNC and c[self.at + 1] == FUNCTION and self.at + 1 not in self.breaks):
            self.function(False)
            return ""
        if ch == CLASS:
            self.class_(False)
            return ""
        if ch == "@":
            self.decorators()
            self.class_(False)
            return ""
        if ch == IMPORT:
            self.at += 1
            if self.opt("."):
                self.eat(META)
            else:
                self.arguments()
            return ""
        if ch in _IDS:
            if ch == AWAIT and self.depth_async or ch == YIELD and self.depth_generator:
                _fail()
            self.at += 1
            return "T"
        return _fail()

    def object(self) -> str:
        c = self.c
        self.eat("{")
        outer, self.no_in = self.no_in, False
        cover = False
        while not self.opt("}"):
            ch, nxt = c[self.at], c[self.at + 1]
            if ch == DOTS:
                self.at += 1
                self.assignment()
            else:
                is_async = generator = False
                if ch in (GET, SET, ASYNC) and (nxt in _NAMES or nxt in (STRING, NUMBER, PRIVATE, "[") or (nxt == "*" and ch == ASYNC)):
                    is_async = ch == ASYNC
                    self.at += 1
                    generator = self.opt("*")
                    self.property_name()
                    self.signature_and_body(is_async, generator, False)
                elif ch == "*":
                    self.at += 1
                    self.property_name()
                    self.signature_and_body(False, True, False)
                else:
                    self.property_name()
                    nxt = c[self.at]
                    if nxt == ":":
                        self.at += 1
                        self.assignment()
                    elif nxt == "(" or (nxt == "<" and self.ts):
                        self.signature_and_body(False, False, False)
                    elif ch in _IDS and nxt in ",}":
                        pass
                    elif ch in _IDS and nxt == "=":
                        self.at += 1
                        self.assignment()
                        cover = True
                    else:
                        _fail()
            if c[self.at] != "}":
                self.eat(",")
        self.no_in = outer
        # {a = 1} is a pattern only
        return "C" if cover and c[self.at] not in (OF, IN) else "P"

    # --- types
    def type_parameters(self) -> None:
        if self.c[self.at] != "<":
            return
        self.at += 1
        while not self.opt(">"):
            while self.c[self.at] in (CONST, IN) or self.c[self.at] in _IDS and self.c[self.at + 1] in _IDS:
                self.at += 1
            self.name()
            if self.opt(EXTENDS):
                self.type()
            if self.opt("="):
                self.type()
            if self.c[self.at] != ">":
                self.eat(",")

    def type_arguments(self) -> None:
        self.eat("<")
        while True:
            self.type()
            if not self.opt(","):
                break
        self.eat(">")

    def type_list(self) -> None:
        self.type()
        while self.opt(","):
            self.type()

    def return_type(self) -> None:
        c = self.c
        if c[self.at] == ASSERTS and (c[self.at + 1] in _IDS or c[self.at + 1] == THIS) and self.at + 1 not in self.breaks:
            self.at += 2
            if self.opt(IS):
                self.type()
            return
        if (c[self.at] in _IDS or c[self.at] == THIS) and c[self.at + 1] == IS and self.at + 1 not in self.breaks:
            self.at += 2
        self.type()

    def type(self) -> None:
        c = self.c
        if c[self.at] == "<" or c[self.at] == "(" and self.function_type_at():
            self.type_parameters()
            self.parameters()
            self.eat(ARROW)
            self.return_type()
            return
        if c[self.at] == NEW or (c[self.at] == ABSTRACT and c[self.at + 1] == NEW):
            self.opt(ABSTRACT)
            self.at += 1
            self.type_parameters()
            self.parameters()
            self.eat(ARROW)
            self.type()
            return
        self.union_type()
        if c[self.at] == EXTENDS and self.at not in self.breaks:
            saved = self.at
            self.at += 1
            self.union_type()
            if not self.opt("?"):
                self.at = saved
                return
            self.type()
            self.eat(":")
            self.type()

    def function_type_at(self) -> bool:
        return self.c[self.close[self.at] + 1] == ARROW

    def union_type(self) -> None:
        c = self.c
        if c[self.at] in "|&":
            self.at += 1
        self.postfix_type()
        while c[self.at] in "|&":
            self.at += 1
            if c[self.at] == "(" and self.function_type_at():
                self.type()
            else:
                self.postfix_type()

    def postfix_type(self) -> None:
        c = self.c
        while c[self.at] in (KEYOF, UNIQUE, READONLY) and (c[self.at + 1] in _NAMES or c[self.at + 1] in "([{" or c[self.at + 1] == STRING):
            self.at += 1
        if c[self.at] == INFER and c[self.at + 1] in _IDS:
            self.at += 2
            if c[self.at] == EXTENDS:
                saved = self.at
                self.at += 1
                self.union_type()
                if c[self.at] == "?":
                    self.at = saved
        else:
            self.primary_type()
        while c[self.at] == "[" and self.at not in self.breaks:
            self.at += 1
            if not self.opt("]"):
                self.type()
                self.eat("]")

    def primary_type(self) -> None:
        c, ch = self.c, self.c[self.at]
        if ch == "(":
            self.at += 1
            self.type()
            self.eat(")")
        elif ch == "[":
            self.at += 1
            while not self.opt("]"):
                self.opt(DOTS)
                if c[self.at] in _NAMES and (c[self.at + 1] == ":" or c[self.at + 1] == "?" and c[self.at + 2] == ":"):
                    self.at += 1
                    self.opt("?")
                    self.eat(":")
                self.type()
                self.opt("?")
                if c[self.at] != "]":
                    self.eat(",")
        elif ch == "{":
            self.object_type()
        elif ch in (STRING, NUMBER, TEMPLATE):
            self.at += 1
        elif ch == "-" and c[self.at + 1] == NUMBER:
            self.at += 2
        elif ch == TYPEOF:
            self.at += 1
            if c[self.at] == IMPORT:
                self.primary_type()
                return
            self.name()
            while self.opt("."):
                self.name()
            if c[self.at] == "<":
                self.type_arguments()
        elif ch == IMPORT:
            self.at += 1
            self.arguments()
            while self.opt("."):
                self.name()
            if c[self.at] == "<":
                self.type_arguments()
        elif ch in _IDS or ch in (VOID, THIS, NULL, TRUE, FALSE):
            self.at += 1
            while self.opt("."):
                self.name()
            if c[self.at] == "<" and self.at not in self.breaks:
                self.type_arguments()
        else:
            _fail()

    def object_type(self) -> None:
        c = self.c
        self.eat("{")
        while not self.opt("}"):
            if c[self.at] in "+-" and c[self.at + 1] == READONLY:
                self.at += 1
            while c[self.at] in (READONLY, GET, SET) and (c[self.at + 1] in _NAMES or c[self.at + 1] in (STRING, NUMBER, "[")):
                self.at += 1
            ch = c[self.at]
            if ch == "[" and c[self.at + 1] in _IDS and c[self.at + 2] in (":", IN):
                self.at += 3
                self.type()
                if self.opt(AS):
                    self.type()
                self.eat("]")
                if c[self.at] in "+-":
                    self.at += 1
                self.opt("?")
                if self.opt(":"):
                    self.type()
            elif ch in "(<" or ch == NEW and c[self.at + 1] in "(<":
                self.opt(NEW)
                self.type_parameters()
                self.parameters()
                if self.opt(":"):
                    self.return_type()
            else:
                self.property_name()
                self.opt("?")
                if c[self.at] in "(<":
                    self.type_parameters()
                    self.parameters()
                    if self.opt(":"):
                        self.return_type()
                elif self.opt(":"):
                    self.type()
            if c[self.at] != "}" and not self.opt(";") and not self.opt(",") and self.at not in self.breaks:
                _fail()


_BRACKETS = re.compile(r"[(){}\[\]]")
_CONTEXT = frozenset(map(_W, "await yield break continue super import export case default with".split()))
_NO_START = frozenset(["(", "[", TEMPLATE, "+", "-", "*", "/", ".", ",", "?", ":", REGEX, WHILE, "{", "}", ELSE, CATCH, FINALLY, "<", "@", STRING])
_LINES: dict[tuple[str, bool], str] = {}


def _line(line: str, ts: bool) -> str:
    """STATEMENT or RETURNS for a line that is whole statements on its own, else the line."""
    key = (line, ts)
    got = _LINES.get(key)
    if got is None:
        got = line
        if line[-1] == ";" and line[0] not in _NO_START and not _CONTEXT.intersection(line) and BAD not in line:
            try:
                p = _Parser(line, ts, False)
                p.depth_function = 1
                while p.at < p.n:
                    p.statement(True)
                got = RETURNS if RETURN in line and ARROW not in line and FUNCTION not in line else line if RETURN in line else STATEMENT
            except (_Invalid, IndexError, RecursionError, KeyError):
                pass
        if len(_LINES) > 100_000:
            _LINES.clear()
        _LINES[key] = got
    return got


_RUN = re.compile(STATEMENT + r"\n(?:" + STATEMENT + r"\n)+")


def _parse(shape: str, ts: bool) -> bool:
    try:
        p = _Parser(shape, ts, True)
        p.program()
        return p.at >= p.n
    except (_Invalid, IndexError, RecursionError, KeyError):
        return False


def _reduced(shape: str, ts: bool) -> str:
    out, ended = [], True
    for line in shape.split("\n"):
        if not line:
            continue
        got = _line(line, ts) if ended else line
        out.append(got)
        ended = line[-1] in ";{}"
    return _RUN.sub(STATEMENT + "\n", "\n".join(out) + "\n")


def javascript(text: str, ts: bool = False) -> bool:
    # nesting is recursion here, of Python frames only
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    if text.startswith("#!"):
        text = text[2 + len(text[2:].split("\n", 1)[0]) :]
    shape = _shape(text, ts)
    if BAD in shape:
        return False
    return _parse(_reduced(shape, ts), ts) or _parse(shape, ts)


def typescript(text: str) -> bool:
    return javascript(text, True)


def python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text.encode("utf-8", "surrogatepass"), "text", "exec", flags=0x400, dont_inherit=True)  # 0x400: the tree only
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError, UnicodeError):
            return False


def _no_constant(_: str):
    raise ValueError


def strict_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
        return True
    except (ValueError, RecursionError):
        return False


GRAMMARS = {"javascript": javascript, "typescript": typescript, "python": python, "json": strict_json}

# The language of a file extension.
EXTENSIONS = {".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".py": "python", ".json": "json"}


def valid(language: str, text: str) -> bool:
    return GRAMMARS[language](text)


# Token classes, in a row, that speak for a language, and how much.
_SIGNS = {
    "javascript": {"function": 1, "const": 1, "let": 1, "var": 1, "=>": 1, "===": 1, "; \n": 1, "{ \n": 1, "} \n": 1},
    "typescript": {"interface": 3, "enum": 3, "readonly": 3, "implements": 3, "namespace": 3, "declare": 3, ") :": 2, "? :": 2, "function": 0.5, "const": 0.5, "let": 0.5, "=>": 0.5, "; \n": 0.5, "{ \n": 0.5, "} \n": 0.5},
    "python": {": \n": 3, "from": 1, ") :": 1, "\n class": 1, "\n import": 1},
    "json": {"STRING :": 1, "[ \n": 1, ", \n": 0.3, "{ \n": 0.3},
}
_SIGNS = {language: {"".join(STRING if t == "STRING" else t if t == "\n" else _W(t) for t in sign.split(" ")): weight for sign, weight in signs.items()} for language, signs in _SIGNS.items()}


def ranked(text: str) -> list[str]:
    """All languages, those whose tokens are most frequent first."""
    shape = _shape(text, False)
    score = {language: sum(weight * shape.count(sign) for sign, weight in signs.items()) for language, signs in _SIGNS.items()}
    return sorted(score, key=lambda k: (-score[k], k))

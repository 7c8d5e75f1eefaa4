"""Recursive-descent parser: tokens to a tree of plain nodes.

A node has a kind, its main token, its first and last token, its parent, and named parts that are nodes,
lists of nodes, token numbers or flags. On a syntax error the parser notes a diagnostic, skips to the
next member or statement, and goes on, so that a broken file still gives facts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from graphmill.frontend.lexer import Lexed, identifier_name, tokenize


class Node:
    __slots__ = ("id", "kind", "token", "first", "last", "parent", "parts")

    def __init__(self, kind: str, token: int, first: int, **parts: Any):
        self.id, self.kind, self.token, self.first, self.last = -1, kind, token, first, first
        self.parent: Node | None = None
        self.parts = parts

    def __getattr__(self, name: str) -> Any:
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(f"{self.kind} node has no {name}") from None

    def get(self, name: str, default: Any = None) -> Any:
        return self.parts.get(name, default)

    def children(self) -> Iterator[Node]:
        """Child nodes in source order of the parts."""
        for part in self.parts.values():
            if isinstance(part, Node):
                yield part
            elif isinstance(part, list):
                for x in part:
                    if isinstance(x, Node):
                        yield x
                    elif isinstance(x, Param) and x.type is not None:
                        yield x.type

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def __repr__(self) -> str:
        return f"<{self.kind} {self.id}>"


class Param:
    """A function parameter; ``type`` is None for ``anytype`` and ``...``."""

    __slots__ = ("name", "type", "anytype", "comptime")

    def __init__(self, name: int | None, type: Node | None, anytype: bool, comptime: bool):
        self.name, self.type, self.anytype, self.comptime = name, type, anytype, comptime


class SyntaxProblem(Exception):
    pass


ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= +%= -%= *%= +|= -|= *|= <<|=".split())
#: Binary operators by rising precedence; comparisons don't chain.
LEVELS = (
    ("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("&", "^", "|", "orelse", "catch"), ("<<", ">>", "<<|"),
    ("+", "-", "++", "+%", "-%", "+|", "-|"), ("||", "*", "/", "%", "**", "*%", "*|"),
)
PREFIX = frozenset("! - ~ -% & try".split())


class Tree:
    """A parsed file: source bytes, tokens, nodes in pre-order (the root is node 0), diagnostics as (byte, message)."""

    def __init__(self, source: bytes):
        self.source = source
        self.lexed: Lexed = tokenize(source)
        self.comments = self.lexed.comments
        # doc comments carry no structure
        self.tokens = [t for t in self.lexed.tokens if t.tag != "doc"]
        self.tags = [t.tag for t in self.tokens]
        self.problems: list[tuple[int, str]] = []
        self.root = Parser(self).file()
        self.nodes: list[Node] = []
        todo = [self.root]
        while todo:
            node = todo.pop()
            node.id = len(self.nodes)
            self.nodes.append(node)
            below = list(node.children())
            for child in below:
                child.parent = node
            todo += reversed(below)

    def text(self, token: int) -> str:
        t = self.tokens[token]
        return self.source[t.start : t.end].decode(errors="replace")

    def name(self, token: int) -> str:
        return identifier_name(self.text(token))

    def node_text(self, node: Node) -> str:
        return self.source[self.tokens[node.first].start : self.tokens[node.last].end].decode(errors="replace")


class Parser:
    def __init__(self, tree: Tree):
        self.tree, self.tags, self.at = tree, tree.tags, 0

    # -- tokens
    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tags[at] if at < len(self.tags) else "eof"

    def take(self, tag: str) -> int | None:
        if self.tags[self.at] == tag:
            self.at += 1
            return self.at - 1
        return None

    def need(self, tag: str) -> int:
        found = self.take(tag)
        if found is None:
            raise SyntaxProblem(f"expected '{tag}', found '{self.peek()}'")
        return found

    def done(self, node: Node) -> Node:
        node.last = max(node.first, self.at - 1)
        return node

    def note(self, problem: SyntaxProblem) -> None:
        self.tree.problems.append((self.tree.tokens[min(self.at, len(self.tags) - 1)].start, str(problem)))

    def skip(self, stop: tuple[str, ...]) -> None:
        """To just after the next ';' or to a closing or starting token of the current level."""
        depth = 0
        while self.peek() != "eof":
            tag = self.peek()
            if depth == 0 and (tag == "}" or tag in stop):
                return
            if tag in "{([":
                depth += 1
            elif tag in "})]":
                depth -= 1
                if tag == "}" and depth <= 0:
                    self.at += 1
                    return
            self.at += 1
            if tag == ";" and depth <= 0:
                return

    # -- containers
    def file(self) -> Node:
        root = Node("root", 0, 0)
        root.parts["members"] = self.members("eof")
        return self.done(root)

    def members(self, end: str) -> list[Node]:
        out: list[Node] = []
        while self.peek() not in (end, "eof"):
            before = self.at
            try:
                out.append(self.member())
            except SyntaxProblem as problem:
                self.note(problem)
                self.skip(("pub", "fn", "const", "var", "test") if self.at > before else ())
                if self.at == before:
                    self.at += 1
        return out

    def member(self) -> Node:
        first = self.at
        if self.peek() == "test":
            token = self.need("test")
            name = self.take("string")
            if name is None:
                name = self.take("identifier")
            return self.done(Node("test", token, first, name=name, body=self.block()))
        if self.peek() == "comptime" and self.peek(1) == "{":
            token = self.need("comptime")
            return self.done(Node("comptime", token, first, expr=self.block()))
        pub = self.take("pub") is not None
        linkage = None
        while self.peek() in ("extern", "export", "inline", "noinline", "threadlocal"):
            if self.peek() in ("extern", "export"):
                linkage = self.peek()
            self.at += 1
            self.take("string")
        if self.peek() == "fn":
            return self.function(first, pub, linkage)
        if self.peek() in ("const", "var"):
            node = self.variable(first, pub, linkage)
            self.need(";")
            return node
        return self.field(first)

    def field(self, first: int) -> Node:
        comptime = self.take("comptime") is not None
        name = None
        if self.peek() == "identifier" and self.peek(1) in (":", ",", "=", "}", "align"):
            name = self.need("identifier")
            tuple_like = False
            type_, align = None, None
            if self.take(":") is not None:
                type_ = self.type_expr()
            align = self.aligned()
        else:
            tuple_like, type_, align = True, self.type_expr(), self.aligned()
        value = self.expr() if self.take("=") is not None else None
        node = self.done(Node("field", name if name is not None else first, first, name=name, comptime=comptime, tuple_like=tuple_like, align=align, type=type_, value=value))
        if self.take(",") is None and self.peek() not in ("}", "eof"):
            raise SyntaxProblem(f"expected ',' after a field, found '{self.peek()}'")
        return node

    def aligned(self) -> Node | None:
        out = None
        while self.peek() in ("align", "addrspace", "linksection", "callconv"):
            self.at += 1
            self.need("(")
            out = self.expr()
            if self.take(":") is not None:  # bit ranges
                self.expr()
                self.need(":")
                self.expr()
            self.need(")")
        return out

    def function(self, first: int, pub: bool = False, linkage: str | None = None) -> Node:
        token = self.need("fn")
        name = self.take("identifier")
        params = self.params()
        align = self.aligned()
        self.take("!")
        inferred = self.tags[self.at - 1] == "!"
        result = None
        if self.peek() not in ("{", ";", ",", ")", "}", "=", "eof"):
            result = self.type_expr()
        proto = self.done(Node("fn_proto", token, first, name=name, pub=pub, linkage=linkage, params=params, align=align, result=result, inferred=inferred))
        if self.peek() == "{" and name is not None:
            return self.done(Node("fn_decl", token, first, proto=proto, body=self.block()))
        if name is not None:
            self.take(";")
        return proto

    def params(self) -> list[Param]:
        self.need("(")
        out: list[Param] = []
        while self.peek() != ")":
            comptime = False
            while self.peek() in ("comptime", "noalias"):
                comptime |= self.peek() == "comptime"
                self.at += 1
            if self.take("...") is not None:
                out.append(Param(None, None, False, False))
            else:
                name = None
                if self.peek() == "identifier" and self.peek(1) == ":":
                    name = self.need("identifier")
                    self.need(":")
                if self.take("anytype") is not None:
                    out.append(Param(name, None, True, comptime))
                else:
                    out.append(Param(name, self.type_expr(), False, comptime))
            if self.take(",") is None:
                break
        self.need(")")
        return out

    def variable(self, first: int, pub: bool = False, linkage: str | None = None, comptime: bool = False) -> Node:
        """``const`` or ``var`` with its value, without the semicolon."""
        token = self.at
        const = self.peek() == "const"
        self.at += 1
        name = self.need("identifier")
        type_ = self.type_expr() if self.take(":") is not None else None
        align = self.aligned()
        init = self.expr() if self.take("=") is not None else None
        return self.done(Node("var", token, first, name=name, const=const, pub=pub, linkage=linkage, comptime=comptime, type=type_, align=align, init=init))

    # -- statements
    def block(self, label: int | None = None, first: int | None = None) -> Node:
        token = self.need("{")
        out: list[Node] = []
        node = Node("block", token, token if first is None else first, label=label)
        while self.peek() not in ("}", "eof"):
            before = self.at
            try:
                out.append(self.statement())
            except SyntaxProblem as problem:
                self.note(problem)
                self.skip(())
                if self.at == before:
                    self.at += 1
        self.need("}")
        node.parts["statements"] = out
        return self.done(node)

    def labelled(self) -> int | None:
        if self.peek() == "identifier" and self.peek(1) == ":" and self.peek(2) in ("{", "while", "for", "inline", "switch"):
            label = self.need("identifier")
            self.need(":")
            return label
        return None

    def statement(self) -> Node:
        first = self.at
        tag = self.peek()
        if tag == "comptime" and self.peek(1) in ("const", "var"):
            self.at += 1
            return self.declaration(first, True)
        if tag in ("const", "var"):
            return self.declaration(first, False)
        if tag == "comptime":
            token = self.need("comptime")
            body = self.statement_body()
            return self.done(Node("comptime", token, first, expr=body))
        if tag in ("defer", "errdefer", "suspend", "nosuspend"):
            token = self.at
            self.at += 1
            payload = self.payload()[:1] if tag == "errdefer" and self.peek() == "|" else []
            return self.done(Node(tag, token, first, payload=payload, expr=self.statement_body()))
        found = self.block_statement()
        if found is not None:
            return found
        node = self.assignment()
        self.need(";")
        return node

    def statement_body(self) -> Node:
        found = self.block_statement()
        if found is not None:
            return found
        node = self.assignment()
        self.need(";")
        return node

    def block_statement(self) -> Node | None:
        """A statement that ends without a semicolon: a block, if, while, for, switch; None if it is an expression."""
        first = self.at
        label = self.labelled()
        tag = self.peek(1) if self.peek() == "inline" else self.peek()
        if tag == "{":
            node = self.block(label, first)
        elif tag == "if":
            node = self.if_expr(True)
        elif tag == "while":
            node = self.while_expr(True)
        elif tag == "for":
            node = self.for_expr(True)
        elif tag == "switch":
            node = self.switch_expr()
        else:
            self.at = first
            return None
        if self.peek() in (".", ".*", ".?", "(", "[") and tag in ("{", "switch") and self.tags[self.at - 1] == "}" and self.peek() != "(":
            self.at = first  # e.g. switch (x) {...}.field = ...
            return None
        if self.tags[self.at - 1] != ";":
            self.take(";")
        return node

    def declaration(self, first: int, comptime: bool) -> Node:
        node = self.variable(first, comptime=comptime)
        if self.peek() == ",":
            return self.destructure(first, [node], comptime)
        self.need(";")
        return node

    def destructure(self, first: int, targets: list[Node], comptime: bool = False) -> Node:
        while self.take(",") is not None:
            start = self.at
            targets.append(self.variable(start, comptime=comptime) if self.peek() in ("const", "var") else self.expr())
        # the value belongs to the whole, not to the last declaration
        last = targets[-1]
        if last.kind == "var" and last.get("init") is not None:
            value = last.parts["init"]
            last.parts["init"] = None
            last.last = value.first - 2
        else:
            self.need("=")
            value = self.expr()
        self.need(";")
        return self.done(Node("destructure", first, first, targets=targets, value=value, comptime=comptime))

    def assignment(self) -> Node:
        first = self.at
        left = self.expr()
        if self.peek() in ASSIGN:
            token = self.at
            op = self.peek()
            self.at += 1
            return self.done(Node("assign", token, first, op=op, left=left, right=self.expr()))
        if self.peek() == ",":
            node = self.destructure(first, [left])
            self.at -= 1  # the caller takes the semicolon
            return node
        return left

    # -- expressions
    def expr(self, level: int = 0) -> Node:
        if level == len(LEVELS):
            return self.prefix()
        first = self.at
        left = self.expr(level + 1)
        while self.peek() in LEVELS[level]:
            token, op = self.at, self.peek()
            self.at += 1
            if op == "catch":
                payload = self.payload() if self.peek() == "|" else []
                left = self.done(Node("catch", token, first, left=left, payload=payload, right=self.expr(level + 1)))
            else:
                left = self.done(Node("binary", token, first, op=op, left=left, right=self.expr(level + 1)))
            if level == 2:
                break
        return left

    def prefix(self) -> Node:
        first = self.at
        if self.peek() in PREFIX:
            op = self.peek()
            self.at += 1
            return self.done(Node("unary", first, first, op=op, expr=self.prefix()))
        return self.primary()

    def primary(self) -> Node:
        first, tag = self.at, self.peek()
        if tag == "comptime":
            self.at += 1
            return self.done(Node("comptime", first, first, expr=self.expr()))
        if tag in ("nosuspend", "resume"):
            self.at += 1
            return self.done(Node(tag, first, first, expr=self.expr()))
        if tag == "return":
            self.at += 1
            return self.done(Node("return", first, first, expr=self.expr() if self.begins_expr() else None))
        if tag in ("break", "continue"):
            self.at += 1
            label = None
            if self.take(":") is not None:
                label = self.need("identifier")
            return self.done(Node(tag, first, first, label=label, expr=self.expr() if self.begins_expr() else None))
        label = self.labelled()
        tag = self.peek(1) if self.peek() == "inline" else self.peek()
        if tag == "if":
            return self.if_expr(False)
        if tag == "while":
            return self.while_expr(False)
        if tag == "for":
            return self.for_expr(False)
        if tag == "{":
            return self.suffixes(self.block(label, first), first)
        return self.type_expr(True)

    def begins_expr(self) -> bool:
        return self.peek() not in (";", ",", ")", "}", "]", "else", "eof", ":", "|")

    def payload(self) -> list[int]:
        """Names between bars, by token."""
        self.need("|")
        out: list[int] = []
        while self.peek() != "|":
            self.take("*")
            out.append(self.need("identifier"))
            if self.take(",") is None:
                break
        self.need("|")
        return out

    def branch(self, statement: bool) -> Node:
        """The body of a control structure."""
        if not statement:
            return self.expr()
        if self.peek() == "{" or self.labelled_ahead():
            first = self.at
            return self.block(self.labelled(), first)
        found = self.block_statement() if self.peek() in ("if", "while", "for", "switch", "inline") else None
        if found is not None:
            return found
        return self.assignment()

    def labelled_ahead(self) -> bool:
        return self.peek() == "identifier" and self.peek(1) == ":" and self.peek(2) == "{"

    def if_expr(self, statement: bool) -> Node:
        first = self.need("if")
        self.need("(")
        cond = self.expr()
        self.need(")")
        payload = self.payload() if self.peek() == "|" else []
        then = self.branch(statement)
        node = Node("if", first, first, cond=cond, payload=payload, then=then, error=[], otherwise=None)
        if self.peek() == "else" or (self.peek() == ";" and self.peek(1) == "else" and statement):
            self.take(";")
            self.need("else")
            node.parts["error"] = self.payload() if self.peek() == "|" else []
            node.parts["otherwise"] = self.branch(statement)
        return self.done(node)

    def while_expr(self, statement: bool) -> Node:
        first = self.at
        self.take("inline")
        token = self.need("while")
        self.need("(")
        cond = self.expr()
        self.need(")")
        payload = self.payload() if self.peek() == "|" else []
        step = None
        if self.take(":") is not None:
            self.need("(")
            step = self.assignment()
            self.need(")")
        node = Node("while", token, first, cond=cond, payload=payload, step=step, then=self.branch(statement), error=[], otherwise=None)
        if self.take("else") is not None:
            node.parts["error"] = self.payload() if self.peek() == "|" else []
            node.parts["otherwise"] = self.branch(statement)
        return self.done(node)

    def for_expr(self, statement: bool) -> Node:
        first = self.at
        self.take("inline")
        token = self.need("for")
        self.need("(")
        inputs: list[Node] = []
        while self.peek() != ")":
            start = self.at
            one = self.expr()
            if self.peek() == "..":
                dots = self.need("..")
                end = self.expr() if self.peek() not in (",", ")") else None
                one = self.done(Node("for_range", dots, start, start=one, end=end))
            inputs.append(one)
            if self.take(",") is None:
                break
        self.need(")")
        payload = self.payload()
        node = Node("for", token, first, inputs=inputs, payload=payload, then=self.branch(statement), otherwise=None)
        if self.take("else") is not None:
            node.parts["otherwise"] = self.branch(statement)
        return self.done(node)

    def switch_expr(self) -> Node:
        first = self.need("switch")
        self.need("(")
        cond = self.expr()
        self.need(")")
        self.need("{")
        cases: list[Node] = []
        while self.peek() != "}":
            start = self.at
            inline = self.take("inline") is not None
            values: list[Node] = []
            if self.peek() == "else" and self.peek(1) == "=>":
                self.at += 1
            else:
                while self.peek() != "=>":
                    begin = self.at
                    value = self.expr()
                    if self.peek() == "...":
                        dots = self.need("...")
                        value = self.done(Node("range", dots, begin, left=value, right=self.expr()))
                    values.append(value)
                    if self.take(",") is None:
                        break
            arrow = self.need("=>")
            payload = self.payload() if self.peek() == "|" else []
            target = self.assignment_value()
            cases.append(self.done(Node("case", arrow, start, values=values, payload=payload, inline=inline, target=target)))
            if self.take(",") is None:
                break
        self.need("}")
        return self.done(Node("switch", first, first, cond=cond, cases=cases))

    def assignment_value(self) -> Node:
        first = self.at
        left = self.expr()
        if self.peek() in ASSIGN:
            token, op = self.at, self.peek()
            self.at += 1
            return self.done(Node("assign", token, first, op=op, left=left, right=self.expr()))
        return left

    def type_expr(self, value: bool = False) -> Node:
        """A type, or any suffixed primary expression; ``value`` allows a curly initialiser after it."""
        first, tag = self.at, self.peek()
        if tag == "?":
            self.at += 1
            return self.done(Node("optional_type", first, first, child=self.type_expr()))
        if tag in ("*", "**"):
            self.at += 1
            node = self.pointer(first, None)
            if tag == "**":
                node = self.done(Node("ptr_type", first, first, sentinel=None, align=None, child=node, size="one"))
            return node
        if tag == "anyframe":
            self.at += 1
            if self.take("->") is not None:
                return self.done(Node("anyframe", first, first, child=self.type_expr()))
            return self.done(Node("anyframe", first, first, child=None))
        if tag == "[":
            return self.bracket_type(first, value)
        left = self.suffixes(self.atom(), first)
        if value and self.peek() == "{" and self.curly_follows(left):
            left = self.suffixes(self.initializer(left, first), first)
        if self.peek() == "!" and self.tags[self.at - 1] != ";":
            token = self.need("!")
            return self.done(Node("error_union", token, first, left=left, right=self.type_expr()))
        return left

    @staticmethod
    def curly_follows(node: Node) -> bool:
        return node.kind in ("identifier", "field_access", "call", "builtin", "container", "grouped", "array_type", "index", "ptr_type", "unwrap", "deref")

    def pointer(self, first: int, sentinel: Node | None, size: str = "one") -> Node:
        align = None
        while self.peek() in ("const", "volatile", "allowzero", "align", "addrspace"):
            if self.peek() in ("align", "addrspace"):
                align = self.aligned()
            else:
                self.at += 1
        return self.done(Node("ptr_type", first, first, sentinel=sentinel, align=align, child=self.type_expr(), size=size))

    def bracket_type(self, first: int, value: bool) -> Node:
        self.need("[")
        if self.take("*") is not None:
            sentinel = None
            if self.peek() == "identifier" and self.tree.text(self.at) == "c":
                self.at += 1
            elif self.take(":") is not None:
                sentinel = self.expr()
            self.need("]")
            return self.pointer(first, sentinel, "many")
        if self.take("]") is not None:
            return self.pointer(first, None, "slice")
        if self.take(":") is not None:
            sentinel = self.expr()
            self.need("]")
            return self.pointer(first, sentinel, "slice")
        length = self.expr()
        sentinel = self.expr() if self.take(":") is not None else None
        self.need("]")
        node = self.done(Node("array_type", first, first, length=length, sentinel=sentinel, child=self.type_expr()))
        if value and self.peek() == "{":
            return self.suffixes(self.initializer(node, first), first)
        return node

    def atom(self) -> Node:
        first, tag = self.at, self.peek()
        simple = {"identifier": "identifier", "number": "number", "string": "string", "char": "char", "unreachable": "unreachable"}
        if tag in simple:
            self.at += 1
            return self.done(Node(simple[tag], first, first))
        if tag == "multiline":
            while self.take("multiline") is not None:
                pass
            return self.done(Node("string", first, first, multiline=True))
        if tag == "builtin":
            self.at += 1
            return self.done(Node("builtin", first, first, args=self.arguments()))
        if tag == "(":
            self.at += 1
            inner = self.expr()
            self.need(")")
            return self.done(Node("grouped", first, first, expr=inner))
        if tag == ".":
            self.at += 1
            if self.peek() == "{":
                return self.initializer(None, first)
            name = self.need("identifier")
            return self.done(Node("enum_literal", name, first))
        if tag == "error":
            self.at += 1
            if self.take(".") is not None:
                return self.done(Node("error_value", self.need("identifier"), first))
            self.need("{")
            names: list[int] = []
            while self.peek() != "}":
                names.append(self.need("identifier"))
                if self.take(",") is None:
                    break
            self.need("}")
            return self.done(Node("error_set", first, first, names=names))
        if tag in ("extern", "packed") or tag in ("struct", "enum", "union", "opaque"):
            return self.container(first)
        if tag == "fn":
            return self.function(first)
        if tag == "if":
            return self.if_expr(False)
        if tag == "switch":
            return self.switch_expr()
        if tag in ("while", "for"):
            return self.while_expr(False) if tag == "while" else self.for_expr(False)
        if tag == "comptime":
            self.at += 1
            return self.done(Node("comptime", first, first, expr=self.type_expr()))
        if tag == "asm":
            self.at += 1
            self.take("volatile")
            self.need("(")
            depth = 1
            while depth and self.peek() != "eof":
                depth += {"(": 1, ")": -1}.get(self.peek(), 0)
                self.at += 1
            return self.done(Node("asm", first, first))
        label = self.labelled()
        if label is not None and self.peek() == "{":
            return self.block(label, first)
        raise SyntaxProblem(f"expected an expression, found '{tag}'")

    def container(self, first: int) -> Node:
        layout = None
        if self.peek() in ("extern", "packed"):
            layout = self.peek()
            self.at += 1
        token, word = self.at, self.peek()
        if word not in ("struct", "enum", "union", "opaque"):
            raise SyntaxProblem(f"expected a container, found '{word}'")
        self.at += 1
        arg, tagged = None, False
        if self.take("(") is not None:
            if word == "union" and self.take("enum") is not None:
                tagged = True
                if self.take("(") is not None:
                    arg = self.expr()
                    self.need(")")
            else:
                arg = self.expr()
            self.need(")")
        self.need("{")
        members = self.members("}")
        self.need("}")
        return self.done(Node("container", token, first, word=word, layout=layout, arg=arg, tagged=tagged, members=members))

    def initializer(self, type_: Node | None, first: int) -> Node:
        token = self.need("{")
        if self.peek() == "." and self.peek(1) == "identifier" and self.peek(2) == "=":
            names: list[int] = []
            values: list[Node] = []
            while self.peek() == ".":
                self.at += 1
                names.append(self.need("identifier"))
                self.need("=")
                values.append(self.expr())
                if self.take(",") is None:
                    break
            self.need("}")
            return self.done(Node("struct_init", token, first, type=type_, names=names, values=values))
        values = []
        while self.peek() != "}":
            values.append(self.expr())
            if self.take(",") is None:
                break
        self.need("}")
        kind = "array_init" if values else "struct_init"
        return self.done(Node(kind, token, first, type=type_, names=[], values=values))

    def arguments(self) -> list[Node]:
        self.need("(")
        out: list[Node] = []
        while self.peek() != ")":
            out.append(self.expr())
            if self.take(",") is None:
                break
        self.need(")")
        return out

    def suffixes(self, node: Node, first: int) -> Node:
        while True:
            tag = self.peek()
            if tag == ".*":
                token = self.need(".*")
                node = self.done(Node("deref", token, first, base=node))
            elif tag == ".?":
                token = self.need(".?")
                node = self.done(Node("unwrap", token, first, base=node))
            elif tag == "." and self.peek(1) == "identifier":
                token = self.need(".")
                node = self.done(Node("field_access", token, first, base=node, name=self.need("identifier")))
            elif tag == "(":
                token = self.at
                node = self.done(Node("call", token, first, callee=node, args=self.arguments()))
            elif tag == "[":
                token = self.need("[")
                start = self.expr()
                if self.take("..") is not None:
                    end = self.expr() if self.peek() not in ("]", ":") else None
                    sentinel = self.expr() if self.take(":") is not None else None
                    self.need("]")
                    node = self.done(Node("slice", token, first, base=node, start=start, end=end, sentinel=sentinel))
                else:
                    self.need("]")
                    node = self.done(Node("index", token, first, base=node, index=start))
            elif tag == "{" and node.kind in ("call", "builtin", "field_access", "identifier") and self.looks_like_initializer():
                node = self.initializer(node, first)
            else:
                return node

    def looks_like_initializer(self) -> bool:
        """In suffix position only ``{}`` after a call's type or ``{ .name =`` is taken; control bodies are not."""
        return self.peek(1) == "." and self.peek(2) == "identifier" and self.peek(3) == "="

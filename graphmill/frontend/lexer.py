"""Tokens of one source file, with byte offsets, and the spans of its comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Reserved words of the analysed language.
KEYWORDS = frozenset(
    """addrspace align allowzero and anyframe anytype asm break callconv catch comptime const continue defer else enum
    errdefer error export extern fn for if inline noalias noinline nosuspend opaque or orelse packed pub resume return
    linksection struct suspend switch test threadlocal try union unreachable var volatile while""".split()
)
#: Punctuation, longest first.
PUNCTUATION = (
    "<<|= +|= -|= *|= <<= >>= +%= -%= *%= ... <<| **  ++ || == != <= >= << >> => -> .. .* .? += -= *= /= %= &= |= ^= +% -% *% +| -| *| "
    "{ } ( ) [ ] ; , . : ? ! = < > + - * / % & | ^ ~"
).split()
_TOKEN = re.compile(
    rb"""(?P<space>[ \t\r\n]+)
    |(?P<doc>//!.*|///(?!/).*)
    |(?P<comment>//.*)
    |(?P<multiline>\\\\.*)
    |(?P<string>"(?:[^"\\\n]|\\.)*")
    |(?P<quoted>@"(?:[^"\\\n]|\\.)*")
    |(?P<builtin>@[A-Za-z_][A-Za-z0-9_]*)
    |(?P<char>'(?:[^'\\\n]|\\.)+')
    |(?P<number>[0-9](?:[eEpP][+-][0-9]|\.[0-9A-Za-z_]|[0-9A-Za-z_])*)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>"""
    + b"|".join(re.escape(p.encode()) for p in PUNCTUATION)
    + rb""")
    |(?P<bad>.)""",
    re.VERBOSE,
)


@dataclass(frozen=True, slots=True)
class Token:
    """``tag``: identifier, builtin, string, multiline, char, number, doc, invalid, eof, or the keyword or punctuation itself."""

    tag: str
    start: int
    end: int


@dataclass(frozen=True, slots=True)
class Lexed:
    tokens: list[Token]
    comments: list[tuple[int, int]]
    identifiers: int


def tokenize(source: bytes) -> Lexed:
    """All tokens (doc comments included) and an end mark; plain comments are kept apart, in order."""
    tokens: list[Token] = []
    comments: list[tuple[int, int]] = []
    identifiers = 0
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "space":
            continue
        if kind == "comment":
            comments.append(m.span())
            continue
        if kind == "word":
            word = m.group().decode()
            tag = word if word in KEYWORDS else "identifier"
        elif kind == "quoted":
            tag = "identifier"
        elif kind == "op":
            tag = m.group().decode()
        else:
            tag = "invalid" if kind == "bad" else kind
        identifiers += tag == "identifier"
        tokens.append(Token(tag, *m.span()))
    tokens.append(Token("eof", len(source), len(source)))
    return Lexed(tokens, comments, identifiers)


def identifier_name(raw: str) -> str:
    """The name without the quoting of ``@"..."``."""
    return raw[2:-1] if raw.startswith('@"') else raw


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


def string_value(raw: str) -> str:
    """The value of a string literal, quotes included in ``raw``."""
    body = raw.strip('"') if "\\" not in raw else raw[1:-1]

    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] == "x":
            return chr(int(x[1:], 16))
        if x[0] == "u":
            return chr(int(x[2:-1], 16))
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]+\}|.)", one, body)

"""A lexer for Java, Kotlin and TypeScript: words, numbers, strings and marks, with lines; comments apart."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?(?:\"\"\"+|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"""
    r"""|(?P<number>\d[\w.]*(?<!\.))|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>->|::|\?\.|!!|=>|\.\.\.|[^\s\w])""",
    re.DOTALL | re.VERBOSE,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokens(source: str, language: str) -> tuple[list[Token], list[Token]]:
    """Tokens, and comments. A backquoted Kotlin name is a word."""
    out, comments, line = [], [], 1
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "string" and text[0] == "`" and language == "kotlin":
            kind, text = "word", text.strip("`")
        if kind == "comment":
            comments.append(Token(kind, text, line, m.start(), m.end()))
        elif kind != "space":
            out.append(Token(kind, text, line, m.start(), m.end()))
        line += m.group().count("\n")
    return out, comments


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def partners(toks: list[Token]) -> dict[int, int]:
    """For each opening bracket the place of its closing one (the end where that is missing)."""
    out, stack = {}, []
    for k, t in enumerate(toks):
        if t.kind == "mark":
            if t.text in OPEN:
                stack.append(k)
            elif t.text in CLOSE:
                while stack and OPEN[toks[stack[-1]].text] != t.text:
                    out[stack.pop()] = k
                if stack:
                    out[stack.pop()] = k
    for k in stack:
        out[k] = len(toks)
    return out


def angle_end(toks: list[Token], at: int, end: int) -> int:
    """Past the type arguments or parameters that begin with the `<` at `at`; at itself where none close."""
    depth = 0
    for k in range(at, min(end, at + 400)):
        text = toks[k].text
        if text == "<":
            depth += 1
        elif text == ">":
            depth -= 1
            if depth == 0:
                return k + 1
        elif text in ";{}" and toks[k].kind == "mark":
            return at
    return at


def plain_type(text: str | None) -> str | None:
    """A type without arguments, marks of null and white space; None unless a path of names is left."""
    if text is None:
        return None
    out, depth, k = [], 0, 0
    while k < len(text):
        c = text[k]
        if text.startswith("->", k):
            if depth == 0:
                return None
            k += 2
            continue
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
        elif depth == 0 and not c.isspace() and c != "?":
            out.append(c)
        k += 1
    path = "".join(out)
    return path if re.fullmatch(r"[^\W\d]\w*(\.[^\W\d]\w*)*", path) else None


def split_commas(toks: list[Token], start: int, end: int, pair: dict[int, int]) -> list[tuple[int, int]]:
    """The spans between commas outside of any brackets."""
    out, begin, k, depth = [], start, start, 0
    while k < end:
        t = toks[k]
        if t.kind == "mark":
            if t.text in OPEN:
                k = pair.get(k, end)
            elif t.text == "<":
                past = angle_end(toks, k, end)
                k = past - 1 if past > k else k
            elif t.text == "," and depth == 0:
                out.append((begin, k))
                begin = k + 1
        k += 1
    if begin < end:
        out.append((begin, end))
    return out

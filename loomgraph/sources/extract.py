"""Source text to symbols, imports, inheritance clauses and call sites, by a hand-written declaration parser.

Java, Kotlin and TypeScript declarations become symbols; Java and Kotlin bodies are scanned for calls with their receivers
and arguments. Java fields are no symbols but type receivers. Calls outside of any callable or container are dropped. Method
references and constructor calls give no call sites.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .lexer import OPEN, angle_end, partners, plain_type, split_commas, tokens

MODIFIERS = set(
    "public private protected internal static final abstract open override sealed data inner suspend inline infix operator lateinit const default synchronized native transient volatile strictfp external "
    "annotation value tailrec actual expect crossinline noinline vararg reified export declare async readonly".split()
)
#: Words before a group that is the head of a statement.
HEADS = {"if", "for", "while", "when", "catch", "switch", "synchronized", "try"}
KEYWORDS = set("if for while switch when catch return throw else do try synchronized assert new super this is as in instanceof typeof await yield case fun function class interface object".split())
KOTLIN_LITERALS = [(r"\d[\d_]*[uU][lL]$", "ULong"), (r"\d[\d_]*[uU]$", "UInt"), (r"[\d_]*[lL]$", "Long"), (r".*[fF]$", "Float"), (r".*\..*", "Double")]


class _File:
    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.toks, self.comments = tokens(source, language)
        self.pair = partners(self.toks)
        self.opened: dict[int, int] | None = None
        self.implicit: str | None = None
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.refs: list[dict] = []
        self.calls: list[dict] = []
        self.nodes: list[dict] = []
        self.package = ""
        self.last_comment = {}
        for c in self.comments:
            self.last_comment[c.end] = c

    def text(self, a: int, b: int) -> str:
        return self.source[self.toks[a].start : self.toks[b - 1].end] if a < b else ""

    def doc(self, start: int) -> str | None:
        """The documentation comment that ends right before place start of the source."""
        before = self.source[:start].rstrip()
        c = self.last_comment.get(len(before))
        if c is None or not c.text.startswith(("/**", "///")):
            return None
        return re.sub(r"(?m)^\s*(/\*\*|///|\*/|\*)\s?|\s*\*/\s*$", "", c.text).strip() or None

    def add(self, kind: str, name: str, a: int, end: int, parent: int | None, mods: set[str], **more) -> int:
        """A symbol from token a to end (exclusive)."""
        head = self.text(a, end).split("{", 1)[0].strip().split("\n")[0] if end > a else name
        outer = self.symbols[parent]["qualified_name"] if parent is not None else self.package
        visibility = next((v for v in ("private", "protected", "internal", "public") if v in mods), "public" if self.language != "java" else None)
        last = self.toks[min(end, len(self.toks)) - 1]
        self.symbols.append({
            "name": name, "qualified_name": f"{outer}.{name}" if outer else name, "kind": kind, "parent": parent, "start_line": self.toks[a].line, "end_line": last.line + last.text.count("\n"), "start_offset": self.toks[a].start, "end_offset": last.end,
            "signature": head[:200] + "..." if len(head) > 200 else head, "doc_comment": self.doc(self.toks[a].start), "visibility": visibility, "is_static": "static" in mods or "companion" in mods, "is_local": more.pop("is_local", False), "declared_type": None,
            "min_params": None, "max_params": None, "param_types": None, "param_names": None, "param_type_vars": None, "type_params": None, "extension_receiver": None, **more,
        })
        return len(self.symbols) - 1

    # Types and parameters

    def type_params(self, a: int, b: int) -> list[tuple[str, str | None]]:
        """(name, its one plain bound) of `<...>` from a to b."""
        out = []
        for x, y in split_commas(self.toks, a + 1, b - 1, self.pair):
            words = [t.text for t in self.toks[x:y] if t.text not in ("in", "out", "reified")]
            if words:
                bound = "".join(words[2:]) if len(words) > 2 and words[1] in ("extends", ":") else None
                out.append((words[0], plain_type(bound) if bound and "&" not in bound else None))
        return out

    def shape(self, a: int, b: int, own: list[tuple[str, str | None]], outer: set[str]) -> dict:
        """Parameter facts of the tokens between the brackets at a and b."""
        types, names, variables, least, vararg = [], [], [], 0, False
        for x, y in split_commas(self.toks, a + 1, b, self.pair):
            while x < y and (self.toks[x].text == "@" or self.toks[x].text in MODIFIERS):
                vararg |= self.toks[x].text == "vararg"
                if self.toks[x].text == "@":
                    x += 2
                    if x < y and self.toks[x].text == "(":
                        x = self.pair[x] + 1
                else:
                    x += 1
            words = [t.text for t in self.toks[x:y]]
            if not words:
                continue
            if self.language == "java":
                dots = "..." in words
                vararg |= dots
                name, kind = words[-1], None if dots else plain_type("".join(words[:-1]))
                least += not dots
            else:
                while words and words[0] in ("val", "var", *MODIFIERS):
                    words, x = words[1:], x + 1
                name = words[0] if words else ""
                cut = words.index("=") if "=" in words else len(words)
                kind = plain_type("".join(words[words.index(":") + 1 : cut])) if ":" in words[:cut] else None
                least += cut == len(words) and "vararg" not in [t.text for t in self.toks[max(a + 1, x - 3) : x]] and "?" not in words[1:2]
            bounds, variable = dict(own), None
            if kind in bounds:
                kind, variable = bounds[kind], None if bounds[kind] else "*"
            elif kind in outer:
                kind, variable = None, kind
            types.append(kind)
            names.append(name)
            variables.append(variable)
        return {"param_types": types, "param_names": names, "param_type_vars": variables, "min_params": least, "max_params": None if vararg else len(types)}

    # Declarations

    def header(self) -> int:
        k, n = 0, len(self.toks)
        while k < n:
            t = self.toks[k]
            if t.text == "package" and t.kind == "word":
                k, self.package = self.path(k + 1)
            elif t.text == "import" and t.kind == "word":
                k = self.import_at(k)
            elif t.text in (";", "@") and k + 1 < n:
                if t.text == "@" and not (self.language == "kotlin" and self.toks[k + 1].text == "file"):
                    break
                k += 1 if t.text == ";" else 4
                if t.text == "@" and k < n and self.toks[k].text == "(":
                    k = self.pair[k] + 1
            else:
                break
        return k

    def path(self, k: int) -> tuple[int, str]:
        parts = []
        line = self.toks[k].line if k < len(self.toks) else 0
        while k < len(self.toks) and self.toks[k].kind == "word" and self.toks[k].line == line:
            parts.append(self.toks[k].text)
            if k + 1 < len(self.toks) and self.toks[k + 1].text == "." and k + 2 < len(self.toks) and self.toks[k + 2].kind == "word":
                k += 2
            else:
                k += 1
                break
        return k, ".".join(parts)

    def import_at(self, k: int) -> int:
        if self.language in ("typescript", "tsx"):
            end = k
            while end < len(self.toks) and self.toks[end].kind != "string" and self.toks[end].text != ";":
                end += 1
            end = min(end + 1, len(self.toks))
            self.imports.append({"import_path": self.text(k, end), "alias": None, "is_wildcard": False})
            return end
        at = k + 1
        if self.toks[at].text == "static":
            at += 1
        at, path = self.path(at)
        star = at + 1 < len(self.toks) and self.toks[at].text == "." and self.toks[at + 1].text == "*"
        at += 2 * star
        alias = None
        if at + 1 < len(self.toks) and self.toks[at].text == "as":
            alias, at = self.toks[at + 1].text, at + 2
        self.imports.append({"import_path": path, "alias": alias, "is_wildcard": star})
        return at

    def clauses(self, owner: int, words: list[tuple[str, int, int]]) -> None:
        for kind, a, b in words:
            name = plain_type(re.split(r"\bby\b", self.text(a, b))[0].split("(")[0])
            lt = next((k for k in range(a, b) if self.toks[k].text == "<"), None)
            args = [plain_type(self.text(x, y)) for x, y in split_commas(self.toks, lt + 1, max(lt + 1, angle_end(self.toks, lt, b) - 1), self.pair)] if lt is not None else []
            if name:
                self.refs.append({"owner": owner, "kind": kind, "type_name": name, "type_args": args})

    def container(self, a: int, k: int, end: int, parent: int | None, kind: str, mods: set[str], outer: set[str], local: bool) -> int:
        """A container whose name stands at k; returns the place after it."""
        name, k = self.toks[k].text, k + 1
        own: list[tuple[str, str | None]] = []
        if k < end and self.toks[k].text == "<":
            past = angle_end(self.toks, k, end)
            own, k = self.type_params(k, past), max(past, k + 1)
        fields: dict[str, str | None] = {}
        while k < end and self.toks[k].text in ("constructor", *MODIFIERS, "@"):
            k += 2 if self.toks[k].text == "@" else 1
        if k < end and self.toks[k].text == "(":
            s = self.shape(k, self.pair[k], [], set())
            fields = dict(zip(s["param_names"], s["param_types"], strict=True))
            k = self.pair[k] + 1
        found, mode, begin = [], None, None
        while k < end and self.toks[k].text not in ("{", ";"):
            t = self.toks[k]
            if t.text == "<":
                k = max(angle_end(self.toks, k, end), k + 1)
                continue
            if t.text in ("extends", "implements", "permits", "where", ":") or t.text == ",":
                if begin is not None:
                    found.append((mode, begin, k))
                begin = k + 1
                if t.text in ("extends", "implements", ":"):
                    mode = t.text
                elif t.text in ("permits", "where"):
                    mode, begin = None, None
            elif self.language == "kotlin" and mode is None and t.line > self.toks[k - 1].line:
                break
            elif self.language == "kotlin" and begin is not None and begin < k and t.line > self.toks[k - 1].line and self.toks[k - 1].text != "," and t.kind == "word" and t.text not in ("by",):
                break
            elif t.text in OPEN:
                k = self.pair[k]
            k += 1
        if begin is not None and mode is not None and begin < k:
            found.append((mode, begin, k))
        body = (k, self.pair[k]) if k < end and self.toks[k].text == "{" else None
        past = body[1] + 1 if body else (k + 1 if k < end and self.toks[k].text == ";" else k)
        me = self.add(kind, name, a, min(past, len(self.toks)), parent, mods, type_params=[n for n, _ in own], is_local=local)
        if not (self.language == "java" and kind == "enum"):
            rows = []
            for m, x, y in found:
                if m == "extends":
                    rows.append(("extends", x, y))
                elif m == "implements":
                    rows.append(("implements", x, y))
                elif m == ":":
                    called = any(self.toks[q].text == "(" for q in range(x, y) if self.toks[q].kind == "mark") and not any(self.toks[q].text == "by" for q in range(x, y))
                    rows.append(("extends" if called else "implements", x, y))
            self.clauses(me, rows)
        if body:
            self.nodes.append({"owner": me, "hit_kind": "header", "start_line": self.toks[a].line, "end_line": self.toks[body[0]].line})
            inside = (self.toks[body[0]].end, self.toks[min(body[1], len(self.toks) - 1)].start)
            self.nodes += [{"owner": me, "hit_kind": "comment", "start_line": c.line, "end_line": c.line + c.text.count("\n")} for c in self.comments if inside[0] <= c.start < inside[1]]
            self.body(body[0] + 1, min(body[1], end), me, outer | {n for n, _ in own}, fields, kind == "enum")
        return past

    def body(self, k: int, end: int, owner: int | None, outer: set[str], fields: dict[str, str | None], enum: bool = False) -> None:
        """Members between k and end. Fields are known to all of them, wherever they stand."""
        if enum and owner is not None:
            while k < end and self.toks[k].text != ";" and not (self.language == "kotlin" and self.toks[k].text in ("fun", "val", "var", "companion")):
                k = self.pair[k] + 1 if self.toks[k].text in OPEN else k + 1
            k += k < end and self.toks[k].text == ";"
        later = []
        while k < end:
            a, known = k, len(self.symbols)
            k = self.member(k, end, owner, outer, fields, later)
            if owner is not None:
                self.node(owner, a, min(max(k, a + 1), end), known)
        for callable_, a, b, scope in later:
            self.scan(a, b, callable_, owner, fields, scope)

    def node(self, owner: int, a: int, b: int, known: int) -> None:
        """What the member from token a to b is to a change of its lines; known: symbols before it."""
        if self.toks[a].text in (";", "}", ","):
            return
        own = next((s for s in self.symbols[known:] if s["start_offset"] == self.toks[a].start), None)
        if own is None:
            kind = "state"
        elif own["kind"] in ("method", "function"):
            kind = "member" if any(t.text in ("{", "=") for t in self.toks[a:b]) else "contract"
        elif own["kind"] in ("property", "field"):
            kind = "member" if any(t.text in ("get", "set") for t in self.toks[a:b]) and not any(t.text == "=" and self.toks[k - 1].text != ")" for k, t in enumerate(self.toks[a:b], a)) else "state"
        elif own["kind"] == "type":
            kind = "unknown"
        else:
            kind = "member"
        last = self.toks[b - 1]
        self.nodes.append({"owner": owner, "hit_kind": kind, "start_line": self.toks[a].line, "end_line": last.line + last.text.count("\n")})

    def member(self, k: int, end: int, owner: int | None, outer: set[str], fields: dict, later: list, local: bool = False) -> int:
        a, mods, toks = k, set(), self.toks
        while k < end and (toks[k].text in MODIFIERS and toks[k].kind == "word" or toks[k].text == "@" or toks[k].text == "companion"):
            if toks[k].text == "@":
                if k + 1 < end and toks[k + 1].text == "interface":
                    break
                k, _ = self.path(k + 1)
                if k < end and toks[k].text == "(":
                    k = self.pair[k] + 1
            else:
                mods.add(toks[k].text)
                k += 1
        if k >= end:
            return end
        t = toks[k]
        following = toks[k + 1] if k + 1 < end else None
        if t.text in ("class", "interface", "enum", "record", "object") and t.kind == "word" and following is not None and (following.kind == "word" or "companion" in mods or t.text == "enum"):
            kind = {"record": "class"}.get(t.text, t.text)
            if t.text == "enum" and following.text == "class":
                return self.container(a, k + 2, end, owner, "enum", mods, outer, local)
            if t.text == "object" and following.kind != "word":
                return self.companion(a, k, end, owner, outer)
            if "companion" in mods:
                return self.companion(a, k + 1, end, owner, outer)
            if not (t.text == "record" and (self.language != "java" or k + 2 < end and toks[k + 2].text not in ("(", "<"))):
                return self.container(a, k + 1, end, owner, kind, mods, outer, local)
        if t.text == "@" and following is not None and following.text == "interface":
            return self.container(a, k + 2, end, owner, "interface", mods, outer, local)
        if self.language == "java":
            return self.java_member(a, k, end, owner, mods, outer, fields, later)
        if self.language == "kotlin":
            return self.kotlin_member(a, k, end, owner, mods, outer, fields, later, local)
        return self.ts_member(a, k, end, owner, mods, outer)

    def companion(self, a: int, k: int, end: int, owner: int | None, outer: set[str]) -> int:
        """A companion's members belong to the class around it."""
        while k < end and self.toks[k].text != "{":
            if self.toks[k].text in ("fun", "val", "var", "class", "}"):
                return k
            k += 1
        if k >= end:
            return end
        self.body(k + 1, min(self.pair[k], end), owner, outer, {})
        return self.pair[k] + 1

    def java_member(self, a, k, end, owner, mods, outer, fields, later) -> int:
        toks, own = self.toks, []
        if toks[k].text == "{":
            later.append((None, k + 1, min(self.pair[k], end), {}))
            return self.pair[k] + 1
        if toks[k].text == "<":
            past = angle_end(toks, k, end)
            own, k = self.type_params(k, past), max(past, k + 1)
        begin, name = k, None
        while k < end and toks[k].text not in ("(", ";", "=", "{", "}"):
            if toks[k].text == "<":
                k = max(angle_end(toks, k, end), k + 1)
                continue
            if toks[k].kind == "word":
                name = k
            k += 1
        if k >= end or name is None:
            return k + 1
        if toks[k].text == "(":
            close = self.pair[k]
            rest = close + 1
            while rest < end and toks[rest].text not in ("{", ";"):
                rest += 1
            past = self.pair[rest] + 1 if rest < end and toks[rest].text == "{" else rest + 1
            made = name == begin and owner is not None and toks[name].text == self.symbols[owner]["name"]
            declared = None if made else plain_type(self.text(begin, name))
            s = self.shape(k, close, own, outer)
            me = self.add("constructor" if made else "method", toks[name].text, a, min(past, end), owner, mods, declared_type=None if declared in dict(own) or declared == "void" else declared, type_params=[n for n, _ in own], **s)
            if rest < end and toks[rest].text == "{":
                later.append((me, rest + 1, min(self.pair[rest], end), dict(zip(s["param_names"], s["param_types"], strict=True))))
            return past
        if toks[k].text in ("=", ";"):
            fields[toks[name].text] = plain_type(self.text(begin, name))
            start = k
            while k < end and toks[k].text != ";":
                k = self.pair[k] + 1 if toks[k].text in OPEN else k + 1
            if toks[start].text == "=":
                later.append((None, start + 1, min(k, end), {}))
            return k + 1
        return self.pair[k] + 1 if toks[k].text in OPEN else k + 1

    def kotlin_member(self, a, k, end, owner, mods, outer, fields, later, local) -> int:
        toks, t = self.toks, self.toks[k]
        if t.text in ("fun", "val", "var"):
            k += 1
            own = []
            if k < end and toks[k].text == "<":
                past = angle_end(toks, k, end)
                own, k = self.type_params(k, past), max(past, k + 1)
            begin = k
            while k < end and (toks[k].kind == "word" or toks[k].text in (".", "?", "?.")):
                if toks[k].text in ("by", "in") or toks[k].line > toks[k - 1].line and k > begin:
                    break
                k += 1
                if k < end and toks[k].text == "<":
                    past = angle_end(toks, k, end)
                    k = past if past > k else k + 1
            name = k - 1
            if name < begin or toks[name].kind != "word":
                return k + 1
            receiver = plain_type(self.text(begin, name).rstrip(".?")) if name > begin else None
            s, params = {}, {}
            if t.text == "fun":
                if k >= end or toks[k].text != "(":
                    return k + 1
                s = self.shape(k, self.pair[k], own, outer)
                params, k = dict(zip(s["param_names"], s["param_types"], strict=True)), self.pair[k] + 1
            declared = None
            if k < end and toks[k].text == ":":
                x = k = k + 1
                while k < end and toks[k].text not in ("{", "=", "}", ";", ",") and not (toks[k].line > toks[k - 1].line and k > x) and toks[k].text not in ("by", "where"):
                    k = max(angle_end(toks, k, end), k + 1) if toks[k].text == "<" else self.pair[k] + 1 if toks[k].text == "(" else k + 1
                declared = plain_type(self.text(x, k))
            code = None
            if k < end and toks[k].text == "{" and t.text == "fun":
                code, past = (k + 1, min(self.pair[k], end)), self.pair[k] + 1
            elif k < end and toks[k].text in ("=", "by") and (t.text == "fun" or toks[k].line >= toks[name].line):
                past = self.expression_end(k + 1, end)
                code = (k + 1, past)
                if t.text != "fun" and declared is None and toks[k].text == "=":
                    declared = self.literal_type(k + 1, past)
            else:
                past = k
            while t.text != "fun" and past < end and toks[past].text in ("get", "set") and past + 1 < end and toks[past + 1].text == "(":
                x = self.pair[past + 1] + 1
                if x < end and toks[x].text == ":":
                    x += 2
                if x < end and toks[x].text == "{":
                    later.append((None, x + 1, min(self.pair[x], end), {}))
                    past = self.pair[x] + 1
                elif x < end and toks[x].text == "=":
                    y = self.expression_end(x + 1, end)
                    later.append((None, x + 1, y, {}))
                    past = y
                else:
                    past = x
            kind = ("method" if owner is not None else "function") if t.text == "fun" else "property"
            if kind == "property":
                fields[toks[name].text] = declared
            me = self.add(kind, toks[name].text, a, min(past, end), owner, mods, declared_type=None if declared in dict(own) else declared, type_params=[n for n, _ in own], extension_receiver=receiver, is_local=local, **s)
            if code:
                later.append((me if t.text == "fun" else None, *code, params))
            return max(past, k)
        if t.text in ("init", "constructor") and k + 1 < end:
            at = k + 1
            params = {}
            if toks[at].text == "(":
                s = self.shape(at, self.pair[at], [], outer)
                params, at = dict(zip(s["param_names"], s["param_types"], strict=True)), self.pair[at] + 1
                if at < end and toks[at].text == ":":
                    at = min((q for q in range(at, end) if toks[q].text == "("), default=at)
                    at = self.pair.get(at, at) + 1
            if at < end and toks[at].text == "{":
                later.append((None, at + 1, min(self.pair[at], end), params))
                return self.pair[at] + 1
            return at
        if t.text == "typealias" and k + 1 < end:
            past = self.expression_end(k + 1, end)
            self.add("type", toks[k + 1].text, a, past, owner, mods)
            return past
        return self.pair[k] + 1 if t.text in OPEN else k + 1

    def expression_end(self, k: int, end: int) -> int:
        """Where an expression that begins at k ends: at a new line that does not go on with it."""
        toks = self.toks
        while k < end:
            if toks[k].text in OPEN:
                k = self.pair[k]
            k += 1
            if k < end and (toks[k].text in (";", "}") or toks[k].line > toks[k - 1].line + toks[k - 1].text.count("\n") and toks[k].text not in (".", "?.", "?", ":", "+", "-", "&", "|", "else", "as") and toks[k - 1].text not in ("=", "->", "+", "-", "&", "|", ",", "else", "?", ":")):
                return k
        return end

    def literal_type(self, a: int, b: int) -> str | None:
        """The type of a Kotlin or Java initializer: a literal's, or a constructor's."""
        if a >= b:
            return None
        t = self.toks[a]
        if t.kind == "string" and b - a == 1:
            return "char" if t.text[0] == "'" and self.language == "java" else "Char" if t.text[0] == "'" else "String"
        if t.text in ("true", "false") and b - a == 1:
            return "Boolean"
        if t.kind == "number" and b - a == 1:
            for pattern, name in KOTLIN_LITERALS:
                if re.match(pattern, t.text):
                    return name
            return "Long" if t.text.replace("_", "").isdigit() and int(t.text.replace("_", "")) > 2**31 - 1 else "Int"
        if t.text == "new":
            a += 1
        k, path = self.path(a)
        if k < b and self.toks[k].text == "<":
            if path in ("mockk", "spyk", "mock", "spy"):
                return plain_type(self.text(k + 1, angle_end(self.toks, k, b) - 1))
            k = max(angle_end(self.toks, k, b), k)
        tail = path.rsplit(".", 1)[-1]
        if k < b and self.toks[k].text == "(" and self.pair[k] == b - 1 and tail[:1].isupper() and (self.language == "kotlin" or self.toks[a - 1].text == "new"):
            return plain_type(path)
        return None

    def ts_member(self, a, k, end, owner, mods, outer) -> int:
        toks, t = self.toks, self.toks[k]
        if t.text in ("type", "namespace") and k + 1 < end and toks[k + 1].kind == "word":
            past = self.expression_end(k + 1, end)
            self.add("type", toks[k + 1].text, a, past, owner, mods)
            return past
        at = k + 1 if t.text in ("function", "get", "set", "const", "let", "var") and k + 1 < end and toks[k + 1].kind == "word" else k
        if toks[at].kind == "word" and toks[at].text not in KEYWORDS:
            x = at + 1
            if x < end and toks[x].text == "<":
                x = max(angle_end(toks, x, end), x + 1)
            arrow = (t.text in ("const", "let") or "const" in mods) and any(toks[q].text == "=>" for q in range(at, min(end, at + 60)))
            if x < end and toks[x].text == "(" and (owner is not None or t.text == "function"):
                s, y = self.shape(x, self.pair[x], [], outer), self.pair[x] + 1
                while y < end and toks[y].text not in ("{", ";") and toks[y].line <= toks[y - 1].line:
                    y += 1
                past = self.pair[y] + 1 if y < end and toks[y].text == "{" else y
                kind = "constructor" if toks[at].text == "constructor" else "method" if owner is not None else "function"
                self.add(kind, toks[at].text, a, min(past, end), owner, mods, **s)
                return max(past, at + 1)
            if arrow and owner is None:
                past = self.expression_end(at, end)
                self.add("function", toks[at].text, a, past, owner, mods)
                return past
            if owner is not None and x < end and toks[x].text in (":", "=", ";", "?"):
                past = self.expression_end(at, end)
                self.add("property", toks[at].text, a, max(past, at + 1), owner, mods)
                return max(past, at + 1)
        return self.pair[k] + 1 if t.text in OPEN else k + 1

    # Calls

    def scan(self, a: int, b: int, callable_: int | None, owner: int | None, fields: dict, scope: dict) -> None:
        """Call sites between a and b. A local variable counts from its declaration's end on, up to the end of the block, of the
        statement whose head declares it, or of the lambda."""
        toks, locals_, sites = self.toks, dict(scope), {}
        source = callable_ if callable_ is not None else owner
        frames: list[tuple[int, dict, str | None]] = []  # last token, and what holds again after it
        pending: list[tuple[int, str, str | None]] = []  # variables whose declarations go on
        self.implicit = None

        def enter(end: int, names: dict, implicit: str | None = None, keep: bool = True) -> None:
            frames.append((end, dict(locals_), self.implicit))
            locals_.update(names)
            self.implicit = self.implicit if keep else implicit

        k = a
        while k < b:
            while frames and k > frames[-1][0]:
                _, held, self.implicit = frames.pop()
                locals_.clear()
                locals_.update(held)
            for stop, name, kind in [x for x in pending if x[0] <= k]:
                locals_[name] = kind
            pending = [x for x in pending if x[0] > k]
            t = toks[k]
            if t.text in ("class", "interface", "object") and t.kind == "word" and k + 1 < b and toks[k + 1].kind == "word" and (k == a or toks[k - 1].text not in (":", ".", "::")):
                k = self.container(k, k + 1, b, callable_ if callable_ is not None else owner, t.text, set(), set(), True)
                continue
            if t.text == "{":
                names, implicit, keep = self.lambda_scope(k, owner, fields, locals_, sites) if self.language == "kotlin" else ({}, None, True)
                enter(self.pair[k], names, implicit, keep)
            elif t.text == "(" and k > a and toks[k - 1].text in HEADS:
                enter(self.head_end(k, b), self.head_names(k))
            elif self.language == "java" and t.text == "instanceof":
                self.pattern(k, locals_)
            elif self.language == "java" and t.text == "case" and (name := self.case_name(k, b)):
                enter(self.rule_end(k, b), {name[0]: name[1]})
            elif self.language == "java" and t.text == "->" and k > a and (names := self.java_lambda(k)):
                enter(self.pair[k + 1] if k + 1 < b and toks[k + 1].text == "{" else self.expression_limit(k + 1, b), dict.fromkeys(names))
            if t.kind == "word" and t.text in ("val", "var") and self.language == "kotlin" and k + 1 < b and toks[k + 1].kind == "word":
                stop = self.expression_end(k + 2, b)
                if k > a and toks[k - 1].text == "(":  # in a statement's head
                    stop = min(stop, self.pair[k - 1])
                cut = next((q for q in range(k + 2, stop) if toks[q].text == "="), stop)
                kind = plain_type(self.text(k + 3, cut)) if k + 2 < b and toks[k + 2].text == ":" else self.literal_type(cut + 1, stop)
                pending.append((max(stop, k + 2), toks[k + 1].text, kind))
                k += 2
                continue
            if self.language == "java" and t.kind == "word" and t.text not in KEYWORDS and (k == a or toks[k - 1].text in ("{", "}", ";", "(", ")", "final")):
                q, path = self.path(k)
                if q < b and toks[q].text == "<":
                    q = max(angle_end(toks, q, b), q)
                if q + 1 < b and toks[q].kind == "word" and toks[q].text != "instanceof" and toks[q + 1].text in ("=", ";", ":") and path:
                    stop = q + 1
                    while stop < b and toks[stop].text not in (";", ")"):
                        stop = self.pair[stop] + 1 if toks[stop].text in OPEN else stop + 1
                    kind = plain_type(path) if path != "var" else self.literal_type(q + 2, stop)
                    pending.append((stop, toks[q].text, kind))
                    k = q + 1
                    continue
            self.call_at(k, b, source, owner, fields, locals_, sites)
            k += 1

    # Scopes

    def before_group(self, close: int) -> int:
        """Where the word before the group that ends at close stands."""
        if self.opened is None:
            self.opened = {v: k for k, v in self.pair.items()}
        return self.opened.get(close, 0) - 1

    def lambda_scope(self, k: int, owner, fields, locals_, sites) -> tuple[dict, str | None, bool]:
        """What a Kotlin brace at k brings in: a lambda's parameters, `it` without any, and the receiver's type in apply, run and with."""
        toks, before = self.toks, self.toks[k - 1] if k else None
        if before is None:
            return {}, None, True
        name = k - 1
        if before.text == ")":
            name = self.before_group(k - 1)
            if name < 0 or toks[name].kind != "word" or toks[name].text in HEADS or toks[name].text in KEYWORDS - {"with", "run", "apply"} or name > 0 and toks[name - 1].text == "fun":
                return {}, None, True
        elif not (before.text in ("(", ",", "=", "return", "?:") or before.kind == "word" and before.text not in KEYWORDS and before.line == toks[k].line):
            return {}, None, True
        q = k + 1
        while q < self.pair[k] and (toks[q].kind == "word" or toks[q].text in (",", ":", "?", ".", "<", ">", "(", ")", "*")):
            q += 1
        names: dict = {"it": None}
        if q < self.pair[k] and toks[q].text == "->":
            names = {}
            for x, y in split_commas(toks, k + 1, q, self.pair):
                for z in range(x, y):
                    if toks[z].kind == "word" and (z == x or toks[z - 1].text == "("):
                        names[toks[z].text] = plain_type(self.text(z + 2, y)) if z + 1 < y and toks[z + 1].text == ":" else None
        callee = toks[name].text if toks[name].kind == "word" else ""
        dotted = name > 0 and toks[name - 1].text in (".", "?.", "!!")
        if callee in ("apply", "run") and dotted:
            return names, self.receiver(name, owner, fields, locals_, sites)[2], False
        if callee == "with" and not dotted and before.text == ")":
            return names, self.arg_type(name + 2, k - 1, owner, fields, locals_), False
        return names, None, True

    def head_end(self, k: int, b: int) -> int:
        """The last token of the statement whose head is the group at k."""
        end = self.pair[k]
        if end + 1 < b and self.toks[end + 1].text == "{":
            return self.pair[end + 1]
        return self.expression_limit(end + 1, b) if self.language == "java" else max(end, self.expression_end(end + 1, b) - 1)

    def expression_limit(self, k: int, b: int) -> int:
        """The last token before a `;`, or before a comma or a closing mark around k."""
        toks = self.toks
        while k < b and toks[k].text not in (";", ",", ")", "]", "}"):
            k = self.pair[k] + 1 if toks[k].text in OPEN else k + 1
        return k if k < b and toks[k].text == ";" else k - 1

    def head_names(self, k: int) -> dict:
        """Variables that the head at k declares without an initializer: a loop's in Kotlin, and what a catch catches."""
        toks, end, word = self.toks, self.pair[k], self.toks[k - 1].text
        inside = toks[k + 1 : end]
        if word == "for" and self.language == "kotlin":
            until = next((q for q, t in enumerate(inside) if t.text == "in"), 0)
            typed = {inside[0].text: plain_type(self.text(k + 3, k + 1 + until))} if until > 2 and inside[1].text == ":" else {}
            return {t.text: None for t in inside[:until] if t.kind == "word"} if not typed else typed
        if word == "catch" and len(inside) >= 2:
            if self.language == "kotlin":
                return {inside[0].text: plain_type(self.text(k + 3, end))} if inside[1].text == ":" else {}
            begin = k + 2 if inside[0].text == "final" else k + 1
            return {inside[-1].text: None if any(t.text == "|" for t in inside) else plain_type(self.text(begin, end - 1))}
        return {}

    def pattern(self, k: int, locals_: dict) -> None:
        """`instanceof Type name` declares name; where the condition may also hold otherwise, its type isn't known."""
        toks = self.toks
        q, path = self.path(k + 1)
        if q < len(toks) and toks[q].text == "<":
            q = max(angle_end(toks, q, len(toks)), q)
        if path and q < len(toks) and toks[q].kind == "word" and toks[q].text not in KEYWORDS:
            a = k
            while a > 0 and toks[a - 1].text not in ("{", "}", ";"):
                a -= 1
            unsure = any(t.text in ("!", "||") for t in toks[a:k]) or toks[q + 1].text == "||"
            locals_[toks[q].text] = None if unsure else plain_type(path)

    def case_name(self, k: int, b: int) -> tuple[str, str | None] | None:
        q, path = self.path(k + 1) if k + 1 < b and self.toks[k + 1].kind == "word" else (k, "")
        return (self.toks[q].text, plain_type(path)) if path and q < b and self.toks[q].kind == "word" and self.toks[q].text not in KEYWORDS else None

    def rule_end(self, k: int, b: int) -> int:
        q = k + 1
        while q < b and self.toks[q].text not in ("case", "default", "}"):
            q = self.pair[q] + 1 if self.toks[q].text in OPEN else q + 1
        return q - 1

    def java_lambda(self, k: int) -> list[str]:
        """The parameters of a Java lambda whose arrow is at k; none for a rule of a switch."""
        toks = self.toks
        if toks[k - 1].text == ")":
            begin = self.before_group(k - 1) + 1
            return [toks[y - 1].text for x, y in split_commas(toks, begin + 1, k - 1, self.pair) if y > x]
        return [toks[k - 1].text] if toks[k - 1].kind == "word" and (k < 2 or toks[k - 2].text in ("(", ",", "=", "return", "->")) else []

    def call_at(self, k, b, source, owner, fields, locals_, sites) -> None:
        toks, t = self.toks, self.toks[k]
        if t.kind != "word" or t.text in KEYWORDS or source is None:
            return
        x = k + 1
        if x < b and toks[x].text == "<" and self.language == "kotlin":
            x = max(angle_end(toks, x, b), x)
        opens = x < b and toks[x].text == "("
        dotted = k > 0 and toks[k - 1].text in (".", "?.", "!!")
        lambda_after = lambda at: self.language == "kotlin" and at < b and toks[at].text == "{" and toks[at].line == toks[at - 1].line
        if not opens and not (dotted and lambda_after(k + 1)):
            return
        if k > 0 and toks[k - 1].text in ("new", "fun", "@", "class", "::"):
            return
        if not dotted and t.text[:1].isupper():
            return  # a constructor
        args, names, spread, closing = [], [], False, k
        if opens:
            closing = self.pair[x]
            for p, q in split_commas(toks, x + 1, min(closing, b), self.pair):
                name = None
                if self.language == "kotlin" and q - p > 2 and toks[p + 1].text == "=" and toks[p + 2].text != "=":
                    name, p = toks[p].text, p + 2
                spread |= toks[p].text == "*"
                args.append(self.arg_type(p, q, owner, fields, locals_))
                names.append(name)
        if lambda_after(closing + 1):
            args.append(None)
            names.append(None)
        sites["source"] = source
        receiver, kind, rtype, declared, step = self.receiver(k, owner, fields, locals_, sites)
        self.calls.append({"source": source, "receiver": receiver, "receiver_kind": kind, "receiver_type": rtype, "receiver_declared": declared, "step": step, "is_navigation": False, "method_name": t.text, "arg_count": None if spread else len(args), "arg_types": args, "arg_names": names, "implicit_receiver_type": self.implicit if kind in ("none", "this") else None, "line": t.line})
        sites[closing] = len(self.calls) - 1

    def arg_type(self, p, q, owner, fields, locals_) -> str | None:
        if q - p == 1:
            t = self.toks[p]
            if t.kind == "number" and re.fullmatch(r"[\d_]+", t.text):
                return "#int"
            if t.text == "this" and owner is not None:
                return self.symbols[owner]["name"]
            if t.kind == "word" and t.text not in ("true", "false", "null"):
                return locals_[t.text] if t.text in locals_ else fields.get(t.text)
        return self.literal_type(p, q)

    def receiver(self, k, owner, fields, locals_, sites):
        """(text, kind, type, whether a scope declares it, the call site whose result it is) of what stands before the name at k."""
        toks = self.toks
        if k == 0 or toks[k - 1].text not in (".", "?.", "!!"):
            return None, "none", None, False, None
        j = k - 2
        while j > 0 and toks[j].text in ("!!", "?"):
            j -= 1
        if j >= 0 and toks[j].text == ")":
            return ")", "chain-or-expression", None, False, sites.get(j)
        parts = []
        while j >= 0 and toks[j].kind == "word":
            parts.insert(0, toks[j].text)
            if j - 1 >= 0 and toks[j - 1].text in (".", "?."):
                j -= 2
            else:
                break
        text = ".".join(parts)
        if self.language == "kotlin" and len(parts) == 1 and j > 1 and toks[j - 1].text == "@" and toks[j - 2].text == "this":
            named = parts[0][:1].isupper()  # a class; otherwise a lambda's or a function's label, whose receiver isn't known
            return f"this@{text}", "identifier", text if named else None, True, None
        if not parts or j >= 0 and toks[j].text in (")", "]", "}"):
            return text or None, "chain-or-expression", None, False, None
        if parts == ["this"]:
            return text, "this", None, False, None
        if parts[0] == "super":
            return text, "super", None, False, None
        if parts[0] == "this" and len(parts) == 2:
            return text, "identifier", fields.get(parts[1]), parts[1] in fields, None
        if len(parts) == 1 and (parts[0] in locals_ or parts[0] in fields):
            return text, "identifier", locals_[parts[0]] if parts[0] in locals_ else fields[parts[0]], True, None
        if len(parts) == 2 and (parts[0] in locals_ or parts[0] in fields):
            source = sites.get("source")
            self.calls.append({"source": source, "receiver": parts[0], "receiver_kind": "identifier", "receiver_type": locals_[parts[0]] if parts[0] in locals_ else fields[parts[0]], "receiver_declared": True, "step": None, "is_navigation": True, "method_name": parts[1], "arg_count": 0, "arg_types": [], "arg_names": [], "implicit_receiver_type": None, "line": toks[k].line})
            return text, "chain-or-expression", None, False, len(self.calls) - 1
        if parts[0][:1].isupper():
            return text, "static-type", text.removesuffix(".Companion"), False, None
        return (text, "identifier", None, False, None) if len(parts) == 1 else (text, "chain-or-expression", None, False, None)


def extract(source: str, language: str) -> dict[str, list[dict] | str]:
    """Records of one file; owners, parents and steps are numbers into the records."""
    f = _File(source, language)
    f.body(f.header(), len(f.toks), None, set(), {})
    return {"package": f.package, "symbols": f.symbols, "imports": f.imports, "refs": f.refs, "calls": f.calls, "nodes": f.nodes}


def _ddl(columns: str) -> str:
    return "struct<" + ", ".join(": ".join(c.split(" ", 1)) for c in columns.split(", ")) + ">"


RECORDS = "file_id string, package_name string, " + ", ".join(f"{n} array<{_ddl(schema.TABLES[t])}>" for n, t in (("symbols", "symbols"), ("imports", "imports"), ("call_sites", "call_sites"), ("inheritance_refs", "inheritance_refs"), ("body_nodes", "body_nodes")))


def records(file_id: str, source: str, language: str) -> dict:
    """One row of RECORDS: ids are the file's, a letter for the table, and a number."""
    got = extract(source, language)
    key = lambda letter, k: None if k is None else f"{file_id}:{letter}{k}"
    symbols = [{**s, "id": key("s", k), "file_id": file_id, "parent_id": key("s", s["parent"])} for k, s in enumerate(got["symbols"])]
    imports = [{**s, "id": key("i", k), "file_id": file_id} for k, s in enumerate(got["imports"])]
    calls = [{**s, "id": key("c", k), "file_id": file_id, "source_symbol_id": key("s", s["source"]), "receiver_site_id": key("c", s["step"])} for k, s in enumerate(got["calls"])]
    refs = [{**s, "id": key("r", k), "file_id": file_id, "source_symbol_id": key("s", s["owner"])} for k, s in enumerate(got["refs"])]
    nodes = [{**s, "file_id": file_id, "container_id": key("s", s["owner"])} for s in got["nodes"]]
    fit = lambda rows, table: [{c.split()[0]: r.get(c.split()[0]) for c in schema.TABLES[table].split(", ")} for r in rows]
    return {"file_id": file_id, "package_name": got["package"], "symbols": fit(symbols, "symbols"), "imports": fit(imports, "imports"), "call_sites": fit(calls, "call_sites"), "inheritance_refs": fit(refs, "inheritance_refs"), "body_nodes": fit(nodes, "body_nodes")}


def facts(files: DataFrame) -> DataFrame:
    """RECORDS, one row per file of files (id, language, content): each is parsed where it lies."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [records(i, text or "", lang) for i, lang, text in zip(part["id"], part["language"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c for c in ("file_id", "package_name", "symbols", "imports", "call_sites", "inheritance_refs", "body_nodes")])

    return files.select("id", "language", "content").mapInPandas(each, RECORDS)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of rows of RECORDS."""
    return {name: parsed.select(F.inline(name)) for name in ("symbols", "imports", "call_sites", "inheritance_refs", "body_nodes")}

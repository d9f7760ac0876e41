"""A small tokenizer for the SQL dialect: words, strings, numbers and signs."""

from __future__ import annotations

import re

_PATTERN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<param>\$\d+)|(?P<sign><->|->>|->|<-|::|:=|\|\||<=|>=|<>|!=|[-+*/%(),.;=<>\[\]{}:])""", re.S)


class Token(str):
    """A piece of SQL text with its kind: string, quoted, number, word, param or sign."""

    kind: str

    def __new__(cls, text: str, kind: str) -> Token:
        out = super().__new__(cls, text)
        out.kind = kind
        return out

    def is_(self, *words: str) -> bool:
        return self.kind in ("word", "sign") and self.upper() in words


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _PATTERN.match(sql, at)
        if m is None:
            raise ValueError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup:
            text = m.group()
            if m.lastgroup == "quoted" and text[0] == '"':
                text = "`" + text[1:-1].replace('""', '"') + "`"
            out.append(Token(text, m.lastgroup))
        at = m.end()
    return out


def join(tokens: list[Token]) -> str:
    """Tokens as SQL text."""
    out = ""
    for i, t in enumerate(tokens):
        tight = t in (".", ")", ",", "]") or i and tokens[i - 1] in (".", "(", "[") or t == "(" and i and tokens[i - 1].kind == "word" and not tokens[i - 1].is_("IN", "AND", "OR", "NOT", "FROM", "JOIN", "EXISTS", "ON", "WHERE", "AS", "BY", "VALUES", "OVER", "THEN", "WHEN", "ELSE")
        out += ("" if tight or not out else " ") + t
    return out


def closing(tokens: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at ``at``."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    opener, closer = tokens[at], pairs[tokens[at]]
    for i in range(at, len(tokens)):
        depth += (tokens[i] == opener) - (tokens[i] == closer)
        if not depth:
            return i
    raise ValueError(f"unbalanced {opener}")


def split(tokens: list[Token], by: str = ",") -> list[list[Token]]:
    """Parts between top-level separators."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        if not depth and t.is_(by):
            out.append([])
        else:
            out[-1].append(t)
    return out if any(out) else []

"""Tokens of SQL text."""

from __future__ import annotations

import re
from typing import NamedTuple

from tracewell.sql.dialects import Dialect


class SqlError(ValueError):
    """Text that isn't understood."""


class Token(NamedTuple):
    kind: str  # word, name (quoted), string, number, op, end
    text: str
    at: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "op" else ""


_WORD = re.compile(r"[^\W\d][\w$]*|@{1,2}\w+|\$\d+", re.UNICODE)
_NUMBER = re.compile(r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?")
_OP = re.compile(r"<=>|->>|#>>|\|>|!~~\*|!~\*|->|#>|::|:=|<=|>=|<>|!=|\|\||&&|=>|==|<<|>>|!~|~\*|@>|<@|\*\*|[-+*/%(),.;:=<>\[\]{}?!~&|^@]")
_DOLLAR = re.compile(r"\$(\w*)\$")
_CLOSE = {'"': '"', "`": "`", "[": "]"}


def tokens(sql: str, dialect: Dialect) -> list[Token]:
    out, i, n = [], 0, len(sql)
    while i < n:
        c = sql[i]
        if c.isspace():
            i += 1
        elif sql.startswith("--", i) or (c == "#" and dialect.hash_comment):
            end = sql.find("\n", i)
            i = n if end < 0 else end + 1
        elif sql.startswith("/*", i):
            depth, j = 1, i + 2
            while depth and j < n:
                if sql.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif sql.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            if depth:
                raise SqlError("a comment isn't closed")
            i = j
        elif c == "'" or (c == '"' and dialect.double_quoted_string) or (c in "eErRbBnN" and i + 1 < n and sql[i + 1] == "'"):
            start = i
            escaped = c in "eE" or dialect.double_quoted_string
            i += c not in "'\""
            q, j, text = sql[i], i + 1, []
            while True:
                if j >= n:
                    raise SqlError("a string isn't closed")
                if sql[j] == "\\" and escaped and j + 1 < n:
                    text.append(sql[j + 1])
                    j += 2
                elif sql[j] == q:
                    if j + 1 < n and sql[j + 1] == q:
                        text.append(q)
                        j += 2
                        continue
                    break
                else:
                    text.append(sql[j])
                    j += 1
            out.append(Token("string", "".join(text), start))
            i = j + 1
        elif c in dialect.quotes and not (c == "[" and out and (out[-1].kind in ("name",) or out[-1].text in (")", "]"))):
            close, j, text = _CLOSE[c], i + 1, []
            while True:
                j2 = sql.find(close, j)
                if j2 < 0:
                    raise SqlError("a quoted name isn't closed")
                text.append(sql[j:j2])
                if sql.startswith(close * 2, j2) and close != "]":
                    text.append(close)
                    j = j2 + 2
                    continue
                break
            out.append(Token("name", "".join(text), i))
            i = j2 + 1
        elif m := _DOLLAR.match(sql, i):
            end = sql.find(m[0], m.end())
            if end < 0:
                raise SqlError("a string isn't closed")
            out.append(Token("string", sql[m.end() : end], i))
            i = end + len(m[0])
        elif m := _NUMBER.match(sql, i) if (c.isdigit() or (c == "." and i + 1 < n and sql[i + 1].isdigit() and not (out and out[-1].kind in ("word", "name")))) else None:
            out.append(Token("number", m[0], i))
            i = m.end()
        elif m := _WORD.match(sql, i):
            out.append(Token("word", m[0], i))
            i = m.end()
        elif m := _OP.match(sql, i):
            out.append(Token("op", m[0], i))
            i = m.end()
        else:
            raise SqlError(f"unexpected {c!r}")
    return [*out, Token("end", "", n)]

"""Globs as regular expressions, alike for Spark and DuckDB."""

from __future__ import annotations

import re


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[")


def glob_regex(glob: str, separator: bool = True) -> str:
    """A whole-string regex: * and ? stay within a path part (unless separator is False), ** crosses parts, [..] is a class.

    A glob with an open class isn't valid; it then stands for itself.
    """
    out, i = "", 0
    any_char = "[^/]" if separator else "."
    while i < len(glob):
        c = glob[i]
        if c == "*" and glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*" and glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + any_char + "*", i + 1
        elif c == "?":
            out, i = out + any_char, i + 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return "^" + re.escape(glob) + "$"
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else body
            out, i = out + "[" + body.replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return "^" + out + "$"

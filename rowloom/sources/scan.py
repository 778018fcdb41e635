"""Small scanning helpers for source text: balanced brackets and top-level splitting, outside of strings."""

from __future__ import annotations

import re

PAIRS = {"(": ")", "[": "]", "{": "}"}
QUOTES = "\"'`"


def balanced(text: str, at: int) -> int:
    """Index behind the bracket that closes the one at ``at``."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in QUOTES:
            i = string_end(text, i)
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return n


def string_end(text: str, at: int) -> int:
    q, i = text[at], at + 1
    while i < len(text) and text[i] != q:
        i += 2 if text[i] == "\\" else 1
    return i + 1


def split_top(text: str, sep: str = ",") -> list[str]:
    out, last, i = [], 0, 0
    while i < len(text):
        c = text[i]
        if c in QUOTES:
            i = string_end(text, i)
        elif c in "([{":
            i = balanced(text, i)
        else:
            if c == sep:
                out.append(text[last:i].strip())
                last = i + 1
            i += 1
    out.append(text[last:].strip())
    return [x for x in out if x]


def without_comments(text: str) -> str:
    """// and /* */ outside of strings become spaces."""
    out, i = [], 0
    while i < len(text):
        if text[i] in QUOTES:
            j = string_end(text, i)
            out.append(text[i:j])
        elif text.startswith("//", i):
            j = text.find("\n", i)
            j = len(text) if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = len(text) if j < 0 else j + 2
            out.append(" ")
        else:
            j = i + 1
            out.append(text[i])
        i = j
    return "".join(out)


def call_arguments(text: str, name: str) -> str | None:
    """What stands in the brackets of the first call of name."""
    m = re.search(rf"(?<![\w$]){re.escape(name)}\s*(?:<[^>()]*>)?\s*\(", text)
    return text[m.end() : balanced(text, m.end() - 1) - 1].strip() if m else None


def quoted_strings(text: str) -> list[str]:
    return [a or b or c for a, b, c in re.findall(r"\"([^\"]*)\"|'([^']*)'|`([^`]*)`", text)]


def option(text: str, key: str) -> str | None:
    """The value of key in an object literal or a list of named arguments."""
    body = text.strip()
    body = body[1:-1] if body[:1] == "{" else body
    for part in split_top(body):
        m = re.match(rf"['\"]?{re.escape(key)}['\"]?\s*[:=]\s*(.+)$", part, re.S)
        if m:
            return m[1].strip()
    return None


def unquoted(text: str | None) -> str | None:
    return text.strip().strip("\"'`") if text else None

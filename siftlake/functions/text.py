"""Normalising text: word wrap, pretty printing, numbering."""

from __future__ import annotations

import json
import re
import tomllib

MAX_LINE = 120


def wrap_words(line: str, width: int = MAX_LINE, split_long: bool = True) -> list[str]:
    """A line as lines of at most width characters, broken between words.

    A line that fits is left alone; in a wrapped one, runs of white space become single blanks. Longer words are cut
    unless split_long is off. A long line of blanks becomes one empty line. width 0 disables.
    """
    if width <= 0 or len(line) <= width:
        return [line]
    out, row = [], ""
    for word in line.split():
        if row and len(row) + 1 + len(word) <= width:
            row += " " + word
            continue
        if row:
            out.append(row)
        row = word
        while split_long and len(row) > width:
            out.append(row[:width])
            row = row[width:]
    return [*out, row] if row or not out else out


def _without_comments(text: str) -> str:
    """JSON with comments and trailing commas, as JSON."""
    for junk in (r"//[^\n]*|/\*.*?\*/", r",(?=\s*[}\]])"):
        token = re.compile(r'"(?:\\.|[^"\\])*"|' + junk, re.DOTALL)
        text = token.sub(lambda m: m[0] if m[0].startswith('"') else "", text)
    return text


def pretty(text: str, extension: str) -> str:
    """JSON is indented and TOML written out anew; anything else, and what cannot be parsed, stays as it is."""
    if extension == "toml":
        try:
            return _toml(tomllib.loads(text)).strip("\n")
        except tomllib.TOMLDecodeError:
            return text
    if extension not in ("json", "jsonc"):
        return text
    try:
        return json.dumps(json.loads(_without_comments(text)), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def _toml_value(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        if len(value) < 2:
            return "[" + ", ".join(map(_toml_value, value)) + "]"
        return "[\n" + "".join(f"    {_toml_value(v)},\n" for v in value) + "]"
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{_toml_key(k)} = {_toml_value(v)}" for k, v in value.items()) + " }" if value else "{}"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def _toml_key(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z0-9_-]+", key) else json.dumps(key, ensure_ascii=False)


def _toml(table: dict, path: tuple[str, ...] = ()) -> str:
    """Plain values first, then tables and arrays of tables, each under its header."""
    tables = {k: v for k, v in table.items() if isinstance(v, dict)}
    arrays = {k: v for k, v in table.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
    out = "".join(f"{_toml_key(k)} = {_toml_value(v)}\n" for k, v in table.items() if k not in tables and k not in arrays)
    name = lambda k: ".".join(map(_toml_key, (*path, k)))
    for k, v in tables.items():
        out += f"\n[{name(k)}]\n" + _toml(v, (*path, k))
    for k, vs in arrays.items():
        for v in vs:
            out += f"\n[[{name(k)}]]\n" + _toml(v, (*path, k))
    return out


def normalise(lines: list[tuple[int, str]], extension: str, width: int = MAX_LINE, exempt: tuple[str, ...] = ()) -> list[tuple[int, str]]:
    """Slots below 2 stay; content is pretty-printed, wrapped, stripped at line ends, and numbered anew from 2."""
    head = [x for x in lines if x[0] < 2]
    content = [c for _, c in sorted(x for x in lines if x[0] >= 2)]
    body = pretty("\n".join(content), extension).split("\n") if content else []
    wrapped = body if extension in exempt else [w for line in body for w in wrap_words(line, width)]
    return head + [(i, line.rstrip()) for i, line in enumerate(wrapped, 2)]

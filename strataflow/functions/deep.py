"""JSON of any depth: the standard reader and writer, and where these run out of stack, the same by an explicit one."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_FIXED = {"true": True, "false": False, "null": None}


def loads(text: str, parse_constant=None):
    """As `json.loads`, of documents of any depth."""
    try:
        return json.loads(text, parse_constant=parse_constant)
    except RecursionError:
        return _loads(text, parse_constant or float)


def _loads(text: str, parse_constant):
    top: list = []
    stack: list = [top]  # the open containers; a key that waits for its value lies between
    at = _SPACE.match(text).end()
    fresh = True  # a value may follow: at the start, behind an opening bracket, a comma or a colon
    while True:
        if at >= len(text):
            break
        c, holder = text[at], stack[-1]
        if c in "]}" and len(stack) > 1 and isinstance(holder, list if c == "]" else dict) and (not fresh or not holder):
            stack.pop()
            at, fresh = at + 1, False
        elif c == "," and not fresh and len(stack) > 1 and not isinstance(holder, str):
            at, fresh = at + 1, True
            if text[_SPACE.match(text, at).end() :][:1] in ("]", "}"):
                raise ValueError("a bracket behind a comma")
        elif isinstance(holder, dict):
            if c != '"' or not fresh:
                raise ValueError("no member")
            key, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            stack.append(key)
            at += 1
        elif not fresh:
            raise ValueError("no separator")
        else:
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif c in "[{":
                value, at = [] if c == "[" else {}, at + 1
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise ValueError("no value")
                at, word = m.end(), m[0]
                value = _FIXED[word] if word in _FIXED else parse_constant(word) if m[1] is None else float(word) if m[2] or m[3] else int(word)
            if isinstance(holder, str):
                stack.pop()
                stack[-1][holder] = value
            else:
                holder.append(value)
            fresh = False
            if isinstance(value, (list, dict)):
                stack.append(value)
                fresh = True
        at = _SPACE.match(text, at).end()
    if len(stack) > 1 or len(top) != 1:
        raise ValueError("not one whole value")
    return top[0]


def dumps(value, sort_keys: bool = False) -> str:
    """As `json.dumps`, of values of any depth."""
    try:
        return json.dumps(value, sort_keys=sort_keys)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [(value, False)]  # (what is to be written, whether it is text already)
    while todo:
        x, text = todo.pop()
        if text:
            out.append(x)
        elif isinstance(x, dict):
            items = sorted(x.items()) if sort_keys else list(x.items())
            parts = [p for k, (key, v) in enumerate(items) for p in ((", " if k else "", True), (f"{json.dumps(key)}: ", True), (v, False))]
            todo += reversed([("{", True), *parts, ("}", True)])
        elif isinstance(x, list):
            parts = [p for k, v in enumerate(x) for p in ((", " if k else "", True), (v, False))]
            todo += reversed([("[", True), *parts, ("]", True)])
        else:
            out.append(json.dumps(x))
    return "".join(out)

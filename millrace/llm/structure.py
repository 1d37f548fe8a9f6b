"""Where a text breaks off: a pushdown parser for its structure, and greedy string tiling."""

from __future__ import annotations

import re
from collections import Counter

_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "‚": "‘", "「": "」", "（": "）"}
_CLOSERS = {")": "([{", "]": "[", "}": "{", "”": "“„", "»": "«", "」": "「", "）": "（"}
_MARKER = re.compile(r"(?:^|(?<=\s))(?:\d{1,3}[.)]|[-*•+])\s*$")
_LIST_LINE = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*•+])\s", re.M)
_TOKEN = re.compile(
    r"(?P<fence>```+|~~~+)|(?P<comment><!--|-->)|(?P<tag></?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>)|(?P<bold>\*\*)|(?P<tick>`)|(?P<quote>\")"
    r"|(?P<open>[(\[{„«‚「（])|(?P<close>[)\]}”»」）])|(?P<curly>“)"
)
#: A text without any of these has no construct.
_MARK = re.compile(r"[`~<>*\"()\[\]{}“”„«»‚「」（）]")
_VOID = {"br", "hr", "img", "input", "meta", "link"}


def open_constructs(text: str) -> list[str]:
    """Stack of what is still open at the end: fences, brackets, quotations, tags, emphasis.

    Inside a fence only its own end counts, inside back ticks only the tick. A closer without its
    opener is ordinary text (``1)``); a closer drops what was left open within its pair, which is
    the recovery from slips inside a text that goes on.
    """
    stack: list[str] = []
    if not _MARK.search(text):
        return stack
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        top = stack[-1] if stack else ""
        if top.startswith(("```", "~~~")):
            if kind == "fence" and token[0] == top[0] and len(token) >= len(top):
                stack.pop()
            continue
        if top == "`" and kind != "tick":
            continue
        if top == "<!--" and token != "-->":
            continue
        if kind == "fence":
            stack.append(token)
        elif kind == "comment":
            if token == "<!--":
                stack.append(token)
            elif top == "<!--":
                stack.pop()
        elif kind in ("bold", "tick", "quote"):
            if token in stack:
                del stack[stack.index(token) :]
            else:
                stack.append(token)
        elif kind == "curly":
            if "„" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("„") :]
            else:
                stack.append(token)
        elif kind == "open":
            stack.append(token)
        elif kind == "close":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in _CLOSERS[token]:
                    del stack[k:]
                    break
        elif kind == "tag":
            name = re.match(r"</?([a-zA-Z0-9]+)", token).group(1).lower()
            if token.startswith("</"):
                if "<" + name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index("<" + name) :]
            elif not token.endswith("/>") and name not in _VOID:
                stack.append("<" + name)
    return stack


def dangling(text: str) -> bool:
    """Whether the structure says that the text breaks off: something is open, or the last item of
    a list has a marker and no content."""
    if any(s != "*" for s in open_constructs(text)):
        return True
    tail = text.rstrip()
    last = tail.rsplit("\n", 1)[-1]
    return bool(_MARKER.search(last)) and (last.strip() != tail.strip() or len(tail) < 4) and bool(_LIST_LINE.search(tail + " "))


def tiles(a: list[str], b: list[str], least: int = 1) -> tuple[int, int]:
    """Greedy string tiling: tokens covered, and number of tiles.

    Again and again the longest run common to the uncovered parts of both is marked, down to runs
    of ``least`` tokens; no token is covered twice.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    places: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        places.setdefault(t, []).append(j)
    covered = count = 0
    while True:
        best, found = least, []
        for i in range(len(a)):
            if not free_a[i]:
                continue
            for j in places.get(a[i], ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return covered, count
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                covered += best
                count += 1


def overlap_bound(a: list[str], b: list[str]) -> int:
    """No tiling covers more tokens than this."""
    return sum((Counter(a) & Counter(b)).values())

"""The paragraphs of a raw mail message that are written in clear, with their places in the message."""

from __future__ import annotations

import re

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:(.*(?:\r?\n[ \t].*)*)", re.I | re.M)
_BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"]*)"|([^\s;]+))', re.I)
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_ENCODED = ("quoted-printable", "base64")
#: A quote mark, also with the initials of whom it quotes.
_QUOTED = re.compile(r"[A-Za-z]{0,3}>|\|")


def clear_parts(text: str) -> list[tuple[int, int]]:
    """(start, stop) of every text/plain body sent in clear, in order, of a message however deep its parts are nested."""
    out, waiting = [], [(0, len(text))]
    while waiting:
        body, inner = _part(text, *waiting.pop())
        waiting += inner[::-1]
        out += body
    return out


def _part(text: str, start: int, stop: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The body of a part that begins with its headers, if it is sent in clear, and the parts that it holds."""
    if text.startswith("\n", start) or text.startswith("\r\n", start):
        head, body = start, text.index("\n", start) + 1
    else:
        gap = _BLANK.search(text, start, stop)
        head, body = (gap.start(), gap.end()) if gap else (stop, stop)
    fields = {m[1].lower(): m[2].strip() for m in reversed(list(_FIELD.finditer(text, start, head)))}
    kind = fields.get("content-type", "").lower()
    if fields.get("content-disposition", "").lower().startswith("attachment"):
        return [], []
    if kind.startswith("multipart/"):
        named = _BOUNDARY.search(fields["content-type"])
        mark = named and (named[1] if named[1] is not None else named[2])
        if not mark:
            return [], []
        lines = list(re.compile(rf"^--{re.escape(mark)}(--)?[ \t]*\r?$\n?", re.M).finditer(text, body, stop))
        parts = []
        for i, line in enumerate(lines):
            if line[1]:
                break
            until = lines[i + 1].start() if i + 1 < len(lines) else stop
            parts.append((line.end(), until))
        return [], parts
    if (kind and not kind.startswith("text/plain")) or fields.get("content-transfer-encoding", "").lower().startswith(_ENCODED):
        return [], []
    return [(body, stop)], []


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the runs of lines that are neither blank nor quoted, up to the signature of each part."""
    out = []
    for start, stop in clear_parts(text):
        begin = end = None
        for line in _LINE.finditer(text, start, stop):
            bare = line[0].rstrip("\r\n")
            if bare == "-- ":
                break
            lead = bare.lstrip()
            if not lead or _QUOTED.match(lead):
                if begin is not None:
                    out.append((begin, end))
                begin = None
                continue
            if begin is None:
                begin = line.start()
            end = line.start() + len(bare.rstrip())
        if begin is not None:
            out.append((begin, end))
    return out

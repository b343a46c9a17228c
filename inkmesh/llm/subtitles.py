"""Spoken text of subtitle files."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_ENCLOSED = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|\[[^\[\]\n]*\]|\([^()\n]*\)")


def spoken(text: str) -> str:
    """The text without timing lines, lines without a letter and what is enclosed on one line."""
    lines = text.replace("\r", "").split("\n")
    return _ENCLOSED.sub("", "\n".join(s for s in lines if "-->" not in s and _LETTER.search(s)))


def cues(text: str) -> list[str]:
    """Spoken text of each cue, in order; a cue begins at a timing line."""
    out, own = [], []
    for s in text.replace("\r", "").split("\n"):
        if "-->" in s:
            if own:
                out.append("\n".join(own))
            own = []
        elif _LETTER.search(s):
            own.append(s)
    if own:
        out.append("\n".join(own))
    return [_ENCLOSED.sub("", c) for c in out]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())

"""Texts cut where tokenizers cut them, with the standard regular expressions.

Most texts hold only common characters, for which the classes of letters, digits, signs and white
space below are those of Unicode. Such a text is cut straight into pre-tokens. Of another text only the
units (runs without white space, with the space before) that hold other characters stay uncut;
a pre-token lies within one unit. Texts with ``ODD`` characters are left to the library as a whole.
"""

from __future__ import annotations

import re

#: Common characters by class, for which Python, the libraries' patterns and their lower case agree.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ž"
SIGNS = r"!-/:-@\[-`{-~" + "\xa1\xa7\xab\xb4\xb7\xbb\xbf‐-―‘-„•…€"
SPACES = r"\t-\r\x20\xa0"
OTHER = re.compile(f"[^{LETTERS}0-9{SIGNS}{SPACES}]")
#: Characters that are white space to only some of the engines.
ODD = re.compile("[\x1c-\x1f\x85᠎]")

#: Units, as the pattern of byte-level pre-tokens leaves white space.
UNITS = re.compile(r"\s+(?!\S)| ?\S+|\s")
#: Byte-level pre-tokens of common characters.
SPACED = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[{SIGNS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Pre-tokens of common characters in lower case, of a tokenizer that drops white space and takes digits one by one.
PLAIN = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[{SIGNS}]+")


def spaced_parts(text: str) -> list[str]:
    """Pre-tokens, or whole units of uncommon characters, that together are the text."""
    if not OTHER.search(text):
        return SPACED.findall(text)
    return [p for u in UNITS.findall(text) for p in ((u,) if OTHER.search(u) else SPACED.findall(u))]


def plain_parts(text: str) -> list[str]:
    """Pre-tokens in lower case, or whole words of uncommon characters as they are, in order; no white space."""
    if not OTHER.search(text):
        return PLAIN.findall(text.lower())
    return [p for u in text.split() for p in ((u,) if OTHER.search(u) else PLAIN.findall(u.lower()))]

"""Canonical forms of texts: letters-and-digits key, words, records of named fields."""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from unicodedata import normalize

import regex

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_OTHER = re.compile(r"[^a-z0-9]+")


def folded(text: str) -> str:
    """Canonical composition of the case-folded text: canonically equivalent texts fold alike."""
    if text.isascii():
        return text.lower()
    return normalize("NFC", normalize("NFD", text).casefold())


def letters(text: str) -> str:
    """The letters and digits of a text in order, case and canonical variants alike."""
    text = folded(text)
    return (_ASCII_OTHER if text.isascii() else _OTHER).sub("", text)


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, case folded."""
    return _WORD.findall(folded(text))


_PAIR = re.compile(r"([^:=\n]+)[:=](.*)")
csv.field_size_limit(sys.maxsize)  # cells have any length


def _json_form(value):
    if isinstance(value, dict):
        return sorted(((letters(str(k)), _json_form(v)) for k, v in value.items()), key=repr)
    if isinstance(value, list):
        return [_json_form(v) for v in value]
    return letters(value if isinstance(value, str) else json.dumps(value))


def record_form(text: str) -> str | None:
    """One string per content of a text made of named fields, whatever the order of its fields.

    Notations: JSON objects (or an array of them), delimited tables with a header, lines of
    name and value. None if the text is none of these. Records keep their order.
    """
    text = text.strip("\ufeff \t\r\n\x0b\x0c")
    if not text:
        return None
    if text[0] in "{[":
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, dict) or isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
            return "json" + repr(_json_form(value if isinstance(value, list) else [value]))
    lines = [x for x in re.split(r"[\r\n\x0b\x0c\x85\u2028\u2029]+", text) if x.strip()]
    if len(lines) < 2:
        return None
    head = lines[0]
    for sign in "\t;,|":
        if sign not in head:
            continue
        try:
            rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=sign))
        except csv.Error:
            continue
        names = [letters(x) for x in rows[0]]
        if len(rows) > 1 and len(names) > 1 and all(names) and len({*names}) == len(names) and all(len(r) == len(names) for r in rows) and not any(x.rstrip().endswith((":", "=")) for x in rows[0]):
            order = sorted(range(len(names)), key=names.__getitem__)
            return "table" + repr([[names[i] for i in order], *([letters(r[i]) for i in order] for r in rows[1:])])
    found = [_PAIR.fullmatch(x) for x in lines]
    if not all(found):
        return None
    blocks = [[y for y in x.split("\n") if y.strip()] for x in re.split(r"\n(?:[^\S\n]*\n)+", text.replace("\r\n", "\n").replace("\r", "\n"))]
    if all(len(x) == 1 for x in blocks):  # double spacing, not several records
        return "lines" + repr([sorted((letters(m[1]), letters(m[2])) for m in found)])
    pairs = [[_PAIR.fullmatch(y) for y in x] for x in blocks if x]
    if not all(all(x) for x in pairs):
        pairs = [found]
    return "lines" + repr([sorted((letters(m[1]), letters(m[2])) for m in x) for x in pairs])

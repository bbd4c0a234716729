"""Texts decoded with the wrong character encoding (problem 2).

Each distinct word with a character beyond ASCII, written as such or as an escape, has a plausibility cost: how rare its pairs of
adjacent characters are over the documents of the corpus. A costly word is the start of a best-first
search whose steps encode a text in one encoding and decode the bytes in another, or unescape it;
states are hashed so that none is visited twice, and the cheapest reachable text wins if it is
cheaper by a margin. ASCII characters are the same in all these encodings, so the words of a text
can be repaired one by one, whether the text was garbled as a whole or in places.

Defined cases: null ids are left out; null and empty texts, and texts in ASCII without escapes, have nothing to repair; a text
with U+FFFD (characters lost) is found, and repaired as far as its other words allow; repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored; texts are
used whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import map_arrow

#: Steps of a search, and how much cheaper (in nats) a repair must be.
DEPTH, MARGIN = 3, 5.0
#: Penalty of a step that decodes UTF-8, and of one that takes one single-byte encoding for another.
STEP, SWAP = 1.0, 4.0
_ESCAPE = r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}"
_LETTERED = re.compile(_ESCAPE)
#: A word with a character beyond ASCII or an escape, from its first character on.
_WORD = re.compile(rf"(?<![^ \t\r\n])[^ \t\r\n]*?(?:[^\x00-\x7f]|{_ESCAPE})[^ \t\r\n]*")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u2e80-\ufdff]")
_RUN = re.compile("([\x80-\u036f\u0530-\u2e7f]+)")

# Encodings that texts were written in, and that they were taken for (fixed values).
WRITTEN = ("utf-8", "cp1252", "cp1251", "cp1253", "cp1250", "mac_roman", "cp850", "cp437")
TAKEN_FOR = ("cp1252", "latin_1", "mac_roman", "cp1250", "cp1251", "cp1253", "cp850", "cp437")


def _table(name: str) -> tuple[dict[str, bytes], list[str]]:
    """A single-byte encoding, with the bytes it leaves out standing for the control characters of that number."""
    decoded = []
    for b in range(256):
        try:
            decoded.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            decoded.append(chr(b))
    return {c: bytes([b]) for b, c in reversed([*enumerate(decoded)])}, decoded


_SINGLE = {n: _table(n) for n in {*WRITTEN, *TAKEN_FOR} - {"utf-8"}}


def encode(text: str, name: str) -> bytes | None:
    try:
        return b"".join(map(_SINGLE[name][0].__getitem__, text))
    except KeyError:
        return None


def decode(data: bytes, name: str) -> str | None:
    if name in _SINGLE:
        return "".join(map(_SINGLE[name][1].__getitem__, data))
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        return None


def unescape(text: str) -> str:
    text = html.unescape(text)
    text = re.sub(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})", lambda m: chr(0x10000 + (int(m[1], 16) - 0xD800) * 0x400 + int(m[2], 16) - 0xDC00), text)
    return re.sub(r"\\u((?![dD][89a-fA-F])[0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)


def plain(text: str) -> tuple[str, tuple]:
    """A text without escapes, also of escapes, and the steps to it."""
    way = ()
    while len(way) < DEPTH and _LETTERED.search(text) and (new := unescape(text)) != text:
        text, way = new, (*way, ("unescape",))
    return text, way


def sign(c: str) -> str:
    """A character of the model: those of large scripts stand for their script, digits for one digit."""
    if c < "\x80":
        return "0" if c.isdigit() else "\n" if c < "!" else c
    if "\u3040" <= c <= "ヿ":
        return "あ"
    if "㐀" <= c <= "鿿" or "豈" <= c <= "\ufaff":
        return "一"
    if "가" <= c <= "힣":
        return "가"
    return c


def pairs(word: str) -> list[str]:
    """Pairs of adjacent signs of a word, its edges included, of which one at least is beyond ASCII."""
    s = ["\n", *map(sign, word), "\n"]
    return [a + b for a, b in zip(s, s[1:]) if a > "\x7f" or b > "\x7f"]


def script(c: str) -> str:
    return "" if not c.isalpha() else "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic" if c < "\u0530" else "other"


class Plausibility:
    """Cost of a word from the number of documents that hold its character pairs."""

    def __init__(self, documents: int, held: dict[str, int]):
        self.unknown = math.log((documents + 1) / 0.2)
        self.of = {k: math.log((documents + 1) / (v + 0.2)) for k, v in held.items()}

    def cost(self, word: str) -> float:
        found = pairs(word)
        cost = sum(self.of.get(x, self.unknown) for x in found)
        for c in word:
            if "\x80" <= c <= "\x9f" or c == "\ufffd" or "\ue000" <= c <= "\uf8ff":
                cost += self.unknown
        # one word, two scripts; a change of case within a word
        kinds = {script(c) for c in word if c > "\x7f" or c.isalpha()} - {""}
        cost += self.unknown * (len(kinds - {"other"}) > 1)
        return cost + 3.0 * sum(a.islower() and b.isupper() and b > "\x7f" for a, b in zip(word, word[1:]))


def swappable(word: str) -> bool:
    """Whether a word can be evidence of one single-byte encoding taken for another: it has a letter
    beyond ASCII, or a sign between letters, isn't just a word in Greek or Cyrillic, and has three
    letters or a digit."""
    kinds = {script(c) for c in word} - {""}
    digits, letters = any(c.isdigit() for c in word), sum(c.isalpha() for c in word)
    if not digits and letters < 3:
        return False
    if kinds and "latin" not in kinds:
        return digits and letters < 3
    return any(c > "\x7f" and (c.isalpha() or a.isalpha() and b.isalpha()) for a, c, b in zip(" " + word, word, word[1:] + " "))


class Repair:
    """Best-first search for the cheapest text a garbled word can come from; it depends on the word and the model alone."""

    def __init__(self, model: Plausibility):
        self.model = model
        self.known: dict[str, tuple[str, tuple]] = {}

    def steps(self, text: str, first: bool):
        """Steps from a text; one single-byte encoding is taken for another only before any other decoding."""
        swap = first and swappable(text)
        for x in TAKEN_FOR:
            data = encode(text, x)
            if data is None:
                continue
            for y in WRITTEN if swap else WRITTEN[:1]:
                if y != x and (new := decode(data, y)) is not None and new != text:
                    yield (x, y), new, STEP if y == "utf-8" else SWAP
        if _LETTERED.search(text) and (new := unescape(text)) != text:
            yield ("unescape",), new, STEP

    def walk(self, word: str, way: tuple) -> str | None:
        for step in way:
            if step == ("unescape",):
                word = unescape(word)
            else:
                data = encode(word, step[0])
                if data is None:
                    return None
                if step[1] == "utf-8" and data[-1:] in (b"\xc3", b"\xc2"):
                    data += b"\xa0"  # a no-break space that was trimmed or became a space
                if (new := decode(data, step[1])) is None:
                    return None
                word = new
        return word

    def search(self, word: str, start: float) -> tuple[str, tuple]:
        """The cheapest state, if it saves the margin, and the way to it."""
        best, text, way = start, word, ()
        queue, seen, order = [(start, 0, word, (), 0.0)], {word}, 0
        while queue:
            _, _, now, path, spent = heappop(queue)
            for step, new, price in self.steps(now, all(len(s) == 1 for s in path)):
                if new in seen:
                    continue
                seen.add(new)
                total = self.model.cost(new) + spent + price
                order += 1
                if total < best and any(len(s) == 2 for s in (*path, step)):
                    best, text, way = total, new, (*path, step)
                if len(path) + 1 < DEPTH:
                    heappush(queue, (total, order, new, (*path, step), spent + price))
            if best < start / 3:  # plausible already
                break
        return (text, way) if start - best >= MARGIN else (word, ())

    def __call__(self, word: str) -> tuple[str, tuple]:
        """The word as it was written, and the way there; the word itself and no way if it is fine."""
        if (found := self.known.get(word)) is not None:
            return found
        if len(self.known) > 300_000:
            self.known = {}
        n = len(pairs(word))
        start = self.model.cost(word)
        found = word, ()
        if start > 3.0 * n or start > self.model.unknown:
            found = self.search(word, start)
            if not found[1] and _OTHER_SCRIPT.search(word) and len(runs := _RUN.findall(word)) and len(runs[0]) < len(word):
                new, ways = [], []  # garbled in places within a word: its runs in neither Greek, Cyrillic nor Asian scripts
                for run in _RUN.split(word):
                    text, way = self(run) if _RUN.fullmatch(run) and len(run) > 1 else (run, ())
                    new.append(text)
                    ways += [way] * bool(way)
                if ways:
                    found = "".join(new), ways[0]
        if not found[1]:  # escapes hide what they stand for from the cost
            base, escapes = plain(word)
            if escapes and not base.isascii():
                new, way = self(base)
                if way:
                    found = new, (*escapes, *way)
        self.known[word] = found
        return found


def character_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Plausibility:
    """In how many documents each character pair occurs, over all records."""
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''")

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*held.keys()], pa.string()), pa.array([*held.values()], pa.int64())], ["pair", "n"])

    def run(batches):
        held: Counter = Counter()
        cache: dict = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[""] += 1
                if not text.isascii():
                    found: set = set()
                    for w in {*_WORD.findall(text)}:
                        if (p := cache.get(w)) is None:
                            p = cache[w] = pairs(w) if len(w) < 2000 else [*{*pairs(w)}]
                        found.update(p)
                    held.update(found)
                    if len(cache) > 200_000:
                        cache = {}
            if len(held) > 200_000:
                yield counted(held)
                held = Counter()
        yield counted(held)

    got = rows.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    held = {x.pair: x.n for x in got}
    return Plausibility(held.pop("", 0), held)


def repaired(docs: DataFrame, model: Plausibility | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, text, words): whether a stretch of the text was decoded wrongly, the text with
    the garbled words as they were written, and how many words were repaired."""
    model = model or character_model(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        repair = Repair(shared.value)

        def one(text: str) -> tuple[bool, str, int]:
            if text.isascii() and not _LETTERED.search(text):
                return False, text, 0
            changed, ways = {}, Counter()
            for w in dict.fromkeys(_WORD.findall(text)):
                new, way = repair(w)
                if way:
                    changed[w] = new
                    ways[way] += 1
            if not changed:
                return "\ufffd" in plain(text)[0] or re.search(r"[\x80-\x84\x86-\x9f]", text) is not None, text, 0
            most = ways.most_common(1)[0][0]
            count = [0]

            def put(m: re.Match) -> str:
                w = m[0]
                if (new := changed.get(w)) is None:
                    # a word the search left, too short to tell by itself: as the rest of the text, if that makes it no worse
                    new = repair.walk(w, most)
                    if new is None or new == w or repair.model.cost(new) > repair.model.cost(plain(w)[0]):
                        return w
                count[0] += 1
                return new

            return True, _WORD.sub(put, text), count[0]

        def f(batch: pa.RecordBatch) -> dict:
            got = [one(x) for x in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "found": [x[0] for x in got], "text": [x[1] for x in got], "words": [x[2] for x in got]}

        return f

    return map_arrow(rows, make, f"doc_id {kind}, found boolean, text string, words int")


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, words) of the records with a wrongly decoded stretch. ASCII texts without escapes never reach Python."""
    model = character_model(docs, id_col, text_col)
    some = docs.where(F.col(text_col).rlike(rf"[^\x00-\x7f]|{_ESCAPE}"))
    return repaired(some, model, id_col, text_col).where("found").select("doc_id", "text", "words").distinct()

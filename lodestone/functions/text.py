"""Text functions as Column expressions; everything here stays inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that aren't indexed (fixed values).
STOPWORDS = "a an and are as at be but by for from had has have he her his i if in into is it its of on or our she so than that the their them then there these they this to was we were what when which will with would you your".split()
#: A word: letters and digits, with single dots or apostrophes inside.
WORD = r"[\p{L}\p{N}]+(?:[.'][\p{L}\p{N}]+)*"
PLAIN_WORD = r"[\p{L}\p{N}]+"
#: Letters that case folding changes and lower() doesn't (fixed values).
FOLD_FROM, FOLD_TO = "ςſϐϑϕϖϰϱϵ", "σsβθφπκρε"


def casefolded(text: Column) -> Column:
    """Case folding by lower(), for all letters of European scripts."""
    return F.replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text, case folded, in order; null for null."""
    return F.regexp_extract_all(casefolded(text), F.lit(pattern), F.lit(0))


#: Stemming by replacements, in order: plurals, then -ing or -ed with the doubled consonant it leaves.
STEMS = [(r"^(.*ss)es$", "$1"), (r"^(.{2,})ies$", "$1y"), (r"^(.{2,}[^suia])s$", "$1"), (r"^(?:(.+)([bdgmnprt])\2(?:ing|ed)|(.{3,})(?:ing|ed))$", "$1$2$3")]


def stem(w: Column) -> Column:
    """Plurals, -ing and -ed taken off; words of up to three letters stay, and no shorter ones arise."""
    for pattern, new in STEMS:
        w = F.regexp_replace(w, pattern, new)
    return w


def is_stopword(w: Column) -> Column:
    return w.isin(STOPWORDS)


def content_hash(text: Column) -> Column:
    """SHA-1 of the ASCII letters and digits with single spaces between; alike for texts that differ in
    layout and ASCII punctuation only. Texts without ASCII letters all hash alike; see content_hash_unicode."""
    return F.sha1(F.trim(F.regexp_replace(casefolded(text), "[^a-z0-9]+", " ")))


def content_hash_unicode(text: Column) -> Column:
    """The same over letters and digits of every script."""
    return F.sha1(F.trim(F.regexp_replace(casefolded(text), r"[^\p{L}\p{N}]+", " ")))


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\u0085\p{Z}\u001C-\u001F]+")), F.lit(0))


def doc_id(rel: Column) -> Column:
    return F.substring(F.sha1(rel), 1, 16)


def tidy(text: Column) -> Column:
    """Line ends, spaces and blank lines made even; paragraphs stay. Canonical composition is the reader's part."""
    out = F.regexp_replace(F.replace(F.regexp_replace(text, "\r\n|\r", "\n"), F.lit("\x00"), F.lit(" ")), r"[ \t\u00a0\u2007\u202f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{3,}", "\n\n"))


def strip_markup(text: Column) -> Column:
    """HTML or XML as plain text: bodies of scripts, styles and heads, comments and tags go, block ends become
    line ends, and the common character references are resolved."""
    out = text
    for name in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|br|li|tr|h[1-6]|section|article)\s*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"<[^>]{0,4000}>", " ")
    for name, sign in (("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return tidy(out)


def shingles(w: Column, size: int = 5) -> Column:
    """Distinct hashes of the overlapping runs of `size` words of an array of words; an empty array for fewer.

    Takes a column that holds the words: an expression would be evaluated anew for every run."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    return F.when(F.size(w) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def normalised(text: Column) -> Column:
    """The words of a text with single spaces between, case folded: what phrases are compared by."""
    return F.trim(F.regexp_replace(casefolded(text), r"[^\p{L}\p{N}]+", " "))


def phrase_regex(phrase: str, loose: bool = False) -> str | None:
    """A Java pattern that finds a phrase's words next to each other, whatever signs are between, as whole words.

    loose: words are split at every sign, as in checklists; else dots and apostrophes inside words stay."""
    found = re.findall(r"[^\W_]+" if loose else r"[^\W_]+(?:[.'][^\W_]+)*", phrase or "")
    if not found:
        return None
    body = r"[^\p{L}\p{N}]+".join(re.escape(w) for w in found)
    return rf"(?iu)(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"


def percent(n: Column, d: Column) -> Column:
    """100 n / d to one place, 0 without d."""
    return F.when(d > 0, F.round(F.lit(100.0) * n / d, 1)).otherwise(F.lit(0.0))

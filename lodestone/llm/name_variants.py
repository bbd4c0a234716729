"""Variant spellings of names typed by people (problem 7).

Each distinct spelling is read as a person (given and family name, in either order, with initials,
as a login), a firm (name, trade, legal form) or nobody (placeholders). Names with a typing error
are found by a pigeonhole segment join: an error is a letter too many, missing or other, or a swap
of neighbours, which may touch two segments. So a name is cut into 4 segments, of which an error
leaves two whole, and pairs of segments are looked up, shifted by one place where a letter was
added or lost, in an inverted index; candidates are verified with a banded edit distance. The join
serves family and firm names, and given names that aren't known. Spellings are joined where the
parts agree; a spelling with initials only, or without a legal form, is joined if just one person
or firm fits it.

What is a given name is learned from the data (a word that occurs with several family names), as are
ends of firms' names that are in no list (a last word of many names that don't begin with a given
name). Both are tables that are joined to the words of a spelling, of whatever size.

Defined cases: null, empty and blank authors and placeholders are nobody; repeated rows count once;
spellings are compared exactly as stored; an empty table gives an empty result; extra columns are
ignored. A very long spelling is a name like any other; family and firm names of 5 letters or more may have errors.
"""

from __future__ import annotations

import re
from itertools import combinations
from unicodedata import combining, normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.runtime import cut, map_arrow

#: Errors that the join allows for; segments a name is cut into.
ERRORS, SEGMENTS = 1, 4
#: Family names a word must occur with to be a given name; names, at least, that an end of firms' names must follow, and their share, at most, that begins with a given name.
PARTNERS, FOLLOWED, GIVEN_SHARE = 4, 10, 0.1
SHORTEST = 5

# Authors that mean nobody, legal forms and words of trades with their abbreviations (fixed values).
PLACEHOLDERS = {"admin", "administrator", "author", "default", "default user", "guest", "microsoft office user", "n/a", "na", "nobody", "none", "null", "office", "office user", "owner", "pc", "root", "scan", "scanner", "system", "test", "unknown", "unknown author", "user", "windows user"}
LEGAL = {"ag": "ag", "co": "company", "company": "company", "corp": "corporation", "corporation": "corporation", "gmbh": "gmbh", "inc": "incorporated", "incorporated": "incorporated", "limited": "limited", "llc": "llc", "ltd": "limited", "plc": "plc", "sarl": "sarl", "societe": "societe", "ste": "societe"}
# Legal forms that could be a family name as well: they are one at the end of a name that doesn't begin with a given name (fixed values).
LEGAL_AT_END = {*"ab aps as bv doo kft kg kk llp lp ltda nv ohg oy oyj pte pty sa sas sl spa srl sro ug".split()}
TRADES = {"bros": "brothers", "brothers": "brothers", "constr": "construction", "construction": "construction", "elec": "electrical", "electrical": "electrical", "eng": "engineering", "engineering": "engineering", "group": "group", "haulage": "haulage", "holdings": "holdings", "international": "international", "intl": "international", "logistics": "logistics", "manufacturing": "manufacturing", "mfg": "manufacturing", "roofing": "roofing", "services": "services", "sons": "sons", "supply": "supply", "svcs": "services", "systems": "systems", "tech": "technology", "technology": "technology", "tooling": "tooling", "transp": "transport", "transport": "transport"}


def plain(text: str) -> str:
    """Case-folded, without marks on letters."""
    return "".join(c for c in normalize("NFKD", text.casefold()) if not combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one error, in a band; most + 1 if it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    two: list[int] = []
    one = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        now = [far] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            v = min(one[j - 1] + (a[i - 1] != b[j - 1]), one[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, two[j - 2] + 1)
            now[j] = v
        if min(now) > most:
            return far
        two, one = one, now
    return min(one[-1], far)


def near(word: str, known: dict[str, str]) -> str | None:
    """What a word of a short fixed list means, one error allowed in words of some length."""
    if word in known:
        return known[word]
    if len(word) >= 5:
        found = {known[k] for k in known if len(k) >= 6 and distance(word, k, 1) <= 1}
        if len(found) == 1:
            return found.pop()
    return None


_PARTS = re.compile(r"[^\W_]+(?:['’.][^\W_]+)*\.?")


def split_words(author: str) -> list[str]:
    """The words of a spelling, without marks on letters; dots between single letters are left out (g.m.b.h.)."""
    text = re.sub(r"\b(?:[a-z]\.){2,}[a-z]?\.?", lambda m: m[0].replace(".", ""), " ".join(plain(author).split()))
    return [x.rstrip(".") for x in _PARTS.findall(text.replace("-", " "))]


class Reader:
    """Reads spellings. given: what each known given name or nickname among its words means; almost: what words one error from
    a known name mean; ends: its last word, if it ends firms' names."""

    def __init__(self, given: dict[str, str], almost: dict[str, str] | None = None, ends: set[str] | None = None):
        self.given, self.almost, self.ends = given, almost or {}, ends or set()

    def name(self, word: str) -> str | None:
        return self.given.get(word) or self.almost.get(word)

    def __call__(self, author: str) -> tuple[str, str, str, str] | None:
        """(kind, a, b, c): person (given, family, ''), initial (letter, family, '') or firm (name, trade, legal)."""
        text = " ".join(plain(author).split())
        if not text or text in PLACEHOLDERS:
            return None
        if re.fullmatch(r"[a-z]+\.[a-z]+", text) and (text.split(".")[1] not in LEGAL):
            a, b = text.split(".")
            if len(a) > 1:
                return ("person", self.name(a) or a, b, "")
        if re.fullmatch(r"[a-z]{5,}", text) and author.islower():
            return ("initial", text[0], text[1:], "")
        words = split_words(author)
        if words[:1] == ["the"]:
            words = words[1:]
        legal = [LEGAL[w] for w in words if w in LEGAL]
        rest = [w for w in words if w not in LEGAL]
        if not legal and len(rest) > 1 and len(rest[-1]) >= 6 and (x := near(rest[-1], LEGAL)):
            legal, rest = [x], rest[:-1]
        if not legal and len(rest) > 1 and "," not in text and (rest[-1] in self.ends or rest[-1] in LEGAL_AT_END and not self.name(rest[0]) and len(rest[0]) > 1):
            legal, rest = rest[-1:], rest[:-1]
        trades = [(i, near(w, TRADES)) for i, w in enumerate(rest)]
        trades = [(i, t) for i, t in trades if t]
        if legal or trades:
            if len(trades) == len(rest):
                trades = trades[1:]
            if not rest:
                return None
            at = {i for i, _ in trades}
            return ("firm", " ".join(w for i, w in enumerate(rest) if i not in at), " ".join(sorted(t for _, t in trades)), legal[0] if legal else "")
        comma = text.split(",")
        if len(comma) == 2 and comma[0].strip() and comma[1].strip():
            family = comma[0].strip()
            words = [x.rstrip(".") for x in _PARTS.findall(comma[1])]
            return self.person(words, family) if words else None
        words = [x.rstrip(".") for x in _PARTS.findall(text)]
        if len(words) < 2:
            return ("person", "", words[0], "") if words else None
        if len(words[-1]) == 1:  # family name first
            return self.person(words[-1:], " ".join(words[:-1])) if len(words[0]) > 1 else None
        if len(words[0]) > 1 and words[0] not in self.given and (words[-1] in self.given or not self.name(words[0]) and self.name(words[-1])):
            return self.person(words[-1:], " ".join(w for w in words[:-1] if len(w) > 1))
        return self.person(words[:-1], words[-1])

    def person(self, given: list[str], family: str) -> tuple[str, str, str, str]:
        """Initials of middle names are left out: many spellings of a person lack them."""
        first = given[0]
        return ("initial", first, family, "") if len(first) == 1 else ("person", self.name(first) or first, family, "")


def segments(length: int) -> list[tuple[int, int]]:
    """(start, length) of the segments a name of that length is cut into."""
    cuts = [length * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def index_keys(name: str) -> set[str]:
    parts = segments(len(name))
    return {f"{len(name)}|{i}|{j}|{name[parts[i][0] : sum(parts[i])]}|{name[parts[j][0] : sum(parts[j])]}" for i, j in combinations(range(SEGMENTS), 2)}


def probe_keys(name: str) -> set[str]:
    """Keys under which names of the same or lesser length with at most ERRORS errors are indexed."""
    out, n = set(), len(name)
    for shorter in range(ERRORS + 1):
        length = n - shorter
        if length < SEGMENTS:
            continue
        parts = segments(length)
        for i, j in combinations(range(SEGMENTS), 2):
            (p, a), (q, b) = parts[i], parts[j]
            for d in range(-ERRORS, ERRORS + 1):
                for e in range(-ERRORS, ERRORS + 1):
                    if abs(d) + abs(e - d) + abs(shorter - e) <= ERRORS and p + d >= 0 and q + e >= 0 and q + e + b <= n:
                        out.add(f"{length}|{i}|{j}|{name[p + d : p + d + a]}|{name[q + e : q + e + b]}")
    return out


def similar_names(names: DataFrame, column: str, others: DataFrame | None = None) -> DataFrame:
    """(a, b, d): pairs of distinct names, a before b, with d of at most ERRORS errors; others: (column) names that one of each pair must be of."""
    rows_of = lambda x: x.select(F.col(column).alias("name")).where(F.length("name") >= SHORTEST).distinct()
    rows = cut(rows_of(names), "names")

    def keys_of(rows: DataFrame, make_keys):
        def make():
            def f(batch: pa.RecordBatch) -> dict:
                pairs = [(k, x) for x in batch.column(0).to_pylist() for k in make_keys(x)]
                return {"key": [k for k, _ in pairs], "name": [x for _, x in pairs]}

            return f

        return map_arrow(rows, make, "key string, name string")

    join = lambda x, y: keys_of(x, index_keys).withColumnRenamed("name", "x").join(keys_of(y, probe_keys).withColumnRenamed("name", "y"), "key")
    if others is None:
        met = join(rows, rows)
    else:
        others = cut(rows_of(others), "names")
        met = join(others, rows).unionByName(join(rows, others))
    met = met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found = [(a, b, d) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (d := distance(a, b, ERRORS)) <= ERRORS]
            return {"a": [x[0] for x in found], "b": [x[1] for x in found], "d": [x[2] for x in found]}

        return f

    return map_arrow(met, make, "a string, b string, d int")


def given_names(authors: DataFrame, nicknames: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """What the list's given names and nicknames mean, and (word, meaning) of these and of those learned from the data.

    A first word (or the word after a comma) that occurs with several family names is a given name."""
    known: dict[str, str] = {}
    for x in nicknames.select("given_name", "nickname").collect():  # a list made by hand
        if x.given_name:
            known[plain(x.given_name)] = plain(x.given_name)
            if x.nickname:
                known.setdefault(plain(x.nickname), plain(x.given_name))

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found = []
            for author in batch.column(0).to_pylist():
                text = " ".join(plain(author).split())
                if m := re.fullmatch(r"([^\W\d_]{3,}) ([^\W\d_]{3,})", text):
                    found.append((m[1], m[2]))
                elif m := re.fullmatch(r"([^\W\d_]{3,}), ([^\W\d_]{3,})(?: [a-z]\.?)?", text):
                    found.append((m[2], m[1]))
            return {"first": [x[0] for x in found], "last": [x[1] for x in found]}

        return f

    def fresh():
        def f(batch: pa.RecordBatch) -> dict:
            words = [w for w in batch.column(0).to_pylist() if w not in known and w not in TRADES and w not in LEGAL and near(w, known) is None]
            return {"word": words, "meaning": words}

        return f

    seen = map_arrow(authors.select("author"), make, "first string, last string").groupBy("first").agg(F.count_distinct("last").alias("n"))
    learned = map_arrow(seen.where(F.col("n") >= PARTNERS).select("first"), fresh, "word string, meaning string")
    listed = authors.sparkSession.createDataFrame([*known.items()], "word string, meaning string")
    return known, cut(listed.unionByName(learned), "given")


def word_lists(authors: DataFrame, given: DataFrame) -> DataFrame:
    """(author, given, almost, ends): for each spelling, those of its words that are given names or one error from just one, as
    maps, and its last word if that ends firms' names."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out = []
            for author in batch.column(0).to_pylist():
                words = split_words(author)
                comma = "," in author
                first, before = (words[0], " ".join(words[:-1])) if len(words) > 1 and not comma else (None, None)
                parts = {*words, *(x for w in words for x in w.split("."))}
                out += [(author, w, w == words[-1] and before is not None and len(w) > 1, first, before) for w in parts if w]
            cols = [*zip(*out)] if out else [()] * 5
            return dict(zip(("author", "word", "last", "first", "before"), cols))

        return f

    said = cut(map_arrow(authors.select("author"), make, "author string, word string, last boolean, first string, before string"), "words")
    words = said.select("word").distinct()
    unknown = words.join(given, "word", "left_anti")
    pairs = similar_names(unknown, "word", given.where(F.length("word") >= 6))
    either = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).join(given.select(F.col("word").alias("b"), "meaning"), "b").join(unknown.withColumnRenamed("word", "a"), "a", "left_semi")
    almost = either.groupBy(F.col("a").alias("word")).agg(F.count_distinct("meaning").alias("n"), F.min("meaning").alias("almost")).where("n = 1").drop("n")
    begins = given.select(F.col("word").alias("first"), F.lit(1).alias("begins"))
    final = said.where("last and length(first) > 1").select("word", "before", "first").distinct().join(begins, "first", "left")
    ends = final.groupBy("word").agg(F.count_distinct("before").alias("n"), F.count("begins").alias("k"), F.count("*").alias("m")).where((F.col("n") >= FOLLOWED) & (F.col("k") <= GIVEN_SHARE * F.col("m"))).select("word", F.lit(True).alias("ends"))
    ends = ends.join(given, "word", "left_anti")
    known = cut(given.join(almost, "word", "full_outer").join(ends, "word", "full_outer"), "known")
    rows = said.join(known, "word", "left").groupBy("author")
    pick = lambda c: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("word", c))))).alias({"meaning": "given"}.get(c, c))
    return rows.agg(pick("meaning"), pick("almost"), F.max(F.when(F.col("last") & F.col("ends"), F.col("word"))).alias("ends"))


def variant_groups(docs: DataFrame, nicknames: DataFrame, author_col: str = "author") -> DataFrame:
    """(author, entity): the spellings that mean a person or firm, with the smallest key of the group."""
    authors = cut(docs.select(F.col(author_col).alias("author")).where("author is not null and trim(author) <> ''").distinct(), "authors")
    _, given = given_names(authors, nicknames)

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            got = []
            for author, known, almost, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if r := Reader(dict(known or ()), dict(almost or ()), {ends} - {None})(author):
                    got.append((author, *r))
            cols = [*zip(*got)] if got else [()] * 5
            return dict(zip(("author", "kind", "a", "b", "c"), cols))

        return f

    told = word_lists(authors, given)
    read = map_arrow(authors.join(told, "author", "left"), make, "author string, kind string, a string, b string, c string")
    read = cut(read.withColumn("key", F.concat_ws("|", "kind", "a", "b", "c")), "read")
    keys = cut(read.select("key", "kind", "a", "b", "c").distinct(), "keys")
    persons = keys.where("kind = 'person' and a <> ''").select("key", F.col("a").alias("given"), F.col("b").alias("family"))
    initials = keys.where("kind = 'initial'").select("key", F.col("a").alias("letter"), F.col("b").alias("family"))
    firms = keys.where("kind = 'firm'").select("key", F.col("a").alias("name"), F.col("b").alias("trade"), F.col("c").alias("legal"))
    names = persons.select(F.col("family").alias("n")).unionByName(initials.select(F.col("family").alias("n"))).unionByName(firms.select(F.col("name").alias("n")))
    pairs = cut(similar_names(names, "n"), "similar")
    either = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    both = cut(either.unionByName(names.distinct().select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(0).alias("d"))), "both")

    def link(left: DataFrame, right: DataFrame, by: str, on: list[str]) -> DataFrame:
        """Pairs of keys whose names are similar and whose other parts agree."""
        r = right.select(F.col("key").alias("other"), F.col(by).alias("b"), *on)
        return left.join(both, left[by] == both.a).join(r, ["b", *on]).where("key <> other").select("key", "other", "d")

    close = link(persons, persons, "family", ["given"]).unionByName(link(firms, firms, "name", ["trade", "legal"]))
    # an error in a given name that isn't known: the same family name, and one error from another's given name. Two names with one
    # error share a form with a letter left out, so these are looked up with the family name
    less = F.transform(F.sequence(F.lit(1), F.length("given")), lambda i: F.concat(F.substring("given", F.lit(1), i - 1), F.substring("given", i + 1, F.length("given"))))
    forms = persons.select("key", "given", "family", F.explode(F.array_distinct(F.concat(F.array("given"), less))).alias("form"))
    strange = forms.join(given.select(F.col("word").alias("given")), "given", "left_anti")
    other = forms.select(F.col("key").alias("other"), F.col("given").alias("other_given"), "family", "form")
    slips = strange.join(other, ["family", "form"]).where("key <> other").select("key", "other", "given", "other_given").distinct()

    def verify():
        def f(batch: pa.RecordBatch) -> dict:
            found = [(k, o) for k, o, x, y in zip(*(c.to_pylist() for c in batch.columns)) if distance(x, y, 1) <= 1]
            return {"key": [x[0] for x in found], "other": [x[1] for x in found], "d": [1] * len(found)}

        return f

    close = close.unionByName(map_arrow(slips.select("key", "other", "given", "other_given"), verify, "key string, other string, d int"))
    close = cut(close.select(F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other")).distinct(), "close")
    roots = components(close, "key", "other")
    rooted = lambda x: x.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # spellings that leave something out: joined if what fits them with the fewest errors is one person or firm
    whole = rooted(persons).select(F.col("root").alias("key"), F.substring("given", 1, 1).alias("letter"), "family").distinct()
    loose = link(initials, whole, "family", ["letter"])
    named = rooted(firms.where("legal <> ''")).select(F.col("root").alias("key"), "name", "trade").distinct()
    loose = loose.unionByName(link(rooted(firms.where("legal = ''")).select(F.col("root").alias("key"), "name", "trade").distinct(), named, "name", ["trade"]))
    loose = cut(loose, "loose")
    best = loose.groupBy("key").agg(F.min("d").alias("d"))
    fits = loose.join(best, ["key", "d"]).groupBy("key").agg(F.min("other").alias("other"), F.count_distinct("other").alias("n")).where("n = 1").select("key", "other")
    # initials that fit nobody are joined to each other
    lonely = initials.join(loose.select("key"), "key", "left_anti")
    all_links = close.select("key", "other").unionByName(fits).unionByName(link(lonely, lonely, "family", ["letter"]).select("key", "other"))
    entity = components(all_links, "key", "other").withColumnRenamed("node", "key")
    return read.join(entity, "key", "left").select("author", F.coalesce("root", "key").alias("entity"))


def variant_pairs(docs: DataFrame, nicknames: DataFrame, author_col: str = "author") -> DataFrame:
    """(author_a, author_b): all pairs of spellings of a group, in code-point order."""
    groups = cut(variant_groups(docs, nicknames, author_col), "variants")
    a = groups.select("entity", F.col("author").alias("author_a"))
    b = groups.select("entity", F.col("author").alias("author_b"))
    return a.join(b, "entity").where("author_a < author_b").select("author_a", "author_b")

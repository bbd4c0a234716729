"""The gap report, table by table, for every knowledge base in one plan each.

Times are epoch seconds and `now` is a parameter. Null and empty values take a named default. Lists
have a total order, so that ties don't depend on how rows arrive.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import near_duplicates
from lodestone.operators.index import KEY, documents, snapshot
from lodestone.runtime import cut

YEAR = 365.25 * 24 * 3600
# Authors that are settings of a program, not people (fixed values).
NO_AUTHOR = ["admin", "administrator", "author", "computer", "default", "guest", "microsoft office user", "n/a", "none", "office", "owner", "pc", "un named", "un-named", "unknown", "unnamed", "user", "users", "windows user"]


def _or(column: str, default: str) -> Column:
    return F.when(F.col(column) != "", F.col(column)).otherwise(default)


def _time() -> Column:
    return F.coalesce("mtime", F.lit(0))


def readable(docs: DataFrame, *columns: str) -> DataFrame:
    return documents(docs, "status", *columns).where("status = 'ok'")


def slim(docs: DataFrame) -> DataFrame:
    """The columns a report shows of a file: null sizes, times and counts as 0, other nulls but the reason's as ''."""
    words = [F.coalesce(c, F.lit("")).alias(c) for c in ("rel", "name", "folder", "ext")]
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "mtime", "nwords")]
    return documents(docs, "rel", "name", "folder", "ext", "size", "mtime", "nwords", "reason").select(*KEY, *words, *numbers, "reason")


def statistics(docs: DataFrame) -> DataFrame:
    """(kb_id, status, files, bytes, words)"""
    return documents(docs, "status", "size", "nwords").groupBy("kb_id", "status").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.sum(F.coalesce("nwords", F.lit(0))).alias("words"))


def counts(docs: DataFrame) -> DataFrame:
    """(kb_id, total, readable, unreadable, skipped, words, bytes); words are those of readable files."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias({"ok": "readable"}.get(s, s))
    words = F.sum(F.when(F.col("status") == "ok", F.coalesce("nwords", F.lit(0))).otherwise(0)).alias("words")
    return documents(docs, "status", "size", "nwords").groupBy("kb_id").agg(F.count("*").alias("total"), is_("ok"), is_("unreadable"), is_("skipped"), words, F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def _described(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, files, words, newest, spread_years of groups of files (rel, mtime, nwords); words are those of the newest file,
    and newest is its path; of files equally new the first path."""
    latest = F.min_by(F.struct("nwords", "rel"), F.struct((-_time()).alias("t"), "rel"))
    out = rows.groupBy(*by).agg(F.count("*").alias("files"), latest.alias("x"), F.max(_time()).alias("hi"), F.min(_time()).alias("lo"))
    return out.select(*by, "files", F.col("x.nwords").alias("words"), F.col("x.rel").alias("newest"), F.round((F.col("hi") - F.col("lo")) / YEAR, 1).alias("spread_years"))


def _hashed(docs: DataFrame, least_words: int = 5) -> DataFrame:
    return readable(docs, "chash", "nwords", "mtime", "rel").where(f"chash is not null and chash <> '' and nwords >= {least_words}")


def exact_groups(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """(kb_id, chash, files, words, newest, spread_years): readable files with one content hash, 2 or more."""
    return _described(_hashed(docs, least_words), ["kb_id", "chash"]).where("files > 1")


def exact_members(docs: DataFrame) -> DataFrame:
    """(kb_id, chash, doc_id, rel): the files of the groups."""
    rows = _hashed(docs)
    many = rows.groupBy("kb_id", "chash").agg(F.count("*").alias("files")).where("files > 1").drop("files")
    return rows.join(many, ["kb_id", "chash"], "left_semi").select("kb_id", "chash", "doc_id", "rel")


def near_members(docs: DataFrame, kbs: DataFrame | None = None) -> DataFrame:
    """(kb_id, group_id, doc_id, similarity): near-duplicates among the readable files in no group of exact copies, written once."""
    return cut(near_duplicates.groups(docs, kbs, apart=exact_members(docs)), "near")


def near_groups(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(kb_id, group_id, files, words, newest, spread_years, similarity)"""
    rows = near.join(readable(docs, "nwords", "mtime", "rel"), KEY)
    best = near.groupBy("kb_id", "group_id").agg(F.max("similarity").alias("similarity"))
    return _described(rows, ["kb_id", "group_id"]).join(best, ["kb_id", "group_id"])


def largest_groups(docs: DataFrame, near: DataFrame, n: int = 24) -> DataFrame:
    """(kb_id, kind, rank, group_id, files, words, newest, spread_years, similarity, members): the n largest groups of either
    kind, exact ones by files and words, near ones by files and similarity; members are paths, the newest first."""
    exact = exact_groups(docs).withColumnRenamed("chash", "group_id").withColumns({"similarity": F.lit(1.0), "kind": F.lit("exact")})
    alike = near_groups(docs, near).withColumn("kind", F.lit("near"))
    second = F.when(F.col("kind") == "exact", F.col("words").cast("double")).otherwise(F.col("similarity"))
    top = _first(exact.unionByName(alike), n, [F.desc("files"), F.desc(second), "group_id"], ["kind"])
    member = exact_members(docs).select("kb_id", F.lit("exact").alias("kind"), F.col("chash").alias("group_id"), "doc_id")
    member = member.unionByName(near.select("kb_id", F.lit("near").alias("kind"), "group_id", "doc_id"))
    by = ["kb_id", "kind", "group_id"]
    paths = member.join(top.select(*by), by, "left_semi").join(readable(docs, "mtime", "rel"), KEY)
    listed = paths.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-_time()).alias("t"), "rel"))), lambda x: x.rel).alias("members"))
    return top.join(listed, by).select("kb_id", "kind", "rank", "group_id", "files", "words", "newest", "spread_years", "similarity", "members")


def duplicate_totals(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(kb_id, exact_groups, near_groups, files_involved, share, wasted_copies): groups of each kind, files in a group, their
    share of readable ones, and files beyond one of each group. near: see near_members; without it, exact copies alone."""
    member = exact_members(docs).select("kb_id", F.lit("exact").alias("kind"), F.col("chash").alias("g"), "doc_id")
    if near is not None:
        member = member.unionByName(near.select("kb_id", F.lit("near").alias("kind"), F.col("group_id").alias("g"), "doc_id"))
    each = member.groupBy("kb_id", "kind", "g").agg(F.count("*").alias("files"))
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_groups")
    per = each.groupBy("kb_id").agg(of("exact"), of("near"), F.sum("files").alias("files_involved"), F.sum(F.col("files") - 1).alias("wasted_copies"))
    names = ["exact_groups", "near_groups", "files_involved", "wasted_copies"]
    rows = counts(docs).join(per, "kb_id", "left").na.fill(0, names)
    return rows.select("kb_id", "exact_groups", "near_groups", "files_involved", T.percent(F.col("files_involved"), F.col("readable")).alias("share"), "wasted_copies")


def staleness(docs: DataFrame, now: int) -> DataFrame:
    """(kb_id, under1, from1to3, from3to5, over5, unknown, share_over3): readable files by age in years."""
    age = (F.lit(now) - _time()) / YEAR
    known = _time() > 0
    rows = readable(docs, "mtime").groupBy("kb_id").agg(
        F.count_if(known & (age < 1)).alias("under1"), F.count_if(known & (age >= 1) & (age < 3)).alias("from1to3"), F.count_if(known & (age >= 3) & (age < 5)).alias("from3to5"),
        F.count_if(known & (age >= 5)).alias("over5"), F.count_if(~known).alias("unknown"), F.count("*").alias("n"),
    )
    return rows.select("kb_id", "under1", "from1to3", "from3to5", "over5", "unknown", T.percent(F.col("from3to5") + F.col("over5"), F.col("n")).alias("share_over3"))


def _first(rows: DataFrame, n: int, order: list, within: list[str] | None = None) -> DataFrame:
    """The first n rows of each knowledge base (and group): a rank with its limit pushed below the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("kb_id", *(within or [])).orderBy(*order))).where(F.col("rank") <= n)


def oldest(docs: DataFrame, now: int, n: int = 12) -> DataFrame:
    """(kb_id, rank, doc_id, rel, years): the oldest readable files with a known time."""
    rows = readable(docs, "mtime", "rel").where(_time() > 0).withColumn("years", F.round((F.lit(now) - F.col("mtime")) / YEAR, 1))
    return _first(rows, n, ["mtime", "rel"]).select("kb_id", "rank", "doc_id", "rel", "years")


def thin(docs: DataFrame, below: int = 25, n: int = 24) -> DataFrame:
    """(kb_id, rank, doc_id, rel, nwords): readable files of very few words, fewest first."""
    return _first(readable(docs, "nwords", "rel").where(F.col("nwords") < below), n, ["nwords", "rel"]).select("kb_id", "rank", "doc_id", "rel", "nwords")


def name_tokens(name: Column) -> Column:
    """Words of a file's name without its extension: 4 letters or more, not only digits."""
    found = F.array_distinct(T.words(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,6}$", ""), T.PLAIN_WORD))
    return F.filter(found, lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\p{N}+$"))


def references(docs: DataFrame) -> DataFrame:
    """(kb_id, doc_id, rel, size, verdict): whether another readable file's text names a file.

    The words of its name count that occur in at most a fifth of the files (or two); a file is referenced if
    another file's text holds all of these, unreferenced if none does or it has no such word, unjudged if its
    name has no word at all. Names with the same words are settled together: how many texts hold them all is
    counted once, from the texts with the rarest of the words, so files aren't paired with each other."""
    rows = readable(docs, "rel", "size", "name").select("kb_id", "doc_id", "rel", F.coalesce("size", F.lit(0)).alias("size"), name_tokens(F.col("name")).alias("tokens"))
    named = rows.select("kb_id", "doc_id", F.explode("tokens").alias("token"))
    wanted = named.select("kb_id", "token").distinct()
    # texts are split once, as they are scanned; a row written twice says its words twice, and they count once
    spoken = docs.where("status = 'ok'").select(*KEY, F.explode(F.array_distinct(T.words(F.col("text"), T.PLAIN_WORD))).alias("token"))
    said = cut(spoken.join(wanted, ["kb_id", "token"], "left_semi").distinct(), "said")
    held = said.groupBy("kb_id", "token").agg(F.count("*").alias("held"))
    most = rows.groupBy("kb_id").agg(F.greatest(F.lit(2.0), F.lit(0.2) * F.count("*")).alias("most"))
    useful = named.join(held, ["kb_id", "token"], "left").join(most, "kb_id").where(F.coalesce("held", F.lit(0)) <= F.col("most"))
    sets = useful.groupBy(KEY).agg(F.array_sort(F.collect_set("token")).alias("needed"), F.min_by("token", F.struct(F.coalesce("held", F.lit(0)), "token")).alias("rarest"))
    holds = said.groupBy(KEY).agg(F.collect_set("token").alias("holds"))
    every = F.size(F.array_except("needed", "holds")) == 0
    texts = said.withColumnRenamed("token", "rarest").join(sets.select("kb_id", "needed", "rarest").distinct(), ["kb_id", "rarest"])
    all_of = texts.join(holds, KEY).where(every).groupBy("kb_id", "needed").agg(F.count("*").alias("texts"))
    own = sets.join(holds, KEY, "left").withColumn("own", F.coalesce(every, F.lit(False)).cast("int")).join(all_of, ["kb_id", "needed"], "left")
    judged = own.select(*KEY, (F.coalesce("texts", F.lit(0)) > F.col("own")).alias("referenced"))
    verdict = F.when(F.size("tokens") == 0, "unjudged").when(F.col("referenced"), "referenced").otherwise("unreferenced")
    return rows.join(judged, KEY, "left").select("kb_id", "doc_id", "rel", "size", verdict.alias("verdict"))


def unreferenced(verdicts: DataFrame, n: int = 36) -> DataFrame:
    """(kb_id, rank, doc_id, rel, size): the largest files that no other names; verdicts: see references."""
    return _first(verdicts.where("verdict = 'unreferenced'"), n, [F.desc("size"), "rel"]).select("kb_id", "rank", "doc_id", "rel", "size")


def unjudged(verdicts: DataFrame, n: int = 12) -> DataFrame:
    """(kb_id, rank, doc_id, rel): the first files whose name has no word to look for."""
    return _first(verdicts.where("verdict = 'unjudged'"), n, ["rel"]).select("kb_id", "rank", "doc_id", "rel")


def reference_counts(verdicts: DataFrame) -> DataFrame:
    """(kb_id, unreferenced, judged, unjudged, share): share is of the files judged."""
    per = verdicts.groupBy("kb_id").agg(F.count_if(F.col("verdict") == "unreferenced").alias("unreferenced"), F.count_if(F.col("verdict") != "unjudged").alias("judged"), F.count_if(F.col("verdict") == "unjudged").alias("unjudged"))
    return per.withColumn("share", T.percent(F.col("unreferenced"), F.col("judged")))


def unread(docs: DataFrame, by: str, examples: int = 5, n: int | None = None) -> DataFrame:
    """(kb_id, key, files, share, bytes, examples): unreadable files by reason, ext or folder, with the first paths; n: the
    n largest of each knowledge base."""
    default = {"reason": "no reason recorded", "ext": "(no extension)", "folder": "(top level)"}[by]
    rows = documents(docs, "status", "rel", "size", by).where("status = 'unreadable'").select("kb_id", _or(by, default).alias("key"), "rel", F.coalesce("size", F.lit(0)).alias("size"))
    per = rows.groupBy("kb_id", "key").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    some = _first(rows, examples, ["rel"], ["key"]).groupBy("kb_id", "key").agg(F.array_sort(F.collect_list("rel")).alias("examples"))
    total = F.sum("files").over(Window.partitionBy("kb_id"))
    per = per.withColumn("share", T.percent(F.col("files"), total))
    per = per if n is None else _first(per, n, [F.desc("files"), "key"])
    return per.join(some, ["kb_id", "key"]).select("kb_id", "key", "files", "share", "bytes", "examples")


def skipped(docs: DataFrame, n: int = 12) -> DataFrame:
    """(kb_id, rank, key, files): skipped files by extension."""
    per = documents(docs, "status", "ext").where("status = 'skipped'").groupBy("kb_id", _or("ext", "(no extension)").alias("key")).agg(F.count("*").alias("files"))
    return _first(per, n, [F.desc("files"), "key"]).select("kb_id", "rank", "key", "files")


def checklist_items(checklist: DataFrame) -> list[dict]:
    """The items of a checklist that are on (null means on) and their phrases as patterns, in order of keys. The checklist
    is a table somebody wrote, so it is read to the driver."""
    out = []
    for x in checklist.where("coalesce(is_on, true)").orderBy("item_key").collect():
        phrases = [(p, r) for p in x.phrases or [] if p and (r := T.phrase_regex(p.casefold(), True))]
        known = x.asDict()
        out.append({"key": x.item_key, "label": known.get("label") or x.item_key, "why": known.get("why") or "", "phrases": phrases})
    return out


def coverage_of_files(docs: DataFrame, checklist: DataFrame) -> DataFrame:
    """(kb_id, doc_id, rel, item_key, place, phrase): readable files with a phrase of a checklist item: place is 'name' if one
    is in the path, else 'text', and phrase the first of the item's phrases found in either. Texts are scanned once for all
    items; of a row written twice the finds are one."""
    hits = []
    for item in checklist_items(checklist):
        if item["phrases"]:
            every = "|".join(r for _, r in item["phrases"])
            first = F.coalesce(*[F.when(F.col("path").rlike(r) | F.col("said").rlike(r), F.lit(p)) for p, r in item["phrases"]], F.lit(None).cast("string"))
            place = F.when(F.col("path").rlike(every), "name").when(F.col("said").rlike(every), "text")
            hits.append(F.when(place.isNotNull(), F.struct(F.lit(item["key"]).alias("item_key"), place.alias("place"), first.alias("phrase"))))
    rows = docs.where("status = 'ok'").select(*KEY, "rel", T.casefolded(F.col("rel")).alias("path"), T.casefolded(F.coalesce("text", F.lit(""))).alias("said"))
    none = F.lit(None).cast("struct<item_key: string, place: string, phrase: string>")
    each = rows.select(*KEY, "rel", F.explode(F.array_compact(F.array(*hits, none))).alias("x")).select(*KEY, "rel", "x.*")
    return each.dropDuplicates([*KEY, "item_key"])


def coverage(docs: DataFrame, checklist: DataFrame, finds: DataFrame | None = None) -> DataFrame:
    """(kb_id, item_key, in_name, in_text, named, found): for each item, switched on and with a phrase, how many readable files
    have a phrase of it in their path, or only in their text. finds: coverage_of_files, where it is at hand."""
    finds = coverage_of_files(docs, checklist) if finds is None else finds
    keys = [(x["key"],) for x in checklist_items(checklist) if x["phrases"]]
    items = docs.sparkSession.createDataFrame(keys, "item_key string")
    kbs = docs.where("status = 'ok'").select("kb_id").distinct()
    is_ = lambda p: F.count_if(F.col("place") == p)
    per = finds.groupBy("kb_id", "item_key").agg(is_("name").alias("in_name"), is_("text").alias("in_text"))
    rows = kbs.join(F.broadcast(items), F.lit(True), "inner").join(per, ["kb_id", "item_key"], "left").na.fill(0, ["in_name", "in_text"])
    return rows.select("*", (F.col("in_name") > 0).alias("named"), (F.col("in_name") + F.col("in_text") > 0).alias("found"))


def coverage_hits(finds: DataFrame, n: int = 5) -> DataFrame:
    """(kb_id, item_key, rank, rel, place, phrase): the first files of each item, those named for it before those that mention it."""
    return _first(finds, n, [F.when(F.col("place") == "name", 0).otherwise(1), "rel", "doc_id"], ["item_key"]).select("kb_id", "item_key", "rank", "rel", "place", "phrase")


def coverage_summary(docs: DataFrame, checklist: DataFrame, cover: DataFrame) -> DataFrame:
    """(kb_id, measured, checked, found, named, mentioned, credit, credit_share, share, missing, mentioned_only), a row for each
    knowledge base: an item named is worth 1, one that is only mentioned a half. Without a readable file or an item nothing
    was measured, and nothing is missing. missing and mentioned_only are labels in order of keys."""
    items = checklist_items(checklist)
    label = docs.sparkSession.createDataFrame([(x["key"], x["label"]) for x in items], "item_key string, label string")
    some = F.count_if("named").alias("named"), F.count_if(F.col("found") & ~F.col("named")).alias("mentioned")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("item_key", "label")))), lambda x: x.label)
    kbs = docs.where("status = 'ok'").select("kb_id").distinct().join(F.broadcast(label), F.lit(True), "inner")
    full = kbs.join(cover, ["kb_id", "item_key"], "left").na.fill(False, ["named", "found"])
    per = full.groupBy("kb_id").agg(*some, listed(~F.col("found")).alias("missing"), listed(F.col("found") & ~F.col("named")).alias("mentioned_only"))
    rows = docs.select("kb_id").distinct().join(per, "kb_id", "left").na.fill(0, ["named", "mentioned"]).withColumn("measured", F.col("missing").isNotNull())
    credit, n, none = F.col("named") + 0.5 * F.col("mentioned"), F.lit(len(items)), F.array().cast("array<string>")
    return rows.select(
        "kb_id", "measured", n.alias("checked"), (F.col("named") + F.col("mentioned")).alias("found"), "named", "mentioned", F.round(credit, 1).alias("credit"), T.percent(credit, n).alias("credit_share"),
        T.percent(F.col("named") + F.col("mentioned"), n).alias("share"), F.coalesce("missing", none).alias("missing"), F.coalesce("mentioned_only", none).alias("mentioned_only"),
    )


def concentration(docs: DataFrame, by: str, n: int = 8) -> DataFrame:
    """(kb_id, rank, key, files, share): readable files by top folder, type or author, the largest n."""
    rows = readable(docs, {"author": "author", "type": "ext", "folder": "folder"}[by])
    if by == "author":
        rows = rows.where((F.trim("author") != "") & ~T.casefolded(F.trim("author")).isin(NO_AUTHOR)).withColumn("key", F.trim("author"))
    else:
        rows = rows.withColumn("key", _or("ext", "(no extension)") if by == "type" else F.when(F.col("folder") != "", F.split_part("folder", F.lit("/"), F.lit(1))).otherwise("(top level)"))
    per = rows.groupBy("kb_id", "key").agg(F.count("*").alias("files")).withColumn("share", T.percent(F.col("files"), F.sum("files").over(Window.partitionBy("kb_id"))))
    return _first(per, n, [F.desc("files"), "key"]).select("kb_id", "rank", "key", "files", "share")


# Weights of the score's parts (fixed values).
WEIGHTS = {"readable": 25.0, "current": 20.0, "unique": 15.0, "covered": 25.0, "spread": 15.0}


def shared_out(parts: list[float], whole: int) -> list[int]:
    """Whole numbers in proportion to the parts that add up to `whole`: each share's floor, and one more where the most was cut off."""
    total = sum(parts)
    exact = [whole * x / total for x in parts]
    order = sorted(range(len(parts)), key=lambda i: (exact[i] // 1 - exact[i], i))
    more = {*order[: whole - sum(int(x) for x in exact)]}
    return [int(x) + (i in more) for i, x in enumerate(exact)]


def scaled_weights(given: dict[str, float] | None) -> dict[str, float]:
    """Weights of the score's parts, in tenths that add up to exactly 100.
    A missing or unusable weight is the default's, a negative one 0; if all are 0 the defaults hold."""
    wanted = []
    for key, default in WEIGHTS.items():
        value = (given or {}).get(key, default)
        number = float(value) if isinstance(value, int | float) and abs(value) < float("inf") else default
        wanted.append(max(0.0, number))
    if not any(wanted):
        return dict(WEIGHTS)
    return {k: n / 10 for k, n in zip(WEIGHTS, shared_out(wanted, 1000))}


# Names of the parts, and of what a score is worth (fixed values).
PARTS = {"readable": "Readable", "current": "Kept current", "unique": "Not copied", "covered": "Checklist covered", "spread": "Spread over folders"}
BANDS = [(80, "good"), (60, "fair"), (40, "poor"), (0, "bad")]


def band(points: Column, out_of: Column) -> Column:
    """What a score is worth, by its percentage of what could be reached: good from 80, fair from 60, poor from 40, else bad; 'none' if nothing was measured."""
    share = 100.0 * points / out_of
    rest = F.lit(BANDS[-1][1])
    for least, name in reversed(BANDS[:-1]):
        rest = F.when(share >= least, name).otherwise(rest)
    return F.when(out_of > 0, rest).otherwise("none")


def score(docs: DataFrame, checklist: DataFrame, now: int, near: DataFrame | None = None, weights: dict[str, float] | None = None, finds: DataFrame | None = None) -> DataFrame:
    """(kb_id, readable, current, unique, covered, spread, points, out_of, band): percentages of the five parts, null where
    there was nothing to measure, and the weighted sum over the parts measured. Every part is one row a knowledge base.
    near: see near_members; without it copies are exact ones alone."""
    w = scaled_weights(weights)
    cover = coverage_summary(docs, checklist, coverage(docs, checklist, finds)).select("kb_id", "measured", "checked", "credit_share")
    top = concentration(docs, "folder", 1).select("kb_id", F.col("share").alias("top"))
    parts = [staleness(docs, now).select("kb_id", "share_over3"), duplicate_totals(docs, near).select("kb_id", F.col("share").alias("copies")), cover, top]
    rows = reduce(lambda a, b: a.join(b, "kb_id", "left"), parts, counts(docs))
    tried, some = F.col("readable") + F.col("unreadable"), F.col("readable") > 0
    pct = {
        "readable": F.when(tried > 0, T.percent(F.col("readable"), tried)),
        "current": F.when(some, 100.0 - F.coalesce("share_over3", F.lit(0.0))),
        "unique": F.when(some, 100.0 - F.coalesce("copies", F.lit(0.0))),
        "covered": F.when(some & (F.col("checked") > 0), F.col("credit_share")),
        "spread": F.when(some, F.when(F.col("top") <= 35, 100.0).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) * (100.0 - F.col("top")) / 65.0))),
    }
    rows = rows.select("kb_id", *[F.round(v, 1).alias(k) for k, v in pct.items()])
    points = reduce(lambda a, b: a + b, [F.coalesce(_points(k, w), F.lit(0.0)) for k in w])
    out_of = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), w[k]).otherwise(0.0) for k in w])
    rows = rows.select("*", F.round(points, 1).alias("points"), F.round(out_of, 1).alias("out_of"))
    return rows.withColumn("band", band(points, F.col("out_of")))


def _points(part: str, weights: dict[str, float]) -> Column:
    return F.round(F.col(part) / 100.0 * weights[part], 1)


def score_parts(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(kb_id, position, part, label, weight, share, points, measured): a row for each part of a score; points add up to the score's."""
    w = scaled_weights(weights)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(k).alias("part"), F.lit(PARTS[k]).alias("label"), F.lit(w[k]).alias("weight"), F.col(k).alias("share"), _points(k, w).alias("points"), F.col(k).isNotNull().alias("measured")) for i, k in enumerate(w, 1)]
    return scores.select("kb_id", F.explode(F.array(*rows)).alias("x")).select("kb_id", "x.*")


def findings(docs: DataFrame, checklist: DataFrame, now: int, near: DataFrame | None = None, kbs: DataFrame | None = None, finds: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(kb_id, rank, kind, files, severity, said): what is worth saying of a knowledge base, worst first, each in a sentence.

    partial: a stopped scan (kbs.is_partial), before all else, as the other figures hold for a part only; unreadable: of all
    files; copies and stale (over 3 years): of readable ones; missing: items of the checklist no file has, where measured;
    piled: the largest folder from 50 % on; unreferenced: of files whose name can be judged. severity is that share in
    percent. None is left out."""
    n = counts(docs)
    refs = reference_counts(references(docs) if verdicts is None else verdicts)
    summary = coverage_summary(docs, checklist, coverage(docs, checklist, finds)).where("measured")
    files = F.size("missing")
    first = F.array_join(F.transform(F.slice("missing", 1, 3), lower_first), ", ")
    top = concentration(docs, "folder", 1)
    old = staleness(docs, now)
    copies = duplicate_totals(docs, near).where("wasted_copies > 0")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    c, over3 = F.col, F.col("from3to5") + F.col("over5")
    rows = [
        n.select("kb_id", F.lit("unreadable").alias("kind"), c("unreadable").alias("files"), T.percent(c("unreadable"), c("total")).alias("severity"), say(c("unreadable"), " of ", c("total"), " files could not be read").alias("said")),
        copies.select("kb_id", F.lit("copies"), "files_involved", "share", say(c("files_involved"), " files are copies of others or nearly so; ", c("wasted_copies"), " of them are one too many")),
        old.select("kb_id", F.lit("stale"), over3, "share_over3", say(over3, " readable files are over three years old")),
        summary.select("kb_id", F.lit("missing"), files, T.percent(files, c("checked")), say(files, " of ", c("checked"), " things on the checklist were not found: ", first, F.when(files > 3, F.lit(" and others")).otherwise(F.lit("")))),
        top.where("share >= 50").select("kb_id", F.lit("piled"), "files", "share", say(c("files"), " readable files lie in one folder, ", c("key"))),
        refs.select("kb_id", F.lit("unreferenced"), "unreferenced", "share", say(c("unreferenced"), " of ", c("judged"), " files are named in no other file")),
    ]
    every = reduce(lambda a, b: a.union(b), rows).where("files > 0")
    if kbs is not None:
        part = kbs.where("is_partial").select("kb_id").distinct().join(n, "kb_id")
        every = every.union(part.select("kb_id", F.lit("partial"), "total", F.lit(0.0), say("the last scan was stopped early: everything here is about the ", c("total"), " files it had reached")))
    order = [F.when(F.col("kind") == "partial", 0).otherwise(1), F.desc("severity"), "kind"]
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("kb_id").orderBy(*order))).select("kb_id", "rank", "kind", "files", "severity", "said")


def lower_first(label: Column) -> Column:
    """A label as it is written within a sentence."""
    return F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 1_000_000))


def slug(name: str) -> str:
    """A name as part of a file's name: ASCII letters, digits and dashes."""
    out = "".join(x if x.isascii() and x.isalnum() else "-" for x in name.lower())
    return "-".join(x for x in out.split("-") if x) or "report"


# --- the whole report --------------------------------------------------------------------------


def sections(docs: DataFrame, kbs: DataFrame, checklist: DataFrame, now: int, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """All tables of the report by name, for every knowledge base. What several of them need (the documents, the finds of the
    checklist, near-duplicates, who names whom) is made once and written."""
    docs = snapshot(docs)
    # three parts of many small steps each, which don't wait for each other
    parts = (lambda: near_members(docs, kbs), lambda: cut(coverage_of_files(docs, checklist), "finds"), lambda: cut(references(docs), "verdicts"))
    with ThreadPoolExecutor(len(parts)) as pool:
        near, finds, verdicts = pool.map(lambda f: f(), parts)
    cover = coverage(docs, checklist, finds)
    scores = cut(score(docs, checklist, now, near, weights, finds), "score")
    return {
        "counts": counts(docs), "duplicates": duplicate_totals(docs, near), "groups": largest_groups(docs, near), "staleness": staleness(docs, now), "oldest": oldest(docs, now),
        "references": reference_counts(verdicts), "unreferenced": unreferenced(verdicts), "unjudged": unjudged(verdicts), "thin": thin(docs),
        "unread_by_reason": unread(docs, "reason"), "unread_by_ext": unread(docs, "ext", n=10), "unread_by_folder": unread(docs, "folder"), "skipped": skipped(docs),
        "coverage": coverage_summary(docs, checklist, cover), "coverage_items": cover, "coverage_hits": coverage_hits(finds), "folders": concentration(docs, "folder"), "types": concentration(docs, "type"), "authors": concentration(docs, "author"),
        "score": scores, "score_parts": score_parts(scores, weights), "findings": findings(docs, checklist, now, near, kbs, finds, verdicts),
    }


#: Sections with one row a knowledge base.
SINGLE = {"counts", "duplicates", "staleness", "references", "coverage", "score"}


def assembled(tables: dict[str, DataFrame]) -> DataFrame:
    """(kb_id, report): one report of each knowledge base as JSON: an object for each section of one row, a list for the others.

    A list has as many rows as its section's limit, or groups of unreadable files; it is gathered for one knowledge base each."""
    parts = []
    for name, rows in tables.items():
        rest = [c for c in rows.columns if c != "kb_id"]
        keys = [c for c in ("kind", "item_key", "position", "rank", "key") if c in rest and (c != "kind" or name == "groups")]
        one = F.struct(*keys, *[c for c in rest if c not in keys])
        whole = F.first(one) if name in SINGLE else F.array_sort(F.collect_list(one))
        body = rows.groupBy("kb_id").agg(whole.alias("x")).select("kb_id", F.lit(name).alias("name"), F.to_json("x", {"ignoreNullFields": "false"}).alias("body"))
        parts.append(body)
    every = reduce(lambda a, b: a.unionByName(b), parts)
    # one shuffle puts all sections together
    found = every.groupBy("kb_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "body"))).alias("of"))
    fields = [F.concat(F.lit(f'"{name}":'), F.coalesce(F.col("of")[name], F.lit("null"))) for name in tables]
    return found.select("kb_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("report"))


def _cells(rows: list[dict]) -> list[str]:
    names = [*rows[0]]
    show = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
    text = lambda v: show(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(text(r.get(c)) for c in names) + " |" for r in rows), ""]


def markdown(title: str, report: str, folder: str = "", when: str = "") -> str:
    """One knowledge base's assembled report as Markdown: findings first, then the score's parts, then all tables in full."""
    found = json.loads(report)
    total = found["score"] or {}
    out = [f"# {title}", "", " · ".join(x for x in (folder, when) if x), ""]
    out += ["## Findings", "", *(f"{x['rank']}. {x['said']} ({x['severity']} %)" if x["kind"] != "partial" else f"{x['rank']}. **{x['said']}**" for x in sorted(found["findings"] or [], key=lambda x: x["rank"])), ""]
    out += [f"## Score: {total.get('points')} of {total.get('out_of')} ({total.get('band')})", "", *(_cells(found["score_parts"]) if found["score_parts"] else [""])]
    for name, rows in found.items():
        if name not in ("findings", "score", "score_parts") and rows:
            out += [f"## {name.replace('_', ' ').capitalize()}", "", *_cells(rows if isinstance(rows, list) else [rows])]
    return "\n".join(out)

"""Queries of the core operators on the test tables and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index, near_duplicates, search
from lodestone.plans import report
from lodestone.runtime import table
from lodestone.sources import files

NOW = 1_775_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the same text functions in SQL ---------------------------------------------------------


def _fold(x: str) -> str:
    return f"replace(translate(lower({x}), '{T.FOLD_FROM}', '{T.FOLD_TO}'), 'ß', 'ss')"


def _words(x: str, pattern: str = T.WORD) -> str:
    return f"regexp_extract_all({_fold(x)}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _stem(rel: str, keep: str) -> str:
    """A select of keep + term from a relation with keep + word."""
    one = r"regexp_replace(regexp_replace(regexp_replace(word, '^(.*ss)es$', '\1'), '^(.{2,})ies$', '\1y'), '^(.{2,}[^suia])s$', '\1')"
    two = r"case when regexp_matches(one, '^.+(bb|dd|gg|mm|nn|pp|rr|tt)(ing|ed)$') then regexp_replace(one, '.(ing|ed)$', '') when regexp_matches(one, '^.{3,}(ing|ed)$') then regexp_replace(one, '(ing|ed)$', '') else one end"
    return f"select {keep}, {two} as term from (select {keep}, {one} as one from ({rel}))"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_DOCS = "d as (select distinct * from docs), ok as (select * from d where status = 'ok')"
_POST = "p as (select distinct kb_id, term, doc_id, tf from postings where trim(term) <> '')"


def _terms(x: str, keep: str = "kb_id, doc_id", stop: bool = False, rel: str = "d") -> str:
    where = "" if stop else f" where word not in ({_STOP})"
    return _stem(f"select * from (select {keep}, unnest({_words(x)}) as word from {rel}){where}", keep)


_BUILT = f"""with {_DOCS}, built as (select kb_id, term, doc_id, sum(w)::int as tf from (
  select *, 1 as w from ({_terms('text')}) union all select *, 2 as w from ({_terms('rel')})) group by kb_id, term, doc_id)"""
_RANKED = "row_number() over (partition by kb_id order by {order}) as rank"


def _bm25(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{_DOCS}, {_POST}, n as (select kb_id, count(*) as docs, avg(case when ntok > 0 then ntok else 1 end) as avgdl from d group by kb_id),
hits as (select * from p where term in ({listed})), f as (select kb_id, term, count(*) as df from hits group by kb_id, term),
scored as (select kb_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
  from (select hits.*, df, docs, avgdl, coalesce(case when ntok > 0 then ntok else 1 end, 1) as dl from hits join f using (kb_id, term) join n using (kb_id)
    left join d using (kb_id, doc_id)) group by kb_id, doc_id)"""


def _page(found: str, k: int, order: str = "score desc, rel", after: int = 0) -> str:
    return f""", total as (select kb_id, count(*) as total from {found} group by kb_id),
ranked as (select *, {_RANKED.format(order=order)} from {found})
select kb_id, rank, doc_id, rel, name, ext, mtime, status, round(score, 4) as score, total, false as at_least from ranked join total using (kb_id) where rank > {after} and rank <= {after + k}"""


_META = "select kb_id, doc_id, rel, name, ext, mtime, status, score, text from scored join d using (kb_id, doc_id)"


def _boosted(terms: list[str], source: str) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    named = _terms("name", "kb_id, doc_id", True)
    return f"""named as (select kb_id, doc_id, count(distinct term) as n from ({named}) where term in ({listed}) group by kb_id, doc_id),
boosted as (select * replace (score * case when n = {len(terms)} then 1.6 when n > 0 then 1.15 else 1 end as score) from ({source}) left join named using (kb_id, doc_id))"""


# --- index -----------------------------------------------------------------------------------


@query(_BUILT + " select * from built")
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index.postings(index.documents(table(spark, sf, "docs"), "text", "rel"))


@query(_BUILT + " select kb_id, doc_id, sum(tf)::int as ntok from built group by kb_id, doc_id")
def document_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return index.lengths(index.postings(index.documents(table(spark, sf, "docs"), "text", "rel")))


@query(f"with {_POST} select kb_id, term, count(*) as df, sum(tf)::bigint as cf from p group by kb_id, term")
def term_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_statistics(index.clean_postings(table(spark, sf, "postings")))


@query(f"""select doc_id, substring(sha1(rel), 1, 16) as computed_id, sha1(trim(regexp_replace({_fold('text')}, '[^a-z0-9]+', ' ', 'g'))) as content_hash,
  length(regexp_extract_all(text, '[^\\s\\x{{0085}}\\p{{Z}}\\x{{1C}}-\\x{{1F}}\\x0B]+')) as words from (select distinct * from docs)""")
def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = index.documents(table(spark, sf, "docs"), "rel", "text")
    return d.select("doc_id", T.doc_id(F.col("rel")).alias("computed_id"), T.content_hash(F.col("text")).alias("content_hash"), T.word_count(F.col("text")).cast("long").alias("words"))


_BATCH = "new as (select kb_id, rel, size, mtime, ext, status, author, chash, nwords, text, substring(sha1(rel), 1, 16) as doc_id, arrival_id from arrivals), latest as (select * from new qualify row_number() over (partition by kb_id, doc_id order by arrival_id desc) = 1)"


@query("select distinct kb_id, rel, size, mtime from arrivals a where not exists (select 1 from docs d where d.kb_id = a.kb_id and d.rel = a.rel and d.size = a.size and d.mtime = a.mtime)")
def incremental_changed(spark: SparkSession, sf: str) -> DataFrame:
    return index.changed(table(spark, sf, "docs"), table(spark, sf, "arrivals").select("kb_id", "rel", "size", "mtime")).distinct()


@query(f"with {_DOCS}, {_BATCH} select kb_id, doc_id, rel, mtime, status, nwords from d where not exists (select 1 from latest l where l.kb_id = d.kb_id and l.doc_id = d.doc_id) union all select kb_id, doc_id, rel, mtime, status, nwords from latest")
def snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["kb_id", "doc_id", "rel", "mtime", "status", "nwords"]
    new = table(spark, sf, "arrivals").withColumn("doc_id", T.doc_id(F.col("rel")))
    return index.upsert(index.documents(table(spark, sf, "docs"), *cols[2:]), index.newest(new, index.KEY, [F.desc("arrival_id")]).select(*cols))


@query(f"with {_DOCS} select kb_id, doc_id, rel from d where kb_id not in (select kb_id from arrivals) or exists (select 1 from arrivals a where a.kb_id = d.kb_id and a.rel = d.rel)")
def snapshot_keep_only(spark: SparkSession, sf: str) -> DataFrame:
    return index.keep_only(index.documents(table(spark, sf, "docs"), "rel"), table(spark, sf, "arrivals")).select("kb_id", "doc_id", "rel")


@query(f"with {_DOCS} select kb_id, doc_id from d where kb_id <> (select min(kb_id) from kbs)")
def snapshot_drop_kb(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "kbs").agg(F.min("kb_id")).first()[0]
    return index.drop_kb(index.documents(table(spark, sf, "docs"), "rel"), first).select("kb_id", "doc_id")


# --- search ----------------------------------------------------------------------------------


def _search(text: str, limit: int = 10, offset: int = 0):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.search(table(spark, sf, "postings"), table(spark, sf, "docs"), text, limit=limit, offset=offset)

    return run


_PHRASE = r"(^|[^\p{L}\p{N}])price[^\p{L}\p{N}]+list([^\p{L}\p{N}]|$)"


def _register_searches() -> None:
    boost = lambda terms, source=_META: "with " + _bm25(terms) + ", " + _boosted(terms, source)
    out = {
        "bm25_topk": ("price invoices", boost(["price", "invoice"]) + _page("boosted", 10)),
        "search_excluded": ("handover -audit", boost(["handover"], f"{_META} where not exists (select 1 from p where p.kb_id = d.kb_id and p.doc_id = d.doc_id and term = 'audit')") + _page("boosted", 10)),
        "search_filtered": ("contract ext:pdf ext:.docx folder:signed", boost(["contract"], f"{_META} where lower(ext) in ('.pdf', '.docx') and contains({_fold('rel')}, 'signed')") + _page("boosted", 10)),
        "search_browse": ("ext:md", f"with {_DOCS}, found as (select *, 0.0::double as score from d where lower(ext) = '.md')" + _page("found", 10, "coalesce(mtime, 0) desc, rel")),
        "search_phrase": ('"price list"', boost(["price", "list"], f"{_META} where regexp_matches(text, '(?i){_PHRASE}')") + _page("boosted", 10)),
        "search_not_phrase": (
            'price -"stock cards"',
            boost(["price"], rf"{_META} where not exists (select 1 from p where p.kb_id = d.kb_id and p.doc_id = d.doc_id and term in ('stock', 'card')) and not regexp_matches(coalesce(text, ''), '(?i)(^|[^\p{{L}}\p{{N}}])stock[^\p{{L}}\p{{N}}]+cards([^\p{{L}}\p{{N}}]|$)')") + _page("boosted", 10),
        ),
        "search_second_page": ("price", boost(["price"]) + _page("boosted", 10, after=10)),
    }
    QUERIES["search_second_page"] = _search("price", 10, 10)
    for name, (text, sql) in out.items():
        QUERIES.setdefault(name, _search(text))
        SQL[name] = sql


_register_searches()


@query()
def search_snippets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "docs")
    q = search.parse('"price list" invoices')
    page = search.search(table(spark, sf, "postings"), docs, q.raw, limit=5)
    return search.snippets(page, docs, q).select("kb_id", "rank", "doc_id", "snippet", "parts")


# --- report ----------------------------------------------------------------------------------

_TIME = "coalesce(mtime, 0)"
_PCT = "case when {d} > 0 then round(100.0::double * {n} / {d}, 1) else 0.0 end"


def _docs_query(name: str, sql: str, f) -> None:
    QUERIES[name], SQL[name] = lambda spark, sf: f(table(spark, sf, "docs")), sql


_EXACT = f"""x as (select kb_id, chash, count(*) as files, arg_min(nwords, struct_pack(a := -{_TIME}, b := rel)) as words, arg_min(rel, struct_pack(a := -{_TIME}, b := rel)) as newest,
  round((max({_TIME}) - min({_TIME})) / 31557600.0::double, 1) as spread_years from ok where chash <> '' and nwords >= 5 group by kb_id, chash having count(*) > 1)"""
_COUNTS = "c as (select kb_id, count(*) as total, count_if(status = 'ok')::bigint as readable, count_if(status = 'unreadable')::bigint as unreadable, count_if(status = 'skipped')::bigint as skipped, sum(case when status = 'ok' then coalesce(nwords, 0) else 0 end)::bigint as words, sum(coalesce(size, 0))::bigint as bytes from d group by kb_id)"
_AGE = f"({NOW} - {_TIME}) / 31557600.0::double"
_STALE = f"""s as (select kb_id, count_if({_TIME} > 0 and {_AGE} < 1)::bigint as under1, count_if({_TIME} > 0 and {_AGE} >= 1 and {_AGE} < 3)::bigint as from1to3,
  count_if({_TIME} > 0 and {_AGE} >= 3 and {_AGE} < 5)::bigint as from3to5, count_if({_TIME} > 0 and {_AGE} >= 5)::bigint as over5, count_if({_TIME} <= 0)::bigint as unknown,
  {_PCT.format(n=f'count_if({_TIME} > 0 and {_AGE} >= 3)', d='count(*)')} as share_over3 from ok group by kb_id)"""
_FIVE = lambda t: f"""
n0 as (select kb_id, doc_id, {_words('text', T.PLAIN_WORD)} as w from {t}), n1 as (select *, array_to_string(w, ' ') as same from n0 where len(w) > 0),
n2 as (select *, min(doc_id) over (partition by kb_id, same) as a from n1), g as (select distinct kb_id, doc_id, array_to_string(w[i:i+4], ' ') as run from (select *, unnest(range(1, len(w) - 3)) as i from n2 where a = doc_id)),
z as (select kb_id, doc_id, count(*) as n from g group by kb_id, doc_id having count(*) >= 8), q as (select a.kb_id, a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.kb_id = b.kb_id and a.run = b.run and a.doc_id < b.doc_id group by all),
lim as (select kb_id, coalesce(max(near_threshold), 0.55) as t from kbs group by kb_id),
np as (select q.kb_id, a, b, round(k / (x.n + y.n - k)::double, 4) as similarity from q join z x on x.kb_id = q.kb_id and x.doc_id = a join z y on y.kb_id = q.kb_id and y.doc_id = b left join lim on lim.kb_id = q.kb_id where k / (x.n + y.n - k)::double >= coalesce(t, 0.55)
  union all select n2.kb_id, a, n2.doc_id, 1.0 from n2 join z on z.kb_id = n2.kb_id and z.doc_id = a where a <> n2.doc_id),
np2 as (select kb_id, a, b from np union select kb_id, b, a from np union select kb_id, a, a from np union select kb_id, b, b from np), nr(kb_id, a, b) as (select * from np2 union select nr.kb_id, nr.a, np2.b from nr join np2 on np2.kb_id = nr.kb_id and np2.a = nr.b),
nm0 as (select kb_id, b as doc_id, min(a) as group_id from nr group by kb_id, b), nm as (select nm0.kb_id, nm0.group_id, doc_id, similarity from nm0 join
  (select nm0.kb_id, group_id, max(np.similarity) as similarity from np join nm0 on nm0.kb_id = np.kb_id and nm0.doc_id = np.a group by all) using (kb_id, group_id))"""  # noqa: E731
_POOL = "pool as (select kb_id, doc_id, coalesce(text, '') as text from ok where nwords >= 30 and not exists (select 1 from x where x.kb_id = ok.kb_id and x.chash = ok.chash))"
_NEAR_PARTS = f"{_EXACT}, {_POOL}, {_FIVE('pool')}"
_COPIES = f"""m as (select kb_id, 'exact' as kind, chash as g, doc_id from ok join x using (kb_id, chash) where ok.nwords >= 5 union all select kb_id, 'near', group_id, doc_id from nm),
t as (select c.kb_id, count(distinct case when kind = 'exact' then g end) as exact_groups, count(distinct case when kind = 'near' then g end) as near_groups, coalesce(count(distinct doc_id), 0) as files_involved,
  {_PCT.format(n='count(distinct doc_id)', d='any_value(readable)')} as share, count(doc_id) - count(distinct kind || g) as wasted_copies from c left join m using (kb_id) group by c.kb_id)"""
_PLAIN = lambda x: f"' ' || regexp_replace({_fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
_COVER = f"""i as (select item_key, any_value(label) as label, list_filter(list_transform(any_value(phrases), lambda q: {{'raw': q, 'said': ' ' || trim(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '}}), lambda q: length(q.said) > 2) as ps from checklist where coalesce(is_on, true) group by item_key),
w as materialized (select kb_id, doc_id, rel as shown, {_PLAIN('rel')} as rel, {_PLAIN("coalesce(text, '')")} as text from ok),
fi as materialized (select * from (select kb_id, doc_id, shown as rel, item_key, case when len(list_filter(ps, lambda q: contains(w.rel, q.said))) > 0 then 'name' when len(list_filter(ps, lambda q: contains(text, q.said))) > 0 then 'text' end as place,
  list_filter(ps, lambda q: contains(w.rel, q.said) or contains(text, q.said))[1].raw as phrase from w, i where len(ps) > 0) where place is not null),
v as materialized (select k.kb_id, item_key, count_if(coalesce(place, '') = 'name')::bigint as in_name, count_if(coalesce(place, '') = 'text')::bigint as in_text, count_if(coalesce(place, '') = 'name') > 0 as named, count(place) > 0 as found
  from (select distinct kb_id from ok) k cross join (select item_key from i where len(ps) > 0) left join fi using (kb_id, item_key) group by k.kb_id, item_key),
cs as (select kb_id, max(measured) as measured, max(checked) as checked, max(n) + max(o) as found, max(n) as named, max(o) as mentioned, round(max(n) + 0.5 * max(o), 1) as credit, {_PCT.format(n='(max(n) + 0.5 * max(o))', d='max(checked)')} as credit_share, {_PCT.format(n='(max(n) + max(o))', d='max(checked)')} as share,
  coalesce(any_value(missing), []) as missing, coalesce(any_value(mentioned_only), []) as mentioned_only from (select distinct kb_id from d) left join (
  select k.kb_id, count_if(coalesce(named, false))::bigint as n, count_if(coalesce(found, false) and not coalesce(named, false))::bigint as o, list(coalesce(label, item_key) order by item_key) filter (not coalesce(found, false)) as missing,
    list(coalesce(label, item_key) order by item_key) filter (coalesce(found, false) and not coalesce(named, false)) as mentioned_only from (select distinct kb_id from ok) k cross join i left join v using (kb_id, item_key) group by k.kb_id) using (kb_id),
  (select count(*)::int as checked from i), (select false as z) group by kb_id)"""
_COVER = _COVER.replace("max(measured) as measured", "max(n) is not null as measured").replace("max(n) + max(o)", "coalesce(max(n), 0) + coalesce(max(o), 0)").replace("max(n) as named, max(o) as mentioned", "coalesce(max(n), 0) as named, coalesce(max(o), 0) as mentioned").replace("max(n) + 0.5 * max(o)", "coalesce(max(n), 0) + 0.5 * coalesce(max(o), 0)")


def _share(key: str, source: str, n: int) -> str:
    return f"""select kb_id, rank, key, files, share from (select *, row_number() over (partition by kb_id order by files desc, key) as rank from (
  select *, {_PCT.format(n='files', d='sum(files) over (partition by kb_id)')} as share from (select kb_id, {key} as key, count(*) as files from {source} group by kb_id, key))) where rank <= {n}"""


_FOLDER = "case when folder <> '' then split_part(folder, '/', 1) else '(top level)' end"
_NOBODY = ", ".join(f"'{x}'" for x in report.NO_AUTHOR)
_docs_query("stats_by_status", f"with {_DOCS} select kb_id, status, count(*) as files, sum(coalesce(size, 0))::bigint as bytes, sum(coalesce(nwords, 0))::bigint as words from d group by kb_id, status", report.statistics)
_docs_query("report_counts", f"with {_DOCS}, {_COUNTS} select * from c", report.counts)
_docs_query("exact_duplicate_groups", f"with {_DOCS}, {_EXACT} select * from x", report.exact_groups)
_docs_query("exact_duplicate_members", f"with {_DOCS}, {_EXACT} select kb_id, chash, doc_id, rel from ok join x using (kb_id, chash) where ok.nwords >= 5", report.exact_members)
_docs_query("staleness_buckets", f"with {_DOCS}, {_STALE} select * from s", lambda d: report.staleness(d, NOW))
_docs_query("oldest_files", f"with {_DOCS} select kb_id, row_number() over (partition by kb_id order by mtime, rel) as rank, doc_id, rel, round(({NOW} - mtime) / 31557600.0::double, 1) as years from ok where {_TIME} > 0 qualify rank <= 12", lambda d: report.oldest(d, NOW))
_docs_query("thin_files", f"with {_DOCS} select kb_id, row_number() over (partition by kb_id order by nwords, rel) as rank, doc_id, rel, nwords from ok where nwords < 25 qualify rank <= 24", report.thin)
for _by, _default in (("reason", "no reason recorded"), ("ext", "(no extension)"), ("folder", "(top level)")):
    _key = f"case when {_by} <> '' then {_by} else '{_default}' end"
    _docs_query(f"unreadable_by_{_by}", f"""with {_DOCS} select *, {_PCT.format(n='files', d='sum(files) over (partition by kb_id)')} as share from (select kb_id, {_key} as key, count(*) as files,
  sum(coalesce(size, 0))::bigint as bytes, list_sort(list(rel))[1:5] as examples from d where status = 'unreadable' group by kb_id, key)""", lambda d, by=_by: report.unread(d, by))  # fmt: skip
_docs_query("unreadable_top_types", SQL["unreadable_by_ext"] + " qualify row_number() over (partition by kb_id order by files desc, key) <= 3", lambda d: report.unread(d, "ext", n=3))
_docs_query("skipped_by_ext", f"""with {_DOCS} select kb_id, rank, key, files from ({_share("case when ext <> '' then ext else '(no extension)' end", "(select * from d where status = 'skipped')", 12)})""", report.skipped)
_docs_query("concentration_folder", f"with {_DOCS} {_share(_FOLDER, 'ok', 8)}", lambda d: report.concentration(d, "folder"))
_docs_query("concentration_type", f"""with {_DOCS} {_share("case when ext <> '' then ext else '(no extension)' end", 'ok', 8)}""", lambda d: report.concentration(d, "type"))
_docs_query("concentration_author", f"""with {_DOCS} {_share("trim(author)", f"(select * from ok where trim(author) <> '' and {_fold('trim(author)')} not in ({_NOBODY}))", 8)}""", lambda d: report.concentration(d, "author"))

_NAME = r"regexp_replace(name, '\.[A-Za-z0-9]{1,6}$', '')"
_NAMES = rf"list_filter(list_distinct({_words(_NAME, T.PLAIN_WORD)}), lambda t: length(t) >= 4 and not regexp_matches(t, '^\p{{N}}+$'))"
_REFS = f"""r as (select kb_id, doc_id, rel, coalesce(size, 0) as size, {_NAMES} as tokens, list_distinct({_words('text', T.PLAIN_WORD)}) as said from ok),
nt as (select kb_id, doc_id, unnest(tokens) as token from r), st as (select kb_id, doc_id, unnest(said) as token from r),
held as (select kb_id, token, count(*) as held from st group by kb_id, token), most as (select kb_id, greatest(2.0, 0.2 * count(*)) as most from r group by kb_id),
u as (select nt.kb_id, nt.doc_id, list(token) as needed from nt left join held using (kb_id, token) join most using (kb_id) where coalesce(held, 0) <= most group by nt.kb_id, nt.doc_id),
ref as (select distinct u.kb_id, u.doc_id from u join r on r.kb_id = u.kb_id and r.doc_id <> u.doc_id and list_has_all(r.said, u.needed))"""
_docs_query("unreferenced_files", f"""with {_DOCS}, {_REFS} select r.kb_id, r.doc_id, rel, size, case when len(tokens) = 0 then 'unjudged' when ref.doc_id is not null then 'referenced' else 'unreferenced' end as verdict
  from r left join ref on ref.kb_id = r.kb_id and ref.doc_id = r.doc_id""", report.references)  # fmt: skip


_VERDICT = """judged as (select r.kb_id, r.doc_id, rel, size, case when len(tokens) = 0 then 'unjudged' when ref.doc_id is not null then 'referenced' else 'unreferenced' end as verdict
  from r left join ref on ref.kb_id = r.kb_id and ref.doc_id = r.doc_id)"""
_REFERENCED = f"with {_DOCS}, {_REFS}, {_VERDICT}"
_docs_query("unreferenced_largest", f"{_REFERENCED} select kb_id, row_number() over (partition by kb_id order by size desc, rel) as rank, doc_id, rel, size from judged where verdict = 'unreferenced' qualify rank <= 36", lambda d: report.unreferenced(report.references(d)))
_docs_query("unjudged_files", f"{_REFERENCED} select kb_id, row_number() over (partition by kb_id order by rel) as rank, doc_id, rel from judged where verdict = 'unjudged' qualify rank <= 12", lambda d: report.unjudged(report.references(d)))
_docs_query(
    "reference_counts",
    f"""{_REFERENCED} select kb_id, count_if(verdict = 'unreferenced')::bigint as unreferenced, count_if(verdict <> 'unjudged')::bigint as judged, count_if(verdict = 'unjudged')::bigint as unjudged,
  {_PCT.format(n="count_if(verdict = 'unreferenced')", d="count_if(verdict <> 'unjudged')")} as share from judged group by kb_id""",
    lambda d: report.reference_counts(report.references(d)),
)


def _checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "docs"), table(spark, sf, "checklist")


@query(f"with {_DOCS}, {_COVER} select * from v")
def coverage_by_item(spark: SparkSession, sf: str) -> DataFrame:
    return report.coverage(*_checked(spark, sf))


@query(f"with {_DOCS}, {_COVER} select kb_id, item_key, row_number() over (partition by kb_id, item_key order by case when place = 'name' then 0 else 1 end, rel, doc_id) as rank, rel, place, phrase from fi qualify rank <= 5")
def coverage_first_hits(spark: SparkSession, sf: str) -> DataFrame:
    return report.coverage_hits(report.coverage_of_files(*_checked(spark, sf)))


@query(f"with {_DOCS}, {_COVER} select kb_id, measured, checked, found, named, mentioned, credit, credit_share, share, missing, mentioned_only from cs")
def coverage_credit(spark: SparkSession, sf: str) -> DataFrame:
    docs, checklist = _checked(spark, sf)
    return report.coverage_summary(docs, checklist, report.coverage(docs, checklist))


@query(f"with recursive {_DOCS}, {_COUNTS}, {_NEAR_PARTS}, {_COPIES} select * from t")
def duplicate_totals(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "docs")
    return report.duplicate_totals(docs, report.near_members(docs, table(spark, sf, "kbs")))


_GROUPS = f"""ga as (select kb_id, 'exact' as kind, chash as group_id, files, words, newest, spread_years, 1.0::double as similarity, words::double as second from x union all
  select kb_id, 'near', group_id, count(*), arg_min(nwords, struct_pack(a := -{_TIME}, b := rel)), arg_min(rel, struct_pack(a := -{_TIME}, b := rel)), round((max({_TIME}) - min({_TIME})) / 31557600.0::double, 1), max(similarity), max(similarity) from nm join ok using (kb_id, doc_id) group by kb_id, group_id),
gt as (select *, row_number() over (partition by kb_id, kind order by files desc, second desc, group_id) as rank from ga qualify rank <= 24)"""


@query(f"with recursive {_DOCS}, {_COUNTS}, {_NEAR_PARTS}, {_COPIES}, {_GROUPS} select gt.kb_id, gt.kind, rank, group_id, files, words, newest, spread_years, similarity, list(rel order by -{_TIME}, rel) as members from gt join m on m.kb_id = gt.kb_id and m.kind = gt.kind and m.g = group_id join ok on ok.kb_id = m.kb_id and ok.doc_id = m.doc_id group by all")
def duplicate_groups_largest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "docs")
    return report.largest_groups(docs, report.near_members(docs, table(spark, sf, "kbs")))


_SCORED = f"""o as (select kb_id, share as top from ({_share(_FOLDER, 'ok', 1)})),
sc0 as (select c.kb_id, case when readable + unreadable > 0 then {_PCT.format(n='readable', d='(readable + unreadable)')} end as readable, case when readable > 0 then round(100.0 - share_over3, 1) end as current,
  case when readable > 0 then round(100.0 - t.share, 1) end as "unique", case when readable > 0 then credit_share end as covered,
  case when readable > 0 then round(case when top <= 35 then 100.0 else greatest(0.0, 100.0 * (100.0 - top) / 65.0) end, 1) end as spread
  from c left join s using (kb_id) left join t using (kb_id) left join cs using (kb_id) left join o using (kb_id)),
sc as (select *, round(coalesce(round(readable / 100.0 * 25, 1), 0) + coalesce(round(current / 100.0 * 20, 1), 0) + coalesce(round("unique" / 100.0 * 15, 1), 0) + coalesce(round(covered / 100.0 * 25, 1), 0) + coalesce(round(spread / 100.0 * 15, 1), 0), 1) as points,
  round((case when readable is not null then 25 else 0 end + case when current is not null then 75 else 0 end)::double, 1) as out_of from sc0)"""
_ALL_PARTS = f"{_DOCS}, {_COUNTS}, {_NEAR_PARTS}, {_COPIES}, {_STALE}, {_COVER}, {_SCORED}"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    docs, checklist = _checked(spark, sf)
    docs = index.snapshot(docs)
    return report.score(docs, checklist, NOW, report.near_members(docs, table(spark, sf, "kbs")))


@query(f"with recursive {_ALL_PARTS} select *, case when out_of = 0 then 'none' when 100 * points / out_of >= 80 then 'good' when 100 * points / out_of >= 60 then 'fair' when 100 * points / out_of >= 40 then 'poor' else 'bad' end as band from sc")
def readiness_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


_ROWS = [("readable", 25, "readable"), ("current", 20, "current"), ("unique", 15, '"unique"'), ("covered", 25, "covered"), ("spread", 15, "spread")]
_PART_ROWS = " union all ".join(f"select kb_id, {i} as position, '{k}' as part, '{report.PARTS[k]}' as label, {w}.0::double as weight, {c} as share, round({c} / 100.0 * {w}, 1) as points, {c} is not null as measured from sc" for i, (k, w, c) in enumerate(_ROWS, 1))


@query(f"with recursive {_ALL_PARTS} {_PART_ROWS}")
def readiness_score_parts(spark: SparkSession, sf: str) -> DataFrame:
    return report.score_parts(_scores(spark, sf))


def _in_one(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one knowledge base, which has many near-duplicates."""
    return table(spark, sf, "docs").withColumn("kb_id", F.lit("all"))


_NEAR_IN = f"with recursive {_DOCS}, {_NEAR_PARTS}"
_NEAR_ALL = f"with recursive d as (select distinct * replace ('all' as kb_id) from docs), ok as (select * from d where status = 'ok'), pool as (select kb_id, doc_id, coalesce(text, '') as text from ok where nwords >= 30), {_FIVE('pool')}"


def _apart(spark: SparkSession, sf: str) -> DataFrame:
    return report.exact_members(table(spark, sf, "docs"))


@query(f"{_NEAR_IN} select * from np")
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, sf, "docs"), table(spark, sf, "kbs"), apart=_apart(spark, sf))


@query(f"{_NEAR_IN} select * from nm")
def near_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return report.near_members(table(spark, sf, "docs"), table(spark, sf, "kbs"))


@query(f"{_NEAR_ALL} select * from np")
def near_duplicate_pairs_in_one(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.pairs(_in_one(spark, sf))


@query(f"{_NEAR_ALL} select * from nm")
def near_duplicate_groups_in_one(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(_in_one(spark, sf))


@query()
def near_duplicate_candidates_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.candidate_pairs_lsh(table(spark, sf, "docs"))


def _listed(where: str, n: int) -> str:
    return f"""with {_DOCS} select kb_id, doc_id, rel, name, folder, ext, coalesce(size, 0) as size, {_TIME} as mtime, coalesce(nwords, 0) as nwords, status, reason,
  row_number() over (partition by kb_id order by {_TIME} desc, rel, doc_id) as rank, count(*) over (partition by kb_id) as total from d where {where} qualify rank <= {n}"""


_docs_query("list_documents", _listed("true", 20), lambda d: index.listed(d, limit=20))
_docs_query("list_unreadable_documents", _listed("status = 'unreadable'", 300), lambda d: index.listed(d, "unreadable"))
_docs_query("slim_documents", f"""with {_DOCS} select kb_id, doc_id, coalesce(rel, '') as rel, coalesce(name, '') as name, coalesce(folder, '') as folder, coalesce(ext, '') as ext, coalesce(size, 0) as size, {_TIME} as mtime, coalesce(nwords, 0) as nwords, reason from d""", report.slim)


@query(f"""with recursive {_ALL_PARTS}, {_REFS}, {_VERDICT},
e as (select kb_id, 'unreadable' as kind, unreadable as files, {_PCT.format(n='unreadable', d='total')} as severity, unreadable || ' of ' || total || ' files could not be read' as said from c
  union all select kb_id, 'copies', files_involved, share, files_involved || ' files are copies of others or nearly so; ' || wasted_copies || ' of them are one too many' from t where wasted_copies > 0
  union all select kb_id, 'stale', from3to5 + over5, share_over3, (from3to5 + over5) || ' readable files are over three years old' from s
  union all select kb_id, 'missing', len(missing), {_PCT.format(n='len(missing)', d='checked')}, len(missing) || ' of ' || checked || ' things on the checklist were not found: ' || array_to_string(list_transform(missing[1:3], lambda l: lower(l[1]) || l[2:]), ', ') || case when len(missing) > 3 then ' and others' else '' end from cs where measured
  union all select kb_id, 'piled', files, share, files || ' readable files lie in one folder, ' || key from ({_share(_FOLDER, 'ok', 1)}) where share >= 50
  union all select kb_id, 'unreferenced', count_if(verdict = 'unreferenced')::bigint, {_PCT.format(n="count_if(verdict = 'unreferenced')", d="count_if(verdict <> 'unjudged')")}, count_if(verdict = 'unreferenced') || ' of ' || count_if(verdict <> 'unjudged') || ' files are named in no other file' from judged group by kb_id),
f2 as (select * from e where files > 0 union all select c.kb_id, 'partial', total, 0.0, 'the last scan was stopped early: everything here is about the ' || total || ' files it had reached' from c where kb_id in (select kb_id from kbs where is_partial))
select kb_id, row_number() over (partition by kb_id order by case when kind = 'partial' then 0 else 1 end, severity desc, kind) as rank, kind, files, severity, said from f2""")
def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    docs, checklist = _checked(spark, sf)
    docs, kbs = index.snapshot(docs), table(spark, sf, "kbs")
    return report.findings(docs, checklist, NOW, report.near_members(docs, kbs), kbs)


@query()
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return report.assembled(report.sections(table(spark, sf, "docs"), table(spark, sf, "kbs"), table(spark, sf, "checklist"), NOW))


@query(f"""with {_DOCS} select k.kb_id, k.name, coalesce(near_threshold, 0.55) as threshold, coalesce(is_partial, false) as is_partial, last_scan, count(doc_id) as files,
  row_number() over (order by last_scan desc nulls last, k.kb_id) as rank from kbs k left join d using (kb_id) group by k.kb_id, k.name, near_threshold, is_partial, last_scan""")
def kb_overview(spark: SparkSession, sf: str) -> DataFrame:
    files = index.documents(table(spark, sf, "docs"), "rel").groupBy("kb_id").agg(F.count("*").alias("files"))
    rows = table(spark, sf, "kbs").join(files, "kb_id", "left").select("kb_id", "name", F.coalesce("near_threshold", F.lit(0.55)).alias("threshold"), F.coalesce("is_partial", F.lit(False)).alias("is_partial"), "last_scan", F.coalesce("files", F.lit(0)).alias("files"))
    # a row for each knowledge base, so one partition holds them
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_scan"), "kb_id")))


@query(f"with {_DOCS} select kb_id, doc_id, rel, left(text, 400000) as text, length(text) > 400000 as text_cut from d where kb_id = (select min(kb_id) from kbs) and doc_id = (select min(doc_id) from d where kb_id = (select min(kb_id) from kbs))")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs, kb = table(spark, sf, "docs"), table(spark, sf, "kbs").agg(F.min("kb_id")).first()[0]
    first = docs.where(F.col("kb_id") == kb).agg(F.min("doc_id")).first()[0]
    return index.lookup(docs, kb, first or "").select("kb_id", "doc_id", "rel", "text", "text_cut")


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_TIDY = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g')), chr(0), ' '), '[ \\t\\x{A0}\\x{2007}\\x{202F}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'),"
    f" '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
)
_KINDS = [".txt", ".html", ".docx", ".md"]


@query(
    f"""with e as (select distinct doc_id, text, case when regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]') then '.txt' else {_KINDS!r}[1 + (strpos('0123456789abcdef', doc_id[1]) - 1) % 4] end as ext from docs where status = 'ok' and text <> ''),
f as (select doc_id, ext, case when ext = '.txt' then regexp_replace(text, '^\\x{{FEFF}}', '') else text end as text from e)
select doc_id, ext, case when {_TIDY} <> '' then 'ok' else 'unreadable' end as status, {_TIDY} as text from f"""
)
def extracted_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every readable text, written as the bytes of a text, HTML or Word file by its id, and read again by the extraction."""
    import pandas as pd

    def make(text: str, ext: str) -> bytes:
        import html
        import io
        import zipfile

        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if ext == ".html":
            return ("<html><head><title>x</title></head><body>" + "".join(f"<p>{html.escape(x)}</p>" for x in lines) + "</body></html>").encode()
        if ext == ".docx":
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", '<w:document xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>{html.escape(x)}</w:t></w:r></w:p>" for x in lines) + "</w:document>")
            return out.getvalue()
        return text.encode("utf-8-sig" if ext == ".md" else "utf-8")

    def written(batches):
        for frame in batches:
            content = [make(t, e) for t, e in zip(frame.pop("text"), frame.ext)]
            yield frame.assign(content=content, size=pd.array([len(x) for x in content], "int64"))

    controls = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.instr(F.lit("0123456789abcdef"), F.substring("doc_id", 1, 1)) - 1) % 4 + 1)
    docs = index.documents(table(spark, sf, "docs"), "status", "text").where("status = 'ok' and text <> ''")
    rows = docs.select("kb_id", F.col("doc_id").alias("rel"), F.col("doc_id").alias("path"), F.col("doc_id").alias("name"), F.lit("").alias("folder"), F.when(F.col("text").rlike(controls), ".txt").otherwise(kind).alias("ext"), F.lit(0).cast("long").alias("mtime"), "text")
    listed = rows.mapInPandas(written, "kb_id string, rel string, path string, name string, folder string, ext string, mtime long, content binary, size long")
    return files.records(listed).select(F.col("rel").alias("doc_id"), "ext", "status", "text")


def _html_sql() -> str:
    x = "text"
    for name in ("script", "style", "head"):
        x = f"regexp_replace({x}, '(?is)<{name}\\b.*?</{name}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|br|li|tr|h[1-6]|section|article)\\s*>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for name, sign in (("nbsp", "\xa0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{sign}')"
    x = f"regexp_replace(replace(regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g'), chr(0), ' '), '[ \\t\\x{{A0}}\\x{{2007}}\\x{{202F}}]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(f"select distinct kb_id, doc_id, {_html_sql()} as text from docs where status = 'ok' and lower(ext) in ('.html', '.htm')")
def html_as_text(spark: SparkSession, sf: str) -> DataFrame:
    d = index.documents(table(spark, sf, "docs"), "status", "ext", "text").where("status = 'ok' and lower(ext) in ('.html', '.htm')")
    return d.select("kb_id", "doc_id", T.strip_markup(F.col("text")).alias("text"))

"""Queries of the subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import batch_dedup, boilerplate, distinctive_terms, encoding_repair, layout_duplicates, markup, mixture, name_variants, term_frequency, tokenize
from lodestone.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return term_frequency.mark_terms(table(spark, sf, "postings")).where("mark is not null").select("term", "mark")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return term_frequency.mark_terms(table(spark, sf, "postings"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive_terms.residuals(table(spark, sf, "postings"), table(spark, sf, "docs"), min_weight=0.2, min_docs=2).select("doc_id", "term")


def p3_residuals(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    r = distinctive_terms.residuals(table(spark, sf, "postings"), table(spark, sf, "docs"))
    return r.select("doc_id", "term", "tf", "n_docs", *[F.round(x, 6).alias(x) for x in ("expected", "residual", "adjusted")])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return layout_duplicates.layout_groups(table(spark, sf, "docs").where("status = 'ok'"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.garbled(table(spark, sf, "docs")).select("doc_id")


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.garbled(table(spark, sf, "docs"))


def p4_same_letters(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of letters keys alone, which SQL can express."""
    from pyspark.sql import functions as F

    keys = layout_duplicates.canonical_keys(table(spark, sf, "docs").where("status = 'ok'")).where(f"kind = {layout_duplicates.LETTERS}")
    return layout_duplicates.adjacent_copies(keys).select("first_id", F.col("id").alias("doc_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(table(spark, sf, "docs")).select("doc_id").distinct()


def p5_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(table(spark, sf, "docs"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return batch_dedup.repeated_arrivals(table(spark, sf, "docs"), table(spark, sf, "arrivals"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, sf, "docs"), table(spark, sf, "given_names"))


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_groups(table(spark, sf, "docs"), table(spark, sf, "given_names")).select("author", "entity")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode(table(spark, sf, "documents"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).documents


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).shares


def p9_mixture_by_chars(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture with sizes in characters, which SQL has as well."""
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), size_col="n_chars").documents


def p9_shares_by_chars(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), size_col="n_chars").shares


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.residue(table(spark, sf, "documents")).select("doc_id")


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The grouping stage alone, which SQL can express."""
    return boilerplate.recurring_lines(table(spark, sf, "documents"))


def p10_kept(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.without_residue(table(spark, sf, "documents")).select("doc_id", "source", "n_chars")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_repaired, p3_found, p3_residuals, p4_found, p4_same_letters, p5_found, p5_cleaned, p6_found, p7_found, p7_groups, p8_ids, p9_mixture, p9_shares, p9_mixture_by_chars, p9_shares_by_chars, p10_found, p10_kept, p10_forms)}

_CELLS = r"""with rows as (select doc_id, term, max(coalesce(tf, 0))::bigint as tf from postings
  where doc_id is not null and regexp_matches(term, '[^\s]') group by doc_id, term),
terms as (select term, count(*) as n_docs, sum(tf)::bigint as term_total from rows group by term),
sums as (select doc_id, sum(tf)::bigint as doc_total from rows group by doc_id)"""

_FOLD = "nfc_normalize(replace(translate(lower(nfc_normalize(text)), 'ςſϐϑϕϖϰϱϵ', 'σsβθφπκρε'), 'ß', 'ss'))"
_LETTERS = f"regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

_MIX = """with t as (select source, max(coalesce(target_share, 0)) as target_share, arg_max(greatest(coalesce(max_repeats, 0), 0), coalesce(target_share, 0)) as max_repeats from mix_targets where source is not null group by source),
d as (select doc_id, source, greatest(coalesce(n_chars, 0), 0) as n from documents where source in (select source from t)),
z as (select t.*, coalesce(sum(n), 0)::bigint as size from t left join d using (source) group by all), g as (select sum(size)::double as total from z),
b as (select *, least(target_share * total, size::double * max_repeats) as budget from z, g), e as (select *, case when size > 0 then least(floor(budget / size), max_repeats)::bigint else 0 end as epochs from b),
r as (select *, case when epochs < max_repeats then budget - epochs * size::double else 0.0 end as rest from e),
u as (select doc_id, source, n as n_tokens, sum(n) over (partition by source order by substring(md5('0:' || doc_id), 1, 16), doc_id rows unbounded preceding) as upto from d),
m as (select doc_id, source, n_tokens, epochs + case when upto - n_tokens / 2 < rest and n_tokens > 0 then 1 else 0 end as uses from u join r using (source))"""



def _form(x: str) -> str:
    for pattern, mark in boilerplate.MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return f"trim({x})"


SQL = {
    "p10_forms": f"""with l as (select doc_id, coalesce(source, '') as source, {_form('line')} as form from (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents where doc_id is not null))
select form, count(distinct doc_id) as documents, count(distinct source) as sources from l where form <> '' group by form having count(distinct doc_id) >= {boilerplate.DOCUMENTS} and count(distinct source) >= {boilerplate.SOURCES}""",
    "p9_mixture_by_chars": _MIX + " select * from m",
    "p9_shares_by_chars": _MIX
    + """, k as (select source, sum(n_tokens * uses)::bigint as tokens, max(uses) as most_uses from m group by source)
select source, target_share, max_repeats, size, coalesce(tokens, 0) as tokens, coalesce(most_uses, 0) as most_uses, coalesce(tokens, 0) / greatest(total, 1) as share_of_size, coalesce(tokens, 0) / (select sum(tokens) from k) as share from r left join k using (source)""",
    "p4_same_letters": f"""with k as (select distinct doc_id, {_LETTERS} as key from docs where status = 'ok'), g as (select key, min(doc_id) as first_id from k where key <> '' group by key)
select first_id, doc_id from k join g using (key) where doc_id <> first_id""",
    "p6_found": f"""with r as (select -1 as ord, 'd' || doc_id as sid, text from docs where text <> '' union all select arrival_id, 'a' || arrival_id, text from arrivals where text <> ''),
f as (select distinct ord, sid, {_LETTERS} as key, regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+') as w from r),
same as (select a.ord from f a where a.ord >= 0 and a.key <> '' and exists (select 1 from f b where b.key = a.key and b.ord < a.ord)),
g as (select distinct ord, sid, array_to_string(w[i:i+4], ' ') as run from (select *, unnest(range(1, len(w) - 3)) as i from f)),
n as (select sid, count(*) as n from g group by sid),
near as (select a.ord from g a join g b on a.run = b.run and a.ord >= 0 and b.ord < a.ord join n x on x.sid = a.sid join n y on y.sid = b.sid group by a.ord, a.sid, b.sid, x.n, y.n having count(*) >= 0.55 * (x.n + y.n - count(*)) - 1e-9)
select ord as arrival_id from same union select ord from near""",
    "p1_counts": _CELLS
    + """ select term, term_total as occurrences, n_docs,
  case when n_docs < 3 then 'rare' when n_docs > 0.25 * (select count(*) from sums) then 'common' end as mark from terms""",
    "p1_found": _CELLS
    + """ select term, case when n_docs < 3 then 'rare' else 'common' end as mark from terms
  where n_docs < 3 or n_docs > 0.25 * (select count(*) from sums)""",
    "p3_found": _CELLS
    + """, lengths as (select doc_id, max(ntok) as ntok from docs where ntok > 0 group by doc_id)
select doc_id, term from rows join terms using (term) join sums using (doc_id) left join lengths using (doc_id)
where n_docs >= 2 and tf / coalesce(ntok, doc_total) * ln((select count(distinct doc_id) from postings) / n_docs) >= 0.2""",
    "p3_residuals": _CELLS
    + """, cells as (select *, doc_total * term_total / g as expected, (1 - doc_total / g) * (1 - term_total / g) as spread
  from rows join terms using (term) join sums using (doc_id), (select sum(tf)::double as g from rows))
select doc_id, term, tf, n_docs, round(expected, 6) as expected, round((tf - expected) / sqrt(expected), 6) as residual,
  round((tf - expected) / sqrt(expected) / sqrt(spread), 6) as adjusted from cells""",
}

"""Mentions with their places, sentences that hold them, and enrichment by document and by site."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, quoted
from heron.functions import html, spans
from heron.functions import text as T
from heron.plans import text as P

R = Registry()
BREAK = r"(?<=[.!?])[ \t\n\f\r]+"


def _sql_spans(source: str, patterns: list[tuple[str, str]]) -> str:
    """row, id, text, k, i, unit, raw, start of every match in source (row, id, text)."""
    start = "list_sum(list_transform(s[1:i], lambda v: len(v))) + coalesce(list_sum(list_transform(r[1:i - 1], lambda v: len(v))), 0)"
    each = " union all ".join(f"select *, unnest(range(1, len(r) + 1)) as i from (select *, {k} as k, {quoted(unit)} as unit, regexp_extract_all(text, {quoted('(?i)' + p)}) as r, string_split_regex(text, {quoted('(?i)' + p)}) as s from {source})" for k, (p, unit) in enumerate(patterns))
    return f"select row, id, text, k, i, unit, r[i] as raw, cast({start} as bigint) as start from ({each})"


_PATTERNS = [*rules.MONEY, *((p, "date") for p in rules.DATES)]
_ROWS = f"(select row_number() over () as row, doc_id as id, text from {P.TOLD})"


@R.add("text_spans", f"select id as doc_id, unit, raw, cast(start as int) as start, cast(start + len(raw) as int) as end_, cast(k as int) as pattern from ({_sql_spans(_ROWS, _PATTERNS)})")
def text_spans(spark, sf_dir):
    """Every amount and date with its place; spans of several patterns may overlap."""
    found = F.concat(*(F.transform(spans.spans(F.col("text"), f"(?iU){p}"), _spanned(unit, k)) for k, (p, unit) in enumerate(_PATTERNS)))
    return P.told(spark, sf_dir).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


def _spanned(unit: str, k: int):
    return lambda s: F.struct(F.lit(unit).alias("unit"), s["raw"].alias("raw"), s["start"].alias("start"), s["end"].alias("end_"), F.lit(k).alias("pattern"))


@R.add("text_mention_sentences", f"""with m as ({_sql_spans(_ROWS, rules.MONEY)}),
 p as (select row, string_split_regex(text, '[.!?][ \\t\\n\\f\\r]+') as s, regexp_extract_all(text, '[.!?][ \\t\\n\\f\\r]+') as r from {_ROWS}),
 b as (select row, i - 1 as sentence, coalesce(list_sum(list_transform(s[1:i - 1], lambda v: len(v))), 0) + coalesce(list_sum(list_transform(r[1:i - 1], lambda v: len(v))), 0) as a, len(s[i]) as n, i <= len(r) as ended from (select *, unnest(range(1, len(s) + 1)) as i from p)),
 e as (select row, sentence, cast(a as bigint) as a, cast(a + n + cast(ended as int) as bigint) as z from b)
 select id as doc_id, raw, unit, cast(start as int) as start, cast(sentence as int) as sentence, cast(a as int) as sentence_start, cast(z as int) as sentence_end from m join e on m.row = e.row and start < z and a < start + len(raw)""")
def text_mention_sentences(spark, sf_dir):
    """The sentence that holds each amount, by an interval join of amounts and sentences."""
    texts = P.told(spark, sf_dir).withColumn("text_key", F.xxhash64("text"))
    keys = ["doc_id", "text_key"]
    said = texts.select(*keys, F.explode(spans.located(F.col("text"), rules.MONEY, 0)).alias("m")).select(*keys, "m.start", "m.end", "m.raw", "m.unit")
    parts = texts.select(*keys, F.posexplode(spans.between(F.col("text"), BREAK)).alias("sentence", "b")).select(*keys, "sentence", F.col("b.start").alias("other_start"), F.col("b.end").alias("other_end"))
    both = spans.interval_join(said, parts, keys, 4096)
    return both.select("doc_id", "raw", "unit", "start", "sentence", F.col("other_start").alias("sentence_start"), F.col("other_end").alias("sentence_end"))


def _oracle(name: str) -> str:
    return f"({P.R.oracles[name]})"


@R.add("enriched_documents", f"""select d.doc_id, coalesce(m.money, '') as money, coalesce(t.dates, '') as dates, array_to_string(l.found, '|') as locations, coalesce(g.keywords, '') as keywords, u.labels as urgency, s.positive, s.negative, s.tone, a.audience from documents d
 left join (select doc_id, string_agg(unit || ':' || raw, '|' order by pos) as money from {_oracle("text_money")} group by doc_id) m using (doc_id) left join (select doc_id, string_agg(raw, '|' order by pos) as dates from {_oracle("text_dates")} group by doc_id) t using (doc_id)
 join {_oracle("text_locations")} l using (doc_id) left join (select doc_id, string_agg(keyword_group || '=' || keywords, ';' order by keyword_group) as keywords from {_oracle("text_keyword_groups_packed")} group by doc_id) g using (doc_id)
 join {_oracle("text_urgency")} u using (doc_id) join {_oracle("text_sentiment_packed")} s using (doc_id) join (select doc_id, {P._sql_audience(rules.AUDIENCES)} as audience from {P.TOLD}) a using (doc_id)""")
def enriched_documents(spark, sf_dir):
    """All that the text functions say of each document, as one flat record."""
    t = F.col("text")
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    keys = F.array_sort(F.transform(F.map_entries(T.keyword_groups(t)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))))
    rows = P.told(spark, sf_dir).select("doc_id", joined(T.raws(t, rules.MONEY), lambda m: F.concat(m["unit"], F.lit(":"), m["raw"])).alias("money"), joined(T.raws(t, [(p, "date") for p in rules.DATES]), lambda m: m["raw"]).alias("dates"), F.array_join(F.sort_array(T.locations(t)), "|").alias("locations"), F.array_join(keys, ";").alias("keywords"), F.array_join(T.urgency(t), "|").alias("urgency"), T.sentiment(t).alias("s"), T.audience(t).alias("audience"))
    return rows.select("doc_id", "money", "dates", "locations", "keywords", "urgency", F.col("s.positive").cast("long").alias("positive"), F.col("s.negative").cast("long").alias("negative"), "s.tone", "audience")


_TOLD_PAGES = f"(select page_id, url, ({html.SQL_VISIBLE}) || chr(10) || case page_id % 6 " + " ".join(f"when {k} then {quoted(t)}" for k, t in enumerate(P.SENTENCES_TOLD)) + " end as text from pages)"
_COUNT = lambda ps: " + ".join(f"len(regexp_extract_all(text, {quoted('(?i)' + p)}))" for p in ps)


@R.add("enriched_sites", f"""select site, count(*) as pages, cast(sum({_COUNT([p for p, _ in rules.MONEY])}) as bigint) as amounts, cast(sum({_COUNT(rules.DATES)}) as bigint) as dates, count(*) filter (where {' or '.join(f'regexp_matches(lower(text), {quoted(p)})' for p in rules.URGENCY)}) as urgent,
 count(*) filter (where {P._sql_audience(rules.AUDIENCES)} <> 'general') as addressed from (select regexp_extract(url, '^https?://([^/?#]+)', 1) as site, text from {_TOLD_PAGES}) group by site""")
def enriched_sites(spark, sf_dir):
    """Enrichment summed up by site: amounts, dates, urgent pages and pages with an audience of their own."""
    sentence = F.element_at(F.array(*map(F.lit, P.SENTENCES_TOLD)), (F.col("page_id") % 6 + 1).cast("int"))
    texts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"), F.concat(html.visible(F.col("html")), F.lit("\n"), sentence).alias("text"))
    t = F.col("text")
    e = texts.select("site", F.size(T.mentions(t, rules.MONEY, 0)).alias("amounts"), F.size(T.dates(t)).alias("dates"), (F.size(T.urgency(t)) > 0).alias("urgent"), (T.audience(t) != "general").alias("addressed"))
    return e.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.sum("amounts").alias("amounts"), F.sum("dates").alias("dates"), F.count_if("urgent").alias("urgent"), F.count_if("addressed").alias("addressed"))

"""Text queries over documents and fixture sentences."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, quoted, sql_any, sql_contained, sql_count, sql_labels
from heron.functions import text as T
from heron.functions.budget import running_sums

R = Registry()
B = chr(92)

SAMPLES = """(values (1, 'We pay $0.55/mile and 62 cents per mile, $5,000 sign-on bonus. Apply today! Drivers with CDL earn $25.50 per hour.'),
 (2, 'Best in class: leading, reliable carriers only. Limited positions available. Shippers get a quote for freight.'),
 (3, 'Report of March 5, 2021 and 2020-11-02: Q3 quarter revenue rose 4.5% in Texas and New York, OR so they said.'),
 (4, ''), (5, 'Owner operator lease purchase, 401k, dental, vision. Hiring immediately! Urgent need. Home weekly, your truck, settlement weekly.'),
 (6, 'Access Denied. You must subscribe. Mandatory fees apply; penalty only.')) as t(id, text)"""


def samples(spark):
    return spark.sql(f"select * from {SAMPLES}")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The sentences of SAMPLES in order of id, and DuckDB SQL of told().
SENTENCES_TOLD = re.findall(r"\(\d, '([^']*)'\)", SAMPLES)
TOLD = "(select doc_id, coalesce(text, '') || chr(10) || case doc_id % 6 " + " ".join(f"when {k} then {quoted(t)}" for k, t in enumerate(SENTENCES_TOLD)) + " end as text from documents)"


def told(spark, sf_dir, *more: str):
    """doc_id, text and `more` columns: every whole document, with one of the six sentences after it, as the invented prose names no pay, dates or places."""
    sentence = F.element_at(F.array(*map(F.lit, SENTENCES_TOLD)), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), sentence).alias("text"), *more)


W = r"[\p{L}\p{N}_]"


def sql_words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '{W}+')"


def sql_term_count(low: str, term: str) -> str:
    # RE2's \b is ASCII: whole words are counted between marks put around every run of word characters
    return f"(len(string_split(regexp_replace({low}, '({W}+)', '<\\1>', 'g'), {quoted(re.sub(r'(\w+)', r'<\1>', term))})) - 1)"


def _sql_counts(low: str, terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"struct_pack(term := {quoted(t)}, n := {sql_term_count(low, t)})" for t in terms) + "], lambda x: x.n > 0)"


@R.add("text_term_counts", f"select doc_id, x.term as term, x.n as n from (select doc_id, unnest({_sql_counts('lower(text)', rules.SYNTHETIC_TERMS)}) as x from documents)")
def text_term_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(T.term_counts(F.col("text"), rules.SYNTHETIC_TERMS)).alias("term", "n")).withColumn("n", F.col("n").cast("long"))


@R.add("text_term_counts_packed", f"select doc_id, x.term as term, x.n as n from (select doc_id, unnest({_sql_counts('lower(text)', rules.TERMS)}) as x from {TOLD})")
def text_term_counts_packed(spark, sf_dir):
    return told(spark, sf_dir).select("doc_id", F.explode(T.term_counts(F.col("text"))).alias("term", "n")).withColumn("n", F.col("n").cast("long"))


ASCII = f"list_filter(regexp_extract_all(text, '{W}+'), lambda w: regexp_matches(w, '^[A-Za-z]+$'))"


def ascii_words(text):
    """Whole words of ASCII letters, lower-case."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: w.rlike("^[A-Za-z]+$")), F.lower)


@R.add("text_ngrams", f"select gram, count(*) as n from (select unnest([lower(w[i]) || ' ' || lower(w[i + 1]) for i in range(1, len(w))]) as gram from (select {ASCII} as w from documents)) group by gram order by n desc, gram limit 100")
def text_ngrams(spark, sf_dir):
    """The hundred most frequent bigrams of the corpus; equal counts in order of the bigram."""
    grams = documents(spark, sf_dir).select(F.explode(T.ngrams(ascii_words(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(100)


FEW_GRAMS = 500_000


@R.add("text_similarity", f"""select item_id, doc_id, met / cast(a + b - met as double) as similarity from (select item_id, doc_id, len(x) as a, len(y) as b, len(list_intersect(x, y)) as met from
 (select item_id, list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) as x from (select item_id, {sql_words('text')} as w from benchmark)),
 (select doc_id, list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) as y from (select doc_id, {sql_words('text')} as w from documents))) where met > 0""")
def text_similarity(spark, sf_dir):
    """Trigram Jaccard of benchmark items and documents that share a trigram, through an inverted list.

    The items' trigrams are broadcast up to FEW_GRAMS rows (about 60 MB); then only trigrams that meet are shuffled.
    """
    sets = lambda d, k: d.select(k, F.array_distinct(T.ngrams(T.words(F.col("text")), 3)).alias("g"))
    items = sets(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")
    docs = sets(documents(spark, sf_dir), "doc_id")
    left = items.select("item_id", F.size("g").alias("a"), F.explode("g").alias("gram"))
    right = docs.select("doc_id", F.size("g").alias("b"), F.explode("g").alias("gram"))
    both = right.join(F.broadcast(left) if left.count() <= FEW_GRAMS else left, "gram").groupBy("item_id", "doc_id", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    return both.select("item_id", "doc_id", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("similarity"))


def _sql_amount(raw: str, unit: str) -> str:
    low, words = f"lower({raw})", "|".join(map(re.escape, T.UNIT_WORDS))
    number = f"try_cast(nullif(regexp_extract(regexp_replace({low}, '[,$%]', '', 'g'), '^\\s*([\\d.]+)\\s*(?:(?:{words})\\s*)*$', 1), '') as double)"
    times = f"case when contains({low}, 'k') or contains({low}, 'thousand') then 1000 when contains({low}, 'million') or ends_with({low}, 'm') then 1e6 else 1 end"
    return f"{number} * {times} / case when {unit} = 'per_mile' and contains({low}, 'cent') then 100 else 1 end"


def sql_mentions(patterns: list[tuple[str, str]], around: int) -> str:
    """row, doc_id, text, pos, unit, raw, context of mentions: one begins after the pieces and the mentions before it."""
    starts = "list_sum(list_transform(s[1:i], lambda v: len(v))) + coalesce(list_sum(list_transform(r[1:i - 1], lambda v: len(v))), 0)"
    found = " union all ".join(f"select *, unnest(range(1, len(r) + 1)) as i from (select *, {k} as k, {quoted(unit)} as unit, regexp_extract_all(text, {quoted('(?i)' + p)}) as r, string_split_regex(text, {quoted('(?i)' + p)}) as s from (select row_number() over () as row, doc_id, text from {TOLD}))" for k, (p, unit) in enumerate(patterns))
    placed = f"select row, doc_id, text, k, i, unit, r[i] as raw, cast({starts} as bigint) as start from ({found})"
    return f"(select row, doc_id, text, unit, raw, row_number() over (partition by row order by k, i) - 1 as pos, regexp_replace(substr(text, greatest(0, start - {around}) + 1, start + len(raw) + {around} - greatest(0, start - {around})), '^\\s+|\\s+$', '', 'g') as context from ({placed}))"


SQL_MONEY = f"""with m as (select *, {_sql_amount('raw', 'unit')} as amount from {sql_mentions(rules.MONEY, 50)}),
 c as (select *, least(1.0, greatest(0.0, 0.5::double + {sql_count('lower(context)', rules.CONTEXT_FOR)} * 0.1::double - {sql_count('lower(context)', rules.CONTEXT_AGAINST)} * 0.15::double + case when {sql_count('lower(text)', rules.CONTEXT_FOR)} > 5 then 0.1::double else 0 end + case when unit in ('per_mile', 'per_hour') then 0.2::double else 0 end + case when amount >= 1000 then 0.1::double else 0 end)) as sure from m)"""


@R.add("text_money", f"{SQL_MONEY} select doc_id, cast(pos as int) as pos, raw, unit, amount, context, round(sure, 4) as confidence from c")
def text_money(spark, sf_dir):
    found = told(spark, sf_dir).select("doc_id", "text", F.posexplode(T.money(F.col("text"))).alias("pos", "m"))
    return found.select("doc_id", "pos", "m.*", F.round(T.mention_confidence(F.col("m"), F.col("text")), 4).alias("confidence"))


@R.add("text_money_dedup", f"{SQL_MONEY} select doc_id, raw, unit, amount from (select *, row_number() over (partition by row, lower(trim(raw)), unit order by len(context) desc, pos) as place from c where sure >= 0.4) where place = 1")
def text_money_dedup(spark, sf_dir):
    """Of mentions equal but for case and blanks, the one with the longest context, the first of equals; likely pay only."""
    text = F.col("text")
    likely = F.filter(F.transform(T.money(text), lambda m, i: F.struct(F.length(m["context"]).alias("n"), (-i).alias("i"), m.alias("m"))), lambda x: T.mention_confidence(x["m"], text) >= 0.4)
    rows = told(spark, sf_dir).select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(likely).alias("x"))
    best = rows.groupBy("doc_id", "text_key", F.lower(F.trim("x.m.raw")).alias("said"), F.col("x.m.unit").alias("unit")).agg(F.max("x").alias("x"))
    return best.select("doc_id", "x.m.raw", "unit", "x.m.amount")


@R.add("text_money_values", f"select doc_id, unnest(regexp_extract_all(text, '{rules.MONEY[5][0]}')) as raw from documents")
def text_money_values(spark, sf_dir):
    """Percentages as written: values without contexts need no offsets."""
    return documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({rules.MONEY[5][0]})"), F.lit(1))).alias("raw"))


@R.add("text_dates", f"select doc_id, cast(pos as int) as pos, raw, context from {sql_mentions([(p, 'date') for p in rules.DATES], 30)}")
def text_dates(spark, sf_dir):
    """Dates with thirty characters around them."""
    return told(spark, sf_dir).select("doc_id", F.posexplode(T.dates(F.col("text"))).alias("pos", "m")).select("doc_id", "pos", "m.*")


# Whole words are marked, as RE2's word boundary is that of ASCII.
STATE_RE = "(?i)<(?:" + "|".join(n.replace(" ", r">\s+<") for n in rules.STATES) + ")>"


@R.add("text_locations", f"select doc_id, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '({W}+)', '<\\1>', 'g'), {quoted(STATE_RE)}), lambda m: regexp_replace(m, '[<>]', '', 'g'))), lambda m: lower(m) not in ({', '.join(map(quoted, rules.NOT_STATES))}) or len(m) > 2)) as found from {TOLD}")
def text_locations(spark, sf_dir):
    return told(spark, sf_dir).select("doc_id", F.sort_array(T.locations(F.col("text"))).alias("found"))


SYNTHETIC_GROUPS = {"english": ["the", "and", "of the"], "german": ["der ", "und ", "mit "], "licence": ["license", "copyright"], "mail": ["@mail"]}


def _sql_groups(low: str, groups: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"struct_pack(k := {quoted(g)}, v := {sql_contained(low, kws)})" for g, kws in groups.items()) + "], lambda x: len(x.v) > 0)"


@R.add("text_keyword_groups", f"select doc_id, x.k as keyword_group, array_to_string(x.v, '|') as keywords from (select doc_id, unnest({_sql_groups('lower(text)', SYNTHETIC_GROUPS)}) as x from documents)")
def text_keyword_groups(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(T.keyword_groups(F.col("text"), SYNTHETIC_GROUPS)).alias("keyword_group", "k")).select("doc_id", "keyword_group", F.array_join("k", "|").alias("keywords"))


@R.add("text_keyword_groups_packed", f"select doc_id, x.k as keyword_group, array_to_string(x.v, '|') as keywords from (select doc_id, unnest({_sql_groups('lower(text)', rules.COMPENSATION)}) as x from {TOLD})")
def text_keyword_groups_packed(spark, sf_dir):
    return told(spark, sf_dir).select("doc_id", F.explode(T.keyword_groups(F.col("text"))).alias("keyword_group", "k")).select("doc_id", "keyword_group", F.array_join("k", "|").alias("keywords"))


def _label(p: str) -> str:
    return p.replace(r"\s+", " ").replace(r"(?:\w+ )?", "").replace(r"(?:\w+\s+)?", "").replace("(?:ly)?", "")


@R.add("text_urgency", f"select doc_id, len(l) > 0 as urgent, array_to_string(l, '|') as labels from (select doc_id, {sql_labels((_label(p), f'regexp_matches(lower(text), {quoted(p)})') for p in rules.URGENCY)} as l from {TOLD})")
def text_urgency(spark, sf_dir):
    return told(spark, sf_dir).select("doc_id", T.urgency(F.col("text")).alias("l")).select("doc_id", (F.size("l") > 0).alias("urgent"), F.array_join("l", "|").alias("labels"))


def _sql_sentiment(key: str, source: str, good: list[str], bad: list[str]) -> str:
    n = lambda ws: f"len(list_filter({sql_words('text')}, lambda w: w in ({', '.join(map(quoted, ws))})))"
    return f"select {key}, p as positive, n as negative, case when p + n = 0 then 0.5 else p / cast(p + n as double) end as ratio, case when p > n then 'positive' when n > p then 'negative' else 'neutral' end as tone from (select {key}, {n(good)} as p, {n(bad)} as n from {source})"


@R.add("text_sentiment", _sql_sentiment("doc_id", "documents", ["the", "and", "of"], ["der", "die", "que"]))
def text_sentiment(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.sentiment(F.col("text"), ["the", "and", "of"], ["der", "die", "que"]).alias("s")).select("doc_id", F.col("s.positive").cast("long").alias("positive"), F.col("s.negative").cast("long").alias("negative"), "s.ratio", "s.tone")


@R.add("text_sentiment_packed", _sql_sentiment("doc_id", TOLD, rules.POSITIVE, rules.NEGATIVE))
def text_sentiment_packed(spark, sf_dir):
    return told(spark, sf_dir).select("doc_id", T.sentiment(F.col("text")).alias("s")).select("doc_id", F.col("s.positive").cast("long").alias("positive"), F.col("s.negative").cast("long").alias("negative"), "s.ratio", "s.tone")


SYNTHETIC_AUDIENCES = {"english": ["the ", "and ", " of "], "german": [" der ", " die ", " und "], "french": [" le ", " et ", " la "], "spanish": [" el ", " y ", " los "]}


def _sql_audience(signals: dict[str, list[str]]) -> str:
    ns = [sql_count("lower(text)", s) for s in signals.values()]
    top = f"greatest({', '.join(ns)})"
    return "case when " + top + " = 0 then 'general' " + " ".join(f"when {n} = {top} then {quoted(a)}" for a, n in zip(signals, ns, strict=True)) + " end"


@R.add("text_audience", f"select doc_id, {_sql_audience(SYNTHETIC_AUDIENCES)} as audience, {_sql_audience(rules.AUDIENCES)} as packed from documents")
def text_audience(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.audience(F.col("text"), SYNTHETIC_AUDIENCES).alias("audience"), T.audience(F.col("text")).alias("packed"))


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@R.add("text_sentences", f"select doc_id, len(s) as sentences, len(list_filter(s, lambda x: {sql_any('lower(x)', ['license', 'copyright', '@mail'])})) as hits, array_to_string(list_filter(s, lambda x: {sql_any('lower(x)', ['license', 'copyright', '@mail'])})[1:5], '|') as first_hits from (select doc_id, {SENTENCES} as s from documents)")
def text_sentences(spark, sf_dir):
    keywords = ["license", "copyright", "@mail"]
    s = T.sentences(F.col("text"))
    hits = F.size(F.filter(s, lambda x: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(x), k))))
    return documents(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("sentences"), hits.cast("long").alias("hits"), F.array_join(T.sentences_with(F.col("text"), keywords), "|").alias("first_hits"))


@R.add("text_content_delta", f"select conv_id, turn, delta, delta >= 20 as improved from (select conv_id, turn, len(list_filter(list_distinct({sql_words('text')}), lambda w: not list_contains(prev, w))) as delta from (select *, coalesce({sql_words('lag(text) over (partition by conv_id order by turn)')}, []) as prev from conversations))")
def text_content_delta(spark, sf_dir):
    """New distinct words of each turn against the turn before."""
    from pyspark.sql import Window

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    out = turns.withColumn("before", before).select("conv_id", "turn", T.added_words(F.col("before"), F.col("text")).cast("long").alias("delta"))
    return out.withColumn("improved", F.col("delta") >= 20)


NW = "len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'))"
BOIL = f"(text = '' or {sql_any('substr(lower(text), 1, 500)', rules.BOILERPLATE)})"


@R.add("text_quality", f"""select doc_id, density, q = 'passed' as passed, q as reason, case when n >= 200 and density < 0.3 and method = 'trafilatura' then 'high' when n >= 100 and density < 0.4 then 'medium' else 'low' end as confidence, {BOIL} as boilerplate from
 (select *, case when n < 50 then printf('word_count %d < 50', n) when density > 0.4 then printf('link_density %.2f > 0.4', floor(density * 100 + 0.5 + 1e-9) / 100) when {BOIL} then 'matches boilerplate pattern' when trim(text) = '' or trim(text) = trim(title) or len(trim(text)) < 20 then 'degenerate extraction' else 'passed' end as q from
 (select doc_id, text, {NW} as n, substr(text, 1, 30) as title, case when text = '' then 1.0 else len(substr(text, 1, cast(doc_id % 900 as int))) / cast(len(text) + 1 as double) end as density, case when doc_id % 2 = 0 then 'trafilatura' else 'density' end as method from documents))""")
def text_quality(spark, sf_dir):
    t = F.col("text")
    base = documents(spark, sf_dir).select("doc_id", "text", F.substring("text", 1, 30).alias("title"), T.link_density(t, F.substring(t, F.lit(1), (F.col("doc_id") % 900).cast("int"))).alias("density"), F.when(F.col("doc_id") % 2 == 0, "trafilatura").otherwise("density").alias("method"))
    q = T.quality(t, F.col("title"), F.col("density"))
    return base.select("doc_id", "density", q["passed"].alias("passed"), q["reason"].alias("reason"), T.confidence(t, F.col("method"), F.col("density")).alias("confidence"), T.boilerplate(t).alias("boilerplate"))


@R.add("text_hash", "select doc_id, substr(sha256(text), 1, 16) as hash, substr(sha256(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))), 1, 16) as normalized_hash from documents")
def text_hash(spark, sf_dir):
    from heron.functions import html

    return documents(spark, sf_dir).select("doc_id", T.short_hash(F.col("text")).alias("hash"), html.content_hash(F.col("text")).alias("normalized_hash"))


TRI = "list_filter(list_distinct(g), lambda x: len(list_filter(g, lambda y: y = x)) > 2)"


@R.add("text_grades", f"""select page_id, completeness, repeated from (select page_id, greatest(1.0, least(5.0, 3.0 + case when n >= 500 then 1.0 when n >= 200 then 0.5 when n < 50 then -1.5 when n < 100 then -0.5 else 0.0 end
 + case when share between 0.05 and 0.4 then 0.5 when share < 0.01 then -1.0 when share > 0.5 then -0.5 else 0.0 end)) as completeness, len({TRI}) as repeated from
 (select *, {NW} as n, len(text) / cast(len(html) as double) as share, [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] as g from (select *, list_filter(string_split(lower(text), ' '), lambda x: x <> '') as w from (select page_id, html, """ + __import__("heron.functions.html", fromlist=["x"]).SQL_VISIBLE + """ as text from pages))))""")
def text_grades(spark, sf_dir):
    from heron.functions import html

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", html.visible(F.col("html")).alias("text"))
    return p.select("page_id", T.completeness(F.col("html"), F.col("text")).alias("completeness"), T.repeated_trigrams(F.col("text")).cast("long").alias("repeated"))


_MARKED = f"len(regexp_extract_all(lower(text), {quoted('|'.join(T.MARKERS))}))"
_SAID = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: len(s) > 10)"
SQL_GRADES = f"""with d as (select row_number() over () as row, doc_id, text from documents),
 w as (select row, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from d),
 g as (select row, array_to_string(w[i:i + 2], ' ') as gram from (select row, w, unnest(range(1, len(w) - 1)) as i from w)),
 again as (select row, count(*) as again from (select row, gram from g group by row, gram having count(*) > 2) group by row),
 f as (select d.row, doc_id, text, {NW} as n, {_MARKED} as marks, coalesce(again, 0) as again, {_SAID} as said, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '')) as parts, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) / cast(greatest(len(text), 1) as double) as signs from d left join again using (row)),
 h as (select *, list_sum(list_transform(said, lambda s: len(regexp_extract_all(s, '[^ \\t\\n\\x0b\\f\\r]+')))) / cast(nullif(len(said), 0) as double) as mean, len(list_filter(said, lambda s: regexp_matches(s, '^\\p{{Lu}}'))) / cast(nullif(len(said), 0) as double) as formed from f),
 k as (select doc_id, greatest(1.0::double, least(5.0::double, 3.0::double + case when n >= 500 then 1.0 when n >= 200 then 0.5 when n < 50 then -1.5 when n < 100 then -0.5 else 0.0 end + case when text = '' then 0.0 when 0.25 between 0.05 and 0.4 then 0.5 else 0.0 end + case when regexp_matches(text, '\\n[A-Z][^.!?]*\\n') then 0.25 else 0.0 end)) as completeness,
 greatest(1.0::double, least(5.0::double, 3.5::double + case marks when 0 then 0.5 when 1 then 0.0 when 2 then 0.0 when 3 then -0.5 when 4 then -0.5 when 5 then -0.5 else -1.0 end + case when n > 20 and again > 5 then -0.5 else 0.0 end)) as precision,
 case when n < 20 then 2.0::double else greatest(1.0::double, least(5.0::double, 3.0::double + case when parts >= 3 then 0.5 when parts = 1 then -0.5 else 0.0 end + case when mean between 10 and 25 then 0.5 when mean < 5 then -0.75 when mean > 40 then -0.5 else 0.0 end + case when signs > 0.15 then -0.5 else 0.0 end + case when formed > 0.7 then 0.25 else 0.0 end)) end as structure from h)
 select *, round_even((completeness + precision + structure) / 3, 2) as average from k"""


@R.add("text_grades_all", SQL_GRADES)
def text_grades_all(spark, sf_dir):
    """All three grades and their mean, of documents as the texts extracted from pages four times as long."""
    return graded(spark, sf_dir, "doc_id")


def graded(spark, sf_dir, *keys: str):
    """keys of each document with its grades and their mean."""
    t = F.col("text")
    graded = documents(spark, sf_dir).select(*keys, T.completeness(F.concat(t, t, t, t), t).alias("completeness"), T.precision(t, F.lit(0.2)).alias("precision"), T.structure(t).alias("structure"))
    return graded.withColumn("average", F.bround((F.col("completeness") + F.col("precision") + F.col("structure")) / 3, 2))


@R.add("grades_by_source", f"select source, count(*) as documents, round_even(avg(completeness), 3) as completeness, round_even(avg(precision), 3) as precision, round_even(avg(structure), 3) as structure, count(*) filter (where average < 3) as weak from ({SQL_GRADES}) join (select doc_id, source from documents) using (doc_id) group by source")
def grades_by_source(spark, sf_dir):
    """Mean grades of each source, and how many of its documents are weak."""
    g = graded(spark, sf_dir, "source")
    mean = lambda c: F.bround(F.avg(c), 3).alias(c)
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), mean("completeness"), mean("precision"), mean("structure"), F.count_if(F.col("average") < 3).alias("weak"))


@R.add("text_labels", """select event_id, case when s < 60 then printf('%.0fs', s) when s < 3600 then printf('%.1fm', s / 60) else printf('%.1fh', s / 3600) end as duration,
 case when s < 60 then floor(s)::bigint || 's' when s < 3600 then floor(s / 60)::bigint || 'm' when s < 86400 then floor(s / 3600)::bigint || 'h' else floor(s / 86400)::bigint || 'd' end as age,
 case when e < 0 then 'session' when e - 1000000 < 0 then 'EXPIRED' when (e - 1000000) // 86400 > 365 then ((e - 1000000) // 86400) // 365 || 'y' when (e - 1000000) // 86400 > 30 then ((e - 1000000) // 86400) // 30 || 'mo' when (e - 1000000) // 86400 > 0 then (e - 1000000) // 86400 || 'd' when (e - 1000000) % 86400 > 3600 then ((e - 1000000) % 86400) // 3600 || 'h' else ((e - 1000000) % 86400) // 60 || 'm' end as expiry,
 case when len(event_type) > 4 then substr(event_type, 1, 3) || '…' else event_type end as short from (select event_id, event_type, (event_id * 37 % 200000) + 0.25::double as s, event_id * 7919 % 40000000 - 500000 as e from events)""")
def text_labels(spark, sf_dir):
    n = F.col("event_id")
    s, e = (n * 37 % 200000) + F.lit(0.25), n * 7919 % 40000000 - 500000
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.duration(s).alias("duration"), T.age(s).alias("age"), T.expiry(e, F.lit(1000000)).alias("expiry"), T.truncated(F.col("event_type"), 4).alias("short"))


INTERVALS = "(values ('7d'), ('24h'), ('30m')) as t(spec)"


@R.add("text_intervals", f"select spec, cast(regexp_extract(spec, '^(\\d+)', 1) as bigint) * case right(spec, 1) when 'd' then 86400 when 'h' then 3600 else 60 end as seconds from {INTERVALS}")
def text_intervals(spark, sf_dir):
    return spark.sql(f"select * from {INTERVALS}").select("spec", T.freshen_seconds(F.col("spec")).alias("seconds"))


@R.add("text_budget", "select source, count(*) as pages, sum(len(t)) as chars, max(doc_id) as last_doc from (select source, doc_id, substr(text, 1, 1000) as t, coalesce(sum(len(substr(text, 1, 1000))) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as held from documents) where held <= 5000 group by source")
def text_budget(spark, sf_dir):
    """Sample text of each source: a thousand characters a document until over five thousand are held."""
    piece = documents(spark, sf_dir).select("source", "doc_id", F.least(F.length("text"), F.lit(1000)).alias("n"))  # the texts themselves don't move
    return running_sums(piece, ["source"], ["doc_id"], "n").filter("held <= 5000").groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chars"), F.max("doc_id").alias("last_doc"))

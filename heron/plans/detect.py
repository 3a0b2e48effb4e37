"""Detection queries over pages and fixture rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, quoted, sql_any, sql_labels, sql_match
from heron.functions import detect as D
from heron.functions import html as H
from heron.functions import urls
from heron.plans.urls import pages

R = Registry()

# The synthetic pages have none of the signs, so every third one gets an empty root, a bundle, a noscript warning or a framework.
ADDED = {0: '<div id="root"></div><script src="/main.0a1b.js"></script><script src="/vendor.ff.js"></script>', 1: "<noscript>Please enable JavaScript</noscript>", 2: '<div ng-version="9"></div>', 3: "window.__INITIAL_STATE__ = {}", 4: ""}
SQL_ADDED = "html || case page_id % 7 " + " ".join(f"when {k} then {quoted(v)}" for k, v in ADDED.items()) + " else '' end"
BODY = r"coalesce(regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1), '')"


def signed(spark, sf_dir):
    extra = F.lit("")
    for k, v in ADDED.items():
        extra = F.when(F.col("page_id") % 7 == k, F.lit(v)).otherwise(extra)
    return pages(spark, sf_dir).select("page_id", "url", F.concat("html", extra).alias("h"))


def _conditions() -> list[tuple[str, str]]:
    bundles = " + ".join(f"len(regexp_extract_all(h, {quoted('(?i)' + p)}))" for p in rules.BUNDLES)
    text = H.SQL_VISIBLE.replace("coalesce(html, '')", BODY)
    found = [(f"empty_root_div:{n}", f"regexp_matches(h, {quoted('(?i)' + p)})") for n, p in rules.SPA_ROOTS.items()]
    found += [(f"framework:{n}", sql_match("h", ps, "(?i)")) for n, ps in rules.FRAMEWORKS.items()]
    return [
        *found,
        ("spa_state_hydration", sql_match("h", rules.HYDRATION, "(?i)")),
        ("noscript_warning", sql_match("h", rules.NOSCRIPT, "(?is)")),
        ("js_bundles", f"{bundles} >= 2"),
        ("high_script_ratio", "len(array_to_string(regexp_extract_all(h, '(?is)<script[^>]*>.*?</script>'), '')) / cast(len(h) as double) > 0.5"),
        ("empty_body", f"regexp_matches(h, '(?is)<body[^>]*>.*?</body>') and len(regexp_extract_all({text}, '\\S+')) < 50 and len(h) > 10000"),
    ]


@R.add("detect_js", f"""select page_id, strong or soft or n >= 2 as required, case when strong then 'high' when soft then 'medium' when n >= 3 then 'high' when n = 2 then 'medium' when n = 1 then 'low' else 'high' end as confidence, framework, signals from
 (select *, list_contains(s, 'noscript_warning') or list_contains(s, 'empty_body') as strong, coalesce(framework in ('aem', 'angular'), false) as soft, len(s) as n, array_to_string(s, '|') as signals from
 (select page_id, {sql_labels(_conditions())} as s, case {' '.join(f"when {sql_match('h', ps, '(?i)')} then {quoted(n)}" for n, ps in rules.FRAMEWORKS.items())} end as framework from (select page_id, {SQL_ADDED} as h from pages)))""")
def detect_js(spark, sf_dir):
    v = signed(spark, sf_dir).select("page_id", D.js_required(F.col("h")).alias("v"))
    return v.select("page_id", "v.required", "v.confidence", "v.framework", F.array_join("v.signals", "|").alias("signals"))


@R.add("detect_technologies", f"""select page_id, array_to_string({sql_labels((n, sql_match('h', ps, '(?i)')) for n, ps in rules.TECHNOLOGIES.items())}, '|') as technologies, array_to_string({sql_labels((n, f"regexp_matches(lower(h), {quoted(p)})") for n, p in rules.INTEGRATIONS.items())}, '|') as integrations, array_to_string({sql_labels((n, f"regexp_matches(lower(h), {quoted(p)})") for n, p in rules.OAUTH.items())}, '|') as oauth from (select page_id, {SQL_ADDED} || case when page_id % 5 = 0 then ' Sign in with Google; Salesforce REST API, wp-content' else '' end as h from pages)""")
def detect_technologies(spark, sf_dir):
    h = signed(spark, sf_dir).withColumn("h", F.concat("h", F.when(F.col("page_id") % 5 == 0, " Sign in with Google; Salesforce REST API, wp-content").otherwise("")))
    return h.select("page_id", F.array_join(D.technologies(F.col("h")), "|").alias("technologies"), F.array_join(D.integrations(F.col("h")), "|").alias("integrations"), F.array_join(D.oauth(F.col("h")), "|").alias("oauth"))


HEADERS = """(values (1, 'cf-ray', 'x', 'nginx', 200, ''), (2, 'sg-captcha', 'challenge', 'nginx', 202, 'Just a moment'), (3, 'x-other', '', 'AkamaiGHost', 403, 'Access denied'), (4, 'x-fastly', '1', '', 200, ''),
 (5, 'x-cdn', 'edge', '', 429, 'too many requests'), (6, 'x-none', '', 'Imperva', 200, 'welcome'), (7, 'x-none', '', '', 200, 'please wait')) as t(id, name, value, server, status, html)"""


def cases(spark, sf_dir, literal: str, n: int):
    """Every event with one of n literal cases (with id from 1 on), dealt by its number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % n + 1).alias("id"))
    return e.join(F.broadcast(spark.sql(f"select * from {literal}")), "id").drop("id")


def sql_cases(literal: str, n: int) -> str:
    return f"(select event_id, t.* exclude (id) from events join {literal} on t.id = event_id % {n} + 1)"


N_HEADERS = 7


@R.add("detect_cdn", f"""select event_id, coalesce(named, case when name = 'x-cdn' then value end) as cdn, named as waf, chal as challenged, blocked, named is not null as waf_detected, chal or blocked or named is not null or status in (403, 429, 451) as defended from
 (select *, case when name in ('cf-ray', 'cf-cache-status') then 'cloudflare' when name = 'sg-captcha' then 'stackpath' {' '.join(f"when name = 'x-{n}' or contains(lower(server), '{n}') then '{n}'" for n in ('akamai', 'fastly', 'sucuri', 'datadome'))} when contains(lower(server), 'imperva') then 'imperva' when name = 'x-distil' then 'distil' end as named,
 {sql_any('lower(html)', rules.CHALLENGES)} as chal, status in (403, 429, 451) or {sql_any('lower(html)', rules.SOFT_BLOCKS)} as blocked from {sql_cases(HEADERS, N_HEADERS)})""")
def detect_cdn(spark, sf_dir):
    rows = cases(spark, sf_dir, HEADERS, N_HEADERS).withColumn("headers", F.expr("map(name, value, 'server', server)"))
    c, ch = D.cdn(F.col("headers")), D.challenge(F.col("html"))
    bl = D.soft_block(F.col("html"), F.col("status"))
    d = D.bot_defence(c["waf"], ch, bl, F.col("status"))
    return rows.select("event_id", c["cdn"].alias("cdn"), c["waf"].alias("waf"), ch.alias("challenged"), bl.alias("blocked"), d["waf_detected"].alias("waf_detected"), d["defended"].alias("defended"))


CAPTURES = """(values (1, 'Timeout 30000ms', '200 OK', 'x', 10, 5), (2, 'not_html: pdf', '200', '', 10, 0), (3, 'request_error', '', '', 0, 0), (4, 'odd', '', '', 0, 0), (5, '', '429 slow', 'fine', 9000, 400),
 (6, '', '200', 'A captcha challenge', 9000, 400), (7, '', '200', 'Access denied: unusual traffic', 9000, 400), (8, '', '200', 'thin', 5001, 29), (9, '', '200', 'thin', 5001, 30), (10, '', 'x', 'long', 5000, 29)) as t(id, error, status, html, html_bytes, words)"""


@R.add("detect_captures", f"""select event_id, outcome, reason, markers from (select event_id, case when error <> '' and contains(e, 'timeout') then 'timeout' when error <> '' and contains(e, 'not_html') then 'non_html' when error <> '' and (contains(e, 'request_error') or contains(e, 'navigation_failed')) then 'network_error' when error <> '' then 'unknown_failure'
 when code in (403, 429, 451) then 'hard_block' when len(c) > 0 then 'challenge_not_cleared' when len(b) > 0 then 'soft_block' when words > 0 and words < 30 and html_bytes > 5000 then 'thin_content' else 'success_real_content' end as outcome,
 case outcome when 'timeout' then 'capture_timeout' when 'non_html' then 'non_html_response' when 'network_error' then 'network_or_navigation_error' when 'unknown_failure' then 'capture_error' when 'hard_block' then 'hard_block_status' when 'challenge_not_cleared' then 'challenge_markers_detected' when 'soft_block' then 'soft_block_markers_detected' when 'thin_content' then 'very_low_extracted_words' else 'content_captured' end as reason,
 array_to_string(case outcome when 'challenge_not_cleared' then c when 'soft_block' then b else [] end, '|') as markers from (select *, lower(error) as e, try_cast(split_part(status, ' ', 1) as int) as code, {sql_labels((m, f"contains(lower(html), {quoted(m)})") for m in rules.CAPTURE_CHALLENGES)} as c, {sql_labels((m, f"contains(lower(html), {quoted(m)})") for m in rules.CAPTURE_BLOCKS)} as b from {sql_cases(CAPTURES, 10)}))""")
def detect_captures(spark, sf_dir):
    rows = cases(spark, sf_dir, CAPTURES, 10).withColumn("headers", F.expr("map('status', status)"))
    o = D.capture_outcome(F.col("error"), D.status_of(F.col("headers")), F.col("html"), F.col("html_bytes"), F.col("words"))
    return rows.select("event_id", o.alias("o")).select("event_id", "o.outcome", "o.reason", F.array_join("o.markers", "|").alias("markers"))


OUTCOMES = ["success_real_content", "soft_block", "challenge_not_cleared", "thin_content", "network_error", "timeout", "hard_block", "non_html"]
ATTEMPTS = f"(select event_id, {{array}}[1 + event_id % 5] as current_strategy, {{outcomes}}[1 + event_id % 8] as outcome, event_id % 3 as attempt, event_id % 2 as retries, event_id % 11 > 4 as stealth, event_id % 13 > 6 as visible_ok, {{array}}[1 + event_id % 6] as ceiling from events)"


def _sql_array(names: list[str]) -> str:
    return "[" + ", ".join(map(quoted, names)) + "]"


LADDER = _sql_array(rules.LADDER)


@R.add("detect_next_strategy", f"""select event_id, backoff, case when outcome in ('success_real_content', 'hard_block', 'non_html', 'robots_denied') or attempt + 1 >= 3 then null when outcome in ('network_error', 'timeout') and retries < 1 then current_strategy
 when ceiling is null or list_position({LADDER}, nxt) <= list_position({LADDER}, ceiling) then nxt end as next_strategy from (select *, least(3.0::double * pow(2, attempt), 120) as backoff, list_filter({LADDER}[list_position({LADDER}, current_strategy) + 1:], lambda s: (s not in ('stealth', 'stealth_patient') or stealth) and (s <> 'visible' or visible_ok))[1] as nxt from {ATTEMPTS.format(array=LADDER, outcomes=_sql_array(OUTCOMES))})""")
def detect_next_strategy(spark, sf_dir):
    n = F.col("event_id")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (n % k).cast("int"))
    a = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", pick(rules.LADDER, 5).alias("current"), pick(OUTCOMES, 8).alias("outcome"), (n % 3).alias("attempt"), (n % 2).alias("retries"), (n % 11 > 4).alias("stealth"), (n % 13 > 6).alias("visible_ok"), pick(rules.LADDER, 6).alias("ceiling"))
    c = F.col
    return a.select("event_id", D.backoff(F.lit(3.0), c("attempt")).alias("backoff"), D.next_strategy(c("current"), c("outcome"), c("attempt"), c("retries"), F.lit(3), c("stealth"), c("visible_ok"), c("ceiling")).alias("next_strategy"))


FIXTURES = """(values (1, 'cloudflare', 'cf-challenge', true), (2, 'cloudflare', null, false), (3, 'stackpath', 'sgcaptcha', true), (4, 'akamai', 'bot-manager', true), (5, 'fastly', null, false), (6, null, null, false), (7, null, null, true)) as t(id, cdn, kind, js)"""


@R.add("detect_methods", f"select event_id, case when kind = 'sgcaptcha' then 'stealth+cookies' when kind is not null then 'stealth' when js or coalesce(cdn = 'cloudflare', false) then 'js' else 'http' end as label, coalesce(case when event_id % 7 = 5 then 'visible' end, case when kind is not null or coalesce(cdn in ('cloudflare', 'stackpath'), false) then 'stealth' when js then 'js' else 'requests' end) as recommended from {sql_cases(FIXTURES, 7)}")
def detect_methods(spark, sf_dir):
    rows = cases(spark, sf_dir, FIXTURES, 7)
    c = F.col
    return rows.select("event_id", D.method_label(c("cdn"), c("kind"), c("js")).alias("label"), D.recommended(F.when(c("event_id") % 7 == 5, "visible"), c("kind").isNotNull(), c("cdn"), c("js")).alias("recommended"))


# Addresses that every eleventh page is given, and whether they are of interest.
PAY_URLS = [("/careers/drivers", True), ("/blog/careers/1", True), ("/drivers", True), ("/blog/drivers", False), ("/driving-change", False), ("/apply", True), ("/pay-stub", False), ("/owner-operator-jobs", True), ("/work-with-us", True), ("/about", False), ("/driver-benefits", True)]


@R.add("detect_pay_pages", "select page_id, case page_id % 11 " + " ".join(f"when {k} then {quoted(u)}" for k, (u, _) in enumerate(PAY_URLS)) + " end as path, case page_id % 11 " + " ".join(f"when {k} then {str(v).lower()}" for k, (_, v) in enumerate(PAY_URLS)) + " end or (page_id % 5 = 0 and page_id % 11 not in (3, 4)) as found from pages")
def detect_pay_pages(spark, sf_dir):
    """Pages on pay and recruiting: by a strong pattern, a weak one outside excluded paths, or their type."""
    path = F.element_at(F.array(*(F.lit(u) for u, _ in PAY_URLS)), (F.col("page_id") % 11 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 5 == 0, "careers").otherwise("other")
    return pages(spark, sf_dir).select("page_id", path.alias("path"), D.pay_page(F.concat(F.lit("https://a.example"), path), kind).alias("found"))


@R.add("detect_homepage", rf"select host, arg_min(page_id, (not regexp_matches(path, '^/?$'), page_id)) as homepage from (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages) group by host")
def detect_homepage(spark, sf_dir):
    """The root page of each host, else its first."""
    p = pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    return p.groupBy("host").agg(F.min_by("page_id", F.struct(~F.col("path").rlike("^/?$"), "page_id")).alias("homepage"))

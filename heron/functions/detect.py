"""Detection and classification of pages, captures and attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import any_contained, any_match, contained, labels_where
from heron.functions.html import visible
from heron.functions.spans import bound


def js_required(html: Column, words: Column | None = None) -> Column:
    """Struct (required, confidence, framework, signals): signs that a page needs scripts to show its text."""
    html = F.coalesce(html, F.lit(""))
    frameworks = [(f"framework:{name}", any_match(html, ps, "(?i)")) for name, ps in rules.FRAMEWORKS.items()]
    bundles = sum((F.regexp_count(html, F.lit(f"(?i){p}")) for p in rules.BUNDLES), F.lit(0))
    in_scripts = F.aggregate(F.regexp_extract_all(html, F.lit("(?is)(<script[^>]*>.*?</script>)"), F.lit(1)), F.lit(0), lambda a, s: a + F.length(s))
    body = F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1)
    found = [(f"empty_root_div:{name}", html.rlike(f"(?i){p}")) for name, p in rules.SPA_ROOTS.items()] + frameworks
    found += [
        ("spa_state_hydration", any_match(html, rules.HYDRATION, "(?i)")),
        ("noscript_warning", any_match(html, rules.NOSCRIPT, "(?is)")),
        ("js_bundles", bundles >= 2),
        ("high_script_ratio", F.coalesce(F.try_divide(in_scripts, F.length(html)) > 0.5, F.lit(False))),
        ("empty_body", html.rlike("(?is)<body[^>]*>.*?</body>") & (F.regexp_count(visible(body), F.lit(r"\S+")) < 50) & (F.length(html) > 10000)),
    ]
    if words is not None:
        found.append(("low_extracted_words", (words < 100) & (F.length(html) > 5000)))
    mark = "framework:"  # each pattern is run once: the framework is read from the signals

    def judged(signals: Column) -> Column:
        first = F.get(F.filter(signals, lambda x: x.startswith(mark)), F.lit(0))
        return F.transform(F.array(F.struct(signals.alias("s"), F.substring(first, len(mark) + 1, 99).alias("f"))), _js_verdict)[0]

    return bound(labels_where(found), judged)


def _js_verdict(x: Column) -> Column:
    n, strong = F.size(x["s"]), F.arrays_overlap(x["s"], F.array(F.lit("noscript_warning"), F.lit("empty_body")))
    by_framework = F.coalesce(x["f"].isin("aem", "angular"), F.lit(False))
    confidence = F.when(strong, "high").when(by_framework, "medium").when(n >= 3, "high").when(n == 2, "medium").when(n == 1, "low").otherwise("high")
    return F.struct((strong | by_framework | (n >= 2)).alias("required"), confidence.alias("confidence"), x["f"].alias("framework"), x["s"].alias("signals"))


def technologies(html: Column, packs: dict[str, list[str]] = rules.TECHNOLOGIES) -> Column:
    return labels_where((name, any_match(html, ps, "(?i)")) for name, ps in packs.items())


def integrations(text: Column, packs: dict[str, str] = rules.INTEGRATIONS) -> Column:
    return labels_where((name, F.lower(text).rlike(p)) for name, p in packs.items())


def oauth(text: Column, packs: dict[str, str] = rules.OAUTH) -> Column:
    return labels_where((name, F.lower(text).rlike(p)) for name, p in packs.items())


def api_endpoints(html: Column, most: int = 5) -> Column:
    """The first distinct endpoint-like strings."""
    found = F.concat(F.regexp_extract_all(html, F.lit(r"(/api/v\d+/)"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"(?i)(graphql)"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"[\"'](https?://[^\"']*api[^\"']*)[\"']"), F.lit(1)))
    return F.slice(F.array_distinct(found), 1, most)


def header(headers: Column, name: str) -> Column:
    """Value of a header in a map with lower-case names."""
    return F.element_at(headers, name)


def cdn(headers: Column) -> Column:
    """Struct (cdn, waf) of a header map with lower-case names, first rule that holds."""
    has = lambda k: F.map_contains_key(headers, k)
    server = F.lower(F.coalesce(header(headers, "server"), F.lit("")))
    named = F.when(has("cf-ray") | has("cf-cache-status"), "cloudflare").when(has("sg-captcha"), "stackpath")
    for name in ("akamai", "fastly", "sucuri", "datadome"):
        named = named.when(has(f"x-{name}") | F.contains(server, F.lit(name)), name)
    named = named.when(F.contains(server, F.lit("imperva")), "imperva").when(has("x-distil"), "distil")
    return F.struct(F.coalesce(named, header(headers, "x-cdn")).alias("cdn"), named.alias("waf"))


def challenge(html: Column, markers: list[str] = rules.CHALLENGES) -> Column:
    return F.coalesce(any_contained(F.lower(html), markers), F.lit(False))


def soft_block(html: Column, status: Column, markers: list[str] = rules.SOFT_BLOCKS) -> Column:
    return F.coalesce(status.isin(403, 429, 451), F.lit(False)) | F.coalesce(any_contained(F.lower(html), markers), F.lit(False))


def bot_defence(waf: Column, challenged: Column, blocked: Column, status: Column) -> Column:
    return F.struct(waf.isNotNull().alias("waf_detected"), (challenged | blocked | waf.isNotNull() | F.coalesce(status.isin(403, 429, 451), F.lit(False))).alias("defended"))


def status_of(headers: Column) -> Column:
    """First whole number among the status headers."""
    names = ("status", "x-status", "http-status", "status-code")
    return F.coalesce(*(F.expr(f"try_cast(split(element_at(headers, '{n}'), ' ')[0] as int)") for n in names))


def capture_outcome(error: Column, status: Column, html: Column, html_bytes: Column, words: Column, challenges: list[str] = rules.CAPTURE_CHALLENGES, blocks: list[str] = rules.CAPTURE_BLOCKS) -> Column:
    """Struct (outcome, reason, markers): error class, block status, challenge, soft block, thin content, success."""
    low, err = F.lower(F.coalesce(html, F.lit(""))), F.lower(error)
    hard = contained(low, challenges)
    soft = contained(low, blocks)
    failed = F.coalesce(error, F.lit("")) != ""
    outcome = (
        F.when(failed & F.contains(err, F.lit("timeout")), "timeout")
        .when(failed & F.contains(err, F.lit("not_html")), "non_html")
        .when(failed & (F.contains(err, F.lit("request_error")) | F.contains(err, F.lit("navigation_failed"))), "network_error")
        .when(failed, "unknown_failure")
        .when(status.isin(403, 429, 451), "hard_block")
        .when(F.size(hard) > 0, "challenge_not_cleared")
        .when(F.size(soft) > 0, "soft_block")
        .when((words > 0) & (words < 30) & (html_bytes > 5000), "thin_content")
        .otherwise("success_real_content")
    )
    reasons = {"timeout": "capture_timeout", "non_html": "non_html_response", "network_error": "network_or_navigation_error", "unknown_failure": "capture_error", "hard_block": "hard_block_status", "challenge_not_cleared": "challenge_markers_detected", "soft_block": "soft_block_markers_detected", "thin_content": "very_low_extracted_words", "success_real_content": "content_captured"}
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in reasons.items() for x in kv)), outcome)
    markers = F.when(outcome == "challenge_not_cleared", hard).when(outcome == "soft_block", soft).otherwise(F.array().cast("array<string>"))
    return F.struct(outcome.alias("outcome"), reason.alias("reason"), markers.alias("markers"))


TERMINAL = ["hard_block", "non_html", "robots_denied"]
AGAIN = ["network_error", "timeout"]


def next_rung(current: Column, stealth: Column, visible_ok: Column, ceiling: Column, ladder: list[str] = rules.LADDER) -> Column:
    """The next allowed strategy of the ladder; null at its end or above the ceiling."""
    place = lambda c: F.array_position(F.array(*map(F.lit, ladder)), c)
    at = F.greatest(F.coalesce(place(current), F.lit(0)), F.lit(1)).cast("int")
    ahead = F.slice(F.array(*map(F.lit, ladder)), at + 1, len(ladder))
    allowed = F.filter(ahead, lambda s: (~s.isin("stealth", "stealth_patient") | stealth) & ((s != "visible") | visible_ok))
    first = F.try_element_at(allowed, F.lit(1))
    top = F.coalesce(place(ceiling), F.lit(0))
    return F.when((top == 0) | (place(first) <= top), first)


def next_strategy(current: Column, outcome: Column, attempt: Column, retries: Column, most: Column, stealth: Column, visible_ok: Column, ceiling: Column) -> Column:
    """What to try next after an outcome; null to give up."""
    stop = (outcome == "success_real_content") | outcome.isin(TERMINAL) | (attempt + 1 >= most)
    return F.when(stop, F.lit(None).cast("string")).when(outcome.isin(AGAIN) & (retries < 1), current).otherwise(next_rung(current, stealth, visible_ok, ceiling))


def backoff(base: Column, attempt: Column) -> Column:
    """Delay without its random part: doubled each attempt, 120 at most."""
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(120.0))


def next_delay(attempt: Column, base: Column, patient: Column, outcome: Column, first: Column, second: Column) -> Column:
    """Delay before the next attempt, one second at least.

    first and second are shares of 1 (F.rand() or a hash): where patience is asked for, the first
    picks a base of 8 to 20 seconds; the second moves the delay by up to a fifth either way.
    """
    own = F.when(patient | F.coalesce(outcome.isin("soft_block", "challenge_not_cleared"), F.lit(False)), 8.0 + first * 12.0).otherwise(base)
    delay = backoff(own, attempt)
    return F.greatest(F.lit(1.0), delay + delay * (second * 0.4 - 0.2))


def recommended(cached: Column, challenged: Column, cdn_name: Column, js: Column) -> Column:
    return F.coalesce(cached, F.when(challenged | F.coalesce(cdn_name.isin("cloudflare", "stackpath"), F.lit(False)), "stealth").when(js, "js").otherwise("requests"))


def method_label(cdn_name: Column, kind: Column, js: Column) -> Column:
    """Label of the recorded-response fixtures: challenge before CDN, script need and plain http."""
    return F.when(kind == "sgcaptcha", "stealth+cookies").when(kind.isNotNull(), "stealth").when(js | F.coalesce(cdn_name == "cloudflare", F.lit(False)), "js").otherwise("http")


def pay_page(url: Column, page_type: Column) -> Column:
    """Whether a page is about pay or recruiting."""
    strong, weak, out = (any_match(url, ps, "(?i)") for ps in (rules.PAY_STRONG, rules.PAY_WEAK, rules.PAY_EXCLUDED))
    return strong | (~out & weak) | (~out & page_type.isin(*rules.PAY_TYPES))

"""URL functions. Hosts keep their port; an invalid URL gives null parts, which count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import any_match, first_match


def part(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case authority without a leading www."""
    return F.regexp_replace(F.lower(part(url, "AUTHORITY")), r"^www\.", "")


def path(url: Column) -> Column:
    return part(url, "PATH")


def canonical(url: Column, drop: list[str] = rules.TRACKING_PARAMS) -> Column:
    """Lower scheme and host, no www., no trailing slash, no tracking parameters or fragment, parameters sorted by name."""
    pairs = F.filter(F.split(part(url, "QUERY"), "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(name(p)) + 2, F.length(p))).otherwise("")
    kept = F.filter(pairs, lambda p: ~F.lower(F.try_url_decode(name(p))).isin(drop))
    decoded = F.transform(kept, lambda p, i: F.struct(F.try_url_decode(name(p)).alias("k"), i.alias("i"), F.try_url_decode(value(p)).alias("v")))
    query = F.array_join(F.transform(F.array_sort(decoded), lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"]))), "&")
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host(url), F.when(trimmed == "", "/").otherwise(trimmed), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def skipped(url: Column, extensions: list[str] = rules.SKIP_EXTENSIONS, patterns: list[str] = rules.SKIP_PATTERNS) -> Column:
    """A resource that isn't a page: by extension of the whole URL, or by pattern."""
    low = F.lower(url)
    return any_match(low, [e.replace(".", r"\.") + "$" for e in extensions]) | any_match(low, patterns)


def skipped_by_path(url: Column, extensions: list[str] = rules.SKIP_EXTENSIONS) -> Column:
    """The same by the path alone, so that a query string doesn't hide the extension."""
    return any_match(F.lower(path(url)), [e.replace(".", r"\.") + "$" for e in extensions])


def internal(url: Column, domain: Column) -> Column:
    """The domain occurs in the host, anywhere (so that mydomain.com also holds domain.com)."""
    return F.contains(host(url), domain)


def filename(url: Column) -> Column:
    """Flat .html name: path with underscores, a hash of the query, 200 characters at most."""
    name = F.replace(F.trim(path(url), F.lit("/")), F.lit("/"), F.lit("_"))
    name = F.when(name == "", "index").otherwise(name)
    query = part(url, "QUERY")
    return F.concat(F.substring(F.concat(name, F.when(query == "", "").otherwise(F.concat(F.lit("_"), F.substring(F.md5(query), 1, 8)))), 1, 200), F.lit(".html"))


def safe_filename(url: Column, extension: str = ".html") -> Column:
    """Variant without query hash: characters that file systems refuse are dropped, .htm(l) is replaced."""
    name = F.replace(F.trim(path(url), F.lit("/")), F.lit("/"), F.lit("_"))
    name = F.regexp_replace(F.regexp_replace(name, r'[<>:"|?*]', ""), r"\.html?$", "")
    return F.concat(F.when(name == "", "index").otherwise(F.substring(name, 1, 200)), F.lit(extension))


def cache_key(url: Column) -> Column:
    authority = part(url, "AUTHORITY")
    return F.replace(F.when(authority == "", F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)).otherwise(authority), F.lit("www."), F.lit(""))


def start_url(domain: Column) -> Column:
    """https URL of a seed: www. is added to hosts with one dot at most; scheme and path stay."""
    d = F.trim(domain)
    bare = F.substring_index(d, "/", 1)
    dots = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit("")))
    return F.when(d.rlike("^https?://"), d).when((dots <= 1) & ~d.startswith("www."), F.concat(F.lit("https://www."), d)).otherwise(F.concat(F.lit("https://"), d))


def page_type(p: Column, types: dict[str, list[str]] = rules.PAGE_TYPES) -> Column:
    return first_match(F.lower(p), types, "other")


def priority(p: Column, priorities: dict[str, list[str]] = rules.PRIORITIES) -> Column:
    return first_match(F.lower(p), priorities, "normal")


def priority_score(p: Column, depth: Column, priorities: dict[str, list[str]] = rules.PRIORITIES) -> Column:
    """Queue order: 100, 75, 10 or 50 by priority; minus depth and segments; home and top-level pages up, noise down; 0 at least."""
    level, low = priority(p, priorities), F.lower(p)
    base = F.when(level == "high", 100).when(level == "medium", 75).when(level == "low", 10).otherwise(50)
    segments = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    place = F.when(low.isin("/", ""), 20).when(p.rlike("^/[^/]+/?$"), 10).otherwise(0)
    noise = F.when(low.rlike(r"(page|p)=?\d+"), 20).otherwise(0) + F.when(low.rlike(r"\.(pdf|doc|xls|ppt)"), 10).otherwise(0) + F.when(F.contains(p, F.lit("#")), 15).otherwise(0)
    return F.greatest(F.lit(0), base - depth * 5 - segments * 2 + place - noise)


def product(p: Column, text: Column, products: list[tuple[str, list[str], list[str]]]) -> Column:
    """First product (name, path patterns, terms) whose pattern is in the path or that has two terms in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for name, patterns, terms in reversed(products):
        hit = any_match(F.lower(p), patterns) if patterns else F.lit(False)
        if len(terms) > 1:
            hit = hit | (sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) >= 2)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


# Names that playbooks, settings and flags use.
STRATEGIES = {"http": "requests", "requests": "requests", "request": "requests", "js": "js", "playwright": "js", "stealth": "stealth", "playwright_stealth": "stealth", "visible": "visible", "headed": "visible", "no-headless": "visible", "manual": "visible"}
METHODS = {"request": "requests", "requests": "requests", "http": "requests", "js": "js", "playwright": "js", "stealth": "stealth", "playwright_stealth": "stealth", "visible": "visible", "headed": "visible", "no-headless": "visible"}


def mapped(c: Column, names: dict[str, str], default: str | None) -> Column:
    """Synonym lookup on the trimmed, lower-case value."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.lit(default))


def nav_label(c: Column, strip: list[str] = rules.NAV_STRIP) -> Column:
    out = F.trim(F.lower(c))
    for p in strip:
        out = F.trim(F.regexp_replace(out, p, ""))
    return out


def nav_section(c: Column, synonyms: dict[str, list[str]] = rules.NAV_SYNONYMS) -> Column:
    """Section of a label: its own name, else the first with a synonym that contains the label or is in it."""
    label = nav_label(c)
    out = F.lit(None).cast("string")
    for section, names in reversed(synonyms.items()):
        near = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(label, n) | F.contains(n, label))
        out = F.when(near, F.lit(section)).otherwise(out)
    return F.when(label.isin(list(synonyms)), label).otherwise(out)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a link without its fragment, for absolute, scheme-, root- and document-relative links."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    origin = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(part(base, "PROTOCOL"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .otherwise(F.concat(origin, F.regexp_replace(F.concat(F.when(path(base) == "", "/").otherwise(path(base))), "[^/]*$", ""), h))
    )

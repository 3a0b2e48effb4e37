"""Regex projections of HTML that need no tree: text, anchors, title, assets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import any_match, first_match
from heron.functions.media import LAZY_ATTRIBUTES

#: DuckDB form of visible().
SQL_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


def visible(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; blanks are collapsed. Entities stay as written."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "[ \t\r\n]+", " "))


def word_count(html: Column) -> Column:
    return F.regexp_count(visible(html), F.lit(r"\S+"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def heading(html: Column) -> Column:
    return visible(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))


def anchors(html: Column) -> Column:
    """Array of (href, text) of the links, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*\bhref=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r'(?i)\bhref="([^"]*)"', 1).alias("href"), visible(F.regexp_extract(t, r"(?s)^<[^>]*>(.*)</a>$", 1)).alias("text")))


def attribute(tag: Column, name: str) -> Column:
    """Value of a double- or single-quoted attribute; null if it isn't there."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    other = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 2)
    return F.when(tag.rlike(rf"(?is)\s{name}\s*=\s*[\"']"), F.when(found == "", other).otherwise(found))


def images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))


def lazy_source(tag: Column, attributes: list[str] = LAZY_ATTRIBUTES) -> Column:
    """First lazy-loading attribute that holds a link, else src."""
    links = [F.when(attribute(tag, a).rlike("^(http|/|data:)"), attribute(tag, a)) for a in attributes]
    return F.coalesce(*links, attribute(tag, "src"))


def dimension(value: Column) -> Column:
    """Whole number that an attribute is, else null: a unit makes it none."""
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))


def sides(tag: Column) -> Column:
    """Struct of both sides in pixels, also where they are written with a unit; null unless both are positive."""
    digits = lambda a: F.regexp_replace(attribute(tag, a), r"[^\d]", "").try_cast("long")
    w, h = digits("width"), digits("height")
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def image_kind(src: Column, alt: Column, width: Column, height: Column, kinds: dict[str, list[str]] = rules.IMAGE_KINDS) -> Column:
    """logo, icon, diagram, screenshot, photo (over 200 by 200) or unknown."""
    named = first_match(F.lower(F.concat_ws(" ", src, alt)), kinds, None)
    return F.coalesce(named, F.when((width > 200) & (height > 200), "photo"), F.lit("unknown"))


def decorative(src: Column, alt: Column, width: Column, height: Column) -> Column:
    """Decorates only: by name, or by size where both sides are known and not 0."""
    sized = (width != 0) & (height != 0)
    tiny = sized & (width <= 3) & (height <= 3)
    small = sized & (width <= 50) & (height <= 50) & (F.coalesce(alt, F.lit("")) == "")
    return F.coalesce(any_match(F.lower(F.concat_ws(" ", src, alt)), rules.DECORATIVE), F.lit(False)) | F.coalesce(tiny, F.lit(False)) | F.coalesce(small, F.lit(False))


def asset_kind(alt: Column, region: Column, url: Column) -> Column:
    """logo before hero image, icon, decorative (no alt text) and content image."""
    a, u = F.lower(F.coalesce(alt, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return F.when(F.contains(a, F.lit("logo")) | F.contains(u, F.lit("logo")), "logo").when(region == "hero", "hero_image").when(F.contains(a, F.lit("icon")) | F.contains(u, F.lit("icon")), "icon").when(a == "", "decorative").otherwise("content_image")


DOCUMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")


def link_kind(href: Column, in_nav: Column, site: Column, link_host: Column) -> Column:
    """documents before nav, external and content."""
    return F.when(F.lower(F.regexp_replace(href, r"[?#].*$", "")).rlike(r"\.(" + "|".join(DOCUMENTS) + ")$"), "documents").when(in_nav, "nav").when((link_host != "") & (link_host != site), "external").otherwise("content")


def content_hash(html: Column) -> Column:
    """Start of the SHA-256 of the HTML with blanks collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(html, r"(?U)\s+", " ")), 256), 1, 16)

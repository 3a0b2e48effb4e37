"""Page records as tables: each page is parsed once, in Arrow batches, and one of its records is kept.

A record hangs on the page alone, so this is a projection: nothing is shuffled, and a batch holds
few pages. A null page is an empty one; broken markup gives what can be read of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from heron.functions import media, page
from heron.functions.dom import Dom
from heron.session import ship

#: Pages whose records are held at a time.
PAGES = 64
LINKS = "array<struct<text:string,url:string>>"
PAGE = f"title string, description string, primary_nav {LINKS}, utility_nav {LINKS}, hero string, main array<struct<type:string,content:string,url:string,level:int>>, footer_links {LINKS}, footer_text string, tagged array<struct<block_type:string,content_type:string,content:string,url:string,level:int,note:string>>, full_text string, word_count long"
SECTIONS = "rows array<struct<pos:int,parent:int,kind:string,level:int,text:string,tag:string,words:int,lines:int,chars:int,src:string,alt:string,title:string,width:long,height:long>>"
IMAGES = "images array<struct<src:string,src_resolved:string,alt:string,title:string,width:long,height:long,srcset:string,caption:string,context_heading:string,context_text:string,classification:string,is_lazy:boolean,is_decorative:boolean,source_tag:string>>"
CODES = "codes array<struct<content:string,language:string,confidence:double,is_inline:boolean,is_config:boolean,is_truncated:boolean,context_heading:string,context_text:string,filename_hint:string,line_count:int,char_count:int,source_tag:string>>"
ASSETS = "assets array<struct<url:string,asset_type:string,alt:string,link_text:string,width:long,height:long,srcset:string,poster:string,region:string,context:string,classification:string>>"
MAIN = "text string, link_density double, place string"
PORTALS = "portal_links array<struct<type:string,url:string,text:string>>"
FORMS = "forms array<struct<action:string,method:string,fields:array<struct<name:string,type:string>>,has_password:boolean,purpose:string>>"
SCAN = f"{PORTALS}, {FORMS}, providers array<string>, integrations array<string>, endpoints array<string>, features array<struct<category:string,feature_type:string,confidence:double>>, portal_count int, feature_count int"
HINTS = "hints array<struct<feature:string,subtree:string,priority:string,reason:string,depth_boost:int>>"
NAVIGATION = f"container string, links array<struct<text:string,url:string,children:{LINKS}>>, utility string"


def made(pages: DataFrame, fields: str, make: Callable[[Dom, str, str], dict]) -> DataFrame:
    """page_id and the fields that make(dom, html, url) gives for each page (page_id, url, html)."""
    ship(pages.sparkSession)
    schema = StructType.fromDDL(f"page_id long, {fields}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                rows = [{"page_id": i, **make(Dom(h), h or "", u or "")} for i, u, h in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def records(pages: DataFrame) -> DataFrame:
    return made(pages, PAGE, lambda dom, html, url: page.record(dom, url))


def section_rows(pages: DataFrame) -> DataFrame:
    return made(pages, SECTIONS, lambda dom, html, url: {"rows": page.sections(dom, url)}).select("page_id", F.inline("rows"))


def image_rows(pages: DataFrame, decorative: bool = False) -> DataFrame:
    return made(pages, IMAGES, lambda dom, html, url: {"images": media.images(dom, url, decorative)}).select("page_id", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", "i.*")


def code_rows(pages: DataFrame, inline: bool = False, config: bool = False) -> DataFrame:
    return made(pages, CODES, lambda dom, html, url: {"codes": media.codes(dom, inline, config)}).select("page_id", F.posexplode("codes").alias("pos", "c")).select("page_id", "pos", "c.*")


def asset_rows(pages: DataFrame) -> DataFrame:
    return made(pages, ASSETS, lambda dom, html, url: {"assets": media.assets(dom, url)}).select("page_id", F.posexplode("assets").alias("pos", "a")).select("page_id", "pos", "a.*")


def anchor_counts(pages: DataFrame) -> DataFrame:
    """page_id, n (anchors with a place to go to), words of the page."""
    return made(pages, "n long, words long", lambda dom, html, url: {"n": sum(1 for a in dom.all(("a",)) if dom.attrs[a].get("href")), "words": len(" ".join(dom.strings(dom.body, ("noscript",))).split())})


def main_texts(pages: DataFrame) -> DataFrame:
    return made(pages, MAIN, lambda dom, html, url: page.main_text(dom))


def scans(pages: DataFrame) -> DataFrame:
    return made(pages, SCAN, lambda dom, html, url: page.scan(dom, html, url))


def portal_rows(pages: DataFrame) -> DataFrame:
    """Links to portals alone, as scans gives them."""
    return made(pages, PORTALS, lambda dom, html, url: {"portal_links": page.portal_links(dom, url)}).select("page_id", F.inline("portal_links"))


def form_rows(pages: DataFrame) -> DataFrame:
    """Forms alone, as scans gives them."""
    return made(pages, FORMS, lambda dom, html, url: {"forms": page.forms(dom)}).select("page_id", F.inline("forms"))


def hints(pages: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    def make(dom: Dom, html: str, url: str) -> dict:
        links = [{"url": page.resolved(url, dom.attrs[a]["href"]), "text": dom.clean(a)} for a in dom.all(("a",)) if "href" in dom.attrs[a]]
        return {"hints": page.hints(links, dom.clean(dom.body), wanted=wanted)}

    return made(pages, HINTS, make).select("page_id", F.posexplode("hints").alias("pos", "h")).select("page_id", "pos", "h.*")


def navigation(pages: DataFrame) -> DataFrame:
    """The primary container with its links and submenus, and the utility container, by tag name."""

    def make(dom: Dom, html: str, url: str) -> dict:
        nav, other = page.nav_container(dom), page.utility_container(dom)
        return {"container": dom.tag[nav] if nav is not None else None, "links": page.nav_links(dom, nav, url) if nav is not None else [], "utility": dom.tag[other] if other is not None else None}

    return made(pages, NAVIGATION, make)

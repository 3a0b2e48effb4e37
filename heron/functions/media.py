"""Images and code of a page, with where they stand and what they are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from heron import rules
from heron.functions.dom import Dom
from heron.functions.markup import LANGUAGES
from heron.functions.page import path_of, resolved, whole

# Attributes, patterns and names that results depend on.
LAZY_ATTRIBUTES = ["data-src", "data-lazy", "data-original", "data-srcset", "data-lazy-src", "data-bg", "data-background", "loading"]
CARDS = [("og:image", "og:image"), ("og:image:url", "og:image"), ("twitter:image", "twitter:image"), ("twitter:image:src", "twitter:image")]
BACKGROUND = r"background(?:-image)?\s*:\s*url\(['\"]?([^'\")]+)['\"]?\)"
LANGUAGE_CLASSES = [(r"language-(\w+)", 1.0), (r"lang-(\w+)", 1.0), (r"highlight-source-(\w+)", 1.0), (r"(\w+)-code", 0.9), (r"hljs\s+(\w+)", 0.9), (r"prism-(\w+)", 0.9), (r"brush:\s*(\w+)", 0.8), (r"syntax-(\w+)", 0.8), (r"code-(\w+)", 0.7)]
LANGUAGE_ATTRIBUTES = ["data-language", "data-lang", "data-code-language", "data-highlight", "data-syntax"]
ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "bash", "shell": "bash", "zsh": "bash", "yml": "yaml",
    "dockerfile": "docker", "objc": "objective-c", "c++": "cpp", "c#": "csharp", "f#": "fsharp", "golang": "go", "rs": "rust", "kt": "kotlin",
    "md": "markdown", "tex": "latex", "plaintext": "text", "plain": "text", "none": "text",
}
FILE_ATTRIBUTES = ["data-filename", "data-file", "data-path"]
HIGHLIGHTERS = ["highlight", "syntax", "code-block", "sourceCode", "blob-code", "CodeMirror", "ace_editor"]
TRUNCATED = r"\.\.\.$|…$|# \.\.\.|// \.\.\."
LINE_NUMBER = r"^\s*\d+[\s:]+"
DOCUMENTS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".csv", ".zip", ".rar", ".7z"]
VIDEOS = [".mp4", ".webm", ".mov", ".avi", ".mkv", ".m4v"]
DATA_SCRIPTS = ["application/json", "application/ld+json", "text/template"]


def image_class(src: str, alt: str | None, width: int | None, height: int | None) -> tuple[str, bool]:
    """What an image is, and whether it only decorates: by name, or by size where both sides are known."""
    said = f"{src.lower()} {(alt or '').lower()}"
    sized = bool(width and height)
    decorates = any(p in said for p in rules.DECORATIVE) or (sized and (max(width, height) <= 3 or (max(width, height) <= 50 and not alt)))
    kind = next((k for k, names in rules.IMAGE_KINDS.items() if any(n in said for n in names)), None)
    return kind or ("photo" if sized and min(width, height) > 200 else "unknown"), decorates


def lazy_source(held: dict[str, str]) -> str | None:
    return next((held[a] for a in LAZY_ATTRIBUTES if held.get(a, "").startswith(("http", "/", "data:"))), None)


def caption(dom: Dom, i: int) -> str | None:
    """Caption of the nearest figure that has one."""
    figures = (a for a in dom.up(i) if dom.tag[a] == "figure")
    return next((dom.joined(c) for f in figures if (c := dom.first(("figcaption",), f)) is not None), None)


def said_near(dom: Dom, i: int, longest: int = 200, least: int = 20, most: int = 2) -> str | None:
    """Caption, else the first paragraph of some length among the nearest ones before, then after."""
    if (found := caption(dom, i)) is not None:
        return found[:longest]
    for near in (dom.before(i, ("p",)), dom.after(i, ("p",))):
        for _, p in zip(range(most), near, strict=False):
            if len(t := dom.joined(p)) > least:
                return t[:longest]
    return None


def _image(dom: Dom, i: int, src: str, base: str, tag: str, **fields) -> dict:
    done = src.startswith(("http://", "https://", "data:"))
    none = {"alt": None, "title": None, "width": None, "height": None, "srcset": None, "caption": None, "context_heading": None, "context_text": None, "classification": "unknown", "is_lazy": False, "is_decorative": False}
    return none | {"src": src, "src_resolved": src if done else resolved(base, src), "source_tag": tag} | fields


def _picture(dom: Dom, i: int, around: int, src: str, base: str, tag: str) -> dict:
    held = dom.attrs[i]
    width, height = whole(held.get("width")), whole(held.get("height"))
    kind, decorates = image_class(src, held.get("alt"), width, height)
    return _image(dom, i, src, base, tag, alt=held.get("alt"), title=held.get("title"), width=width, height=height, srcset=held.get("srcset"), caption=caption(dom, around), context_heading=dom.heading_near(around), context_text=said_near(dom, around), classification=kind, is_lazy=lazy_source(held) is not None, is_decorative=decorates)


def _images(dom: Dom, base: str) -> Iterator[dict]:
    for i in dom.all(("img",)):
        src = lazy_source(dom.attrs[i]) or dom.attrs[i].get("src", "")
        if src and not src.startswith("data:image/gif"):
            yield _picture(dom, i, i, src, base, "img")
    for p in dom.all(("picture",)):
        if (i := dom.first(("img",), p)) is None:
            continue
        source = dom.first(("source",), p)
        listed = dom.attrs[source].get("srcset", "").split(",")[0].split() if source is not None else []
        if src := lazy_source(dom.attrs[i]) or dom.attrs[i].get("src") or (listed[0] if listed else ""):
            yield _picture(dom, i, p, src, base, "picture")
    for name, tag in CARDS:
        exact = re.compile(f"^{re.escape(name)}$")
        meta = dom.first(("meta",), property_=exact)
        meta = dom.first(("meta",), name_=exact) if meta is None else meta
        if meta is not None and (src := dom.attrs[meta].get("content")):
            yield _image(dom, meta, src, base, tag, classification="photo")
    for i in dom.all():
        for src in re.findall(BACKGROUND, dom.attrs[i].get("style", ""), re.I):
            if not src.startswith("data:"):
                yield _image(dom, i, src, base, "background", context_heading=dom.heading_near(i), context_text=said_near(dom, i))


def images(dom: Dom, base: str, decorative: bool = False) -> list[dict]:
    """Images by img, picture, card and background, each address once; without those that only decorate, if not asked for."""
    once = {}
    for image in _images(dom, base):
        once.setdefault(image["src_resolved"], image)
    return [x for x in once.values() if decorative or not x["is_decorative"]]


def language_name(raw: str | None) -> str | None:
    low = (raw or "").lower().strip()
    return ALIASES.get(low, low) if raw else None


def language_of(dom: Dom, i: int, code: str) -> tuple[str | None, float]:
    """By data attribute, by class of the element and the two above it, else by what the code looks like."""
    for a in LANGUAGE_ATTRIBUTES:
        if value := dom.attrs[i].get(a):
            return language_name(value), 1.0
    for k in [i, *list(dom.up(i))[:2]]:
        for pattern, sure in LANGUAGE_CLASSES:
            if m := re.search(pattern, dom.attrs[k].get("class", ""), re.I):
                return language_name(m[1]), sure
    if len(code) < 10:
        return None, 0.0
    found = [(sure, name) for pattern, name, sure in LANGUAGES if re.search(pattern, code, re.M | re.I)]
    top = max((s for s, _ in found), default=0.0)
    return next(((name, s) for s, name in found if s == top), (None, 0.0))


def cleaned(code: str) -> tuple[str, bool]:
    """Code without leading line numbers, unless that takes over half of it, and whether it ends in an ellipsis."""
    bare = "\n".join(re.sub(LINE_NUMBER, "", line) for line in code.split("\n"))
    return (code if len(bare) * 2 < len(code) else bare).strip(), re.search(TRUNCATED, code.strip()) is not None


def file_name(dom: Dom, i: int) -> str | None:
    for k in (i, dom.parent[i]):
        if k > 0 and (named := next((dom.attrs[k][a] for a in FILE_ATTRIBUTES if dom.attrs[k].get(a)), None)):
            return named
    before = dom.previous_sibling(i)
    text = dom.joined(before) if before is not None and dom.tag[before] in ("div", "span", "p") else ""
    return text if len(text) < 50 and re.match(r"^[\w./\\-]+\.\w+$", text) else None


def explained(dom: Dom, i: int, longest: int = 300, least: int = 30, most: int = 3) -> str | None:
    near = zip(range(most), dom.before(i, ("p",)), strict=False)
    return next((t[:longest] for _, p in near if len(t := dom.joined(p)) > least), None)


def _code(dom: Dom, i: int, named: int, raw: str, tag: str, inline: bool = False) -> dict:
    code, cut = cleaned(raw)
    language, sure = language_of(dom, named, code)
    return {
        "content": code, "language": language, "confidence": sure, "is_inline": inline, "is_config": False, "is_truncated": cut, "context_heading": None if inline else dom.heading_near(i),
        "context_text": None if inline else explained(dom, i), "filename_hint": file_name(dom, i), "line_count": code.count("\n") + 1, "char_count": len(code), "source_tag": tag,
    }


def inline_code(dom: Dom, i: int) -> bool:
    """A short line in the text."""
    style = dom.attrs[i].get("style", "")
    return "display: block" not in style and "display:block" not in style and "\n" not in dom.text(i) and len(dom.text(i)) < 100


def _codes(dom: Dom) -> Iterator[dict]:
    for i in dom.all(("pre",)):
        inner = dom.first(("code",), i)
        named = i if inner is None else inner
        if dom.text(named).strip():
            yield _code(dom, i, named, dom.text(named), "pre")
    for i in dom.all(("code",)):
        raw, inline = dom.text(i), inline_code(dom, i)
        if dom.inside(i, ("pre",)) is None and raw.strip() and not (inline and len(raw) < 5):
            yield _code(dom, i, i, raw, "code", inline)
    for name in HIGHLIGHTERS:
        pattern = re.compile(name, re.I)
        for i in dom.all():
            if dom.tag[i] in ("pre", "code") or not dom.has(i, "class", pattern) or dom.inside(i, ("pre", "code")) is not None or dom.first(("pre", "code"), i) is not None:
                continue
            raw = dom.text(i)
            if raw.strip() and len(raw) >= 10:
                yield _code(dom, i, i, raw, "highlight")


def _data(dom: Dom) -> Iterator[dict]:
    for i in dom.all(("script",)):
        kind = dom.attrs[i].get("type", "")
        content = "".join(dom.pieces[dom.begins[i] : dom.ends[i]]).strip()
        if kind in DATA_SCRIPTS and content:
            none = {"is_inline": False, "is_truncated": False, "context_heading": None, "context_text": None, "filename_hint": None}
            yield none | {"content": content, "language": "json" if "json" in kind else "html", "confidence": 1.0, "is_config": True, "line_count": content.count("\n") + 1, "char_count": len(content), "source_tag": "script"}


def codes(dom: Dom, inline: bool = False, config: bool = False, least: int = 20) -> list[dict]:
    """Code blocks, each content once; inline code and data scripts if asked for."""
    sources: list[Callable[[Dom], Iterator[dict]]] = [_codes, _data] if config else [_codes]
    once = {}
    for block in (b for s in sources for b in s(dom)):
        if (inline or not block["is_inline"]) and block["char_count"] >= least:
            once.setdefault(block["content"], block)
    return list(once.values())


REGIONS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "sidebar", "main": "main"}
HERO = re.compile("hero|banner|jumbotron", re.I)


def region(dom: Dom, i: int) -> str:
    """The nearest container that says where an element stands."""
    for a in dom.up(i):
        if dom.tag[a] in ("section", "article", "div") and dom.has(a, "class", HERO):
            return "hero"
        if dom.tag[a] in REGIONS:
            return REGIONS[dom.tag[a]]
    return "main"


def asset_class(alt: str | None, where: str, url: str) -> str:
    """What an image is for: logo before hero image, icon, decoration (no text) and content."""
    said = f"{(alt or '').lower()} {url.lower()}"
    if "logo" in said:
        return "logo"
    if where == "hero":
        return "hero_image"
    return "icon" if "icon" in said else "content_image" if alt else "decorative"


def sides(held: dict[str, str]) -> tuple[int | None, int | None]:
    """Both sides in pixels, also where they are written with a unit; none unless both are there."""
    width, height = (int(re.sub(r"\D", "", held.get(k, "")) or 0) for k in ("width", "height"))
    return (width, height) if width and height else (None, None)


def _assets(dom: Dom) -> Iterator[tuple[int, str, str | None, dict]]:
    for i in dom.all(("img",)):
        held = dom.attrs[i]
        width, height = sides(held)
        yield i, "image", held.get("src") or held.get("data-src") or held.get("data-lazy"), {"alt": held.get("alt"), "srcset": held.get("srcset"), "width": width, "height": height}
    for p in dom.all(("picture",)):
        for i in dom.all(("source",), p):
            listed = dom.attrs[i].get("srcset", "").split(",")[0].split()
            yield i, "image", listed[0] if listed else None, {}
    for kind in ("video", "audio"):
        for v in dom.all((kind,)):
            for i in (v, *dom.all(("source",), v)):
                yield i, kind, dom.attrs[i].get("src"), {"poster": dom.attrs[v].get("poster")} if kind == "video" else {}
    for kind, endings in (("document", DOCUMENTS), ("video", VIDEOS)):
        for i in dom.all(("a",)):
            href = dom.attrs[i].get("href", "")
            if path_of(href).lower().endswith(tuple(endings)):
                yield i, kind, href, {"link_text": dom.joined(i) or None}


def assets(dom: Dom, base: str) -> list[dict]:
    """Images, videos, audio and documents of a page, each address once, with where they stand and what is said around them."""
    once: dict[str, dict] = {}
    for i, kind, src, fields in _assets(dom):
        if not src or src.startswith("data:"):
            continue
        url, where = resolved(base, src), region(dom, i)
        none = {"alt": None, "link_text": None, "width": None, "height": None, "srcset": None, "poster": None}
        around = dom.joined(dom.parent[i], " ")[:200] if dom.parent[i] >= 0 else ""
        once.setdefault(url, none | {"url": url, "asset_type": kind, "region": where, "context": around, "classification": asset_class(fields.get("alt"), where, url) if kind == "image" else kind} | fields)
    return list(once.values())

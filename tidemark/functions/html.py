"""HTML made inert, sanitized by an allow-list, and reduced to its main text, in Arrow batches over html.parser."""

from __future__ import annotations

import html
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

# Tags that may stay, tags that go with all that they hold, and tags without an end tag.
HTML_TAGS = set(
    "p div article section main header footer h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code em strong b i u s br hr a img figure figcaption table thead tbody tr th td span sup sub".split()
)
SVG_TAGS = set("svg g path circle ellipse line polyline polygon rect text tspan title desc".split())
MATH_TAGS = set(
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mpadded mspace mphantom mfenced menclose mmultiscripts mprescripts none semantics annotation".split()
)
DROPPED = set("script style noscript template iframe frame object embed form input button textarea select meta link base foreignobject animate animatemotion animatetransform set use".split())
VOID = set("area base br col embed frame hr img input link meta source track wbr".split())
# Attributes that may stay, by kind of tag.
SVG_ATTRIBUTES = set("viewbox preserveaspectratio width height x y x1 y1 x2 y2 cx cy r rx ry d points fill stroke stroke-width stroke-linecap stroke-linejoin opacity transform role aria-label".split())
MATH_ATTRIBUTES = set("display mathvariant mathsize mathcolor columnalign rowalign encoding accent accentunder align columnspacing columnlines columnwidth rowspacing rowlines linethickness stretchy symmetric largeop movablelimits form fence separator".split())
LAZY = ("data-src", "data-original", "data-lazy-src", "data-actualsrc", "src")
#: Values that could run or load something, in any attribute.
_ACTIVE = re.compile(r"javascript:|url\(|[\x00-\x08\x0a-\x1f]", re.IGNORECASE)
_PRIVATE = re.compile(r"(0|10|127)(\.\d+){3}|169\.254(\.\d+){2}|192\.168(\.\d+){2}|172\.(1[6-9]|2\d|3[01])(\.\d+){2}")


def safe_url(value: str | None, base: str | None, image: bool = False) -> str | None:
    """The absolute address of a link (http, https, mailto) or an image (https without user, to a public host; or image data)."""
    value = (value or "").strip()
    if not value or value.startswith("//") or _ACTIVE.search(value):
        return None
    if image and value.lower().startswith("data:image/"):
        return value
    try:
        whole = urljoin(base or "", value)
        parts = urlsplit(whole)
        host = (parts.hostname or "").lower()
    except ValueError:
        return None
    if not image:
        return whole if parts.scheme in ("http", "https", "mailto") or not parts.scheme else None
    local = host in ("", "localhost") or host.endswith((".localhost", ".local")) or _PRIVATE.fullmatch(host)
    return whole if parts.scheme == "https" and not local and parts.username is None and parts.password is None else None


def best_source(srcset: str) -> str | None:
    """The widest candidate of a srcset."""
    found = []
    for part in srcset.split(","):
        bits = part.split()
        if bits:
            size = bits[1][:-1] if len(bits) > 1 else "1"
            found.append((float(size) if size.replace(".", "", 1).isdigit() else 0.0, bits[0]))
    return max(found)[1] if found else None


class _Ends(HTMLParser):
    """Counts the end tags that the parser comes to, so none in comments, scripts or attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = Counter()

    def handle_endtag(self, tag):
        self.found[tag] += 1


def end_tags(source: str) -> Counter:
    parser = _Ends()
    parser.feed(source)
    parser.close()
    return parser.found


class _Sanitizer(HTMLParser):
    def __init__(self, base: str | None, ends: Counter):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.text, self.title, self.skip, self.open, self.in_title = base, [], [], [], [], [], False
        self.ends = ends  # end tags to come: a dropped tag that is never closed hides nothing but itself

    def handle_starttag(self, tag, attrs):
        own = {k: v for k, v in attrs if v is not None}
        if tag == "script" and own.get("type", "").startswith("math/tex"):
            self.skip.append("math-display" if "display" in own["type"] else "math-inline")
            return
        if tag in DROPPED:
            if tag not in VOID and (tag in ("script", "style") or self.ends[tag] > self.skip.count(tag)):
                self.skip.append(tag)
            return
        if tag == "title" and "svg" not in self.open:
            self.in_title = True
            return
        if self.skip or tag not in HTML_TAGS | SVG_TAGS | MATH_TAGS:
            return
        self.open.append(tag)
        allowed = SVG_ATTRIBUTES if tag in SVG_TAGS else MATH_ATTRIBUTES if tag in MATH_TAGS else {"a": {"title"}, "img": {"alt", "title", "width", "height"}}.get(tag, set())
        kept = [(k, v) for k, v in own.items() if k in allowed and v and not _ACTIVE.search(v)]
        if tag == "img":
            source = next((own[k] for k in LAZY if own.get(k, "").strip()), None) or best_source(own.get("data-srcset") or own.get("srcset") or "")
            if url := safe_url(source, self.base, image=True):
                kept.insert(0, ("src", url))
            for part in own.get("style", "").split(";"):
                name, _, value = (x.strip() for x in part.partition(":"))
                if name in ("width", "height") and name not in own and re.fullmatch(r"\d+(\.\d+)?(px|%)?", value):
                    kept.append((name, value.removesuffix("px")))
        elif tag == "a" and (url := safe_url(own.get("href"), self.base)):
            kept.insert(0, ("href", url))
        self.out.append(f"<{tag}{''.join(f' {k}={html.escape(v, quote=True).join([chr(34)] * 2)}' for k, v in kept)}>")
        self.text.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in DROPPED:
            self.handle_endtag(tag)
            return
        self.ends[tag] -= 1
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_endtag(self, tag):
        self.ends[tag] -= 1
        if tag == "title" and self.in_title:
            self.in_title = False
            return
        if self.skip:
            if self.skip[-1] == tag or (tag == "script" and self.skip[-1].startswith("math-")):
                self.skip.pop()
            return
        if tag in HTML_TAGS | SVG_TAGS | MATH_TAGS and tag not in VOID:
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag)]
            self.out.append(f"</{tag}>")
            self.text.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
            return
        if self.skip and self.skip[-1].startswith("math-"):
            data = f"\\[{data}\\]" if self.skip[-1] == "math-display" else f"\\({data}\\)"
        elif self.skip:
            return
        self.out.append(html.escape(data, quote=False))
        self.text.append(data)


def sanitize(source: str | None, base: str | None = None) -> tuple[str, str, str]:
    """(title, sanitized HTML, plain text). Never runs or keeps anything active; TeX scripts become text delimiters."""
    parser = _Sanitizer(base, end_tags(source or ""))
    parser.feed(source or "")
    parser.close()
    return " ".join("".join(parser.title).split()), "".join(parser.out), " ".join("".join(parser.text).split())


def readable(source: str | None, base: str | None = None) -> str:
    """Plain text of the first article or main element, else of the whole page."""
    low = (source or "").lower()
    for tag in ("article", "main"):
        start, end = low.find(f"<{tag}"), low.rfind(f"</{tag}>")
        if 0 <= start < end:
            return sanitize((source or "")[start:end], base)[2]
    return sanitize(source, base)[2]


def sanitized_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, sanitized_html, plain_text, readable_text of (page_id, url, html)."""

    def run(batches):
        for b in batches:
            found = [sanitize(h, u) for h, u in zip(b["html"], b["url"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "title": [x[0] for x in found], "sanitized_html": [x[1] for x in found], "plain_text": [x[2] for x in found], "readable_text": [readable(h, u) for h, u in zip(b["html"], b["url"], strict=True)]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, sanitized_html string, plain_text string, readable_text string")

"""HTML columns: what a page says, read once from its markup as it stands.

A page is one left-to-right scan over its tags. Attributes follow the HTML rules for values in double, single or no quotes, so a value
may hold ``>`` or what looks like another attribute, and attributes need no blank between them; of one name the first counts. All
named and numeric entities that end in ``;`` are decoded (numbers also without it). Comments, scripts, styles and templates
are no text. Markup that is not closed ends with the page, a heading also with the next one. Nothing raises: a page that is cut off
anywhere gives what stands before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .batches import sliced

_LIST = pa.list_(pa.string())
#: What is read of a page.
_FIELDS = [
    ("title", pa.string()), ("description", pa.string()), ("robots", pa.string()), ("canonical", pa.string()),
    ("alternates", pa.list_(pa.struct([("hreflang", pa.string()), ("href", pa.string())]))), ("h1", _LIST), ("h2", _LIST), ("h3", _LIST), ("hrefs", _LIST),
    ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))), ("json_ld", _LIST), ("body_text", pa.string()),
]
PAGE = from_arrow_schema(pa.schema(_FIELDS))

_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?"""
_MARKUP = re.compile(rf"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[\s/]*+{_ATTRIBUTE})*+)[\s/]*+>?|<[!?/][^>]*+>?""")
_PAIR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*+))?)?""")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[a-zA-Z][a-zA-Z0-9]*;)")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "title", "textarea", "template")}
_TAG = re.compile("<[^>]*>")


def decoded(text: str) -> str:
    return _ENTITY.sub(lambda m: unescape(m[0]), text) if "&" in text else text


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _PAIR.findall(raw):
        found.setdefault(name.lower(), decoded(double or single or bare).strip())
    return found


def _blanks(text: str) -> str:
    return " ".join(text.split())


def read_page(html: str) -> dict:
    """The fields of ``PAGE`` of one page."""
    page: dict = {name: [] for name, kind in _FIELDS if pa.types.is_list(kind)}
    page |= dict.fromkeys(("title", "canonical"))
    page["description"] = page["robots"] = ""
    parts: list[str] = []  # all text so far
    heading, since, at, end = "", 0, 0, len(html)
    unclosed: set[str] = set()

    def close() -> None:
        if heading and (text := _blanks(" ".join(parts[since:]))):
            page[heading].append(text)

    while at < end:
        m = _MARKUP.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(decoded(html[at:stop]))
        if not m:
            break
        at = m.end()
        closing, opening, raw = m.groups()
        if closing and closing.lower() in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close()
            heading = ""
        if not opening:
            continue
        name = opening.lower()
        if name in _RAW:
            over = None if name in unclosed else _RAW[name].search(html, at)
            if not over:
                unclosed.add(name)  # so that the rest is not searched again
            to = over.start() if over else end
            if name == "title" and not over:  # an open title ends with the next tag
                to = found if (found := html.find("<", at)) >= 0 else end
            inside, at = html[at:to], to
            if name == "title" and page["title"] is None:
                page["title"] = _blanks(decoded(_TAG.sub(" ", inside)))
            elif name == "textarea":
                parts.append(decoded(inside))
            elif name == "script" and _attributes(raw).get("type", "").lower() == "application/ld+json":
                page["json_ld"].append(inside)
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close()
            heading, since = name if name < "h4" else "", len(parts)
        elif name == "a":
            if (href := _attributes(raw).get("href")) is not None:
                page["hrefs"].append(href)
        elif name == "img":
            a = _attributes(raw)
            if src := a.get("src") or a.get("data-src"):
                page["images"].append({"src": src, "alt": a.get("alt", "")})
        elif name == "meta":
            a = _attributes(raw)
            if (what := a.get("name", "").lower()) in ("description", "robots"):
                page[what] = a.get("content", "")
        elif name == "link":
            a = _attributes(raw)
            rel = a.get("rel", "").lower()
            if "canonical" in rel and page["canonical"] is None:
                page["canonical"] = a.get("href", "")
            if "alternate" in rel and a.get("hreflang"):
                page["alternates"].append({"hreflang": a["hreflang"], "href": a.get("href", "")})
    close()
    page["robots"] = page["robots"].lower()
    page["title"] = page["title"] or ""
    page["body_text"] = _blanks(" ".join(parts))
    return page


def _read(texts: list[str | None]) -> pa.Array:
    pages = [read_page(h or "") for h in texts]
    return pa.StructArray.from_arrays([pa.array([p[n] for p in pages], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


@F.arrow_udf(PAGE)
def parsed(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fields of ``PAGE``; a null page is an empty one. Pages go out by slices, so no more than one slice of them is held."""
    for batch in html:
        yield from sliced(batch, _read)


def json_objects(scripts: Column) -> Column:
    """The objects of JSON scripts as JSON texts; a list gives its elements, what is no JSON gives nothing."""
    raw = F.transform(scripts, lambda s: F.try_parse_json(s))
    one = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.transform(F.flatten(F.transform(F.filter(raw, lambda v: v.isNotNull()), one)), lambda v: F.to_json(v))

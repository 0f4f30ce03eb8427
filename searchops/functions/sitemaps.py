"""Sitemap files as sites serve them: cut off, with bare ampersands, or an HTML error page in their place.

The scan keeps a stack of open elements and never raises. It recovers as lenient XML readers do: an end tag closes the element that
is open, whatever its name; what is open at the end is closed there; what follows the root is not read; an ampersand that starts no
known entity goes together with the name behind it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .batches import sliced

_FIELDS = [("is_index", pa.bool_()), ("locs", pa.list_(pa.string()))]
_TOKEN = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>(?s:.*?))(?:\]\]>|\Z)|<[?!][^>]*+>?|</[^>]*+>?|<(?P<name>[^\s/<>]++)(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?P<end>>?)|(?P<text>[^<]++)|<""")
_REFERENCE = re.compile(r"&(#[0-9]{1,7};|#x[0-9a-fA-F]{1,6};|(?:lt|gt|amp|quot|apos);|[\w.:-]*;?)")
_KNOWN = re.compile(r"#.*|(?:lt|gt|amp|quot|apos);")


def _decoded(text: str) -> str:
    return _REFERENCE.sub(lambda m: unescape(m[0]) if _KNOWN.fullmatch(m[1]) else "", text) if "&" in text else text


def read_sitemap(xml: str) -> tuple[bool, list[str]]:
    """Whether the file is an index, and the ``loc`` texts right under its ``sitemap`` (of an index) or ``url`` elements."""
    found: dict[str, list[str]] = {"url": [], "sitemap": []}
    stack: list[str] = []
    parts: list[str] | None = None
    index = started = False

    def pop() -> None:
        nonlocal parts
        if stack.pop() == "loc" and parts is not None and stack and stack[-1] in found:
            found[stack[-1]].append("".join(parts))
            parts = None

    for m in _TOKEN.finditer(xml):
        token = m[0]
        if m["name"]:
            name = m["name"].rpartition(":")[2]
            if name == "loc" and stack and stack[-1] in found:
                parts = []
            index |= name == "sitemapindex"
            started = True
            stack.append(name)
            if token.endswith("/>"):
                pop()
        elif token.startswith("</"):
            if stack:
                pop()
        elif parts is not None and (m["text"] or m["cdata"]):
            parts.append((_decoded(m["text"]) if m["text"] else m["cdata"]).strip())
        if started and not stack:
            break
    while stack:
        pop()
    return index, found["sitemap" if index else "url"]


def _read(files: list[str | None]) -> pa.Array:
    rows = [read_sitemap(x or "") for x in files]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


@F.arrow_udf(from_arrow_schema(pa.schema(_FIELDS)))
def sitemap(xml: pa.Array) -> pa.Array:
    """is_index and locs of a file; a null file has none."""
    return pa.concat_arrays(list(sliced(xml, _read)))

"""Text columns: keyword normal form and tokens, redaction, token estimates."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no topic.
STOP_WORDS = ("the", "a", "an", "of", "for", "to", "in", "on", "and", "or")
#: Credential formats, and what replaces them.
CREDENTIALS = (
    r"sk-[A-Za-z0-9_-]{16,}",
    r"sk-ant-[A-Za-z0-9_-]{16,}",
    r"AIza[0-9A-Za-z_-]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"napi_[a-z0-9]{20,}",
    r"npg_[A-Za-z0-9]{12,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
)
#: The format that runs over lines; it stands apart as the SQL twins read CREDENTIALS.
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
PLACEHOLDER = "«REDACTED»"
#: Shorter known values are not taken as secrets.
LEAST_SECRET = 8


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


@F.arrow_udf(StringType())
def folded(term: pa.Array) -> pa.Array:
    """NFKC and case folding."""
    return pa.array([t and unicodedata.normalize("NFKC", t).casefold() for t in term.to_pylist()], pa.string())


def keyword(term: Column) -> Column:
    """Folded case, all but letters and digits of any script as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(term), r"[^\p{L}\p{N}_ '-]", " "), " +", " "))


def singular(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & w.rlike("(s|x|z|ch|sh)es$"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def tokens(term: Column) -> Column:
    """Sorted set of singular words of two letters or more, without stop words."""
    words = F.filter(F.split(keyword(term), " "), lambda w: F.length(w) >= 2)
    return F.array_sort(F.array_except(F.array_distinct(F.transform(words, singular)), F.array(*map(F.lit, STOP_WORDS))))


def redact(text: Column, known: list[str] | Column = ()) -> Column:
    """The text without known secrets (a list, or an array column) and without credentials of the known formats."""
    if isinstance(known, Column):
        text = F.aggregate(F.coalesce(known, F.array().cast("array<string>")), text, lambda t, s: F.when(F.length(s) >= LEAST_SECRET, F.replace(t, s, F.lit(PLACEHOLDER))).otherwise(t))
    else:
        for secret in known:
            if len(secret) >= LEAST_SECRET:
                text = F.replace(text, F.lit(secret), F.lit(PLACEHOLDER))
    for pattern in (*CREDENTIALS, PRIVATE_KEY):
        text = F.regexp_replace(text, pattern, PLACEHOLDER)
    return text


def is_clean(text: Column, known: Column) -> Column:
    """Whether no known secret is left; the gate in front of any text that leaves."""
    return ~F.exists(known, lambda s: (F.length(s) >= LEAST_SECRET) & text.contains(s))


def has_credential(text: Column) -> Column:
    return text.rlike("|".join((*CREDENTIALS, PRIVATE_KEY)))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a substring."""
    n = F.length(word)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / n).cast("int")).otherwise(0)


def slug(text: Column) -> Column:
    """Lower-cased words joined by hyphens, 120 characters; "cluster" for no words."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(F.trim(F.lower(text)), r"\s+", "-"), F.lit(120)), F.lit("")), F.lit("cluster"))


def json_object(text: Column) -> Column:
    """From the first "{" to the last "}", if that is a JSON object; else null."""
    cut = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((cut != "") & F.try_parse_json(cut).isNotNull(), cut)


#: What a field of an object may be, and what the type of such a JSON value begins with.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def rejection(text: Column, fields: dict[str, str]) -> Column:
    """Why the object cut from a text is not one of these fields: null if it is, "no object", or what is wrong by field.

    fields has a kind for each name; with "?" behind it the field may be left out or null. Other fields may be there.
    """
    cut = json_object(text)
    value = F.try_parse_json(cut)
    wrong = []
    for name, kind in fields.items():
        got = F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant")), F.lit("VOID"))
        right = got.rlike("^(" + "|".join(KINDS[kind.rstrip("?")]) + ")")
        absent = F.lit(None).cast("string") if kind.endswith("?") else F.lit(f"{name}: missing")
        wrong.append(F.when(got == "VOID", absent).when(~right, F.lit(f"{name}: not {kind.rstrip('?')}")))
    return F.when(cut.isNull(), "no object").otherwise(F.nullif(F.concat_ws(", ", *wrong), F.lit("")))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")

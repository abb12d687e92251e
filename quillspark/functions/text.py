"""String and array expressions on Columns, built-in functions wherever Spark has them."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line ends that flatten to a space, and those that JSON lines escape.
NEWLINES = r"[\n\r\x{85}\x{2028}\x{2029}]"
UNICODE_NEWLINES = r"[\x{85}\x{2028}\x{2029}]"
#: Fixed value: two characters that only appear where UTF-8 was read as Latin-1.
MOJIBAKE = r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]|[\x{80}-\x{9F}]"


def tokens(text: Column) -> Column:
    """Distinct-preserving word array: runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def flatten_newlines(text: Column) -> Column:
    return F.regexp_replace(text, NEWLINES, " ")


def escape_newlines(text: Column) -> Column:
    """Line ends that JSON leaves as they are, as the two characters backslash and n."""
    return F.regexp_replace(text, UNICODE_NEWLINES, r"\\n")


def demojibake(text: Column) -> Column:
    """Undo UTF-8 that was decoded as Latin-1; text that doesn't come out valid stays."""
    suspect = text.rlike(MOJIBAKE) & text.rlike(r"^[\x00-\xFF]*$")
    fixed = F.try_validate_utf8(F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", ""), "ISO-8859-1").cast("string"))
    return F.when(suspect, F.coalesce(fixed, text)).otherwise(text)


def blank_to_null(text: Column) -> Column:
    """Non-breaking spaces become spaces, ends are trimmed, and nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\x{A0}", " ")), F.lit(""))


def meaningful(token: Column, min_length: int) -> Column:
    """Long enough, or a single character outside the Latin script."""
    return (F.length(token) >= min_length) | ((F.length(token) == 1) & ~token.rlike(r"^\p{IsLatin}$"))


def author_terms(authors: Column, min_length: int = 2, cap: int = 25) -> Column:
    """Search terms of an author list: letter runs worth searching, once each, at most ``cap``."""
    name = lambda a: F.array_join(F.filter(F.regexp_extract_all(a, F.lit(r"\p{L}+"), F.lit(0)), lambda t: meaningful(t, min_length)), " ")
    return F.slice(F.array_distinct(F.filter(F.transform(authors, name), lambda a: a != "")), 1, cap)


def camel_to_snake(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?<!^)(?=[A-Z])", "_"))


def page_range(first: Column, last: Column) -> Column:
    return F.when((F.length(first) > 0) & (F.length(last) > 0), F.concat(first, F.lit("-"), last))


def year_or(year: Column, date: Column, prior: Column) -> Column:
    """Year, else the date's year, else the prior value; 0 counts as absent."""
    return F.coalesce(F.nullif(year, F.lit(0)), F.year(date), prior)


def year_decay(year: Column, origin: Column, offset: float = 1, scale: float = 9, decay: float = 0.5, weight: float = 0.1) -> Column:
    """Factor of 1 to 1 + weight that halves its bonus every ``scale`` years beyond ``offset``; no bonus without both years."""
    from math import log

    away = F.greatest(F.lit(0.0), F.abs(year - origin).cast("double") - offset)
    return F.when(year.isNotNull() & origin.isNotNull(), 1 + weight * F.exp(log(decay) / scale * away)).otherwise(1.0)


def qualified_label(scheme: Column, label: Column) -> Column:
    return F.concat_ws("/", scheme, label)


def split_authors(text: Column) -> Column:
    """``A; B; C`` to structs of name and position; one author alone is the first."""
    names = F.filter(F.transform(F.split(text, ";"), lambda n: F.trim(n)), lambda n: n != "")
    place = lambda i, n: F.when(i == 0, "first").when(i == n - 1, "last").otherwise("middle")
    return F.transform(names, lambda n, i: F.struct(n.alias("display_name"), place(i, F.size(names)).alias("position")))


def parse_tag(tag: Column) -> Column:
    """``scheme/label@score`` to a struct; the first ``@`` and the first ``/`` divide."""
    body = F.regexp_extract(tag, r"(?s)^([^@]*)", 1)
    return F.struct(
        F.regexp_extract(body, r"(?s)^([^/]*)", 1).alias("scheme"),
        F.nullif(F.regexp_extract(body, r"(?s)^[^/]*/(.*)$", 1), F.lit("")).alias("label"),
        F.trim(F.regexp_extract(tag, r"(?s)^[^@]*@(.*)$", 1)).try_cast("double").alias("score"),
    )


#: Fields that don't count when contents of a kind are compared; suffixes and their content types.
NOT_COMPARED = {"bibliographic": ["updated_date"], "raw": ["source_export_date"], "full_text": ["retrieved_at", "blob"]}
CONTENT_TYPES = {"jsonl": "application/jsonl", "json": "application/json", "csv": "text/csv", "txt": "text/plain", "ris": "application/x-research-info-systems", "pdf": "application/pdf"}


def fingerprint(*columns: str, kind: str | None = None) -> Column:
    """Equality key of the given fields in a fixed order, without those that a kind of content leaves out."""
    used = sorted(set(columns) - set(NOT_COMPARED.get(kind, [])))
    return F.sha2(F.to_json(F.struct(*used), {"ignoreNullFields": "false"}), 256)


def layer_key(content: Column) -> Column:
    """Equality key of a layer: its content's fingerprint, source, visibility, robot version and origins (in any order)."""
    origins = F.array_sort(F.coalesce(F.col("derived_from"), F.array().cast("array<string>")))
    return F.sha2(F.to_json(F.struct("source", "visibility", "robot_version", origins.alias("derived_from"), content.alias("content")), {"ignoreNullFields": "false"}), 256)


def chunks(items: Column, n: int) -> Column:
    """An array as an array of arrays of at most ``n``."""
    count = F.ceil(F.size(items) / n).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(items, i * n + 1, F.lit(n)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(cut, 1, 0))


def stripped_items(items: Column) -> Column:
    """Items without spaces at their ends; null and empty ones are dropped."""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def content_type(name: Column) -> Column:
    """Content type by a file name's ending, or null."""
    ending = F.lower(F.substring_index(name, ".", -1))
    return F.coalesce(*(F.when(ending == k, v) for k, v in CONTENT_TYPES.items()), F.lit(None))


def format_errors(errors: Column) -> Column:
    return F.array_join(F.transform(errors, lambda e: F.regexp_replace(e, r"^\s+|\s+$", "")), "\n\n")


def demojibake_fields(df: DataFrame, names: tuple[str, ...] = ("title", "publisher", "venue", "abstract", "authors")) -> DataFrame:
    """``df`` with mojibake undone in the text fields, and in text arrays item by item, that it has."""
    fixed = {n: F.transform(n, demojibake) if k == "array<string>" else demojibake(F.col(n)) for n, k in df.dtypes if n in names and k in ("string", "array<string>")}
    return df.withColumns(fixed)


#: Keys of linked data whose texts are mended.
TEXT_KEYS = ("name", "description", "supportingText", "@value")
_SUSPECT = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\x\1", MOJIBAKE))


def _mend(text: str) -> str:
    try:
        return text.encode("latin-1").decode() if _SUSPECT.search(text) else text
    except UnicodeError:
        return text


def _walk(node, is_text: bool = False):
    """``node`` with its texts mended that lie under a text key, by themselves or in lists."""
    if isinstance(node, dict):
        return {k: _walk(v, k in TEXT_KEYS) for k, v in node.items()}
    if isinstance(node, list):
        return [_walk(x, is_text) for x in node]
    return _mend(node) if is_text and isinstance(node, str) else node


@F.pandas_udf(T.StringType())
def demojibake_json(documents: pd.Series) -> pd.Series:
    """Mojibake undone under ``TEXT_KEYS`` at any depth of a JSON text; what isn't JSON stays."""

    def one(text):
        try:
            return json.dumps(_walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return text

    return documents.map(one)


def sampled(key: Column, bits: int | None) -> Column:
    """Whether a uuid falls into a stable sample of one in 2**bits; None samples nothing."""
    if bits is None:
        return F.lit(False)

    @F.pandas_udf(T.BooleanType())
    def chosen(uuids: pd.Series) -> pd.Series:
        digest = lambda u: int.from_bytes(hashlib.blake2b(uuid.UUID(u).bytes).digest(), "big")
        return uuids.map(lambda u: None if u is None else digest(u) & ((1 << bits) - 1) == 0)

    return chosen(key)

"""Exports: JSON lines, RIS records, and content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import demojibake, escape_newlines, flatten_newlines

#: RIS tags in their order, by field; and RIS types by venue type.
RIS_TAGS = [
    ("title", "TI"), ("authors", "AU"), ("publication_year", "PY"), ("publication_date", "DA"), ("journal", "T2"),
    ("volume", "VL"), ("issue", "IS"), ("start_page", "SP"), ("end_page", "EP"), ("publisher", "PB"), ("issns", "SN"),
    ("doi", "DO"), ("accession", "AN"), ("database", "DB"), ("pdf_url", "L1"), ("urls", "UR"), ("abstract", "AB"),
]
RIS_TYPES = {"journal": "JOUR", "conference": "CONF", "repository": "GEN", "book_series": "SER", "ebook_platform": "BOOK", "other": "GEN"}


def ris_type(venue_type: Column) -> Column:
    return F.coalesce(*(F.when(venue_type == k, v) for k, v in RIS_TYPES.items()), F.lit("GEN"))


def ris_record(df: DataFrame, exclude: tuple[str, ...] = ("abstract",)) -> Column:
    """One RIS record a row, of the fields that ``df`` has; empty values give no line."""
    if unknown := set(exclude) - {f for f, _ in RIS_TAGS}:
        raise ValueError(f"unknown RIS fields: {sorted(unknown)}")
    kinds = dict(df.dtypes)
    line = lambda tag, v: F.concat(F.lit(f"{tag}  - "), flatten_newlines(demojibake(v)))
    lines = lambda tag, vs: F.transform(vs, lambda v: line(tag, v))
    parts = [F.array(F.concat(F.lit("TY  - "), F.col("ris_type")))]
    for name, tag in RIS_TAGS:
        if name in exclude or name not in kinds:
            continue
        if kinds[name].startswith("array"):
            kept = F.filter(name, lambda x: x.isNotNull() & (x != ""))
            parts.append(F.coalesce(lines(tag, kept), F.array().cast("array<string>")))
        else:
            text = F.date_format(name, "yyyy/MM/dd") if kinds[name] in ("date", "timestamp", "timestamp_ntz") else F.col(name).cast("string")
            parts.append(F.array_compact(F.array(F.when(F.length(text) > 0, line(tag, text)))))
    parts.append(F.array(F.lit("ER  - ")))
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def json_line(*columns: str) -> Column:
    """A record as one line of JSON without its null fields."""
    return escape_newlines(F.to_json(F.struct(*columns)))


def export_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def write_payloads(df: DataFrame, key: str, path: str) -> None:
    """One JSON line a row, in files by key's hash range, for payloads looked up by ``key``."""
    df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("payload")).repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def result_lines(classified: DataFrame, messages: dict[str, str]) -> DataFrame:
    """One JSON line for each line of a result file, then one for each missing reference (``line``, ``at``)."""
    text = F.coalesce(*(F.when(F.col("outcome") == k, v) for k, v in messages.items()), F.lit(None).cast("string"))
    return classified.select(F.to_json(F.struct("reference_id", text.alias("error"))).alias("line"), F.col("line_no").alias("at"))


def digests(df: DataFrame, content: str, most_bytes: int) -> DataFrame:
    """``df`` with sha256 and byte_size of a binary column; too_large if the size exceeds the cap."""
    size = F.octet_length(content)
    return df.withColumns({"sha256": F.sha2(content, 256), "byte_size": size.cast("long"), "too_large": size > most_bytes})


def redacted(enhancements: Column, entitled: bool) -> Column:
    """Enhancements without full texts unless entitled to them."""
    return enhancements if entitled else F.filter(enhancements, lambda e: e["enhancement_type"] != "full_text")

"""Scalar functions as column expressions: normalisation, canonical keys, content hashes, identifiers, token counts."""

from __future__ import annotations

import html
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that Unicode trimming removes at both ends of a text.
UNICODE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_unicode(text: Column) -> Column:
    return F.btrim(text, F.lit(UNICODE_SPACE))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def normalize_text(text: Column) -> Column:
    """Line ends become line feeds, outer white space goes; empty texts and texts with NUL become null."""
    ends = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return bound(trim_unicode(ends), lambda clean: F.when((clean != "") & ~F.contains(clean, F.lit("\0")), clean))


def normalize_title(title: Column) -> Column:
    """White space collapses to single blanks; an empty title is null."""
    return F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_field(text: Column, upper: bool = False) -> Column:
    """A field of an extracted graph: trimmed, entities resolved, control characters dropped."""
    text = trim_unicode(F.upper(text) if upper else text)
    return F.regexp_replace(unescape_html(text), "[\\x00-\\x1F\\x7F-\\x9F]", "")


def string_set(values: Column) -> Column:
    """Sorted and without repeats: the canonical form of a set."""
    return F.array_sort(F.array_distinct(values))


def normalize_aliases(aliases: Column, title: Column) -> Column:
    """Upper-cased and trimmed, without empty ones and the title itself, as a canonical set."""
    upper = F.transform(aliases, lambda x: F.trim(F.upper(x)))
    return string_set(F.filter(upper, lambda x: (x != "") & (x != F.trim(F.upper(title)))))


def canonical_key(*values: Column) -> Column:
    """Values joined as length:value, so that no two lists give the same key."""
    return F.concat(*[F.concat(F.octet_length(x).cast("string"), F.lit(":"), x) for x in values])


def big_endian(n: Column) -> Column:
    """A non-negative long as eight bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def length_prefixed(text: Column) -> Column:
    return F.concat(big_endian(F.octet_length(text)), F.encode(text, "UTF-8"))


def entity_hash(aliases: Column, description: Column) -> Column:
    """SHA-256 over the number of aliases, each alias, and the description, every string with its length before it."""
    joined = F.aggregate(aliases, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, length_prefixed(x)))
    return F.sha2(F.concat(big_endian(F.size(aliases)), joined, length_prefixed(description)), 256)


def description_hash(description: Column) -> Column:
    """The content hash of relations and claims."""
    return F.sha2(length_prefixed(description), 256)


def set_digest(ordered_ids: Column) -> Column:
    """SHA-256 over ids, each followed by NUL."""
    return F.sha2(F.concat_ws("", F.transform(ordered_ids, lambda x: F.concat(x, F.lit("\0")))), 256)


def deterministic_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def reference(id_: Column, version: Column) -> Column:
    """id@version."""
    return F.concat(id_, F.lit("@"), version.cast("string"))


def parse_reference(text: Column) -> Column:
    """(id, version) of id@version; null for any other spelling, such as leading zeros."""
    matched = F.regexp_like(text, F.lit(r"^[^@]+@[1-9][0-9]{0,18}$"))
    parts = F.split(text, "@")
    return F.when(matched, F.struct(parts[0].alias("id"), F.try_to_number(parts[1], F.lit("9" * 19)).cast("long").alias("version")))


def token_count(text: Column) -> Column:
    """Tokens of the default tokenizer: runs of non-space characters."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def plain_float(value: float) -> str:
    """Shortest decimal that reads back the same, always with a point."""
    if math.isnan(value) or math.isinf(value):
        raise ValueError("not a finite number")
    text = repr(value)
    if "e" in text:
        text = format(Decimal(text), "f")
    return text if "." in text else f"{text}.0"


def l2_normalize(vector: Column) -> Column:
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(doubles, lambda x: x / norm)


def valid_vector(vector: Column) -> Column:
    """Not empty, all components finite, not of norm zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def whole_days(since: Column, until: Column) -> Column:
    """Complete periods of 24 hours from one NTZ timestamp to another; 0 if the second isn't later."""
    micros = F.timestamp_diff("MICROSECOND", since, until)
    return F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000))).cast("long")

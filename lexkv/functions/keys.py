"""Key encodings, number texts and display helpers. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_TEXT = r"^(-?[0-9]+)?$"


def encode_int(n: Column, width: int = 21) -> Column:
    """Zero-padded decimal text; text order equals number order for n >= 0 only (see encode_signed)."""
    return F.format_string(f"%0{width}d", n)


def encode_signed(n: Column) -> Column:
    """Decimal text whose order equals number order for all int64: shifted by 2^63."""
    return F.lpad((n.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


def encode_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def encode_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def composite(*parts: Column) -> Column:
    """'/' before each part: a prefix of parts is a prefix of the key."""
    return F.concat(*[x for p in parts for x in (F.lit("/"), p)])


def composite_part(key: Column, n: int) -> Column:
    return F.split(key, "/").getItem(n + 1)


def field_key(field: Column, row_id: Column) -> Column:
    """Index key: field|id."""
    return F.concat(field, F.lit("|"), row_id)


def md5_key(text: Column) -> Column:
    return F.md5(text)


def prefix_successor(prefix: str | bytes) -> str | bytes | None:
    """The least key above all keys that start with prefix; None where there is none."""
    if isinstance(prefix, bytes):
        cut = prefix.rstrip(b"\xff")
        return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
    cut = prefix.rstrip("\U0010ffff")
    if not cut:
        return None
    after = ord(cut[-1]) + 1
    return cut[:-1] + chr(0xE000 if after == 0xD800 else after)


def next_key(key: str | bytes) -> str | bytes:
    """The least key above key."""
    return key + (b"\0" if isinstance(key, bytes) else "\0")


def is_int_text(text: Column) -> Column:
    """Whether text is a number by the grammar -?[0-9]+ or empty (0), inside int64."""
    return F.coalesce(text.rlike(INT_TEXT) & ((text == "") | text.try_cast("long").isNotNull()), F.lit(False))


def int_of_text(text: Column) -> Column:
    """The number a text stands for: empty is 0, everything outside the grammar is null."""
    return F.when(text == "", F.lit(0).cast("long")).when(text.rlike(INT_TEXT), text.try_cast("long"))


def is_printable(key: Column) -> Column:
    return key.rlike(r"^[\x20-\x7f]*$")


def display_key(key: Column) -> Column:
    return F.when(is_printable(key), key).otherwise(F.hex(key))


def human_bytes(n: Column) -> Column:
    """Size with a unit and one decimal place at most: 999 B, 1.5 KB, 20 MB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        size = F.regexp_replace(F.round(n / 1000.0**power, 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
        out = F.when(n >= 1000**power, F.concat(size, F.lit(f" {unit}"))).otherwise(out)
    return out


def byte_find(text: Column, part: str) -> Column:
    """Place of part in text from 1; 0 where it is missing."""
    return F.instr(text, part)


def checksum(value: Column) -> Column:
    return F.crc32(value.cast("binary"))

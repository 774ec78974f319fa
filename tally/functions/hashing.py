"""Digests, header rules, bit masks and ratios as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: header rules by magic bytes (offset, hex) and header length
HEADER_RULES = {"ines": ((0, "4E45531A"), 16), "a78": ((1, "415441524937383030"), 128), "lnx": ((0, "4C594E58"), 64)}
COPIER_HEADER = 512


def digests(content) -> list[Column]:
    """crc32, md5, sha1 and length of bytes."""
    c = F.col(content) if isinstance(content, str) else content
    return [F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0").alias("crc32"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.octet_length(c).cast("long").alias("size")]


def header_found(content, rule: str) -> Column:
    """Whether bytes carry the header of a rule."""
    c = F.col(content) if isinstance(content, str) else content
    if rule == "smc":
        return F.octet_length(c) % 1024 == COPIER_HEADER
    (at, magic), _ = HEADER_RULES[rule]
    return F.substring(c, at + 1, len(magic) // 2) == F.unhex(F.lit(magic))


def header_length(rule: str) -> int:
    return COPIER_HEADER if rule == "smc" else HEADER_RULES[rule][1] if rule in HEADER_RULES else 0


def two_forms(content, rule: str) -> Column:
    """(ordinal, bytes) forms of a file: whole, and without its header where one is found."""
    c = F.col(content) if isinstance(content, str) else content
    n = header_length(rule)
    whole = F.struct(F.lit(0).alias("form"), c.alias("bytes"))
    rest = F.struct(F.lit(1).alias("form"), F.substring(c, F.lit(n + 1), F.octet_length(c)).alias("bytes"))
    return F.when(header_found(c, rule), F.array(whole, rest)).otherwise(F.array(whole)) if n else F.array(whole)


def word_order(content) -> Column:
    """Byte order of a cartridge image from its first four bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "80371240", "big").when(head == "37804012", "swapped16").when(head == "40123780", "little32")


def bit_of(value, known: list[str], other: int = 62) -> Column:
    """1 << place of a value in a list; a value outside it has bit ``other``; null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    place = F.array_position(F.array(*map(F.lit, known)), v).cast("int")
    # shiftleft takes a literal shift only; the powers are a small table
    table = F.array(*[F.lit(1 << k).cast("long") for k in range(len(known))])
    return F.when(v.isNull(), F.lit(None)).when(place > 0, F.element_at(table, F.greatest(place, F.lit(1)))).otherwise(F.lit(1 << other).cast("long"))


def progress(done, size) -> Column:
    """Share done of a transfer; an empty one is complete."""
    return F.when(F.col(size) == 0, 1.0).otherwise(F.least(F.col(done), F.col(size)) / F.col(size))


def clamp(c, low=0, high=None) -> Column:
    out = F.greatest(F.lit(low), c)
    return out if high is None else F.least(out, F.lit(high))


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)

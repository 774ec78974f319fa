"""Arcade sets: lists of sets, and images put together from parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_romsets(spark: SparkSession, path: str) -> DataFrame:
    """sets and bios of set lists: names of the elements, and file names that stand alone on a line of a comment."""
    return romsets_of(spark.read.text(path, wholetext=True))


def romsets_of(whole: DataFrame) -> DataFrame:
    """The same for set lists that are texts (value) of a table; other columns are dropped."""
    names = F.regexp_extract_all("value", F.lit(r"(?i)<romset\b[^>]*?\bname\s*=\s*[\"']\s*([^\"']*?)\s*[\"']"), F.lit(1))
    comments = F.array_join(F.regexp_extract_all("value", F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), "\n")
    lines = F.transform(F.split(comments, r"\r?\n"), lambda x: F.btrim(x))
    short = lambda x: (x != "") & (F.octet_length(x) <= 256)
    return whole.select(F.array_distinct(F.filter(names, short)).alias("sets"), F.array_distinct(F.filter(lines, lambda x: x.rlike(r"^[\w-]+\.\w{1,4}$") & short(x))).alias("bios"))


def interleaved(parts: list[tuple[bytes, str]], width: int) -> bytes:
    """Parts spread over words of ``width`` bits.

    A part's map has a digit for each byte of a word, the last digit for the first
    byte: 0 leaves the byte to another part, n takes the n-th byte of the part's unit.
    """
    size = width // 8
    words = max((len(data) // max(1, sum(d != "0" for d in spread)) for data, spread in parts), default=0)
    out = bytearray(words * size)
    for data, spread in parts:
        if len(spread) != size or not spread.isdigit():
            raise ValueError("a map needs a digit for each byte of a word")
        unit = sum(d != "0" for d in spread)
        for place, digit in enumerate(reversed(spread)):
            if digit != "0":
                column = data[int(digit) - 1 :: unit][:words]
                out[place : place + size * len(column) : size] = column
    return bytes(out)


def assemble(items: list[dict], patches: list[tuple[int, bytes, bool]] = (), most: int = 1 << 30) -> tuple[bytes, str]:
    """(image, MD5 of the part bytes in document order) of parts, repeats and interleaves; patches write or xor at an offset.

    An item is {data, offset, length, repeat} or {width, parts: [(data, map)]}.
    """
    image, fed = bytearray(), hashlib.md5()
    for item in items:
        if "parts" in item:
            for data, _ in item["parts"]:
                fed.update(data)
            image += interleaved(item["parts"], item["width"])
        else:
            start = item.get("offset", 0)
            piece = item["data"][start : start + item["length"]] if item.get("length") else item["data"][start:]
            if len(image) + len(piece) * item.get("repeat", 1) > most:
                raise ValueError("image too large")
            piece *= item.get("repeat", 1)
            fed.update(piece)
            image += piece
    for at, data, xor in patches:
        old = image[at : at + len(data)]
        if len(old) < len(data):
            raise ValueError("patch beyond the end")
        image[at : at + len(data)] = bytes(a ^ b for a, b in zip(old, data, strict=True)) if xor else data
    return bytes(image), fed.hexdigest()


IMAGES = "image bigint, size bigint, md5 string, fed_md5 string, fault string"


def images(parts: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """image, size, MD5 of the whole and of the part bytes, for parts (image, at, data, offset, length, repeat) in order of ``at``.

    An image is put together in one task: it is a file of its own, some MB, and its parts follow each other.
    patches: image, offset, data, xor.
    """
    import pandas as pd

    def build(rows: pd.DataFrame, changes: list) -> pd.DataFrame:
        items = [{"data": bytes(r.data), "offset": int(r.offset), "length": int(r.length), "repeat": int(r.repeat)} for r in rows.sort_values("at").itertuples()]
        key = int(rows["image"].iloc[0])
        try:
            image, fed = assemble(items, changes)
        except ValueError as e:
            return pd.DataFrame([(key, None, None, None, str(e))], columns=["image", "size", "md5", "fed_md5", "fault"])
        return pd.DataFrame([(key, len(image), hashlib.md5(image).hexdigest(), fed, None)], columns=["image", "size", "md5", "fed_md5", "fault"])

    def both(rows: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame([], columns=["image", "size", "md5", "fed_md5", "fault"])
        return build(rows, [(int(c.offset), bytes(c.data), bool(c.xor)) for c in changes.itertuples()])

    if patches is None:
        return parts.groupBy("image").applyInPandas(lambda rows: build(rows, []), IMAGES)
    return parts.groupBy("image").cogroup(patches.groupBy("image")).applyInPandas(both, IMAGES)

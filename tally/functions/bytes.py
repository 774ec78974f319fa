"""Byte work that has no built-in: CRC32 algebra and byte order."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from .lazy import udf

_POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def shift_crc(crc: int, zeros: int) -> int:
    """The CRC register after so many zero bytes: powers of the one-bit step by squaring."""
    step = [_POLYNOMIAL] + [1 << k for k in range(31)]
    for _ in range(3):
        step = [_times(step, x) for x in step]
    while zeros:
        if zeros & 1:
            crc = _times(step, crc)
        step = [_times(step, x) for x in step]
        zeros >>= 1
    return crc


def strip_crc(whole: int, head: bytes, rest: int) -> int:
    """CRC32 of what follows a header, from the CRC of the whole file, the header and the rest's length."""
    return whole ^ shift_crc(zlib.crc32(head), rest)


@udf("long", vectorised=True)
def content_crc(whole: pd.Series, head: pd.Series, size: pd.Series) -> pd.Series:
    """strip_crc of columns: the whole file's CRC, its header bytes, and its size."""
    return pd.Series([None if w is None or pd.isna(w) or h is None else strip_crc(int(w), bytes(h), int(s) - len(h)) for w, h, s in zip(whole, head, size, strict=True)], dtype="Int64")


def swapped(content: bytes, order: str) -> bytes:
    """Big-endian bytes of an image in another word order; a last partial word stays."""
    width = {"swapped16": 2, "little32": 4}.get(order)
    if not width:
        return content
    n = len(content) // width * width
    return np.frombuffer(content[:n], f"<u{width}").byteswap().tobytes() + content[n:]


@udf("binary", vectorised=True)
def big_endian(content: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else swapped(bytes(c), o) for c, o in zip(content, order, strict=True)])


# fixed value: the first code point of escaped bytes
ESCAPED = 0x10FF00
_ESCAPES = {0xDC00 + b: ESCAPED + b for b in range(0x80, 0x100)}


@udf("string", vectorised=True)
def escape_invalid(content: pd.Series) -> pd.Series:
    """Bytes as text: what is no UTF-8 becomes a private code point a byte, so that a reader never fails on it."""
    return pd.Series([None if c is None else bytes(c).decode("utf-8", "surrogateescape").translate(_ESCAPES) for c in content], dtype=object)


def has_escapes(text):
    """Whether a text holds bytes that were no UTF-8."""
    from pyspark.sql import functions as F

    return (F.col(text) if isinstance(text, str) else text).rlike("[\U0010ff80-\U0010ffff]")

"""Torrents and magnet links: a bencode reader, file lists and infohashes."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import udf

DEPTH, LENGTH = 64, 64 << 20


def decode(data: bytes, at: int = 0, depth: int = 0):
    """(value, end) of the bencoded value at a place; keys of a dict may stand in any order, the last of repeated ones counts; numbers are plain."""
    if depth > DEPTH:
        raise ValueError("nested too deeply")
    head = data[at : at + 1]
    if head == b"i":
        end = data.index(b"e", at)
        digits = data[at + 1 : end]
        if not digits.lstrip(b"-").isdigit() or digits.startswith((b"-0", b"00")) or (digits[:1] == b"0" and len(digits) > 1):
            raise ValueError("bad number")
        return int(digits), end + 1
    if head in (b"l", b"d"):
        items, at = [], at + 1
        while data[at : at + 1] != b"e":
            value, at = decode(data, at, depth + 1)
            items.append(value)
        if head == b"l":
            return items, at + 1
        if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
            raise ValueError("bad dict")
        return dict(zip(items[::2], items[1::2], strict=True)), at + 1
    if head.isdigit():
        colon = data.index(b":", at, at + 12)
        n = int(data[at:colon])
        if n > LENGTH or colon + 1 + n > len(data):
            raise ValueError("text too long")
        return data[colon + 1 : colon + 1 + n], colon + 1 + n
    raise ValueError("no value")


def encode(value) -> bytes:
    """Canonical bencoding."""
    if isinstance(value, bool):
        raise TypeError("no booleans in bencode")
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return b"%d:%s" % (len(value), value)
    if isinstance(value, (list, tuple)):
        return b"l" + b"".join(map(encode, value)) + b"e"
    pairs = sorted((k.encode() if isinstance(k, str) else k, v) for k, v in value.items())
    return b"d" + b"".join(encode(k) + encode(v) for k, v in pairs) + b"e"


def _info_span(data: bytes) -> tuple[int, int]:
    """Where the raw info dict stands."""
    if data[:1] != b"d":
        raise ValueError("no dict")
    at = 1
    while data[at : at + 1] != b"e":
        key, start = decode(data, at, 1)
        _, at = decode(data, start, 1)
        if key == b"info":
            return start, at
    raise ValueError("no info")


def parse_torrent(data: bytes) -> tuple[str, str, list[tuple[int, str, int]]]:
    """infohash, name and (index, path, size) of the files; torrents without v1 files are refused."""
    start, end = _info_span(data)
    info, _ = decode(data, start)
    text = lambda b: b.decode("utf-8", "replace")
    name = text(info[b"name"])
    if b"files" in info:
        files = [(k, "/".join([name, *map(text, f[b"path"])]), f[b"length"]) for k, f in enumerate(info[b"files"])]
    elif b"length" in info:
        files = [(0, name, info[b"length"])]
    else:
        raise ValueError("no v1 files")
    return hashlib.sha1(data[start:end]).hexdigest(), name, files


FILES = "path string, infohash string, name string, file_index int, file string, size bigint, fault string"


def read_torrents(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of each torrent; a torrent that cannot be read is one row with its fault."""
    return torrent_files(spark.read.format("binaryFile").load(path))


def torrent_files(files: DataFrame) -> DataFrame:
    """The same for torrents (path, content) of a table."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    infohash, name, files = parse_torrent(bytes(content))
                    out += [(file, infohash, name, k, p, n, None) for k, p, n in files]
                except (ValueError, KeyError, IndexError, TypeError) as e:
                    out.append((file, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            rows = pd.DataFrame(out, columns=[c.split()[0] for c in FILES.split(", ")])
            yield rows.astype({"file_index": "Int32", "size": "Int64"})

    return files.select("path", "content").mapInPandas(run, FILES)


def _base32(text: str | None) -> str | None:
    try:
        return base64.b32decode(text.upper()).hex() if text else None
    except ValueError:
        return None


@udf("string", vectorised=True)
def base32_hex(texts: pd.Series) -> pd.Series:
    return pd.Series([_base32(t) for t in texts], dtype=object)


def magnets(df: DataFrame, link: str) -> DataFrame:
    """infohash and display name of magnet links; hex hashes stay native, base32 ones take a UDF."""
    found = F.regexp_extract(link, r"(?i)[?&]xt=urn:btih:([0-9a-z]+)", 1)
    name = F.regexp_extract(link, r"[?&]dn=([^&]*)", 1)
    infohash = F.when(found.rlike("^[0-9a-fA-F]{40}$"), F.lower(found)).when(found.rlike("^[2-7A-Za-z]{32}$"), base32_hex(found))
    return df.withColumns({"infohash": infohash, "display_name": F.nullif(F.try_url_decode(name), F.lit(""))})

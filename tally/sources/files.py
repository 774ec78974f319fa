"""Directory listings, containers, disc images and arcade descriptions."""

from __future__ import annotations

import io
import re
import struct
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import digests
from ..functions.text import directory, extension


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of all files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows if content else rows.drop("content")
    return rows.where(extension("path").isin(*extensions)) if extensions else rows


def unit(path, root: str, depth: int = 1) -> Column:
    """The directory that a file belongs to as a unit: so many levels below the root."""
    rest = F.regexp_replace(path, "^" + re.escape(root.rstrip("/") + "/"), "")
    return F.substring_index(rest, "/", depth)


def walked(path, root: str, depth: int = 4, skipped: tuple[str, ...] = ("_organized",)) -> Column:
    """Whether a walk of so many levels below the root meets a file, without the folders it skips."""
    parts = F.split(F.regexp_replace(path, "^" + re.escape(root.rstrip("/") + "/"), ""), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return (F.size(parts) <= depth) & ~F.exists(folders, lambda p: p.isin(*skipped))


def changed(listed: DataFrame, stored: DataFrame, path: str = "path") -> DataFrame:
    """Listed files whose size or time differs from the stored row, or that have none: what has to be hashed."""
    known = stored.select(path, F.col("length").alias("_length"), F.col("modificationTime").alias("_time"))
    joined = listed.join(known, path, "left")
    same = (F.col("length") == F.col("_length")) & (F.col("modificationTime") == F.col("_time"))
    return joined.where(~F.coalesce(same, F.lit(False))).drop("_length", "_time")


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", *digests("content"))


MEMBERS = "path string, member string, size bigint, crc32 bigint"


def zip_members(files: DataFrame) -> DataFrame:
    """Central directories of zip files: no member is inflated."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, m.filename, m.file_size, m.CRC) for m in z.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "member", "size", "crc32"]).astype({"size": "Int64", "crc32": "Int64"})

    return files.select("path", "content").mapInPandas(run, MEMBERS)


def worth_hashing(members: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Members whose (crc32, size) the catalogue knows: the semi join before inflating anything."""
    return members.join(catalogue.select("crc32", "size").distinct(), ["crc32", "size"], "left_semi")


# fixed values: the header layout of compressed disc images, version 5
DISC_MAGIC, DISC_HEADER, DISC_VERSION = b"MComprHD", 124, 5


def disc_header(head: bytes) -> dict:
    """Version, codecs, sizes and digests of a disc image header, or the reason why it is refused."""
    empty = {"reason": None, "logical_bytes": None, "hunk_bytes": None, "unit_bytes": None, "codecs": None, "raw_sha1": None, "sha1": None, "parent_sha1": None}
    if len(head) < 16 or head[:8] != DISC_MAGIC:
        return empty | {"reason": "not_an_image"}
    size, version = struct.unpack_from(">II", head, 8)
    if version != DISC_VERSION:
        return empty | {"reason": "other_version"}
    if size != DISC_HEADER or len(head) < DISC_HEADER:
        return empty | {"reason": "truncated"}
    codecs = [head[k : k + 4].decode("latin-1") for k in range(16, 32, 4) if any(head[k : k + 4])]
    logical, _, _ = struct.unpack_from(">QQQ", head, 32)
    hunk, per_unit = struct.unpack_from(">II", head, 56)
    reason = "no_units" if not per_unit or not hunk or hunk % per_unit else "empty" if not logical else "has_parent" if any(head[104:124]) else None
    return {"reason": reason, "logical_bytes": logical, "hunk_bytes": hunk, "unit_bytes": per_unit, "codecs": codecs, "raw_sha1": head[64:84], "sha1": head[84:104], "parent_sha1": head[104:124] if any(head[104:124]) else None}


DISC = "reason string, logical_bytes bigint, hunk_bytes bigint, unit_bytes bigint, codecs array<string>, raw_sha1 binary, sha1 binary, parent_sha1 binary"


def disc_headers(files: DataFrame) -> DataFrame:
    """The header fields of images (path, content), of which the first 124 bytes go to Python."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [disc_header(bytes(head)) if head is not None else {} for head in batch["head"]]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DISC.split(", ")], index=batch.index)
            out.insert(0, "path", batch["path"])
            yield out.astype({c: "Int64" for c in ("logical_bytes", "hunk_bytes", "unit_bytes")})

    return files.select("path", F.substring("content", 1, DISC_HEADER).alias("head")).mapInPandas(run, "path string, " + DISC)


def track_fields(meta) -> Column:
    """KEY:VALUE text of a track's metadata as a map."""
    return F.str_to_map(F.btrim(meta), F.lit(" "), F.lit(":"))


def shallowest(files: DataFrame, key: str, path: str) -> DataFrame:
    """One path of each file: the one fewest levels down, then the first by name."""
    depth = F.size(F.split(F.col(path), "/"))
    w = Window.partitionBy(key).orderBy(depth, path)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def zip_location(zips, default: str = "mame") -> Column:
    """Where a named zip lies: under the default folder, or as an absolute path; ``..`` steps back, never above the root."""
    full = F.when(F.startswith(zips, F.lit("/")), zips).otherwise(F.concat(F.lit(f"{default}/"), zips))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def parse_mra(text: str) -> dict:
    """Name, set, core, zips and parts of an arcade description; tag and attribute case does not matter, end tags may miss."""
    tags = re.findall(r"<(/?)([a-zA-Z]+)((?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>([^<]*)", text)
    out = {"name": None, "setname": None, "rbf": None, "zips": [], "parts": []}
    rom = None
    for end, tag, attributes, _, content in tags:
        tag = tag.lower()
        at = {k.lower(): v[1:-1] for k, v in re.findall(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*')", attributes)}
        if end:
            rom = None if tag == "rom" else rom
        elif tag in ("name", "setname", "rbf"):
            out[tag] = content.strip() or None
        elif tag == "rom":
            rom = at.get("index")
            out["zips"] = list(dict.fromkeys([*out["zips"], *filter(None, at.get("zip", "").split("|"))]))
        elif tag == "part" and rom is not None:
            out["parts"].append({"rom": rom, "name": at.get("name"), "crc": at.get("crc"), "repeat": at.get("repeat"), "data": content.strip() or None})
    return out


MRA = "name string, setname string, rbf string, zips array<string>, parts array<struct<rom:string,name:string,crc:string,repeat:string,data:string>>"


def read_mra(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("wholetext", "true").text(path).withColumn("path", F.input_file_name())
    return mra_of(whole)


def mra_of(whole: DataFrame) -> DataFrame:
    """The same for descriptions (path, value) of a table."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = pd.DataFrame([parse_mra(t or "") for t in batch["value"]], columns=["name", "setname", "rbf", "zips", "parts"], index=batch.index)
            out.insert(0, "path", batch["path"])
            yield out

    return whole.select("path", "value").mapInPandas(run, "path string, " + MRA)


def placement(entries: DataFrame, domain: str, kind: str, name: str) -> DataFrame:
    """Placement plans as data: target path and steps, nothing is moved."""
    target = F.concat_ws("/", domain, F.when(F.col(kind) == "disc", F.col("entry")), name)
    steps = F.array_compact(F.array(F.when(F.col(kind) == "disc", F.lit("mkdir")), F.when(extension("staged") == "zip", F.lit("unzip")), F.when(F.col("strip"), F.lit("strip_header")), F.lit("rename")))
    return entries.select("entry", target.alias("target"), steps.alias("steps"), directory("staged").alias("from"))

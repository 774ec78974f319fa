"""Catalogue files: game lists as XML, exports with nested files, packs; and writing them back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hex_digest, split_list

GAME = "_name string, _cloneof string, _romof string, description string, category string, rom array<struct<_name:string,_size:string,_crc:string,_md5:string,_sha1:string,_status:string,_header:string>>, release array<struct<_name:string,_region:string,_language:string>>"
EXPORT = "_name string, archive struct<_number:string,_clone:string,_region:string,_languages:string,_status:string>, source array<struct<file:array<struct<_extension:string,_format:string,_size:string,_crc32:string,_md5:string,_sha1:string,_header:string,_item:string,_forcename:string,_bad:string>>>>"
STATUS = ("good", "baddump", "nodump", "verified")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """One row a game of XML lists, streamed game by game; elements that don't parse go to _corrupt."""
    reader = spark.read.format("xml").option("rowTag", "game").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.schema(GAME + ", _corrupt string").load(path)


def games_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """The games of lists that are texts of a column, one row each."""
    cut = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(<game\b.*?</game>)"), F.lit(1))).alias("xml"))
    return cut.select(F.from_xml("xml", GAME, {"rowTag": "game"}).alias("g")).select("g.*")


def items(games: DataFrame) -> DataFrame:
    """One row an expected file, typed and checked; ``fault`` names what is wrong."""
    rows = games.select(F.col("_name").alias("entry"), F.explode("rom").alias("r"))
    status = F.lower(F.coalesce("r._status", F.lit("good")))
    size = F.expr("try_cast(r._size AS bigint)")
    digests = {n: hex_digest(f"r.{c}", k) for n, c, k in (("crc32", "_crc", 4), ("md5", "_md5", 16), ("sha1", "_sha1", 20))}
    wrong = [F.when(F.col(f"r.{c}").isNotNull() & (F.col(f"r.{c}") != "") & digests[n].isNull(), F.lit(n)) for n, c in (("crc32", "_crc"), ("md5", "_md5"), ("sha1", "_sha1"))]
    fault = F.concat_ws(",", F.when(size.isNull() | (size < 0), F.lit("size")), *wrong, F.when(~status.isin(*STATUS), F.lit("status")))
    return rows.select("entry", F.col("r._name").alias("name"), size.alias("size"), *[c.alias(n) for n, c in digests.items()], status.alias("status"), F.unhex(F.regexp_replace("r._header", " ", "")).alias("header"), F.nullif(fault, F.lit("")).alias("fault"))


def parents(games: DataFrame) -> DataFrame:
    """entry, parent: by clone name within the list, itself where there is none."""
    names = games.select(F.col("_name").alias("entry"), F.coalesce("_cloneof", "_romof").alias("of"))
    known = names.select(F.col("entry").alias("of"), F.col("entry").alias("_parent")).distinct()
    return names.join(known, "of", "left").select("entry", F.coalesce("_parent", "entry").alias("parent"))


def kind(paths: DataFrame) -> DataFrame:
    """Which of the two list formats each file is, from its head; null for others."""
    head = F.substring("value", 1, 65536)
    found = F.when(head.rlike(r"(?s)<archive\b"), "export").when(head.rlike(r"(?s)<datafile\b|<game\b"), "list")
    return paths.withColumn("kind", found)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Games of an export: the file has two root elements, so games are cut out of its text and parsed each."""
    return exported_games(spark.read.text(path, wholetext=True))


def exported_games(texts: DataFrame, text: str = "value") -> DataFrame:
    """The games of exports that are texts of a column."""
    cut = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(<game\b.*?</game>)"), F.lit(1))).alias("xml"))
    return cut.select(F.from_xml("xml", EXPORT, {"rowTag": "game"}).alias("g")).select("g.*")


def export_parents(games: DataFrame) -> DataFrame:
    """entry, parent: the game whose number is the clone attribute, unless that is itself."""
    rows = games.select(F.col("_name").alias("entry"), F.col("archive._number").alias("number"), F.col("archive._clone").alias("clone"))
    known = rows.select(F.col("number").alias("clone"), F.col("entry").alias("_parent")).dropDuplicates(["clone"])
    return rows.join(known, "clone", "left").select("entry", F.coalesce("_parent", "entry").alias("parent"))


def export_files(games: DataFrame, header: int = 0) -> DataFrame:
    """The files of each game that count: of its best kind, each key once, good ones first.

    Kinds are headerless (or a file that a larger sibling with the header is
    exactly the header longer than), headered, big-endian, plain and other.
    """
    f = games.select(F.col("_name").alias("entry"), F.posexplode("source").alias("source", "s")).select("entry", "source", F.posexplode("s.file").alias("at", "f"))
    fmt = F.lower(F.coalesce("f._format", F.lit("")))
    named = F.when(fmt == "headerless", 0).when(fmt == "bigendian", 1).when(fmt == "headered", 2).when(fmt == "", 3).otherwise(4)
    rows = f.select("entry", "source", "at", named.alias("rank"), F.expr("try_cast(f._size AS bigint)").alias("size"), F.lower("f._crc32").alias("crc32"), F.lower("f._sha1").alias("sha1"), F.lower("f._extension").alias("extension"), F.coalesce(F.col("f._bad") == "1", F.lit(False)).alias("bad"))
    if header:
        bigger = rows.where("rank = 2").select("entry", "source", (F.col("size") - header).alias("size")).distinct().withColumn("strips", F.lit(True))
        rows = rows.join(bigger, ["entry", "source", "size"], "left").withColumn("rank", F.when(F.col("strips") & (F.col("rank") > 2), 0).otherwise(F.col("rank"))).drop("strips")
    best = rows.withColumn("_best", F.min("rank").over(Window.partitionBy("entry"))).where(F.col("rank") == F.col("_best")).drop("_best")
    key = F.coalesce("sha1", F.concat_ws("/", "crc32", F.col("size").cast("string")))
    w = Window.partitionBy("entry", "_key").orderBy("bad", "source", "at")
    return best.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def export_tags(games: DataFrame) -> DataFrame:
    return games.select(F.col("_name").alias("entry"), split_list("archive._region").alias("regions"), split_list("archive._languages").alias("languages"))


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, xml): the lists in zip packs, unzipped on the executors."""
    return packed_lists(spark.read.format("binaryFile").load(path))


def packed_lists(files: DataFrame) -> DataFrame:
    """The lists in zip packs (path, content)."""

    def unzip(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(file, n, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.lower().endswith((".dat", ".xml"))]
            yield pd.DataFrame(out, columns=["path", "member", "xml"])

    return files.select("path", "content").mapInPandas(unzip, "path string, member string, xml string")


def write_games(entries: DataFrame, path: str) -> None:
    """Canonical XML of (entry, parent, items): what the reader reads and nothing else, games by name, files by place."""
    rom = F.transform("items", lambda r: F.struct(r["name"].alias("_name"), r["size"].cast("string").alias("_size"), F.lower(F.hex(r["crc32"])).alias("_crc"), F.lower(F.hex(r["md5"])).alias("_md5"), F.lower(F.hex(r["sha1"])).alias("_sha1"), F.nullif(r["status"], F.lit("good")).alias("_status")))
    rows = entries.select(F.col("entry").alias("_name"), F.when(F.col("parent") != F.col("entry"), F.col("parent")).alias("_cloneof"), rom.alias("rom"))
    rows.repartitionByRange("_name").sortWithinPartitions("_name").write.format("xml").option("rowTag", "game").option("rootTag", "datafile").save(path)

"""Named queries of the file formats: documents are composed from the test tables and read back, against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as byte
from ..functions import hashing
from ..sources import arcade, catalogues, files, torrents
from .catalogue import table
from .queries import query

#: CRC32 of an ASCII text in SQL: the register over its bits, least first.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[((ord(substr({0}, i::INT, 1)) >> j) & 1)::BIGINT FOR j IN range(8)] FOR i IN range(1, length({0}) + 1)])), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


# lists -------------------------------------------------------------------------------


def _lists(spark, d):
    """One XML list a brand: a game for each part, with a file whose digest may be broken."""
    game = F.expr("""concat('<game name="', p_partkey, '"', CASE WHEN p_partkey % 3 = 1 THEN concat(' cloneof="', p_partkey - 1, '"') WHEN p_partkey % 3 = 2 THEN ' cloneof="nowhere"' ELSE '' END,
      '><description>', p_name, '</description><rom name="', p_name, '.bin" size="', CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END, '" crc="', CASE WHEN p_partkey % 5 = 0 THEN 'zz' ELSE 'DEADBEEF' END, '"',
      CASE WHEN p_partkey % 2 = 0 THEN ' status="verified"' ELSE '' END, '/></game>')""")
    return table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit('<?xml version="1.0"?><datafile>'), F.array_join(F.collect_list(game), "\n"), F.lit("</datafile>")).alias("value"))


@query("SELECT p_partkey::VARCHAR AS entry, p_name || '.bin' AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_size END::BIGINT AS size, CASE WHEN p_partkey % 5 <> 0 THEN 'DEADBEEF' END AS crc, CASE WHEN p_partkey % 2 = 0 THEN 'verified' ELSE 'good' END AS status, nullif(concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'size' END, CASE WHEN p_partkey % 5 = 0 THEN 'crc32' END), '') AS fault FROM part")
def list_items(spark, d):
    rows = catalogues.items(catalogues.games_of(_lists(spark, d)))
    return rows.select("entry", "name", "size", F.hex("crc32").alias("crc"), "status", "fault")


@query("SELECT p_partkey::VARCHAR AS entry, CASE WHEN p_partkey % 3 = 1 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - 1) THEN p_partkey - 1 ELSE p_partkey END::VARCHAR AS parent FROM part p")
def list_parents(spark, d):
    return catalogues.parents(catalogues.games_of(_lists(spark, d)))


@query("SELECT p_brand, 'list' AS kind FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'export' END FROM nation")
def list_kinds(spark, d):
    other = table(spark, d, "nation").select(F.col("n_name").alias("p_brand"), F.when(F.col("n_nationkey") % 2 == 0, "<datafile><game><archive number='1'/></game>").otherwise("<html/>").alias("value"))
    return catalogues.kind(_lists(spark, d).unionByName(other)).select("p_brand", "kind")


def _exports(spark, d):
    file = "concat('<file extension=\"bin\"', {0}, ' size=\"', {1}, '\" crc32=\"0000000', {2}, '\"', {3}, '/>')"
    one, two = (
        file.format("CASE WHEN p_partkey % 3 = 2 THEN ' format=\"BigEndian\"' ELSE '' END", "p_size", "1", "CASE WHEN p_partkey % 4 = 0 THEN ' bad=\"1\"' ELSE '' END"),
        file.format("CASE p_partkey % 3 WHEN 2 THEN ' format=\"BigEndian\"' ELSE ' format=\"Headered\"' END", "CASE p_partkey % 3 WHEN 0 THEN p_size + 16 WHEN 1 THEN p_size + 20 ELSE p_size END", "CASE p_partkey % 3 WHEN 2 THEN '1' ELSE '2' END", "''"),
    )
    game = f"""concat('<game name="', p_partkey, '"><archive number="', p_partkey + 5, '" clone="', p_partkey + 5 - p_partkey % 2, '" region="USA, ', p_type, '" languages="En"/><source>', {one}, {two}, '</source></game>')"""
    return table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit("<header/><datafile>"), F.array_join(F.collect_list(F.expr(game)), ""), F.lit("</datafile>")).alias("value"))


@query("SELECT p_partkey::VARCHAR AS entry, CASE p_partkey % 3 WHEN 1 THEN p_size + 20 ELSE p_size END::BIGINT AS size, CASE p_partkey % 3 WHEN 1 THEN '00000002' ELSE '00000001' END AS crc32, p_partkey % 3 = 0 AND p_partkey % 4 = 0 AS bad FROM part")
def export_file_selection(spark, d):
    """Headerless by its larger sibling, headered before plain, big-endian copies once and the good one first."""
    return catalogues.export_files(catalogues.exported_games(_exports(spark, d)), header=16).select("entry", "size", "crc32", "bad")


@query("SELECT p_partkey::VARCHAR AS entry, CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - p.p_partkey % 2) THEN p_partkey - p_partkey % 2 ELSE p_partkey END::VARCHAR AS parent FROM part p")
def export_parents(spark, d):
    return catalogues.export_parents(catalogues.exported_games(_exports(spark, d)))


@query("SELECT p_partkey::VARCHAR AS entry, ['USA', p_type] AS regions, ['En'] AS languages FROM part")
def export_tags(spark, d):
    return catalogues.export_tags(catalogues.exported_games(_exports(spark, d)))


def _zips(spark, d):
    """One zip a brand: a list for each part, and a text that is none."""

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for names in batch["names"]:
                at = io.BytesIO()
                with zipfile.ZipFile(at, "w") as z:
                    for n in sorted(set(names)):
                        z.writestr(f"{n}.DAT", f"<datafile>{n}</datafile>")
                    z.writestr("read.me", "x")
                out.append(at.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": out})

    names = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.collect_set("p_name").alias("names"))
    return names.mapInPandas(pack, "path string, content binary")


@query("SELECT DISTINCT p_brand AS path, p_name || '.DAT' AS member, '<datafile>' || p_name || '</datafile>' AS xml FROM part")
def packed_lists(spark, d):
    return catalogues.packed_lists(_zips(spark, d))


@query(f"WITH m AS (SELECT DISTINCT p_brand AS path, p_name || '.DAT' AS member, '<datafile>' || p_name || '</datafile>' AS body FROM part UNION ALL SELECT DISTINCT p_brand, 'read.me', 'x' FROM part), c AS (SELECT body, {CRC_SQL.format('body')} AS crc32 FROM (SELECT DISTINCT body FROM m)) SELECT path, member, length(body)::BIGINT AS size, crc32::BIGINT AS crc32 FROM m JOIN c USING (body)")
def zip_members(spark, d):
    return files.zip_members(_zips(spark, d))


@query("SELECT DISTINCT p_brand AS path, p_name || '.DAT' AS member FROM part WHERE length(p_name) IN (8, 10)")
def members_worth_hashing(spark, d):
    members = files.zip_members(_zips(spark, d))
    known = members.where("size in (29, 31) and member != 'read.me'").select("crc32", "size")
    return files.worth_hashing(members, known).select("path", "member")


# offers ------------------------------------------------------------------------------


#: The info dict of a made-up torrent of two files, as an expression of both dialects.
_FILE = "'d6:lengthi', {0} * s_suppkey + 1, 'e4:pathl1:d6:f{0}.binee'"
_INFO = f"concat('d5:filesl', {_FILE.format(1)}, {_FILE.format(2)}, 'e4:name', length(s_name), ':', s_name, '12:piece lengthi16e6:pieces0:e')"


@query(f"SELECT s_suppkey::VARCHAR AS path, sha1({_INFO}) AS infohash, s_name AS name, (k - 1)::INT AS file_index, s_name || '/d/f' || k || '.bin' AS file, (k * s_suppkey + 1)::BIGINT AS size FROM supplier, (VALUES (1), (2)) v(k) WHERE s_suppkey % 10 <> 9 UNION ALL SELECT s_suppkey::VARCHAR, NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 9")
def torrent_files(spark, d):
    whole = F.concat(F.lit("d8:announce1:x4:info"), F.expr(_INFO), F.lit("e"))
    content = F.when(F.col("s_suppkey") % 10 == 9, F.lit("d4:infod4:name1:xee")).otherwise(whole).cast("binary")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content"))
    return torrents.torrent_files(rows).select("path", "infohash", "name", "file_index", "file", "size")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN sha1(c_name) WHEN 1 THEN repeat('0', 40) END AS infohash, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' & co' END AS display_name FROM customer")
def magnet_links(spark, d):
    link = F.expr("concat('magnet:?', CASE c_custkey % 3 WHEN 0 THEN concat('xt=urn:btih:', upper(sha1(c_name))) WHEN 1 THEN concat('xt=urn:btih:', repeat('A', 32)) ELSE 'xt=urn:sha1:x' END, CASE WHEN c_custkey % 2 = 0 THEN concat('&dn=', url_encode(concat(c_name, ' & co'))) ELSE '' END)")
    return torrents.magnets(table(spark, d, "customer").withColumn("link", link), "link").select("c_custkey", "infohash", "display_name")


@query("SELECT p_partkey::VARCHAR AS path, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 's' || p_partkey END AS setname, 'core' AS rbf, ['a.zip', p_type || '.zip'] AS zips, 2::BIGINT AS n FROM part")
def arcade_descriptions(spark, d):
    text = F.expr("concat('<misterromdescription><NAME>', p_name, '</Name>', CASE WHEN p_partkey % 2 = 0 THEN concat('<setname>s', p_partkey, '</setname>') ELSE '' END, '<rbf>core</rbf><ROM Index=\"0\" zip=\"a.zip|', p_type, '.zip|a.zip\"><part name=\"x\" crc=\"01\"/><part>00 FF</part></rom>')")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("value"))
    return files.mra_of(rows).select("path", "name", "setname", "rbf", "zips", F.size("parts").cast("long").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mame/' || p_partkey || '.zip' WHEN 1 THEN 'x/' || p_partkey || '.zip' WHEN 2 THEN p_partkey || '.zip' ELSE 'y.zip' END AS place FROM part")
def zip_locations(spark, d):
    zips = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey, '.zip') WHEN 1 THEN concat('/x//', p_partkey, '.zip') WHEN 2 THEN concat('../', p_partkey, '.zip') ELSE '/../../y.zip' END")
    return table(spark, d, "part").select("p_partkey", files.zip_location(zips).alias("place"))


@query("SELECT n_regionkey::BIGINT AS image, sum(length(piece))::BIGINT AS size, md5(CASE WHEN n_regionkey % 2 = 0 THEN 'zz' || substr(string_agg(piece, '' ORDER BY n_nationkey), 3) ELSE string_agg(piece, '' ORDER BY n_nationkey) END) AS md5, md5(string_agg(piece, '' ORDER BY n_nationkey)) AS fed_md5 FROM (SELECT *, repeat(CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 2, 4) ELSE substr(n_name, 2) END, (n_nationkey % 2 + 1)::INT) AS piece FROM nation) GROUP BY n_regionkey")
def part_assembly(spark, d):
    """Images from parts with offsets, lengths and repeats; those of even regions are patched at the start."""
    n = table(spark, d, "nation")
    parts = n.select(F.col("n_regionkey").cast("long").alias("image"), F.col("n_nationkey").alias("at"), F.encode("n_name", "UTF-8").alias("data"), F.lit(1).alias("offset"), F.when(F.col("n_nationkey") % 3 == 0, 4).otherwise(0).alias("length"), (F.col("n_nationkey") % 2 + 1).alias("repeat"))
    patches = n.where("n_regionkey % 2 = 0").select(F.col("n_regionkey").cast("long").alias("image"), F.lit(0).alias("offset"), F.encode(F.lit("zz"), "UTF-8").alias("data"), F.lit(False).alias("xor")).distinct()
    return arcade.images(parts, patches).select("image", "size", "md5", "fed_md5")


@query("SELECT list(DISTINCT n_name ORDER BY n_name) AS sets, ['bios.rom'] AS bios FROM nation GROUP BY n_regionkey")
def romset_lists(spark, d):
    name = F.concat(F.lit('<romset name=" '), F.col("n_name"), F.lit('"/>'))
    texts = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<!-- needs\n bios.rom\n not this.rom\n-->"), F.array_join(F.collect_list(name), "")).alias("value"))
    return arcade.romsets_of(texts).select(F.array_sort("sets").alias("sets"), "bios")


# images and bytes ----------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS path, CASE p_partkey % 6 WHEN 0 THEN 'not_an_image' WHEN 1 THEN 'other_version' WHEN 2 THEN 'truncated' WHEN 3 THEN 'has_parent' WHEN 4 THEN 'no_units' END AS reason, CASE WHEN p_partkey % 6 >= 3 THEN p_size * 2448 END::BIGINT AS logical_bytes FROM part WHERE p_size > 0")
def disc_headers(spark, d):
    number = lambda c, n: f"unhex(lpad(hex(CAST({c} AS BIGINT)), {2 * n}, '0'))"
    head = "concat(CAST(CASE WHEN p_partkey % 6 = 0 THEN 'XX' ELSE 'MC' END AS BINARY), CAST('omprHD' AS BINARY), " + ", ".join([
        number("124", 4), number("CASE WHEN p_partkey % 6 = 1 THEN 4 ELSE 5 END", 4), "CAST('zlib' AS BINARY)", "unhex(repeat('00', 12))", number("p_size * 2448", 8), "unhex(repeat('00', 16))",
        number("9792", 4), number("CASE WHEN p_partkey % 6 = 4 THEN 5 ELSE 2448 END", 4), "unhex(repeat('11', 40))", "unhex(repeat(CASE WHEN p_partkey % 6 = 3 THEN '22' ELSE '00' END, 20))",
    ]) + ")"
    rows = table(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").cast("string").alias("path"), F.expr(f"substring({head}, 1, CASE WHEN p_partkey % 6 = 2 THEN 60 ELSE 200 END)").alias("content"))
    return files.disc_headers(rows).select("path", "reason", "logical_bytes")


@query("SELECT p_partkey, p_partkey % 3 = 0 AS ines, p_partkey % 3 = 1 AS lnx, (1 + (p_partkey % 3 = 0)::INT)::BIGINT AS forms, md5(p_name) AS rest FROM part")
def header_forms(spark, d):
    head = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(unhex('4E45531A'), unhex(repeat('00', 12))) WHEN 1 THEN unhex('4C594E58') ELSE unhex('') END")
    rows = table(spark, d, "part").withColumn("content", F.concat(head, F.encode("p_name", "UTF-8")))
    forms = hashing.two_forms("content", "ines")
    rest = F.when(F.size(forms) > 1, F.md5(F.element_at(forms, -1)["bytes"])).when(F.col("p_partkey") % 3 == 1, F.md5(F.substring(F.col("content"), F.lit(5), F.octet_length("content")))).otherwise(F.md5("content"))
    return rows.select("p_partkey", F.coalesce(hashing.header_found("content", "ines"), F.lit(False)).alias("ines"), F.coalesce(hashing.header_found("content", "lnx"), F.lit(False)).alias("lnx"), F.size(forms).cast("long").alias("forms"), rest.alias("rest"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'big' WHEN 1 THEN 'swapped16' WHEN 2 THEN 'little32' END AS word_order, CASE WHEN p_partkey % 4 < 3 THEN '80371240AABBCCDD' ELSE '00371240AABBCCDD' END AS image FROM part")
def byte_orders(spark, d):
    image = F.expr("unhex(CASE p_partkey % 4 WHEN 0 THEN '80371240AABBCCDD' WHEN 1 THEN '37804012BBAADDCC' WHEN 2 THEN '40123780DDCCBBAA' ELSE '00371240AABBCCDD' END)")
    rows = table(spark, d, "part").withColumn("content", image).withColumn("word_order", hashing.word_order("content"))
    return rows.select("p_partkey", "word_order", F.hex(byte.big_endian("content", "word_order")).alias("image"))


_NAMES = f"names AS (SELECT DISTINCT p_name FROM part), crcs AS (SELECT p_name, {CRC_SQL.format('p_name')} AS crc FROM names)"


@query(f"WITH {_NAMES} SELECT p_name, printf('%08x', crc::BIGINT) AS crc32, md5(p_name) AS md5, sha1(p_name) AS sha1, length(p_name)::BIGINT AS size FROM crcs")
def content_crcs(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", *hashing.digests(F.col("p_name").cast("binary")))


@query(f"WITH {_NAMES} SELECT p_name, crc::BIGINT AS crc FROM crcs")
def crc_without_header(spark, d):
    """The CRC of the content, from the CRC of header and content, the header and the size alone."""
    rows = table(spark, d, "part").select("p_name").distinct().withColumn("head", F.unhex(F.lit("4E45531A00010203")))
    whole = F.concat("head", F.encode("p_name", "UTF-8"))
    return rows.select("p_name", byte.content_crc(F.crc32(whole), F.col("head"), F.octet_length(whole)).alias("crc"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || 'é' WHEN 1 THEN p_name || chr(1114089) || '!' ELSE chr(1114050) || p_name END AS text, p_partkey % 3 > 0 AS escaped FROM part")
def invalid_bytes_escaped(spark, d):
    """Latin-1 bytes and a stray continuation byte among names in UTF-8."""
    content = F.expr("CASE p_partkey % 3 WHEN 0 THEN encode(concat(p_name, 'é'), 'UTF-8') WHEN 1 THEN concat(encode(p_name, 'UTF-8'), unhex('E921')) ELSE concat(unhex('C2'), encode(p_name, 'UTF-8')) END")
    rows = table(spark, d, "part").select("p_partkey", byte.escape_invalid(content).alias("text"))
    return rows.withColumn("escaped", byte.has_escapes("text"))


# directories ---------------------------------------------------------------------------


def _listed(spark, d):
    return table(spark, d, "pages").select(F.concat(F.lit("/media/games/"), F.col("page_id") % 9, F.lit("/"), F.col("page_id"), F.lit(".bin")).alias("path"), F.length("html").cast("long").alias("length"), (F.col("page_id") % 4).alias("modificationTime"), "page_id")


@query("SELECT page_id, (page_id % 9)::VARCHAR AS unit FROM pages")
def unit_directories(spark, d):
    return _listed(spark, d).select("page_id", files.unit("path", "/media/games").alias("unit"))


@query("SELECT page_id, page_id % 6 < 4 AND page_id % 5 <> 0 AS walked FROM pages")
def walked_tree(spark, d):
    path = F.expr("concat('/media/_Arcade/', CASE WHEN page_id % 5 = 0 THEN '_organized/' ELSE '' END, repeat('a/', CAST(page_id % 6 AS INT)), page_id, '.mra')")
    return table(spark, d, "pages").select("page_id", files.walked(path, "/media/_Arcade").alias("walked"))


@query("SELECT page_id FROM pages WHERE page_id % 5 = 0 OR page_id % 4 = 1 OR page_id % 7 = 0")
def changed_files(spark, d):
    listed = _listed(spark, d)
    stored = listed.where("page_id % 5 != 0").select("path", F.when(F.col("page_id") % 7 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"), F.when(F.col("page_id") % 4 == 1, F.lit(9)).otherwise(F.col("modificationTime")).alias("modificationTime"))
    return files.changed(listed, stored).select("page_id")


@query("SELECT page_id % 9 AS inode, path FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/b/' ELSE 'z/' END || page_id AS path FROM pages) QUALIFY row_number() OVER (PARTITION BY page_id % 9 ORDER BY length(path) - length(replace(path, '/', '')), path) = 1")
def shallowest_paths(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 9).alias("inode"), F.concat(F.when(F.col("page_id") % 2 == 0, "a/b/").otherwise("z/"), F.col("page_id")).alias("path"))
    return files.shallowest(rows, "inode", "path")


@query("SELECT p_partkey AS entry, CASE WHEN p_partkey % 2 = 0 THEN 'snes/' || p_partkey || '/a.bin' ELSE 'snes/a.bin' END AS target, CASE WHEN p_partkey % 2 = 0 THEN 'mkdir,' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'unzip,' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'strip_header,' ELSE '' END || 'rename' AS steps FROM part")
def placement_plans(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.lit("snes").alias("domain"), F.when(F.col("p_partkey") % 2 == 0, "disc").otherwise("cartridge").alias("kind"), F.lit("a.bin").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "in/a.zip").otherwise("in/a.bin").alias("staged"), (F.col("p_partkey") % 5 == 0).alias("strip"))
    return files.placement(rows, "domain", "kind", "name").select("entry", "target", F.array_join("steps", ",").alias("steps"))

import hashlib
import io
import struct
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tally.sources import catalogues, files, torrents

LIST = """<?xml version="1.0"?><datafile><header><name>Set</name></header>
<game name="A (USA)"><description>A</description><rom name="A (USA).bin" size="10" crc="DEADBEEF" sha1="{0}"/></game>
<game name="A (Japan)" cloneof="A (USA)"><rom name="A (Japan).bin" size="x" crc="zz" status="verified"/><rom name="b" size="3"/></game></datafile>""".format("ab" * 20)
EXPORT = """<header><name>X</name></header><datafile>
<game name="P"><archive number="1" clone="1" region="USA, Europe" languages="En"/><source><file extension="bin" size="100" sha1="{0}"/><file extension="bin" format="Headered" size="116" sha1="{1}"/></source></game>
<game name="C"><archive number="2" clone="1"/><source><file format="BigEndian" size="5" crc32="00000001"/><file format="BigEndian" size="5" crc32="00000001" bad="1"/></source></game></datafile>""".format("11" * 20, "22" * 20)


def test_list(spark, tmp_path):
    (tmp_path / "a.xml").write_text(LIST)
    games = catalogues.read_games(spark, str(tmp_path))
    rows = {r["name"]: r for r in catalogues.items(games).collect()}
    assert rows["A (USA).bin"]["fault"] is None and rows["A (USA).bin"]["crc32"] == bytearray.fromhex("deadbeef")
    assert rows["A (Japan).bin"]["fault"] == "size,crc32" and rows["b"]["status"] == "good"
    assert {r["entry"]: r["parent"] for r in catalogues.parents(games).collect()} == {"A (USA)": "A (USA)", "A (Japan)": "A (USA)"}


def test_rewrite_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(LIST)

    def rewrite(source, target):
        games = catalogues.read_games(spark, str(source))
        rows = catalogues.items(games).where("fault is null").groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("name", "size", "crc32", "md5", "sha1", "status"))).alias("items"))
        catalogues.write_games(rows.join(catalogues.parents(games), "entry"), str(target))
        return sorted(catalogues.items(catalogues.read_games(spark, str(target))).select("entry", "name", "size", "sha1", "status").collect())

    assert rewrite(tmp_path / "in", tmp_path / "one") == rewrite(tmp_path / "one", tmp_path / "two")


def test_export(spark, tmp_path):
    (tmp_path / "a.xml").write_text(EXPORT)
    games = catalogues.read_export(spark, str(tmp_path))
    assert {r["entry"]: r["parent"] for r in catalogues.export_parents(games).collect()} == {"P": "P", "C": "P"}
    got = {(r["entry"], r["size"], r["bad"]) for r in catalogues.export_files(games, header=16).collect()}
    assert got == {("P", 100, False), ("C", 5, False)}
    assert catalogues.export_tags(games).where("entry = 'P'").first()["regions"] == ["USA", "Europe"]
    texts = spark.read.text(str(tmp_path), wholetext=True)
    assert catalogues.kind(texts).first()["kind"] == "export"


def test_pack_and_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("one.dat", LIST)
        z.writestr("skip.txt", "x")
    assert [(r["member"], r["xml"][:5]) for r in catalogues.read_pack(spark, str(tmp_path)).collect()] == [("one.dat", "<?xml")]
    members = files.zip_members(files.listing(spark, str(tmp_path), content=True)).orderBy("member").collect()
    assert [(r["member"], r["size"]) for r in members] == [("one.dat", len(LIST)), ("skip.txt", 1)]


JSONISH = st.recursive(st.integers(-(2**60), 2**60) | st.binary(max_size=20), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.binary(max_size=6), x, max_size=4), max_leaves=12)


@given(JSONISH)
def test_bencode_round_trip(value):
    data = torrents.encode(value)
    assert torrents.decode(data) == (value, len(data))


@pytest.mark.parametrize("bad", [b"i01e", b"i-0e", b"5:ab", b"d1:ae", b"x", b"l" * 100])
def test_bencode_refuses(bad):
    with pytest.raises((ValueError, IndexError)):
        torrents.decode(bad)


def test_torrents(spark, tmp_path):
    info = {"name": "T", "piece length": 16, "pieces": b"", "files": [{"length": 3, "path": ["d", "a.bin"]}, {"length": 4, "path": ["b.bin"]}]}
    (tmp_path / "t.torrent").write_bytes(torrents.encode({"announce": "x", "info": info}))
    (tmp_path / "u.torrent").write_bytes(b"d4:infod4:name1:xee")
    rows = torrents.read_torrents(spark, str(tmp_path)).collect()
    good = sorted((r["file"], r["size"], r["infohash"]) for r in rows if r["fault"] is None)
    h = hashlib.sha1(torrents.encode(info)).hexdigest()
    assert good == [("T/b.bin", 4, h), ("T/d/a.bin", 3, h)]
    assert sum(r["fault"] is not None for r in rows) == 1


def test_magnets(spark):
    links = [("magnet:?xt=urn:btih:" + "AB" * 20 + "&dn=a+b%20c",), ("magnet:?xt=urn:btih:" + "A" * 32,), ("magnet:?dn=x",)]
    got = [tuple(r) for r in torrents.magnets(spark.createDataFrame(links, "m string"), "m").select("infohash", "display_name").collect()]
    assert got == [("ab" * 20, "a b c"), ("00" * 20, None), (None, "x")]


def test_disc_header(spark):
    head = b"MComprHD" + struct.pack(">II", 124, 5) + b"zlib" + b"\0" * 12 + struct.pack(">QQQ", 2448 * 8, 0, 0) + struct.pack(">II", 2448 * 4, 2448) + b"\1" * 20 + b"\2" * 20 + b"\0" * 20
    got = files.disc_header(head)
    assert got["reason"] is None and got["codecs"] == ["zlib"] and got["sha1"] == b"\2" * 20
    assert files.disc_header(b"x")["reason"] == "not_an_image" and files.disc_header(head[:50])["reason"] == "truncated"


def test_listing(spark, tmp_path):
    (tmp_path / "u/v").mkdir(parents=True)
    (tmp_path / "u/a.bin").write_bytes(b"abc")
    (tmp_path / "u/v/b.txt").write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path), ("bin",))
    assert [r["length"] for r in listed.collect()] == [3]
    assert files.changed(listed, listed).count() == 0
    full = files.listing(spark, str(tmp_path), content=True)
    assert {r["md5"] for r in files.hashed(full).collect()} == {hashlib.md5(b"abc").hexdigest(), hashlib.md5(b"x").hexdigest()}


def test_mra():
    text = '<misterromdescription><NAME>G</name><setname>g</setname><rbf>core</rbf><rom Index="0" ZIP="a.zip|b.zip"><part name="x.1" crc="01"/><part>00 FF</part></rom></misterromdescription>'
    got = files.parse_mra(text)
    assert (got["name"], got["zips"], [p["name"] for p in got["parts"]]) == ("G", ["a.zip", "b.zip"], ["x.1", None])
    assert io.BytesIO  # stdlib only

import hashlib

import pytest

from tally.sources import arcade


def test_romsets(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<!-- needs:\n  exbios.rom\n not a name.rom\n--><romsets><romset name=" a "/><ROMSET pad="1" name="b"/><romset name="a"/></romsets>')
    row = arcade.read_romsets(spark, str(tmp_path)).first()
    assert (row["sets"], row["bios"]) == (["a", "b"], ["exbios.rom"])


def test_interleave():
    assert arcade.interleaved([(b"\x01\x02", "01"), (b"\x11\x12", "10")], 16) == b"\x01\x11\x02\x12"
    assert arcade.interleaved([(b"\x01\x02\x03\x04", "12")], 16) == b"\x02\x01\x04\x03"
    with pytest.raises(ValueError):
        arcade.interleaved([(b"x", "1")], 16)


def test_assemble():
    items = [{"data": b"abcd", "offset": 1, "length": 2}, {"data": b"\xff", "repeat": 3}, {"width": 16, "parts": [(b"\x01", "01"), (b"\x02", "10")]}]
    image, md5 = arcade.assemble(items, [(0, b"Z", False), (1, b"\x01", True)])
    assert image == b"Zb\xff\xff\xff\x01\x02"
    assert md5 == hashlib.md5(b"bc\xff\xff\xff\x01\x02").hexdigest()
    with pytest.raises(ValueError):
        arcade.assemble([{"data": b"a"}], [(5, b"x", False)])

import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tally.functions import bytes as tb
from tally.functions import hashing, naming, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths_and_names(spark):
    got = values(spark, [("a/b\\c.Tar.GZ",), (".hidden",), ("",), (None,)], "p string", text.leaf("p"), text.directory("p"), text.extension("p"), text.stem("p"))
    assert got == [("c.Tar.GZ", "a/b\\", "gz", "c.Tar"), (".hidden", "", "", ".hidden"), ("", "", "", ""), (None, None, None, None)]


def test_ascii_case_only(spark):
    got = values(spark, [("ÉA quest",)], "s string", text.ascii_lower("s"), text.ascii_contains("s", "éa"), text.ascii_contains("s", "a QUEST"))
    assert got == [("Éa quest", False, True)]


def test_versions(spark):
    rows = [("1.9", "1.10"), ("20260101-000000", "20260102"), ("x", "1"), ("2", "2")]
    got = values(spark, rows, "a string, b string", text.not_older("a", "b"), text.not_older("b", "a"))
    assert got == [(False, True), (False, True), (True, True), (True, True)]


def test_family_key(spark):
    rows = [("Set A (Headered)",), ("Set A (DB Export)",), ("X (2)",), ("X",), ("Set  A (20260101-1) (3.2)",)]
    assert [r[0] for r in values(spark, rows, "n string", text.family_key("n"))] == ["set a", "set a", "x", "x", "set a"]


def test_family_key_of_any_form(spark):
    same = ["Maker - Box (Headered)", "Maker - Box (DB Export)", "Maker - Box (Parent-Clone) (20240101-000000)", "maker -  Box (Headerless) (v1.2)", "Maker - Box [Retool 2024-01-01]", "Maker - Box (LittleEndian)"]
    other = {"Maker - Box (Private)": "maker - box (private)", "Maker - Box (Headered Extra)": "maker - box (headered extra)", "Box (Open": "box (open", "Box (Open [Retool]": "box (open [retool]", "Box [v1.2]": "box", "Box (20240101) (Headered) [Retool]": "box", "(Headered)": "(headered)", "(DB Export) (20240101)": "(db export) (20240101)", "": ""}
    got = values(spark, [(x,) for x in [*same, *other]], "n string", text.family_key("n"))
    assert [r[0] for r in got] == ["maker - box"] * len(same) + list(other.values())
    got = values(spark, [("Box (20240101-000000)",), ("Box [v2]",), ("Box (Europe)",)], "n string", text.split_version("n"))
    assert [tuple(r[0]) for r in got] == [("Box", "20240101-000000"), ("Box", "v2"), ("Box (Europe)", None)]


def test_words_without_versions(spark):
    want = {"some_quest_v2": ["some", "quest"], "Rev 1 quest": ["quest"], "rev b2 quest": ["b2", "quest"], "1.0.6 v2": [], "name.v1.2": ["name"], "abc1": ["abc1"], "A-a b_B 3": ["a", "a", "b", "b", "3"], "Quest 2 (USA)": ["quest", "2"], "tale1.0.6": ["tale"], "tale..1.0": ["tale"], "version rev a": [], "a.b c": ["a", "b", "c"]}
    got = values(spark, [(x,) for x in want], "n string", text.words("n"))
    assert [r[0] for r in got] == list(want.values())


def test_words_and_sequels(spark):
    rows = [("Nova1.0.6 the Squirrel (USA)",), ("Quest v1.2 II",), ("",)]
    assert [r[0] for r in values(spark, rows, "n string", text.words("n"))] == [["nova", "the", "squirrel"], ["quest", "ii"], []]
    assert values(spark, [("ii",), ("7",), ("the",)], "w string", text.is_sequel(F.col("w"))) == [(True,), (True,), (False,)]


def test_percent_and_lists(spark):
    assert values(spark, [("a b~/ü",)], "s string", text.percent_encode("s")) == [("a%20b~%2F%C3%BC",)]
    assert values(spark, [(" a, ,b ",)], "s string", text.split_list("s")) == [(["a", "b"],)]
    assert values(spark, [("DEADbeef",), ("dead",)], "s string", text.hex_digest("s", 4)) == [(bytearray.fromhex("deadbeef"),), (None,)]


def test_digests_and_headers(spark):
    body = bytes(range(64))
    rows = [(bytearray(b"abc"),), (bytearray(b"NES\x1a" + b"\0" * 12 + body),)]
    got = values(spark, rows, "c binary", *hashing.digests("c"), hashing.header_found("c", "ines"), F.size(hashing.two_forms("c", "ines")))
    assert got[0] == ("352441c2", "900150983cd24fb0d6963f7d28e17f72", "a9993e364706816aba3e25717850c26c9cd0d89d", 3, False, 1)
    assert got[1][3:] == (80, True, 2)


def test_bits(spark):
    got = values(spark, [("usa",), ("Atlantis",), (None,)], "r string", hashing.bit_of("r", ["world", "usa"]))
    assert got == [(2,), (1 << 62,), (None,)]


@given(st.binary(max_size=40), st.binary(max_size=300))
def test_crc_of_the_rest(head, rest):
    assert tb.strip_crc(zlib.crc32(head + rest), head, len(rest)) == zlib.crc32(rest)


def test_byte_order():
    assert tb.swapped(b"\x37\x80\x40\x12x", "swapped16") == b"\x80\x37\x12\x40x"
    assert tb.swapped(b"\x40\x12\x37\x80", "little32") == b"\x80\x37\x12\x40"


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Example Quest (USA, Europe) (En,Fr) (Rev 1) [b]", {"base_name": "Example Quest", "regions": ["USA", "Europe"], "languages": ["En", "Fr"], "revision": "Rev 1", "version": [1, 1, 0, 0], "flags": ["baddump"]}),
        ("[BIOS] Console (Japan) (v2.1)", {"base_name": "Console", "flags": ["bios"], "version": [2, 1, 0, 0]}),
        ("Saga (Atlantis, usa) (Disc 2) (Unl)", {"regions": ["Atlantis", "USA"], "disc": 2, "flags": ["unl"]}),
        ("Odd (a (nested) tag) (Beta 3)", {"base_name": "Odd", "flags": ["other:a (nested) tag", "beta"], "stage": 1, "pre": 3}),
        ("Open (bracket", {"base_name": "Open (bracket", "flags": []}),
        ("", {"base_name": "", "regions": []}),
    ],
)
def test_parse_name(name, want):
    got = naming.parse_name(name)
    assert {k: got[k] for k in want} == want


@given(st.text(max_size=60))
def test_parse_name_never_fails(name):
    naming.parse_name(name)
    naming.match_text(name)


def test_name_columns(spark):
    rows = [("Example:  Quest ＆ Co (USA)",), (None,)]
    got = values(spark, rows, "n string", naming.parsed_name("n")["base_name"], naming.normalize_for_match("n"))
    assert got == [("Example:  Quest ＆ Co", "example_ quest _ co (usa)"), ("", None)]

"""Text functions as native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: Roman numerals, version words and marker words that the formats define
SEQUEL_NUMERALS = ("ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")
VERSION_WORDS = ("rev", "ver", "version")
FORMAT_MARKERS = ("db export", "headered", "headerless", "parent clone", "retool", "bigendian", "byteswapped", "littleendian")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower case of A-Z alone, as SQL NOCASE compares."""
    return F.translate(_col(c), _UPPER, _LOWER)


def ascii_contains(c, needle: str) -> Column:
    """Substring test that ignores the case of A-Z; the needle has no wildcards."""
    return _col(c).rlike("(?i)" + re.escape(needle))


def leaf(c) -> Column:
    """Last component of a path with either slash."""
    return F.regexp_extract(_col(c), r"[^/\\]*$", 0)


def directory(c) -> Column:
    """What stands before the leaf, with its slash."""
    return F.regexp_extract(_col(c), r"^(.*[/\\])?[^/\\]*$", 1)


def extension(c) -> Column:
    """Lower-case extension of a leaf without its dot; empty for none or a leading dot."""
    return ascii_lower(F.regexp_extract(leaf(c), r"^.+\.([^.]+)$", 1))


def stem(c) -> Column:
    """A leaf without its extension; a leading dot is part of the stem."""
    return F.regexp_replace(leaf(c), r"^(.+)\.[^.]*$", "$1")


def base_name(c) -> Column:
    """A name before its first opening bracket."""
    return F.rtrim(F.substring_index(_col(c), "(", 1))


def collapse(c) -> Column:
    return F.btrim(F.regexp_replace(_col(c), r"\s+", " "))


def binding_name(c) -> Column:
    """Letters and digits in lower case, all else one blank, brackets dropped with their content."""
    bare = F.regexp_replace(_col(c), r"\([^()]*\)|\[[^\[\]]*\]", " ")
    return collapse(F.regexp_replace(ascii_lower(bare), r"[^\p{L}\p{N}]+", " "))


def version_order(c) -> Column:
    """Digit runs of a version as longs, comparable in order; null without digits."""
    runs = F.filter(F.split(_col(c), "[^0-9]+"), lambda x: x != "")
    return F.when(F.size(runs) > 0, F.transform(runs, lambda x: x.cast("long")))


def not_older(new, current) -> Column:
    """Whether a version is as new as another; incomparable ones count as newer."""
    return F.coalesce(version_order(new) >= version_order(current), F.lit(True))


#: The inside of a version group: digits with marks, perhaps after a v.
_VERSION_GROUP = r"\s*[vV]?[.\-_: ]*[0-9][0-9.\-_: ]*"


def split_version(c) -> Column:
    """(name, version): a trailing version group cut off a name; version is null without one."""
    pattern = rf"^(.*?)\s*(?:\(({_VERSION_GROUP})\)|\[({_VERSION_GROUP})\])$"
    bare = F.btrim(_col(c))
    version = F.btrim(F.concat(F.regexp_extract(bare, pattern, 2), F.regexp_extract(bare, pattern, 3)))
    has = bare.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(bare, pattern, 1)).otherwise(bare).alias("name"), F.when(has, version).alias("version"))


def family_key(c) -> Column:
    """A catalogue name without format markers (a date may follow one) and trailing versions, in lower case.

    A name that is nothing else keeps its text. Groups are read from the left; from
    one that does not close on, nothing is taken for a group.
    """
    markers = "|".join(m.replace(" ", "[ _-]+") for m in FORMAT_MARKERS)
    marker = rf"(?i:[ _-]*(?:{markers})(?:[ _-]+[0-9.: _-]*)?)"
    other = rf"[^(\[]|\((?!{marker}\))[^)]*\)|\[(?!{marker}\])[^\]]*\]"
    bare = F.regexp_replace(collapse(c), rf"\G((?:{other})*+)(?:\({marker}\)|\[{marker}\])", "$1")
    cut = F.regexp_replace(collapse(bare), rf"(?:\s*(?:\({_VERSION_GROUP}\)|\[{_VERSION_GROUP}\]))+$", "")
    return F.lower(F.coalesce(F.nullif(collapse(cut), F.lit("")), collapse(c)))


def is_version_tag(word: Column) -> Column:
    """v2, v1.0.6, 1.0.6, and the words that announce a version."""
    return word.rlike(r"^(?:v[0-9]+(?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)+)$") | word.isin(*VERSION_WORDS)


def words(c) -> Column:
    """Lower-case words of a name up to its first bracket, without versions.

    A version tag, a version glued to a word, and a letter or number after "rev" are left out.
    """
    low = F.regexp_replace(F.lower(_col(c)), r"(?s)[(\[].*$", "")
    chunks = F.transform(F.split(low, r"[\s\p{Z}_+-]"), lambda x: F.btrim(x, F.lit(".")))
    cut = F.transform(chunks, lambda x: F.when(is_version_tag(x), x).otherwise(F.regexp_replace(x, r"^(.+?)\.*(?:\.v[0-9]+(?:\.[0-9]+)*|(?<!\.)[0-9]+(?:\.[0-9]+)+|(?<=\.)[0-9]+(?:\.[0-9]+)+)$", "$1")))

    def kept(all_: Column) -> Column:
        after_rev = lambda i: F.coalesce(F.get(all_, i - 1) == "rev", F.lit(False))
        return F.filter(all_, lambda x, i: (x != "") & ~is_version_tag(x) & ~(after_rev(i) & ((F.octet_length(x) == 1) | x.rlike("^[0-9]+$"))))

    named = F.element_at(F.transform(F.array(cut), kept), 1)
    return F.filter(F.flatten(F.transform(named, lambda w: F.split(w, r"[^\p{IsAlphabetic}\p{N}]+"))), lambda w: w != "")


def is_sequel(word: Column) -> Column:
    """Whether a word numbers a sequel: digits, or Roman numerals from ii to xx."""
    return word.rlike("^[0-9]+$") | word.isin(*SEQUEL_NUMERALS)


def is_language_code(token: Column) -> Column:
    return token.rlike("^[A-Z][a-z](-[A-Za-z]{2,4})?$")


def is_bad_dump(tag: Column) -> Column:
    return tag.rlike("^b[0-9]*$")


def split_list(c, sep: str = ",") -> Column:
    """A separated list, trimmed, empties left out."""
    return F.filter(F.transform(F.split(_col(c), sep), lambda x: F.btrim(x)), lambda x: x != "")


def tags(c) -> Column:
    """Contents of the round brackets of a name, outermost, in order."""
    return F.regexp_extract_all(_col(c), F.lit(r"\(([^()]*)\)"), F.lit(1))


def safe_name(c) -> Column:
    """A name that may be a file: no separators or control characters; null if nothing is left."""
    clean = F.btrim(F.regexp_replace(_col(c), r'[\x00-\x1f/\\:*?"<>|]', "_"), F.lit(" ."))
    return F.when(clean != "", clean)


def own_tail(title, name) -> Column:
    """What a name adds to its title; null if it does not start with it."""
    return F.when(F.startswith(_col(name), _col(title)), F.substring(_col(name), F.length(_col(title)) + 1, F.length(_col(name))))


def compose_name(title, tail, own) -> Column:
    """The full name again: the own name, or the title and the tail."""
    return F.when(_col(own), _col(tail)).otherwise(F.concat(_col(title), _col(tail)))


def percent_encode(c) -> Column:
    """URL encoding that keeps ~ and writes blanks as %20."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(_col(c)), r"\+", "%20"), "%7E", "~")


def subject_key(c) -> Column:
    """Sorted key-value pairs of a flat JSON object as one text."""
    entries = F.map_entries(F.from_json(_col(c), "map<string,string>"))
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x1f"), e["value"]))), "\x1e")


def prefix_range(path, prefix: str) -> Column:
    """Paths under a directory as a range that the scan can prune."""
    return (_col(path) >= prefix) & (_col(path) < prefix[:-1] + chr(ord(prefix[-1]) + 1))


def hex_digest(c, size: int) -> Column:
    """Bytes of a hexadecimal digest of the given size, else null."""
    low = ascii_lower(F.btrim(_col(c)))
    return F.when(low.rlike(f"^[0-9a-f]{{{2 * size}}}$"), F.unhex(low))


def export_name(c) -> Column:
    """(name, version) of a file "<system> (DB Export) (<version>)"; null for other names, the version empty if it is missing."""
    bare = F.regexp_replace(leaf(c), r"(?i)\.(?:xml|dat|zip)$", "")
    pattern = r"(?is)^\s*(.*?)\s*\(db export\)\s*(?:\(\s*([^)]*?)\s*\))?"
    system = F.regexp_extract(bare, pattern, 1)
    found = F.struct(F.concat(system, F.lit(" (DB Export)")).alias("name"), F.regexp_extract(bare, pattern, 2).alias("version"))
    return F.when(bare.rlike(pattern) & (system != ""), found)


def percent_decode(c) -> Column:
    """The bytes of a text with its %XX escapes decoded; a malformed escape stays as it is."""
    parts = F.regexp_extract_all(_col(c), F.lit("(?s)(%[0-9A-Fa-f]{2}|%|[^%]+)"), F.lit(1))
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))), ""))


def name_fits(path, item, own_extensions: tuple[str, ...] = ()) -> Column:
    """Whether a file may be called as it is for an item: the same leaf, or the same stem with one of a domain's extensions."""
    same = leaf(path) == leaf(item)
    return same | ((stem(path) == stem(item)) & extension(path).isin(*own_extensions)) if own_extensions else same


def member_range(c, container: str, nocase: bool = False) -> Column:
    """Paths of the members of a container, "<container>/...", as a range of the column; without regard to the case of A-Z if asked."""
    return prefix_range(ascii_lower(c), container.translate(str.maketrans(_UPPER, _LOWER)) + "/") if nocase else prefix_range(c, container + "/")


def track_number(c) -> Column:
    """The number at the end of a member's stem; null without one."""
    return F.nullif(F.regexp_extract(_col(c), r"([0-9]{1,9})\D*(?:\.[^.]*)?$", 1), F.lit("")).cast("int")


def known_words(c, known: tuple[str, ...]) -> Column:
    """The words of a status text that are known flags, in their order, once each, whatever their case."""
    found = F.filter(F.split(ascii_lower(c), r"[^a-z0-9]+"), lambda w: w.isin(*known))
    return F.array_distinct(found)


def spaced_hex(c) -> Column:
    """Bytes of hexadecimal digits with blanks between them; null for other text."""
    bare = F.regexp_replace(_col(c), r"\s+", "")
    return F.when(bare.rlike("^(?:[0-9A-Fa-f]{2})+$"), F.unhex(bare))


def seed_policy(c) -> Column:
    """(policy, ratio) of "none", "client" or "ratio <number above zero>"; null for other text."""
    bare = F.btrim(ascii_lower(c))
    ratio = F.nullif(F.regexp_extract(bare, r"^ratio ([0-9]{1,9}(?:\.[0-9]{1,9})?)$", 1), F.lit("")).cast("double")
    return F.when(bare.isin("none", "client"), F.struct(bare.alias("policy"), F.lit(None).cast("double").alias("ratio"))).when(ratio > 0, F.struct(F.lit("ratio").alias("policy"), ratio.alias("ratio")))

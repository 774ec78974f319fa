r"""Fuzzy line dedup over the whole corpus, on DataFrame functions alone.

Lines are normalised (lower case, digits as 0, white space runs as one blank);
lines of fewer than ``MIN_WORDS`` words stay as they are. Equal normalised lines
are one id (the XXH64 of their words' XXH64). Two different lines are candidates if

* their SimHashes, over their distinct words, differ in at most ``BUDGET`` bits, or
* both have at most ``SHORT`` words and they are equal but for one word, which is
  replaced, added or lost (a SimHash says little about so few words).

Candidates are linked if their edit similarity, 1 - distance / longer length, is at
least ``SIMILARITY`` in words or in characters. Of all lines in one connected group
the first, by doc_id, row and place, stays; the others go. A document that loses all
its words goes, too. No candidate is missed and none is decided by a part of it.

The join on pigeonhole blocks: of BUDGET + k blocks of bits, k agree, so lines meet
in a key for each choice of k blocks. k grows with the number of lines (``BLOCKS``),
which keeps the lines by chance in a key few; any k finds the same pairs. A key of
over ``HOT`` lines is cut further: the bits outside it fall into BUDGET + 1 parts, of
which one agrees. For the short lines a key is the sum of the hashes of all words
but one, or of all.

Keys are counted, map-side first, and only keys of two different lines or more are
joined back. A group of many similar lines is not expanded into pairs: each key first
links its lines to the least of them, and only lines that are in different components
after that are compared with each other. What the second join leaves out joins
nothing new, so no link is lost. Lines that are repeated so often that one task would
feel it are at most ``MOST`` and are joined by broadcast, all others by their ids.

Texts are moved once: into a table bucketed by row number. The lines of candidate
pairs are fetched by row, and the result is cut by row, which the buckets already
hold together.

With ``runs``, lines that share a run of two to four words are candidates as well: a
line of L words has over 0.2 L disjoint runs of three words (two at five words, four
from twenty on), so one of them survives up to 0.2 L word edits. Lines of fewer than
twenty words have all their runs as keys: of these, no pair of similarity 0.8 in words
is lost. Longer ones have the runs of four that start at multiples of four from either
end: no pair is lost that differs by replaced words, nor by words added or lost while
a run before the first or after the last of these is whole. That costs a key for every
second word, and common runs bring many pairs; it is meant for small tables.

Defined results: null and empty texts, and short lines, pass unchanged; rows of
the same doc_id are documents of their own; an empty table gives an empty result.
Other columns pass through, whatever their names: the operator's own columns lie
beside a struct of the caller's.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import block_masks, bucket_count, drop_table, parts, signed, word_count, written, written_by
from .graph import components

MIN_WORDS = 5
SIMILARITY = 0.8
BUDGET = 3
SHORT = 32
#: (lines up to which, blocks that agree): 10 keys of 25 bits, 20 of 32, 35 of 36, 56 of 40. Few keys have more than two lines by chance.
BLOCKS = ((1 << 22, 2), (1 << 28, 3), (1 << 32, 4), (1 << 62, 5))
#: Lines in a key from which it is cut by the bits outside it.
HOT = 64
#: Lines that are repeated over 1 / MOST of all lines each.
MOST = 1000
#: Keys that a task counts before they are shuffled.
KEYS = 1 << 19
#: Keys up to which the list of shared keys is broadcast (16 bytes each).
BROADCAST_KEYS = 1 << 20
_SUMS = (1 << 62) - 1
#: The low bits of four and of two counters in a long, and the hashes that 16 bits count.
_ONES16, _ONES32, MOST_COUNTED = 0x0001000100010001, 0x0000000100000001, 16_383
#: Hashes of a list that are added up before they reach its counters.
EACH = 8


def folded(text: Column) -> Column:
    """A text in lower case, with digits as 0."""
    return F.lower(F.regexp_replace(text, "[1-9]", "0"))


def line_words(line: Column) -> Column:
    """Words of a folded line."""
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def word_codes(words: Column) -> Column:
    """A text of one character a word, by a hash to 917,504 of them, so that Levenshtein distance counts words."""
    code = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xE0000)) + F.lit(0x10000)), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _let(value: Column, fn) -> Column:
    """fn of a value that is computed once, not once a mention."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _majority(sums: list[Column], ones: int, bit: int) -> Column:
    """The bits that over half of n have; sum k holds counters of bits k, k + step, ... ; lifted, a counter has bit ``bit`` if it is over half."""
    lift = F.lit(ones) * (F.lit((1 << bit) - 1) - F.floor(F.col("n") / 2))
    return _or([F.shiftleft(F.shiftrightunsigned((s + lift).bitwiseAND(F.lit(ones << bit)), bit), k) for k, s in enumerate(sums)])


def eights(lists: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (the size of the list), part (MOST_COUNTED hashes, about) and h0, h1, ...: EACH hashes a row of rows (keys, hashes), the last ones 0."""
    n = F.size("hashes")
    rows = lists.where(n > 0).select(*keys, n.alias("n"), "hashes", F.explode(F.sequence(F.lit(0), n - 1, F.lit(EACH))).alias("at"))
    hashes = [F.coalesce(F.get("hashes", F.col("at") + j), F.lit(0).cast("long")).alias(f"h{j}") for j in range(EACH)]
    return rows.select(*keys, "n", F.floor(F.col("at") / MOST_COUNTED).alias("part"), *hashes)


def simhashes(lists: DataFrame, keys: list[str], label: str = "simhashes") -> DataFrame:
    """keys and sh of rows (keys, hashes): the bits that over half of a list's hashes have, for lists of any length.

    Counters of 16 bits, four in a sum, add up some MOST_COUNTED hashes each; only lists longer than that go on
    to counters of 32 bits. The sums are compiled code over rows of EACH hashes, so that a list is looked up
    once for so many; a loop over an array is not compiled.
    """
    rows = eights(lists, keys)
    counted = [[F.shiftrightunsigned(f"h{j}", k).bitwiseAND(F.lit(_ONES16)) for j in range(EACH)] for k in range(16)]
    sums = [F.sum(reduce(add, c)).alias(f"s{k}") for k, c in enumerate(counted)]
    names = [f"s{k}" for k in range(16)]
    rows = rows.groupBy(*keys, "n", "part").agg(*sums)
    few = F.col("n") <= MOST_COUNTED
    sh = F.when(few, _majority([F.col(s) for s in names], _ONES16, 14))
    found = written(rows.select(*keys, "n", sh.alias("sh"), F.when(~few, F.array(*names)).alias("sums")), label)
    long = found.where("sums is not null")
    if long.isEmpty():
        return found.select(*keys, "sh")
    wide = [F.sum(F.shiftrightunsigned(F.get("sums", F.lit(k)), 16 * m).bitwiseAND(F.lit(0xFFFF * _ONES32))).alias(f"w{16 * m + k}") for m in range(2) for k in range(16)]
    long = long.groupBy(*keys, "n").agg(*wide).select(*keys, _majority([F.col(f"w{k}") for k in range(32)], _ONES32, 30).alias("sh"))
    return found.where("sums is null").select(*keys, "sh").unionByName(long)


def short_keys(hashes: Column) -> Column:
    """Of a line of at most SHORT words: the sums of its words' hashes without one of them, and with all."""

    def keys(total: Column) -> Column:
        each = F.array_append(F.array_distinct(hashes), F.lit(0).cast("long"))
        return F.transform(each, lambda h: (total - h.bitwiseAND(F.lit(_SUMS))).bitwiseAND(F.lit(_SUMS)))

    total = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + h.bitwiseAND(F.lit(_SUMS))).bitwiseAND(F.lit(_SUMS)))
    return F.when(F.size(hashes) <= SHORT, _let(total, keys)).otherwise(F.array().cast("array<bigint>"))


def run_keys(words: Column) -> Column:
    """Hashes of the runs of words that a line is compared by."""
    n, none = F.size(words), F.array().cast("array<bigint>")

    def at(starts: Column, q: int) -> Column:
        return F.when(n >= q, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, q)))).otherwise(none)

    two, three, four = (at(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), q) for q in (2, 3, 4))
    left = F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1)), F.lit(4))
    blocks = F.concat(at(left, 4), at(F.transform(left, lambda i: i + n % 4), 4))
    return F.array_distinct(F.when(n < 6, F.concat(two, three)).when(n < 16, three).when(n < 20, F.concat(three, four)).otherwise(blocks))


def _lines(prepared: DataFrame, min_words: int, runs: bool) -> DataFrame:
    """row, did (the doc_id), pos, id, sh and more (further keys) of every line that is long enough."""

    def facts(words: Column, i: Column) -> Column:
        def found(hashes: Column) -> Column:
            more = F.concat(short_keys(hashes), run_keys(words)) if runs else short_keys(hashes)
            return F.struct(i.alias("pos"), F.xxhash64(hashes).alias("id"), F.array_distinct(hashes).alias("hashes"), more.alias("more"))

        return F.when(F.size(words) >= min_words, _let(F.transform(words, lambda w: F.xxhash64(w)), found))

    def line(x: Column, i: Column) -> Column:
        return F.when(F.length(x) >= 2 * min_words - 1, _let(line_words(x), lambda words: facts(words, i)))

    # in one expression before the rows part, so that no filter is pushed down and computes it again
    found = F.filter(F.transform(F.split(folded(F.col("doc.text")), "\n"), line), lambda x: x.isNotNull())
    rows = prepared.select("row", F.col("doc.doc_id").alias("did"), F.explode(found).alias("x")).select("row", "did", "x.*")
    return simhashes(rows, ["row", "did", "pos", "id", "more"], "lines-hashes")


def _ids(lines: DataFrame) -> DataFrame:
    """id, sh, more, at (the first place of such a line) and n (how many there are)."""
    at = F.struct(F.col("did").isNull().alias("no_id"), "did", "row", "pos")
    return written(lines.groupBy("id").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.min("sh").alias("sh"), F.first("more").alias("more")), "lines-ids")


def _shared(keyed: DataFrame, label: str, blocks: bool) -> DataFrame:
    """(key, block, id, sh, n) of the rows (key, block, id, sh) whose key has n > 1 of them.

    Of block keys, those of two lines alone that differ in too many bits are left out at
    once: that is most of what meets by chance.
    """
    counts = [F.count("*").alias("n"), *([F.bit_xor("sh").alias("x")] if blocks else [])]
    keys = keyed.groupBy("key").agg(*counts).where("n > 1")
    keys = written((keys.where((F.col("n") > 2) | (F.bit_count("x") <= BUDGET)) if blocks else keys).select("key", "n"), f"{label}-keys")
    small = keys.count() <= BROADCAST_KEYS
    found = written(keyed.join(F.broadcast(keys) if small else keys, "key").select("key", "block", "id", "sh", "n"), label)
    drop_table(keys)
    return found


def _members(ids: DataFrame) -> DataFrame:
    """Lines by the keys that they share with others: key, block (null for further keys), id, sh, n."""
    n = ids.count()
    masks = block_masks(BUDGET, next(agree for most, agree in BLOCKS if n <= most))
    keys = [F.struct(F.xxhash64(F.lit(k), F.col("sh").bitwiseAND(signed(m))).alias("key"), F.lit(k).alias("block")) for k, m in enumerate(masks)]
    further = F.transform("more", lambda x: F.struct(x.alias("key"), F.lit(None).cast("int").alias("block")))
    # dealt out so that a task counts some KEYS keys in memory
    rows = ids.select("id", "sh").repartition(max(1, n * len(keys) // KEYS))
    blocks = rows.select(F.explode(F.array(*keys)).alias("k"), "id", "sh").select("k.key", "k.block", "id", "sh")
    others = ids.where(F.size("more") > 0).select(F.explode(further).alias("k"), "id", "sh").select("k.key", "k.block", "id", "sh")
    near, more = _shared(blocks, "lines-shared", True), _shared(others, "lines-short", False)
    hot = near.where(f"n > {HOT}")
    if hot.isEmpty():
        return near.unionByName(more)
    rest = [[signed(p) for p in parts([b for b in range(64) if not m >> b & 1], BUDGET + 1)] for m in masks]
    outside = F.get(F.array(*[F.array(*r) for r in rest]), F.col("block"))
    cut = hot.select(F.explode(F.transform(outside, lambda p: F.xxhash64("key", p, F.col("sh").bitwiseAND(p)))).alias("key"), "block", "id", "sh")
    return near.where(f"n <= {HOT}").unionByName(more).unionByName(_shared(cut, "lines-cut", True))


def _close(a: str, b: str) -> Column:
    """Whether two lines of a key can be linked: any of a further key, those within the budget of a block key."""
    return F.col("block").isNull() | (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BUDGET)


def _edits(a: str, b: str) -> Column:
    """Whether two texts have an edit similarity of SIMILARITY, by characters."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    room = f"cast(floor(greatest(length({a}), length({b})) * {1 - SIMILARITY:.6f} + 0.000001) as int)"
    return (shorter >= SIMILARITY * longer - 0.000001) & F.expr(f"levenshtein({a}, {b}, {room}) between 0 and {room}")


def _linked(pairs: DataFrame, ids: DataFrame, prepared: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose lines are similar enough in words, or in characters."""
    pairs = written(pairs.distinct(), "lines-pairs")
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    first = ids.join(wanted, "id", "left_semi").select("id", "at.row", "at.pos")
    by_row = first.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "id"))).alias("want"))
    read = prepared.select("row", F.col("doc.text").alias("text")).join(by_row, "row")
    # the lines that are wanted, cut out of the split text before any of them becomes a row
    cut = _let(F.split("text", "\n"), lambda x: F.transform(F.map_entries("want"), lambda e: F.struct(e["value"].alias("id"), F.get(x, e["key"]).alias("line"))))
    read = read.select(F.explode(cut).alias("x")).select("x.id", line_words(folded(F.col("x.line"))).alias("words"))
    texts = written(read.select("id", word_codes(F.col("words")).alias("codes"), F.array_join("words", " ").alias("plain")), "lines-texts")
    sides = [texts.select(F.col("id").alias(k), F.col("codes").alias(f"{k}_codes"), F.col("plain").alias(f"{k}_plain")) for k in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    found = written(both.where(_edits("u_codes", "v_codes") | _edits("u_plain", "v_plain")).select("u", "v"), "lines-links")
    drop_table(pairs)
    drop_table(texts)
    return found


def groups(ids: DataFrame, prepared: DataFrame) -> DataFrame:
    """(node, root): ids of lines that are linked to others, with the least id of their component."""
    members = _members(ids)
    firsts = members.groupBy("key").agg(F.min("id").alias("first"), F.min_by("sh", "id").alias("first_sh"))
    stars = members.join(firsts, "key").where(F.col("id") != F.col("first")).where(_close("sh", "first_sh")).select(F.col("first").alias("u"), F.col("id").alias("v"))
    roots = written(components(_linked(stars, ids, prepared)), "lines-roots")
    known = members.join(roots, members["id"] == roots["node"], "left").select("key", "block", "id", "sh", F.coalesce("root", "id").alias("root"))
    # keys whose lines are all in one component have nothing more to compare
    open_keys = known.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("key")
    known = written(known.join(open_keys, "key", "left_semi"), "lines-open")
    a, b = (known.select("key", *([F.col("block")] if side == "a" else []), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "sh", "root")]) for side in "ab")
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("a_root") < F.col("b_root"))).where(_close("a_sh", "b_sh"))
    more = _linked(rest.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), ids, prepared)
    drop_table(known)
    drop_table(members)
    if more.isEmpty():
        return roots
    return written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "lines-roots")


def _gone(lines: DataFrame, ids: DataFrame, roots: DataFrame) -> DataFrame:
    """(row, gone): the places of the lines that go."""
    ids = written(ids.join(roots, ids["id"] == roots["node"], "left").select("id", "at", "n", F.coalesce("root", "id").alias("root")), "lines-rooted")
    firsts = ids.groupBy("root").agg(F.min("at").alias("first"), F.sum("n").alias("all")).where("all > 1").select("root", "first")
    known = written(ids.join(firsts, "root").select("id", "n", F.col("first.row").alias("f_row"), F.col("first.pos").alias("f_pos")), "lines-firsts")
    bar = lines.count() // MOST
    often = known.where(F.col("n") > bar)
    places = lines.select("id", "row", "pos")
    hot = places.join(F.broadcast(often), "id")
    rest = places.join(F.broadcast(often.select("id")), "id", "left_anti").join(known.where(F.col("n") <= bar), "id")
    found = hot.unionByName(rest).where("row != f_row or pos != f_pos")
    return found.groupBy("row").agg(F.collect_list("pos").alias("gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False, runs: bool = False) -> DataFrame:
    """docs without repeated lines, documents that lost all words left out.

    counts: keep every document, and add n_lines and n_removed.
    runs: lines that share a run of words are candidates as well.
    """
    n = bucket_count(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    prepared = written_by(rows.repartition(n, "row"), "lines", "row", n)
    lines = _lines(prepared, min_words, runs)
    ids = _ids(lines)
    rows = prepared.join(_gone(lines, ids, groups(ids, prepared)), "row", "left")
    text = F.col("doc.text")
    kept = _let(F.split(text, "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)))
    rows = rows.withColumn("cut", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")))
    columns = []
    for f in docs.schema.fields:
        c = F.col("doc").getField(f.name)
        if f.name == "text":
            c = F.col("cut")
        elif f.name == "n_chars":
            c = F.when(F.col("gone").isNull(), c).otherwise(F.length("cut")).cast(f.dataType)
        columns.append(c.alias(f.name))
    if counts:
        lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
        return rows.select(*columns, lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return rows.where(F.col("gone").isNull() | (word_count("cut") > 0)).select(columns)

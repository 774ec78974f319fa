"""Quality rules: per-document counts, and lines that too many documents of a host share.

One Arrow pass over the texts gives each row its counts and the hashes of its
distinct normalised lines (lower case, digits as 0, white space runs as one
blank). A line is frequent on a host (``source``) if more documents than
``max(LIMIT_DOCS, LIMIT_SHARE * documents of the host)`` hold it. Frequent lines
go; a document that keeps less than half of its words is rejected as depleted.

Counting is on (host, line) with map-side sums, so a line in a third of all rows
costs one row a task. The list of frequent lines is broadcast only if it has at
most ``BROADCAST_LINES`` rows; else it is joined by shuffle, where adaptive
execution splits hot lines.

Defined results: a null text has no words and no lines; a null host is a host of
its own; every row is a document, also where doc_ids repeat; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
LIMIT_DOCS = 20
LIMIT_SHARE = 0.02
BROADCAST_LINES = 200_000
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in windows found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    code, span = ids[:n], len(names)
    for k in range(1, window):
        if code.max() > (1 << 62) // max(1, len(names)):
            code = np.unique(code, return_inverse=True)[1]
        code = code * span + ids[k : n + k]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(len(words), bool)
    for k in range(window):
        cover[k : n + k] |= twice
    return int(cover.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), int(((joined & 0xC0) != 0x80).sum()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def line_hash(line: bytes) -> int:
    """Hash of a normalised line as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().translate(_DIGITS).split()))
    return h - (1 << 64) if h >> 63 else h


def line_words(text: bytes | None) -> dict[int, int]:
    """Words in each distinct normalised line."""
    found: dict[int, int] = {}
    for line in text.split(b"\n") if text else ():
        if n := len(line.split()):
            h = line_hash(line)
            found[h] = found.get(h, 0) + n
    return found


MEASURED = "row bigint, doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, line_words array<int>"


def _measure(batches):
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts, n = batch.column("text"), batch.num_rows
        counts, lines, sizes = [], [], []
        for i in range(n):
            text = texts[i].as_py()
            counts.append(base_counts(text))
            found = line_words(text)
            lines.append(list(found))
            sizes.append(list(found.values()))
        columns = np.array(counts, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("host"), *map(pa.array, columns), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
            names=[x.split()[0] for x in MEASURED.split(", ")],
        )
        row += n


def measure(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(_measure, MEASURED), "rules")


def frequent_lines(measured: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """(host, line): the lines above the limit of their host, null hosts as ''+flag."""
    host = [F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host")]
    docs = measured.groupBy(*host).agg(F.count("*").alias("docs"))
    counts = measured.select(*host, F.explode("lines").alias("line")).groupBy("h", "no_host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit_docs)
    return counts.join(docs, ["h", "no_host"]).where(F.col("n") > F.col("docs") * limit_share).select("h", "no_host", "line")


def removed_words(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, removed): words in frequent lines of each row that has any."""
    lines = measured.select("row", F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host"), F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lines = lines.select("row", "h", "no_host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    few = frequent.count() <= BROADCAST_LINES
    hit = lines.join(F.broadcast(frequent) if few else frequent, ["h", "no_host", "line"])
    return hit.groupBy("row").agg(F.sum("words").alias("removed"))


def judge(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """doc_id, the counts, base_failed, n_removed_words and kept of every row."""
    measured = measure(docs)
    frequent = written(frequent_lines(measured, limit_docs, limit_share), "rules-lines")
    rows = measured.drop("lines", "line_words").join(removed_words(measured, frequent), "row", "left").withColumn("n_removed_words", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = 2 * F.col("n_removed_words") > F.col("n_words")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words")


def _strip(column: str):
    def run(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if text is not None and gone:
                    drop = set(gone)
                    text = b"\n".join(x for x in text.encode().split(b"\n") if not x.split() or line_hash(x) not in drop).decode()
                out.append(text)
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return run


def without_frequent_lines(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """docs with the frequent lines of their hosts taken out of the texts; other columns pass through, whatever their names.

    A row gets the list of its own lines that go, never that of its host.
    """
    row, lost = fresh(docs.columns, "row", "gone")
    # rows are numbered in a table, so that both sides of the join see the same numbers
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "rules-docs")
    host = [F.coalesce("source", F.lit("")).alias("h"), F.col("source").isNull().alias("no_host")]
    lines = docs.select(F.col(row).alias("row"), *host, F.col("text").cast("binary").alias("text")).mapInArrow(_hashes, "row bigint, h string, no_host boolean, line bigint")
    lines = written(lines, "rules-hashes")
    sizes = docs.groupBy(*host).agg(F.count("*").alias("docs"))
    often = lines.groupBy("h", "no_host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit_docs)
    often = written(often.join(sizes, ["h", "no_host"]).where(F.col("n") > F.col("docs") * limit_share).select("h", "no_host", "line"), "rules-lines")
    few = often.count() <= BROADCAST_LINES
    hit = lines.join(F.broadcast(often) if few else often, ["h", "no_host", "line"])
    gone = hit.groupBy("row").agg(F.collect_list("line").alias(lost)).withColumnRenamed("row", row)
    columns = [f.name for f in docs.schema.fields if f.name != row]
    rows = docs.join(gone, row, "left").select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{lost}`"))
    return rows.mapInArrow(_strip(lost), docs.select(*[F.col(f"`{c}`") for c in columns]).schema)


def _hashes(batches):
    """A row for each distinct line of a text."""
    for batch in batches:
        texts, at, out = batch.column("text"), [], []
        for i in range(batch.num_rows):
            found = list(line_words(texts[i].as_py()))
            at += [i] * len(found)
            out += found
        picked = [batch.column(n).take(pa.array(at, pa.int32())) for n in ("row", "h", "no_host")]
        yield pa.RecordBatch.from_arrays([*picked, pa.array(out, pa.int64())], names=["row", "h", "no_host", "line"])


#: The same rows in DuckDB's SQL: windows of three words by position, lines by their normalised text.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), grams AS (
  SELECT r, i, [word, lead(word) OVER q, lead(word, 2) OVER q] AS gram, lead(word, 2) OVER q IS NOT NULL AS whole FROM words WINDOW q AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM grams WHERE whole QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r
), lines AS (
  SELECT r, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d)
), kept_lines AS (
  SELECT r, source, line, len(w) AS n, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS plain FROM lines WHERE len(w) > 0
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM kept_lines GROUP BY r
), hosts AS (
  SELECT source, count(*) AS docs FROM d GROUP BY source
), often AS (
  SELECT l.source, plain FROM kept_lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source GROUP BY l.source, plain, docs HAVING count(DISTINCT r) > greatest(@LIMIT_DOCS, @LIMIT_SHARE * docs)
), removed AS (
  SELECT r, sum(n) AS n_removed FROM kept_lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.plain = l.plain GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_words <= n_words AS kept FROM counted
""".replace("@LIMIT_DOCS", str(LIMIT_DOCS)).replace("@LIMIT_SHARE", str(LIMIT_SHARE))

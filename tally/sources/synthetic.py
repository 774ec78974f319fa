"""A made-up catalogue of any size for tests and benches: the same rows for the same seed, in Spark and in SQL.

Every value comes from an MD5 of the seed, the row's number and the value's name, so
that rows are made independently of each other, on any number of executors, and an
SQL engine can make the same. Syllables and groups follow a power law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = ("ka", "ro", "mi", "ten", "sol", "va", "du", "lin", "pex", "ora", "shi", "gal")
REGIONS = ("USA", "Europe", "Japan", "World", "Korea")


def _columns(number, pick) -> str:
    """The columns of a title; number(name) is a 32-bit number of the row, pick(list, place) an element."""
    syllable = lambda k: pick(SYLLABLES, f"CAST(floor({len(SYLLABLES)} * pow({number(f's{k}')} / 4294967296.0, 2)) AS INT)")
    base = "concat(" + ", ".join(syllable(k) for k in range(2)) + ", ' ', " + ", ".join(syllable(k) for k in range(2, 5)) + f", ' ', CAST(id - id % (1 + {number('g')} % 3) AS STRING))"
    region = pick(REGIONS, f"CAST(floor({len(REGIONS)} * pow({number('r')} / 4294967296.0, 2)) AS INT)")
    return ", ".join([
        "id", f"CAST(floor(40 * pow({number('d')} / 4294967296.0, 2)) AS BIGINT) AS domain", f"{base} AS name", f"{region} AS region", "CAST(id - id % 4 AS BIGINT) AS root",
        f"{number('w')} % 10 = 0 AS wanted", f"{number('h')} % 3 = 0 AS have", f"CAST({number('f')} % 8 AS BIGINT) AS bit", f"CAST({number('z')} % 4000000 AS BIGINT) AS size",
    ])


def titles(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """id, domain, name, region, root, wanted, have, bit, size of n titles."""
    number = lambda name: f"CAST(conv(substring(md5(concat('{seed}:{name}:', CAST(id AS STRING))), 1, 8), 16, 10) AS BIGINT)"
    pick = lambda values, place: "element_at(array(" + ", ".join(f"'{v}'" for v in values) + f"), {place} + 1)"
    return spark.sql(f"SELECT {_columns(number, pick)} FROM {{t}}", t=spark.range(n))


def titles_sql(n: int, seed: int = 1) -> str:
    """The same rows in DuckDB's SQL."""
    number = lambda name: f"('0x' || substr(md5('{seed}:{name}:' || id::VARCHAR), 1, 8))::BIGINT"
    pick = lambda values, place: "([" + ", ".join(f"'{v}'" for v in values) + f"])[{place} + 1]"
    return f"SELECT {_columns(number, pick)} FROM (SELECT range AS id FROM range({n}))"

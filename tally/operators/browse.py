"""Browse filters over groups and their variants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_contains, ascii_lower
from .relational import page, tri_state


@dataclass(frozen=True)
class Filter:
    """What to show; None means any."""

    search: str | None = None
    have: bool | None = None
    wanted: bool | None = None
    region: int | None = None
    required: tuple[int, ...] = ()
    hidden: int = 0
    sort: str = "name"
    fields: dict = field(default_factory=dict)


def _passes(flags: Column, regions: Column, chosen: Filter) -> Column:
    out = flags.bitwiseAND(F.lit(chosen.hidden)) == 0
    if chosen.region is not None:
        out = out & (regions.bitwiseAND(F.lit(chosen.region)) != 0)
    for bit in chosen.required:
        out = out & (flags.bitwiseAND(F.lit(bit)) != 0)
    return out


def visible(groups: DataFrame, variants: DataFrame, keys: Sequence[str], chosen: Filter, flags: str = "bit", regions: str = "region_bit") -> DataFrame:
    """Groups with a variant that has no hidden bit, the region, and every required flag.

    A summary that holds its variants' masks (groups.mask_sets) decides alone, in one
    scan. Without them, the masks of the group are necessary conditions and go first;
    one variant has to pass all tests at once, which a semi join checks.
    """
    if "masks" in groups.columns:
        return groups.where(F.exists("masks", lambda m: _passes(m["bit"], m["region"], chosen)))
    first = (F.col("lean_flags").bitwiseAND(F.lit(chosen.hidden)) == 0) | F.lit(chosen.hidden == 0) | (F.col("variants") > 1)
    if chosen.region is not None:
        first = first & (F.col("region_union").bitwiseAND(F.lit(chosen.region)) != 0)
    for bit in chosen.required:
        first = first & (F.col("flag_union").bitwiseAND(F.lit(bit)) != 0)
    passing = variants.where(_passes(F.col(flags), F.col(regions), chosen))
    return groups.where(first).join(passing.select(*keys), list(keys), "left_semi")


def conditions(chosen: Filter, name: str = "name") -> Column:
    out = tri_state(F.col("have") > 0, chosen.have) & tri_state(F.col("wanted") > 0, chosen.wanted)
    return out & ascii_contains(name, chosen.search) if chosen.search else out


def order(chosen: Filter, name: str, key: str) -> list[Column]:
    by_name = [ascii_lower(name).asc_nulls_first(), F.col(key).asc_nulls_first()]
    if chosen.sort == "have":
        return [(F.col("have") > 0).desc(), *by_name]
    if chosen.sort == "newest":
        return [F.col("newest_id").desc(), F.col(key).asc()]
    return by_name


def browse(groups: DataFrame, variants: DataFrame, keys: Sequence[str], chosen: Filter, name: str, key: str, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the groups that a filter shows."""
    shown = visible(groups, variants, keys, chosen).where(conditions(chosen, name))
    return page(shown, order(chosen, name, key), limit, offset), shown.agg(F.count("*").alias("total"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text, ASCII case ignored."""
    low = ascii_lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_search(rows: DataFrame, postings: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Rows that hold a phrase: those that share all its trigrams, then checked."""
    grams = sorted({phrase.lower()[i : i + 3] for i in range(len(phrase) - 2)})
    if not grams:
        return rows.where(ascii_contains(text, phrase))
    hits = postings.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams))
    return rows.join(hits.select(key), key, "left_semi").where(ascii_contains(text, phrase))


def trigram_postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode(trigrams(F.col(text))).alias("gram"))

"""Transfers, jobs, deferred work and offers: what one event or request does to whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .relational import first_per_key


def _state(word: str, table: tuple[str, ...] = S.TRANSFER_STATE) -> Column:
    return F.lit(table.index(word))


def _in(column: str, words: tuple[str, ...], table: tuple[str, ...] = S.TRANSFER_STATE) -> Column:
    return F.col(column).isin(S.codes(table, words))


# transfers ---------------------------------------------------------------------


def best_offers(offers: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(item_id, best_source, best_index): the first offer of each item in an order."""
    best = first_per_key(offers.where("item_id is not null"), ["item_id"], order)
    return best.select("item_id", F.col("source_id").alias("best_source"), F.col("file_index").alias("best_index"))


def promote(transfers: DataFrame, best: DataFrame, now: int) -> DataFrame:
    """transfers with the wanted ones that now have an offer queued on it."""
    rows = transfers.join(best, "item_id", "left")
    moves = (F.col("state") == _state("wanted")) & F.col("best_source").isNotNull()
    new = {"state": _state("queued"), "source_id": F.col("best_source"), "file_index": F.col("best_index"), "updated_at": F.lit(now)}
    return rows.withColumns({c: F.when(moves, v).otherwise(F.col(c)) for c, v in new.items()}).select(transfers.columns)


def retry(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, outcome) of each request: missing, not_failed, busy (another open transfer of the item) or queued."""
    open_ones = transfers.where(_in("state", S.OPEN)).select("item_id").distinct().withColumn("busy", F.lit(True))
    rows = requests.select("id").distinct().join(transfers.select("id", "state", "item_id"), "id", "left").join(open_ones, "item_id", "left")
    # the transfer itself is failed, so any open one is another
    outcome = F.when(F.col("state").isNull(), "missing").when(F.col("state") != _state("failed"), "not_failed").when(F.col("busy"), "busy").otherwise("queued")
    return rows.select("id", outcome.alias("outcome"))


def cancel(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, outcome, started) of each request: missing, final or cancelled; started where the client had it already."""
    rows = requests.select("id").distinct().join(transfers.select("id", "state"), "id", "left")
    outcome = F.when(F.col("state").isNull(), "missing").when(_in("state", S.CANCELLABLE), "cancelled").otherwise("final")
    return rows.select("id", outcome.alias("outcome"), F.coalesce(_in("state", S.STARTED), F.lit(False)).alias("started"))


def cancel_where(transfers: DataFrame, entries: DataFrame, which: Column, states: tuple[str, ...] = S.CANCELLABLE) -> DataFrame:
    """(id, source_id, started) of the transfers in some states whose entry fulfils a condition."""
    mine = entries.where(which).select(F.col("id").alias("entry_id"))
    return transfers.where(_in("state", states)).join(mine, "entry_id", "left_semi").select("id", "source_id", _in("state", S.STARTED).alias("started"))


def move(transfers: DataFrame, ids: DataFrame, to: str, now: int) -> DataFrame:
    """transfers with the given ones in another state."""
    marks = ids.select("id").distinct().withColumn("moved", F.lit(True))
    rows = transfers.join(marks, "id", "left")
    new = {"state": _state(to), "updated_at": F.lit(now)}
    return rows.withColumns({c: F.when(F.col("moved"), v).otherwise(F.col(c)) for c, v in new.items()}).select(transfers.columns)


def want_again(transfers: DataFrame, bad: DataFrame, entries: DataFrame, files: DataFrame, best: DataFrame) -> DataFrame:
    """(entry_id, item_id, state, source_id, file_index): new rows for items of bad transfers that are still wanted and neither held nor open."""
    wanted = entries.where("wanted and not retired").select(F.col("id").alias("entry_id"))
    held = files.where(F.col("state") == _state("verified", S.FILE_STATE)).select("item_id")
    open_ones = transfers.where(_in("state", S.OPEN)).select("item_id")
    rows = transfers.join(bad.select("id"), "id", "left_semi").where(F.col("state") == _state("bad")).join(wanted, "entry_id", "left_semi")
    rows = rows.join(held, "item_id", "left_anti").join(open_ones, "item_id", "left_anti").select("entry_id", "item_id").distinct().join(best, "item_id", "left")
    state = F.when(F.col("best_source").isNotNull(), "queued").otherwise("wanted")
    return rows.select("entry_id", "item_id", state.alias("state"), F.col("best_source").alias("source_id"), F.col("best_index").alias("file_index"))


def redundant(transfers: DataFrame, proven: DataFrame) -> DataFrame:
    """(id) of cancellable transfers of an item that another offer (item_id, source_id, file_index) has brought."""
    p = proven.select("item_id", F.col("source_id").alias("by_source"), F.col("file_index").alias("by_index"))
    own = F.col("source_id").eqNullSafe(F.col("by_source")) & F.col("file_index").eqNullSafe(F.col("by_index"))
    return transfers.where(_in("state", S.CANCELLABLE)).join(p, "item_id").where(~own).select("id").distinct()


def observe(transfers: DataFrame, seen: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """transfers with what was observed (id, to, at): the state where the move is allowed, and its progress."""
    pairs = [S.TRANSFER_STATE.index(a) * 100 + S.TRANSFER_STATE.index(b) for a, to in allowed.items() for b in (a, *to)]
    rows = transfers.join(seen.select("id", "to", F.col("at").alias("seen_at")), "id", "left")
    may = (F.col("state") * 100 + F.col("to")).isin(pairs)
    new = {"state": F.col("to"), "progress": F.col("seen_at")}
    return rows.withColumns({c: F.when(may, v).otherwise(F.col(c)) for c, v in new.items()}).select(transfers.columns)


# offers and their proofs ---------------------------------------------------------


def prove(offers: DataFrame, candidates: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers (source_id, file_index) that hashed to an item name it as proven, and their candidates go."""
    keys = ["source_id", "file_index"]
    rows = offers.join(proofs.select(*keys, F.col("item_id").alias("proven")), keys, "left")
    new = {"item_id": F.col("proven"), "confidence": _state("hash", S.CONFIDENCE)}
    after = rows.withColumns({c: F.when(F.col("proven").isNotNull(), v).otherwise(F.col(c)) for c, v in new.items()}).select(offers.columns)
    return after, candidates.join(proofs.select(*keys), keys, "left_anti")


def drop_pairs(offers: DataFrame, candidates: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers lose a match, and candidates a row, that turned out to be another item."""
    keys = ["source_id", "file_index", "item_id"]
    rows = offers.join(pairs.select(*keys).distinct().withColumn("wrong", F.lit(True)), keys, "left")
    after = rows.withColumns({c: F.when(F.col("wrong").isNull(), F.col(c)) for c in ("item_id", "confidence")}).select(offers.columns)
    return after, candidates.join(pairs.select(*keys), keys, "left_anti")


def drop_foreign_proofs(offers: DataFrame, live: DataFrame) -> DataFrame:
    """offers whose proof names an item outside the live ones of its source (source_id, item_id) lose it."""
    rows = offers.join(live.select("source_id", "item_id").distinct().withColumn("known", F.lit(True)), ["source_id", "item_id"], "left")
    gone = (F.col("confidence") == _state("hash", S.CONFIDENCE)) & F.col("known").isNull()
    return rows.withColumns({c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)) for c in ("item_id", "confidence")}).select(offers.columns)


def apply_candidates(offers: DataFrame, candidates: DataFrame, add: DataFrame, remove: DataFrame, ruled_out: DataFrame) -> DataFrame:
    """candidates after a difference: none is added to a proven offer or where the pair is ruled out."""
    keys = ["source_id", "file_index", "item_id"]
    unproven = offers.where(~F.coalesce(F.col("confidence") == _state("hash", S.CONFIDENCE), F.lit(False))).select("source_id", "file_index")
    new = add.join(unproven, ["source_id", "file_index"], "left_semi").join(ruled_out.select(*keys), keys, "left_anti")
    kept = candidates.join(remove.select(*keys), keys, "left_anti").join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(candidates.columns))


# jobs and deferred work ------------------------------------------------------------


def claim(jobs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """jobs with those of the ids that are queued running."""
    marks = ids.select("id").distinct().withColumn("asked", F.lit(True))
    may = F.col("asked").isNotNull() & (F.col("state") == _state("queued", S.JOB_STATE))
    new = {"state": _state("running", S.JOB_STATE), "updated_at": F.lit(now)}
    return jobs.join(marks, "id", "left").withColumns({c: F.when(may, v).otherwise(F.col(c)) for c, v in new.items()}).select(jobs.columns)


def find_job(jobs: DataFrame, wanted: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """(kind, subject, id): the first job in some states for each kind and subject asked for."""
    found = jobs.where(_in("state", states, S.JOB_STATE)).groupBy("kind", "subject").agg(F.min("id").alias("id"))
    return wanted.select("kind", "subject").distinct().join(found, ["kind", "subject"])


def reconcile(jobs: DataFrame, readable: Column, revivable: Column) -> DataFrame:
    """(id, action) of the active jobs after a restart: unreadable and others fail, later repeats of a kind and payload go, the rest is queued again."""
    active = jobs.where(_in("state", S.ACTIVE_JOBS, S.JOB_STATE)).withColumn("readable", F.coalesce(readable, F.lit(False)))
    repeat = F.row_number().over(Window.partitionBy("readable", "kind", "payload").orderBy("id")) > 1
    action = F.when(~F.col("readable"), "unreadable").when(repeat, "dropped").when(revivable, "requeued").otherwise("failed")
    return active.select("id", action.alias("action"))


def defer(ops: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """ops (op, since, tries) with new ones added once."""
    fresh = new.select("op").distinct().join(ops.select("op"), "op", "left_anti")
    return ops.unionByName(fresh.select("op", F.lit(now).cast("long").alias("since"), F.lit(0).cast("int").alias("tries")))


def finish(ops: DataFrame, done: DataFrame, refused: DataFrame, now: int, most_tries: int = 20, most_age: int = 86_400) -> DataFrame:
    """ops after a round: done ones are gone, refused ones count a try and are dropped after both bounds."""
    rows = ops.join(done.select("op"), "op", "left_anti").join(refused.select("op").distinct().withColumn("no", F.lit(True)), "op", "left")
    rows = rows.withColumn("tries", F.col("tries") + F.col("no").isNotNull().cast("int"))
    over = F.col("no").isNotNull() & (F.col("tries") >= most_tries) & (F.lit(now) - F.col("since") >= most_age)
    return rows.where(~over).select(ops.columns)


# lifecycles -----------------------------------------------------------------------


def source_state(enabled: Column, files: Column, domain: Column) -> Column:
    """disabled, resolving until its files are known, then bound or unbound."""
    return F.when(~enabled, "disabled").when(F.coalesce(files, F.lit(0)) == 0, "resolving").when(domain.isNotNull(), "bound").otherwise("unbound")


def file_state(hashed: Column, disc: Column, tracks_known: Column, item: Column, status: Column, name_fits: Column) -> Column:
    """pending until hashed; discs whose tracks say nothing are unidentified; the rest by its item."""
    bad = F.coalesce(status == S.ITEM_STATUS.index("baddump"), F.lit(False))
    by_item = F.when(item.isNull(), "unverified").when(bad, "bad").when(name_fits, "verified").otherwise("misnamed")
    return F.when(~hashed, "pending").when(disc & ~tracks_known, "unidentified").otherwise(by_item)


def directory_states(members: DataFrame, directory: Sequence[str], entry_items: DataFrame) -> DataFrame:
    """directory, entry_id, state: a directory is verified if its files match all items of one entry, the first of those by id, and no other file is in it.

    members: directory, item_id (null: no match), entry_id. A directory that matches no
    entry whole is unverified; one whose entry has all items but that holds more, misnamed.
    """
    need = entry_items.groupBy("entry_id").agg(F.count("*").alias("need"))
    total = members.groupBy(*directory).agg(F.count("*").alias("files"))
    held = members.where("item_id is not null").groupBy(*directory, "entry_id").agg(F.count_distinct("item_id").alias("have"), F.count("*").alias("rows"))
    whole = held.join(need, "entry_id").where("have = need")
    first = first_per_key(whole, list(directory), [F.col("entry_id")])
    state = F.when(F.col("entry_id").isNull(), "unverified").when(F.col("rows") == F.col("files"), "verified").otherwise("misnamed")
    return total.join(first, list(directory), "left").select(*directory, "entry_id", state.alias("state"))


def disc_states(discs: DataFrame, tracks: DataFrame, items: DataFrame) -> DataFrame:
    """disc, entry_id, state: verified where every track matched an item of one entry and no item is bad; bad where one is; else unidentified.

    discs: disc. tracks: disc, item_id. items: item_id, entry_id, status.
    """
    matched = tracks.join(items, "item_id", "left")
    n = tracks.groupBy("disc").agg(F.count("*").alias("n"))
    of = matched.where("entry_id is not null").groupBy("disc", "entry_id").agg(F.count_distinct("item_id").alias("hit"), F.bool_or(F.col("status") == S.ITEM_STATUS.index("baddump")).alias("spoilt"))
    size = items.groupBy("entry_id").agg(F.count("*").alias("size"))
    full = of.join(size, "entry_id").join(n, "disc").where("hit = n and hit = size")
    first = first_per_key(full, ["disc"], [F.col("entry_id")]).select("disc", "entry_id", "spoilt")
    state = F.when(F.col("entry_id").isNull(), "unidentified").when(F.col("spoilt"), "bad").otherwise("verified")
    return discs.join(first, "disc", "left").select("disc", "entry_id", state.alias("state"))


# jobs over many rows -----------------------------------------------------------------


def settle_names(files: DataFrame, items: DataFrame, fits: Column) -> DataFrame:
    """files whose misnamed ones are verified where the name now fits (fits may use item_name)."""
    names = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"))
    settled = _in("state", ("misnamed",), S.FILE_STATE) & F.col("item_name").isNotNull() & fits
    rows = files.join(names, "item_id", "left")
    return rows.withColumn("state", F.when(settled, _state("verified", S.FILE_STATE)).otherwise(F.col("state"))).select(files.columns)


def rebind(sources: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """(id, domain, score) of the unbound sources that no user chose for and whose best domain scores enough; a suggested domain wins ties."""
    waiting = sources.where(_in("state", ("unbound",), S.SOURCE_STATE) & ~F.coalesce("user_binding", F.lit(False))).select("id", "suggested_domain")
    rows = scores.where(F.col("score") >= least).join(waiting, "id")
    order = [F.desc("score"), F.coalesce(F.col("domain") == F.col("suggested_domain"), F.lit(False)).desc(), F.col("domain")]
    return first_per_key(rows, ["id"], order).select("id", "domain", "score")


def remap(offers: DataFrame, stale: DataFrame, matches: DataFrame) -> DataFrame:
    """offers of stale sources with new matches (source_id, file_index, item_id, confidence) or none; proofs stay."""
    keys = ["source_id", "file_index"]
    marks = stale.select(F.col("id").alias("source_id")).distinct().withColumn("stale", F.lit(True))
    new = matches.select(*keys, F.col("item_id").alias("to_item"), F.col("confidence").alias("to_confidence"))
    moves = F.col("stale").isNotNull() & ~F.coalesce(F.col("confidence") == _state("hash", S.CONFIDENCE), F.lit(False))
    rows = offers.join(marks, "source_id", "left").join(new, keys, "left").withColumn("moves", moves)
    return rows.withColumns({c: F.when(F.col("moves"), F.col(f"to_{n}")).otherwise(F.col(c)) for c, n in (("item_id", "item"), ("confidence", "confidence"))}).select(offers.columns)

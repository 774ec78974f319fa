"""Tables of a reconciliation catalogue: schemas, code tables and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values: codes that the tables store, in code order
FILE_STATE = ("pending", "verified", "misnamed", "unverified", "bad", "unidentified")
HEADER_RULE = ("none", "ines", "smc", "a78", "lnx", "n64", "chd")
ITEM_STATUS = ("good", "baddump", "nodump", "verified")
ENTRY_SOURCE = ("dat", "mra")
TAG_KIND = ("flag", "region", "language")
CONFIDENCE = ("hash", "name", "base", "fuzzy", "size")
SOURCE_STATE = ("resolving", "unbound", "bound", "disabled")
SEED_POLICY = ("none", "ratio", "client")
TRANSFER_STATE = ("wanted", "queued", "transferring", "checking", "importing", "done", "bad", "failed", "cancelled")
JOB_STATE = ("queued", "running", "paused", "done", "failed")
IMPORT_ACTION = ("placed", "replaced", "quarantined", "skipped_existing", "renamed")
MRA_CHECK = ("match", "refused", "missing_part", "mismatch")
DOMAIN_KIND = ("cartridge", "disc", "romset", "arcade")
REASON = ("off", "pending", "no_layout", "unreadable", "not_chd", "version", "parent", "not_cd", "too_large", "codec", "gdrom", "old_layout", "cooked", "pregap", "corrupt", "checksum", "no_checksum")

LOADABLE = ("verified", "misnamed", "bad")
FIRM = ("hash", "name", "base")
OPEN = ("wanted", "queued", "transferring", "checking", "importing")
SELECTED = ("queued", "transferring", "checking", "importing")
STARTED = ("transferring", "checking")
CANCELLABLE = ("wanted", "queued", "transferring", "checking")
UNSTARTED = ("wanted", "queued")
ACTIVE_JOBS = ("queued", "running", "paused")
#: From the first of these codes on, a check fails.
FAILING_CHECK = 2

TABLES = {
    "entries": "id bigint, domain bigint, version_id bigint, name string, base_name string, parent_id bigint, group_root bigint, revision string, is_pick boolean, wanted boolean, retired boolean, clone_of string, group_key string, inferred boolean, source tinyint, setname string, path string, check tinyint, seen bigint",
    "items": "id bigint, entry_id bigint, own_name boolean, name string, size bigint, crc32 binary, md5 binary, sha1 binary, status tinyint, retired boolean, match_name string, match_base string, header string, zip_dir string, present boolean",
    "files": "id bigint, domain bigint, rel_path string, size bigint, mtime bigint, crc32 binary, md5 binary, sha1 binary, header_rule tinyint, item_id bigint, state tinyint, scanned_at bigint, reason tinyint",
    "versions": "id bigint, domain bigint, name string, version string, source_file string, loaded_at bigint, superseded_by bigint, entry_count bigint, retired boolean, source tinyint, family string",
    "tags": "id bigint, kind tinyint, name string, bit bigint",
    "entry_tags": "entry_id bigint, pos int, tag_id bigint",
    "sources": "id bigint, infohash string, display_name string, origin_file string, domain bigint, bind_score double, state tinyint, reason string, seed_policy tinyint, seed_ratio double, file_count bigint, total_size bigint, client_id string, added_at bigint, suggested_domain bigint, user_binding boolean",
    "offers": "source_id bigint, file_index int, path string, size bigint, item_id bigint, confidence tinyint",
    "candidates": "source_id bigint, file_index int, item_id bigint, confidence tinyint",
    "transfers": "id bigint, entry_id bigint, item_id bigint, source_id bigint, file_index int, state tinyint, progress double, error string, created_at bigint, updated_at bigint",
    "audit": "id bigint, at bigint, transfer_id bigint, file_id bigint, action tinyint, detail string",
    "jobs": "id bigint, kind tinyint, payload string, state tinyint, progress string, created_at bigint, updated_at bigint, lane tinyint, subject string",
    "domains": "id bigint, slug string, name string, kind tinyint, enabled boolean",
    "events": "epoch bigint, seq bigint, kind string, data string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def word(code, table: tuple[str, ...]) -> Column:
    """The word of a stored code; null for codes that the table does not have."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c.between(0, len(table) - 1), F.element_at(F.array(*map(F.lit, table)), F.coalesce(c, F.lit(0)).cast("int") + 1))


def code(name, table: tuple[str, ...]) -> Column:
    """The stored code of a word; null for words that the table does not have."""
    place = F.array_position(F.array(*map(F.lit, table)), F.col(name) if isinstance(name, str) else name)
    return F.when(place > 0, (place - 1).cast("tinyint"))


def codes(table: tuple[str, ...], words: tuple[str, ...]) -> list[int]:
    return [table.index(w) for w in words]


def rules(name: str) -> dict[str, Column]:
    """Checks that a table's rows have to pass."""
    width = lambda c, n: F.octet_length(c) == n
    digests = {"crc32": width("crc32", 4), "md5": width("md5", 16), "sha1": width("sha1", 20)} if name in ("items", "files") else {}
    own = {
        "items": {"status": F.col("status").between(0, 3), "size": F.col("size") >= 0},
        "files": {"state": F.col("state").between(0, 5), "reason": F.col("reason").isNull() | (F.col("state") == FILE_STATE.index("unidentified"))},
        "sources": {"score": F.col("bind_score").between(0, 1), "ratio": (F.col("seed_policy") == 1) == F.col("seed_ratio").isNotNull()},
        "transfers": {"state": F.col("state").between(0, 8), "progress": F.col("progress").between(0, 1)},
        "jobs": {"state": F.col("state").between(0, 4), "payload": F.try_parse_json("payload").isNotNull()},
        "versions": {"superseded": F.col("superseded_by") != F.col("id")},
    }.get(name, {})
    return digests | own


def report(df: DataFrame, name: str) -> DataFrame:
    from .operators.quality import check_report

    return check_report(df, name, rules(name))

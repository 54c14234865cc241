"""Deterministic identifiers and fingerprints."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def finding_id(rule_id: Column, path: Column, line: Column) -> Column:
    """First 12 hex digits of md5('rule:file:line')."""
    return F.substring(F.md5(F.concat_ws(":", rule_id, path, line.cast("string"))), 1, 12)


def stable_id(kind: str, *parts: Column) -> Column:
    """16-hex id of a fact row (functions, classes, nodes)."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts]), 256), 1, 16)


def fallback_id(name: Column, path: Column, line: Column) -> Column:
    """'name_file_line' with white-space runs turned into '_' and lower-cased."""
    return F.lower(F.regexp_replace(F.concat_ws("_", name, path, line.cast("string")), r"\s+", "_"))


def sarif_fingerprint(path: Column, line: Column, rule_id: Column) -> Column:
    """Hex of |h| where h = 31*h + code unit over 'file:line:rule', kept in 32-bit two's complement.

    Evaluated with a bigint fold masked to 32 bits (no overflow under ANSI mode).
    Characters outside the BMP are counted as their UTF-16 surrogate pair.
    """
    s = F.concat_ws(":", path, line.cast("string"), rule_id)
    hexs = F.hex(F.encode(s, "UTF-16BE"))
    # one 4-hex-digit group per UTF-16 code unit
    groups = F.regexp_extract_all(hexs, F.lit("(.{4})"), 1)
    h = F.aggregate(groups, F.lit(0).cast("long"),
                    lambda acc, g: ((acc * 31 + F.conv(g, 16, 10).cast("long")) % F.lit(4294967296)))
    signed = F.when(h >= 2147483648, h - 4294967296).otherwise(h)
    return F.lower(F.hex(F.abs(signed)))

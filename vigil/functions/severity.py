"""Severity mappings."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import catalog


def _map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def severity_rank(sev: Column) -> Column:
    return F.coalesce(F.element_at(_map(catalog.SEVERITY_RANK), sev), F.lit(0))


def sarif_level(sev: Column) -> Column:
    return F.coalesce(F.element_at(_map(catalog.SARIF_LEVEL), sev), F.lit("warning"))


def normalize_severity(sev: Column) -> Column:
    """Rule-pack severity text -> one of the five levels, unknown -> medium."""
    return F.coalesce(F.element_at(_map({k: k for k in catalog.SEVERITY_RANK}), F.lower(sev)), F.lit("medium"))


def danger_level(entry: Column) -> Column:
    """Severity of a dangerous-function list entry by substring tests."""
    crit = None
    for c in catalog.DANGER_CRITICAL:
        t = entry.contains(c)
        crit = t if crit is None else (crit | t)
    high = None
    for h in catalog.DANGER_HIGH:
        t = entry.contains(h)
        high = t if high is None else (high | t)
    return F.when(crit, "critical").when(high, "high").otherwise("medium")


def category_name(category: Column) -> Column:
    return F.coalesce(F.element_at(_map(catalog.CATEGORY_NAMES), F.lower(category)), F.lit(catalog.CATEGORY_DEFAULT))

"""Remediation lookup (J11): summary, impact, prerequisites, mitigation and references of each finding's rule.

The texts are fixed data of a dozen rules; they become one literal map, so the
lookup is a projection.  A rule without an entry gets the default one, in which
the finding's own description and fix suggestion come first.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = os.path.join(os.path.dirname(os.path.dirname(__file__)), "remediation", "remediation.yaml")
FIELDS = ("summary", "impact", "prerequisites", "mitigation", "references")


def remediation_texts() -> dict:
    import yaml
    with open(TEXTS, encoding="utf-8") as f:
        return yaml.safe_load(f)


def remediation_table(spark) -> DataFrame:
    """(rule_id, summary, impact, prerequisites, mitigation, references), the default under rule_id 'default'."""
    rows = [(k, *(v.get(c) for c in FIELDS)) for k, v in remediation_texts().items()]
    return spark.createDataFrame(rows, "rule_id string, summary string, impact string, prerequisites array<string>, "
                                       "mitigation string, references array<string>")


def _entry(texts: dict) -> Column:
    def value(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v).cast("string")
    return F.struct(*[value(texts.get(c)).alias(c) for c in FIELDS])


def with_remediation(findings: DataFrame) -> DataFrame:
    """findings plus the five remediation columns (prefixed ``remediation_`` where they need telling apart)."""
    texts = remediation_texts()
    known = {k: v for k, v in texts.items() if k != "default"}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), _entry(v))])
    own = F.coalesce(F.element_at(table, F.col("rule_id")),
                     F.element_at(table, F.regexp_replace("rule_id", "_RISK$", "")))
    d, r = _entry(texts["default"]), F.col("_own")
    fix = F.nullif(F.col("fix_suggestion"), F.lit(""))
    out = findings.withColumn("_own", own)
    return out.withColumns({
        "remediation_summary": F.coalesce(r["summary"], F.col("description")),
        "remediation_impact": F.coalesce(r["impact"], d["impact"]),
        "remediation_prerequisites": F.coalesce(r["prerequisites"], d["prerequisites"]),
        "remediation_mitigation": F.coalesce(r["mitigation"], fix, d["mitigation"]),
        "remediation_references": F.coalesce(r["references"], d["references"]),
    }).drop("_own")

"""Rule packs (S10, S11, D18): YAML files on the driver -> validated rule list / DataFrame.

A rule pack is small configuration; it is read on the driver and turned
into literal regex expressions (compiled once per task), never into a
pattern column joined against lines.
"""
from __future__ import annotations

import glob
import os
from dataclasses import dataclass, field

DEFAULT_PACK_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")


@dataclass
class RulePack:
    rules: list = field(default_factory=list)      # ordered: first load order of each id, last definition wins
    config: dict = field(default_factory=dict)     # minSeverity, exclude: applied by the scan
    errors: list = field(default_factory=list)     # (rule_id, pattern or file, message) of what was rejected


def load_rule_pack(path: str | None = None, extra_rules: list | None = None) -> RulePack:
    """Load every *.yaml / *.yml file of a directory (or one file) in name order.

    Only enabled rules are kept (``extra_rules`` are enabled unless they say
    otherwise); a later file's rule replaces an earlier one with the same id;
    config sections are merged key by key.  A file that cannot be parsed and
    a rule that is no mapping with an id are skipped and recorded in ``errors``.
    """
    import yaml
    path = path or DEFAULT_PACK_DIR
    files = [path] if os.path.isfile(path) else sorted(
        glob.glob(os.path.join(path, "*.yaml")) + glob.glob(os.path.join(path, "*.yml")))
    by_id: dict = {}
    pack = RulePack()

    def take(rules, where: str, enabled: bool) -> None:
        for k, r in enumerate(rules):
            if not isinstance(r, dict) or not r.get("id"):
                pack.errors.append((None, where, f"Rule {k + 1} of {where} has no id"))
            elif r.get("enabled", enabled):
                by_id[r["id"]] = r

    for f in files:
        try:
            with open(f, encoding="utf-8") as fh:
                data = yaml.safe_load(fh) or {}
            rules, config = data.get("rules") or [], data.get("config") or {}
            pack.config = {**pack.config, **config}
            take(rules, f, False)
        except Exception as e:  # noqa: BLE001 - a bad file is reported, the scan goes on
            pack.errors.append((None, f, f"Error loading rules from {f}: {e}"))
    take(extra_rules or [], "extra_rules", True)
    pack.rules = list(by_id.values())
    return pack


def rule_patterns(rule: dict) -> list[str]:
    """Patterns of a rule in list order; those that validation rejected are left out."""
    return rule.get("_patterns", [p["pattern"] if isinstance(p, dict) else p for p in rule.get("patterns") or []])


def validate_patterns(spark, pack: RulePack) -> RulePack:
    """Compile every pattern in the JVM; invalid ones are dropped and listed in ``errors``."""
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    for r in pack.rules:
        good = []
        for pat in [p["pattern"] if isinstance(p, dict) else p for p in r.get("patterns") or []]:
            try:
                compile_(pat)
                good.append(pat)
            except Exception as e:  # noqa: BLE001
                pack.errors.append((r["id"], pat, f"Invalid regex pattern in rule {r['id']}: {e}"))
        r["_patterns"] = good
    return pack


def rules_dataframe(spark, pack: RulePack):
    rows = [(i, r["id"], r.get("name"), r.get("description"), r.get("category"), r.get("severity"),
             list(r.get("languages") or []), r.get("cwe"), r.get("owasp"), list(r.get("tags") or []),
             rule_patterns(r), r.get("fixSuggestion")) for i, r in enumerate(pack.rules)]
    return spark.createDataFrame(rows, "load_ord int, rule_id string, name string, description string, category string, "
                                       "severity string, languages array<string>, cwe string, owasp string, "
                                       "tags array<string>, patterns array<string>, fix_suggestion string")

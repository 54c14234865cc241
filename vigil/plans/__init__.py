"""Skew-safe plan building blocks: blocked scans, as-of lookups, disjoint ranges, ordinals."""
from vigil.plans.prefix import running, asof  # noqa: F401
from vigil.plans.intervals import first_enclosing  # noqa: F401

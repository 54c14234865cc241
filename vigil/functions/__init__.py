"""Scalar column functions (built-in Spark expressions only)."""
from vigil.functions.text import js_trim, js_trim_start, leading_ws, WS_CLASS  # noqa: F401
from vigil.functions.ids import finding_id, stable_id, sarif_fingerprint  # noqa: F401
from vigil.functions.severity import severity_rank, sarif_level, normalize_severity, danger_level  # noqa: F401

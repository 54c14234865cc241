"""Text helpers with the white-space semantics of the scanned languages' tooling.

Spark's ``trim`` strips only spaces; the rebuilt line model strips the full
ECMAScript white-space + line-terminator set.  The class below is valid in
both Java regex and RE2, so the DuckDB oracle uses the same string.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: ECMAScript WhiteSpace + LineTerminator code points
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
TRIM_BOTH = rf"^{WS_CLASS}+|{WS_CLASS}+$"
TRIM_START = rf"^{WS_CLASS}+"


# the same set as characters, for Spark's (non-regex) character-set trim
WS_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def js_trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def leading_ws(c: Column) -> Column:
    """Number of leading white-space characters (the indent)."""
    return F.length(c) - F.length(js_trim_start(c))


def truncate(c: Column, n: int) -> Column:
    """Cut to ``n`` characters, ending with '...' when cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def escape_html(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([*_`\[\]])", r"\\$1")


def format_duration(ms: Column) -> Column:
    return (F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
            .when(ms < 60000, F.concat(F.format_number(ms / 1000.0, 2), F.lit("s")))
            .otherwise(F.format_string("%dm %ds", F.floor(ms / 60000), F.floor((ms % 60000) / 1000))))


def format_error(message: Column, context: Column = None) -> Column:
    return message if context is None else F.concat_ws(": ", context, message)

"""Path helpers: language detection (P2, P3), glob translation (S2, P9, P10), normalisation."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import catalog as C


def extension(path: Column) -> Column:
    """Lower-cased extension including the dot ('' when none), as path.extname would give."""
    base = F.element_at(F.split(path, "/", -1), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def detect_language(path: Column) -> Column:
    """Extension -> language; unknown -> 'python'."""
    m = F.create_map(*[F.lit(x) for lang, exts in C.FILE_EXTENSIONS.items() for e in exts for x in (e, lang)])
    return F.coalesce(F.element_at(m, extension(path)), F.lit("python"))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*[e for exts in C.FILE_EXTENSIONS.values() for e in exts])


def extension_order(path: Column) -> Column:
    """Position of the extension in the language/extension list (file discovery order)."""
    m = F.create_map(*[F.lit(x) for i, e in enumerate(e for exts in C.FILE_EXTENSIONS.values() for e in exts)
                       for x in (e, i)])
    return F.element_at(m, extension(path))


#: Named classes inside of brackets, as ranges.
_NAMED = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": " \t-\r", "punct": "!-/:-@[-`{-~",
          "xdigit": "0-9A-Fa-f", "word": "a-zA-Z0-9_"}
_GROUPS = {"@": "", "?": "?", "*": "*", "+": "+"}
_MOST_NUMBERS = 10_000


def _closing(glob: str, i: int, opening: str, closing: str) -> int:
    """Where the bracket at i ends, or -1; escapes and inner brackets are skipped."""
    depth = 0
    while i < len(glob):
        if glob[i] == "\\":
            i += 1
        elif glob[i] == opening:
            depth += 1
        elif glob[i] == closing:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def _split(text: str, separator: str) -> list[str]:
    """Pieces between separators that lie outside of braces, parentheses and escapes."""
    out, start, depth, i = [], 0, 0, 0
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] in "{(":
            depth += 1
        elif text[i] in "})":
            depth -= 1
        elif text[i] == separator and depth == 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [*out, text[start:]]


def _class_regex(glob: str, i: int) -> tuple[str, int] | None:
    """(regex, position behind) of the character class at i, which never takes a '/'; None if it does not end."""
    j = i + 1
    negated = j < len(glob) and glob[j] in "!^"
    j += negated
    first, ranges = True, []
    while j < len(glob) and (first or glob[j] != "]"):
        first = False
        name = re.match(r"\[:(\w+):\]", glob[j:])
        if name and name.group(1) in _NAMED:
            named = _NAMED[name.group(1)]
            ranges += [(named[k], named[k + 2]) if named[k + 1:k + 2] == "-" else (named[k], named[k]) for k in _range_starts(named)]
            j += name.end()
            continue
        if glob[j] == "\\" and j + 1 < len(glob):
            j += 1
        low = high = glob[j]
        if glob[j + 1:j + 2] == "-" and glob[j + 2:j + 3] not in ("", "]"):
            high = glob[j + 2]
            j += 2
        ranges.append((low, high))
        j += 1
    if j >= len(glob):
        return None
    if negated:
        ranges.append(("/", "/"))
    else:
        ranges = [r for low, high in ranges for r in ((low, min(high, ".")), (max(low, "0"), high)) if r[0] <= r[1]] \
            if any(low <= "/" <= high for low, high in ranges) else [r for r in ranges if r[0] <= r[1]]
    body = "".join(re.sub(r"[^\w]", lambda m: "\\" + m.group(), low) + ("" if low == high else "-" + re.sub(r"[^\w]", lambda m: "\\" + m.group(), high))
                   for low, high in ranges if low <= high)
    if not body:
        return "[^\\x{0}-\\x{10FFFF}]", j + 1  # no character at all
    return f"[{'^' if negated else ''}{body}]", j + 1


def _range_starts(named: str) -> list[int]:
    out, k = [], 0
    while k < len(named):
        out.append(k)
        k += 3 if named[k + 1:k + 2] == "-" else 1
    return out


def _glob_body(glob: str, outer_before: str = "/", outer_after: str = "/") -> str:
    """Regex of a glob or of one branch of it; outer_*: what stands around the branch, '/' for an end of the glob."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
            continue
        if c in _GROUPS and glob[i + 1:i + 2] == "(" and (end := _closing(glob, i + 1, "(", ")")) > 0:
            out.append("(?:" + "|".join(_glob_body(p, "", "") for p in _split(glob[i + 2:end], "|")) + ")" + _GROUPS[c])
            i = end + 1
            continue
        if c == "!" and glob[i + 1:i + 2] == "(" and _closing(glob, i + 1, "(", ")") > 0:
            raise ValueError(f"a negated group is not supported: {glob}")
        if c == "*":
            j = i
            while glob[j:j + 1] == "*" and glob[j + 1:j + 2] != "(":
                j += 1
            before, after = glob[i - 1] if i else outer_before, glob[j] if j < len(glob) else outer_after
            if j - i >= 2 and before == "/" and after == "/":  # a segment of its own
                if j < len(glob):
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            i = j
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[" and (found := _class_regex(glob, i)):
            out.append(found[0])
            i = found[1]
            continue
        elif c == "{" and (end := _closing(glob, i, "{", "}")) > 0:
            inner, pieces = glob[i + 1:end], _split(glob[i + 1:end], ",")
            numbers = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner)
            if numbers and abs(int(numbers[1]) - int(numbers[2])) < _MOST_NUMBERS:
                low, high = sorted(map(int, numbers.groups()))
                out.append("(?:" + "|".join(re.escape(str(n)) for n in range(low, high + 1)) + ")")
                i = end + 1
                continue
            if len(pieces) > 1:
                before, after = glob[i - 1] if i else outer_before, glob[end + 1] if end + 1 < len(glob) else outer_after
                out.append("(?:" + "|".join(_glob_body(p, before, after) for p in pieces) + ")")
                i = end + 1
                continue
            out.append(re.escape(c))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_to_regex(glob: str) -> str:
    """Anchored regex of a glob.

    ``**/`` any directories (or none), ``**`` as the last segment anything, ``*``
    within a segment, ``?`` one character, ``[a-z]`` and ``[!a-z]`` (or ``^``) one of
    a class, ``{a,b}`` and ``{1..3}`` alternatives, ``@(a|b)``, ``?(a)``, ``*(a)``,
    ``+(a)`` groups, ``\\`` before a character that stands for itself.  Names that
    begin with a dot are names like others.  What does not close is literal.
    """
    return "^" + _glob_body(glob) + "$"


def excluded(path: Column, globs=C.DEFAULT_EXCLUDE_PATTERNS) -> Column:
    """True when the (relative or absolute) path matches an exclusion glob.

    A glob that begins with '!' takes back what those before it exclude; the last match decides.
    """
    out, run = F.lit(False), []

    def matches(some):
        rx = "|".join("(?:%s)" % glob_to_regex(g)[1:-1] for g in some)
        return path.rlike("^(?:/?)(?:" + rx + ")$") | path.rlike("^(?:.*/)?(?:" + rx + ")$")

    for g in globs:
        if g.startswith("!") and not g.startswith("!("):
            out = ((out | matches(run)) if run else out) & ~matches([g[1:]])
            run = []
        else:
            run.append(g)
    return (out | matches(run)) if run else out


def simple_excluded(path: Column, patterns) -> Column:
    """P10: '**' patterns as case-insensitive unanchored regex ('**' -> '.*', '*' -> '[^/]*'), others as substring."""
    conds = []
    for p in patterns:
        p = p.replace("\\", "/")
        if "**" in p:
            conds.append(path.rlike("(?i)" + p.replace("**", "\u0000").replace("*", "[^/]*").replace("\u0000", ".*")))
        else:
            conds.append(path.contains(p.replace("*", "", 1)))
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: Column, base: str) -> Column:
    b = base.rstrip("/") + "/"
    return F.when(path.startswith(b), F.substr(path, F.lit(len(b) + 1))).otherwise(path)


def valid_target(path: Column) -> Column:
    """Non-empty, no '..', no NUL."""
    return (path != "") & ~path.contains("..") & ~path.contains("\u0000")


def validate_target(path: str | None) -> str | None:
    """P15 for an argument: the reason why a target path is refused, or None."""
    if not path:
        return "Target path is required"
    if ".." in path or "\0" in path:
        return "Invalid path format"
    return None

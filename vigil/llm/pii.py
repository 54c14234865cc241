"""Personal data (8): fixed patterns, and a semi-Markov conditional random field that adds spans.

The base spans are those of four patterns.  The random field then reads zones:
runs of neighbouring chunks that hold a digit or an ``@``.  A zone is cut into
tokens; every run of at most MAX_TOKENS tokens is a candidate segment, scored as
a whole for each type by features of its shape (signs, digit groups, checksum,
word before it) that no single token has.  Dynamic programming over segment ends
chooses boundaries and types together; a token outside every segment stands
alone with score 0.  Segments that overlap no base span are added to these.

The weights are trained here: stochastic gradient ascent on the conditional
likelihood (forward-backward over the same segments) of zones from a sample of
at most ``max_rows`` documents and ``max_bytes`` of text (``fit``), the first
``max_zones`` of them (``train``), whose base spans are the labels.  Features that
merely repeat a pattern's fixed part, such as the plus of a phone number, are
left out at random in training, so the field learns the rest of the shape too.

Base kinds, leftmost and without overlap per kind, offsets in code points:
email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15
digits); a match that fails its test is dropped and not tried anew.  Null texts
are empty and hold nothing; repeated rows are judged each; an empty table gives
no rows; extra columns are ignored or, in the masking, kept.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import append, bounded_sample, free_name

KINDS = ("email", "ip", "card", "phone")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit before it: a run of digits that fails at its start fails at every later place, too
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
INNER = LOCAL | {"@"}
#: Chunks that hold a digit or an @, with single spaces between them.
ZONE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
MAX_TOKENS = 16
LONGEST_SEGMENT = 80
#: Tokens of a zone that the field reads at once; longer zones are read in overlapping parts.
ZONE_TOKENS = 512
FEATURES = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        # the name before an @ is the longest run of its signs after the last match: equal to a leftmost search, in linear time
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        tail = EMAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            end = tail.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _shape(s: str) -> list[str]:
    """Features of a candidate segment as a whole."""
    digits, signs = only_digits(s), "".join(sorted({c for c in s if not c.isalnum()}))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    letters = any(c.isalpha() for c in s)
    out = [f"signs:{signs}", f"digits:{min(len(digits), 20)}", f"letters:{letters}",
           f"groups:{','.join(map(str, groups[:6]))}" if not letters else "groups:-", f"first:{_class(s[0])}", f"last:{_class(s[-1])}"]
    if "@" in s:
        name, _, host = s.rpartition("@")
        out.append(f"at:{s.count('@')},{bool(name)},{'.' in host.strip('.')},{' ' in s}")
    if s.count(".") == 3 and not letters and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in s.split(".")):
        out.append("octets")
    if not letters and 14 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if not letters and 10 <= len(digits) <= 15:
        out.append(f"phone-size:{len(groups) > 1}")
    return out


def _class(c: str) -> str:
    return "d" if "0" <= c <= "9" else "a" if c.isalpha() else c


def _slots(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "little") % FEATURES for n in names])


class Zone:
    """A zone's tokens and the feature rows of its candidate segments."""

    def __init__(self, text: str, start: int, end: int, cache: dict):
        self.edges = [start + m.start() for m in TOKEN.finditer(text[start:end])] + [end]
        self.n = len(self.edges) - 1
        before = text[max(0, start - 24):start].split()
        self.segments = []  # (first token, end token, feature slots)
        # a segment neither begins nor ends inside a name, number or address
        ends = [self._free(text, b) for b in self.edges]
        for i in range(self.n):
            if text[self.edges[i]] == " " or self.edges[i] > 0 and text[self.edges[i] - 1] in INNER:
                continue
            word = (text[max(start, self.edges[i] - 24):self.edges[i]].split() or before or [""])[-1].strip(":(#").lower()
            left = _class(text[self.edges[i] - 1]) if self.edges[i] > 0 else "^"
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                if not ends[j]:
                    continue
                a, b = self.edges[i], self.edges[j]
                piece = text[a:b]
                if piece[-1] == " " or b - a > LONGEST_SEGMENT or not ("@" in piece or sum("0" <= c <= "9" for c in piece) >= 4):
                    continue
                right = _class(text[b]) if b < len(text) else "$"
                if piece not in cache:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[piece] = _shape(piece)
                key = (*cache[piece], f"word:{word[:12]}", f"left:{left}", f"right:{right}", "bias")
                self.segments.append((i, j, key))

    @staticmethod
    def _free(text: str, at: int) -> bool:
        if at < len(text) and text[at] == ".":
            at += 1  # a full stop may follow
        return at >= len(text) or text[at] not in INNER

    def slots(self, cache: dict) -> list[np.ndarray]:
        out = []
        for _, _, names in self.segments:
            if names not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[names] = _slots(list(names))
            out.append(cache[names])
        return out


def _zones(text: str, cache: dict):
    if "@" not in text and not re.search("[0-9]", text):
        return
    for m in ZONE.finditer(text):
        if m.end() - m.start() < 5 or not ("@" in m[0] or len(re.findall("[0-9]", m[0])) >= 4):
            continue
        edges = [m.start() + t.start() for t in TOKEN.finditer(m[0])] + [m.end()]
        step = ZONE_TOKENS - 2 * MAX_TOKENS
        for k in range(0, max(1, len(edges) - 1), step):
            yield Zone(text, edges[k], edges[min(len(edges) - 1, k + ZONE_TOKENS)], cache)
            if k + ZONE_TOKENS >= len(edges) - 1:
                break


class Field:
    """Weights by feature slot and type."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, len(KINDS))) if weights is None else weights
        self.shapes, self.known = {}, {}

    def scores(self, zone: Zone) -> np.ndarray:
        return np.array([self.weights[s].sum(axis=0) for s in zone.slots(self.known)]).reshape(-1, len(KINDS))

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """Best segmentation of every zone."""
        found = set()
        for zone in _zones(text, self.shapes):
            if not zone.segments:
                continue
            scores = self.scores(zone)
            kind, top = scores.argmax(axis=1), scores.max(axis=1)
            ends: dict[int, list[int]] = {}
            for k in np.flatnonzero(top > 0).tolist():
                ends.setdefault(zone.segments[k][1], []).append(k)
            best, choice = [0.0] * (zone.n + 1), [None] * (zone.n + 1)
            for j in range(1, zone.n + 1):
                best[j] = best[j - 1]
                for k in ends.get(j, ()):
                    total = best[zone.segments[k][0]] + top[k]
                    if total > best[j]:
                        best[j], choice[j] = total, k
            j = zone.n
            while j > 0:
                if choice[j] is None:
                    j -= 1
                else:
                    i, e, _ = zone.segments[choice[j]]
                    found.add((zone.edges[i], zone.edges[e], KINDS[kind[choice[j]]]))
                    j = i
        out: list[tuple[int, int, str]] = []
        for span in sorted(found):  # overlapping parts of a long zone may differ: the first stands
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out

    def step(self, zone: Zone, gold: dict, rate: float, hidden: set) -> None:
        """One ascent step on the likelihood of a zone; gold: (first token, end token) -> type."""
        slots = [np.array([s for s in row if s not in hidden], np.int64) for row in zone.slots(self.known)]
        scores = np.array([self.weights[s].sum(axis=0) for s in slots]).reshape(-1, len(KINDS))
        by_end, by_start = {}, {}
        for k, (i, j, _) in enumerate(zone.segments):
            by_end.setdefault(j, []).append(k)
            by_start.setdefault(i, []).append(k)
        total = np.logaddexp.reduce(scores, axis=1)
        ahead, behind = np.zeros(zone.n + 1), np.zeros(zone.n + 1)
        for j in range(1, zone.n + 1):
            ways = [ahead[j - 1]] + [ahead[zone.segments[k][0]] + total[k] for k in by_end.get(j, ())]
            ahead[j] = np.logaddexp.reduce(ways)
        for i in range(zone.n - 1, -1, -1):
            ways = [behind[i + 1]] + [behind[zone.segments[k][1]] + total[k] for k in by_start.get(i, ())]
            behind[i] = np.logaddexp.reduce(ways)
        for k, (i, j, _) in enumerate(zone.segments):
            expected = np.exp(ahead[i] + behind[j] - ahead[-1] + scores[k])
            gradient = -expected
            kind = gold.get((i, j))
            if kind is not None:
                gradient[kind] += 1
            if np.abs(gradient).max() > 1e-4:
                self.weights[slots[k]] += rate * gradient


def train(texts: list[str], epochs: int = 6, rate: float = 0.2, seed: int = 5, max_zones: int = 1500) -> Field:
    """Field fitted to the base spans of some texts (their first max_zones zones in a random order)."""
    field, examples = Field(), []
    rng = np.random.default_rng(seed)
    for t in rng.permutation(len(texts)):
        spans = base_spans(texts[t])
        for zone in _zones(texts[t], field.shapes):
            token = {e: k for k, e in enumerate(zone.edges)}
            known = {(i, j) for i, j, _ in zone.segments}
            gold = {(token[a], token[b]): KINDS.index(kind) for a, b, kind in spans if a in token and b in token
                    and (token[a], token[b]) in known}
            if zone.segments:
                examples.append((zone, gold))
        if len(examples) >= max_zones:
            break
    plus = set(_slots(["first:+"]).tolist())
    for epoch in range(epochs):
        for k in rng.permutation(len(examples)):
            zone, gold = examples[k]
            field.step(zone, gold, rate / (1 + epoch), plus if gold and rng.random() < 0.3 else set())
    return field


def fit(docs: DataFrame, max_rows: int = 1000, max_bytes: int = 64 << 20) -> Field:
    """Field trained on at most max_rows documents with digits or an @ (smallest hashes of the id), max_bytes of text in all.

    A document stands once however many rows repeat its id.
    """
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL").filter(F.col("text").rlike("[0-9@]"))
    some = able.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = bounded_sample(able.join(F.broadcast(some), "doc_id"), "doc_id", max_bytes)  # the broadcast side has max_rows numbers
    return train([r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.text))])


def find_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans): what the field adds overlaps no base span."""
    base = base_spans(text)
    added = [s for s in field.decode(text) if all(s[1] <= b[0] or s[0] >= b[1] for b in base)] if base else field.decode(text)
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "__pii"


def _detected(docs: DataFrame, field: Field, out: str = FOUND) -> DataFrame:
    weights = field.weights

    def start():
        import pyarrow as pa
        own = Field(weights)
        kind = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS] + [("base", pa.string()), ("spans", pa.string()), ("masked", pa.string())])

        def run(data, part):
            rows = []
            for text in data:
                text = text.decode("utf-8", "replace")
                base, spans = find_spans(text, own)
                row = {f"n_{k}": sum(s[2] == k for s in base) for k in KINDS}
                rows.append(row | {"base": _listed(base), "spans": _listed(spans), "masked": mask(text, spans) if spans else None})
            return [pa.array(rows, kind)]
        return run

    fields = "".join(f"n_{k}:bigint," for k in KINDS)
    return append(docs, start, [(out, f"struct<{fields}base:string,spans:string,masked:string>")])


def mask(text: str, spans) -> str:
    """Spans replaced by their kind; a span that overlaps the one before it hides only what is left of it."""
    out, at = [], 0
    for a, b, kind in spans:
        if b > at:
            out += [text[at:max(a, at)], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _detected(docs, fit(docs))
    return found.select("doc_id", *(F.col(FOUND)[f"n_{k}"].alias(f"n_{k}") for k in KINDS),
                        F.sha2(F.col(FOUND)["base"], 256).alias("base_sha256"), F.col(FOUND)["spans"].alias("spans"))


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, where there is one, counted anew."""
    name = free_name(docs, FOUND)
    found = _detected(docs, fit(docs), name)
    out = found.withColumn("text", F.coalesce(F.col(name)["masked"], F.col("text"))).drop(name)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out

"""Operators over whole texts against brute-force versions written here."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import decontam, near_dup, packing, pii, quality, substring_dedup, token_count
from vigil.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- packing
def test_packing_places_every_id_once(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE)
    pieces = packing.pack_documents(docs, BYTE, max_tokens=256, max_segments=16).collect()
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[(r.doc_id, np.array(ids, "<u4").tobytes())] += 1
    spans, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
        spans[(p.doc_id, p.doc_tokens)].append((p.start, p.length, bytes(p.ids)))
        places[p.sequence_id].append((p.offset, p.length))
    for key, n in want.items():
        size = len(key[1]) // 4
        found = spans[(key[0], size)]
        cover = Counter((s + k, ids[4 * k:4 * k + 4]) for s, length, ids in found for k in range(length))
        for k in range(size):
            assert cover[(k, key[1][4 * k:4 * k + 4])] >= n
    assert sum(len(v) // 4 * n for (_, v), n in want.items()) == sum(p.length for p in pieces)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256 and len(found) <= 16


def test_packing_pads_little():
    packer, out = packing.Packer((128, 64, 128), cut=True), []
    rng = np.random.default_rng(1)
    for key, n in enumerate(rng.integers(1, 300, 500).tolist()):
        out += packer.add(key, n, n)
    out += packer.finish()
    used = Counter()
    for _, _, n, sequence, _, _ in out:
        used[sequence] += n
    assert sum(0 if n & (n - 1) == 0 else 128 - n for n in used.values()) == 0


@pytest.mark.parametrize("sizes", [[1], [3], [5], [1, 2, 3, 4, 5, 6, 7, 8], [2, 900, 1], [2047, 1, 2], [5000, 3]])
def test_short_and_mixed_texts_are_hardly_padded(sizes):
    rng = np.random.default_rng(3)
    packer, out, total = packing.Packer((2048, 2048, 2048), cut=True), [], 0
    for key in range(20_000 if max(sizes) < 100 else 600):
        n = int(rng.choice(sizes))
        total += n
        out += packer.add(key, n, n)
        assert len(packer.items) + len(packer.fresh) < packer.pool_size and len(packer.placed) <= 2048
    out += packer.finish()
    used = Counter()
    for _, _, n, sequence, offset, _ in out:
        assert offset == used[sequence]  # handed out in order, without gaps
        used[sequence] += n
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert sum(used.values()) == total and max(used.values()) <= 2048 and padding < 0.02 * total


def test_memo_keeps_frequent_keys():
    from vigil.llm.shared import Memo

    class Squares(Memo):
        asked = 0

        def compute(self, key):
            self.asked += 1
            return key * key

    memo = Squares(most=20)
    for k in range(5000):
        assert memo[k % 7] == (k % 7) ** 2 and memo[100 + k] == (100 + k) ** 2
        assert len(memo) <= 20 and len(memo.old) <= 20
    assert memo.asked == 5007


def test_vector_limits_hold_without_cutting(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(t), int(t * s)) for i, (t, s) in enumerate(zip(rng.integers(1, 100, 400), rng.random(400)))]
    rows += [(1000, 500, 1), (1001, None, None), (1002, 0, 0)]
    df = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long")
    found = {r.example_id: r for r in packing.pack_examples(df, 128, 6, 40).collect()}
    assert len(found) == len(rows)
    assert found[1000].sequence_id is None and found[1001].sequence_id is not None
    sums = defaultdict(lambda: [0, 0, 0])
    for i, t, x in rows:
        if found[i].sequence_id is None:
            assert (t or 0) > 128 or (x or 0) > 40
            continue
        for k, v in enumerate((t or 0, 1, x or 0)):
            sums[found[i].sequence_id][k] += v
    assert all(a <= 128 and b <= 6 and c <= 40 for a, b, c in sums.values())
    lower = max(sum(t for _, t, _ in rows[:400]) / 128, sum(x for _, _, x in rows[:400]) / 40)
    assert len(sums) < 1.3 * lower + 8


# ----------------------------------------------------------- token counts
def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORD)
    found = Counter(map(tuple, token_count.count_tokens(docs, WORD).collect()))
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        want[(r.doc_id, len(text.encode()), n, n > 2048)] += 1
    assert found == want


def test_word_starts_equal_the_pattern():
    import random

    import regex
    nxt, emit = token_count.compile_splitter()
    classes, rng = token_count.char_classes(), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("'srtvemlldéA1½!? \n\u00a0", k=rng.randrange(0, 700))) + " "
        marks = token_count.word_starts(classes[[ord(c) for c in text]], nxt, emit)
        assert np.flatnonzero(marks).tolist() == [m.start() for m in regex.finditer(token_count.PATTERN, text)]


def test_merge_transducer_equals_the_library(monkeypatch):
    import json
    import random

    from tokenizers import Tokenizer
    from vigil.llm.shared import byte_letters
    spec = json.load(open(WORD, encoding="utf-8"))
    model, letters, rng = Tokenizer.from_file(WORD).model, byte_letters(), random.Random(3)
    merges = token_count.Merges(spec["model"])
    whole = [t.replace("</w>", "") for t in spec["model"]["vocab"] if t.isascii()]
    words = ["".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(3000)]  # ties and overlaps of one merge
    words += [rng.choice("aehlsz0-!.") * n for n in range(1, 200)]
    words += ["".join(rng.choices(whole, k=rng.randint(1, 5))) for _ in range(6000)]
    words = [w.encode() for w in words] + [rng.randbytes(rng.randint(1, 12)) for _ in range(3000)] + [b"etaoin" * 20_000]
    want = [len(model.tokenize("".join(letters[b] for b in w))) for w in words]
    assert [merges.count(w) for w in words] == want
    monkeypatch.setattr(token_count, "CACHE_STATES", 50)  # states that are dropped are built again
    assert [merges.count(w) for w in words[::7]] == want[::7]


def test_merges_that_are_not_compiled_are_refused():
    letters = token_count.byte_letters()
    vocab = {name: k for k, name in enumerate(letters)}
    for merges in (["a b", "ab c", "a bc"], ["ab c", "a b"], ["a b", "b c", "ab c", "a bc"]):
        with pytest.raises(ValueError):
            token_count.Merges({"end_of_word_suffix": None, "vocab": vocab, "merges": merges})


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (37, 5)).astype(np.uint8)
    want, scanned = np.arange(5), token_count.prefix_scan(maps)
    for k in range(37):
        want = maps[k][want]
        assert (scanned[k] == want).all()


# ---------------------------------------------------------- decontamination
def brute_contamination(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(window, len(w))
        wins = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k:k + n]) in wins:
                hit |= set(range(k, k + n))
                names.add(name)
    names = sorted(str(x) for x in names if x is not None)
    return len(words), len(hit), len(names), sha(",".join(names)), bool(hit)


@pytest.fixture(scope="module")
def items(spark, corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 40]
    rows = [(1, " ".join(texts[0].split()[5:30]).upper()), (2, "unrelated words that occur nowhere at all in there or else"),
            (3, "A b"), (4, None), (5, " ...! "), (6, " ".join(texts[3].split()[:10])), (6, "one"), (11, "x x x x x x x x x x x x"),
            (None, " ".join(texts[5].split()[:12])), (8, texts[7])]
    return rows, spark.createDataFrame(rows, "item_id long, text string").withColumn("hit", F.lit("clash"))


@pytest.mark.parametrize("part_bytes", [1 << 24, 64])
def test_contamination_equals_brute_force(docs, items, part_bytes, monkeypatch):
    rows, table = items
    monkeypatch.setattr(decontam, "ITEM_BYTES", part_bytes)
    if part_bytes == 64:
        docs, table, rows = docs.limit(25), table.filter("item_id IN (1, 3, 6)"), [r for r in rows if r[0] in (1, 3, 6)]
    found = Counter(tuple(r) for r in decontam.contamination(docs, table).drop("matches").collect())
    want = Counter((r.doc_id, *brute_contamination(r.text, rows)) for r in docs.collect())
    assert found == want
    left = decontam.remove_contaminated(docs, table)
    assert left.columns == docs.columns
    assert left.count() == sum(n for row, n in want.items() if not row[-1])


def test_matches_are_longest_and_placed(spark):
    text = " ".join(f"w{k}" for k in range(50))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(9, "no " + " ".join(f"w{k}" for k in range(10, 33)) + " end")], "item_id long, text string")
    found = decontam.contamination(d, b).first()
    assert [tuple(m) for m in found.matches] == [(9, 10, 23, 1)] and found.n_hit == 23


def test_matches_are_verbatim():
    def found(doc, item, window=10):
        return decontam.Benchmark([(1, " ".join(item).encode())], window).search([" ".join(doc).encode()])[0][2].get(0, [])

    letters = list("abcdefghijkl")
    assert found(letters, letters[:11] + ["x"] + letters[1:]) == [(0, 11, 0), (1, 11, 12)]
    assert found(["the"] * 3, ["the"]) == [(0, 1, 0), (1, 1, 0), (2, 1, 0)]
    rng = np.random.default_rng(4)
    for _ in range(300):
        doc, item = (["w%d" % x for x in rng.integers(0, 3, rng.integers(0, 25))] for _ in range(2))
        window = int(rng.integers(1, 5))
        least = min(window, len(item))
        inside = lambda part: any(item[k:k + len(part)] == part for k in range(len(item)))
        want = [(s, n) for s in range(len(doc)) for n in range(max(least, 1), len(doc) - s + 1)
                if item and inside(doc[s:s + n]) and not (s + n < len(doc) and inside(doc[s:s + n + 1])) and not (s and inside(doc[s - 1:s + n]))]
        got = found(doc, item, window)
        assert sorted(x[:2] for x in got) == sorted(want)
        assert all(doc[s:s + n] == item[at:at + n] for s, n, at in got)


def test_columns_of_any_name_pass_through(spark, labelled, items):
    """Names that the stages use inside, in the input."""
    docs, labels = labelled
    odd = ["__found", "__found_before", "__score", "__SCORE", "__pii", "__gone", "__row", "id", "row", "h1", "sig", "component_id"]
    docs = docs.limit(40).select("doc_id", "text", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(odd) if c != "__SCORE"])
    stages = {"quality": lambda d: quality.keep_good(d, labels, -1.0), "contamination": lambda d: decontam.remove_contaminated(d, items[1]),
              "pii": pii.mask_documents, "near": near_dup.remove_near_duplicates}
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"v{odd.index(c)}" for r in rows for c in docs.columns[2:]), name


def test_samples_hold_a_row_per_id_and_bounded_bytes(spark):
    from vigil.llm.shared import bounded_sample
    rows = [(1, "a" * 100, 5)] * 50 + [(1, "b" * 100, 5)] * 50 + [(k, "t" * 10 * k, k) for k in range(2, 30)] + [(40, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    some = bounded_sample(df, "doc_id", 10 ** 9)
    assert sorted(r.doc_id for r in some) == [*range(1, 30), 40]
    few = bounded_sample(df, "doc_id", 700)
    assert 1 <= len(few) < 29 and sum(len(r.text or "") for r in few) <= 700
    assert {tuple(r) for r in few} <= {tuple(r) for r in some} and len(bounded_sample(df, "doc_id", 0)) == 1


# ------------------------------------------------------- near-duplicates
def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            same = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or same and 100 * same >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least[root(i)], d)
    return Counter((d, len(s), None if d is None else least[root(i)], d is None or d == least[root(i)])
                   for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == brute_components(rows)
    assert near_dup.remove_near_duplicates(docs).columns == docs.columns


def test_near_duplicate_rows_stay_one_by_one(spark):
    t, u = "the same words stand here in this one text and in its copies", "another text of quite different words that nobody has copied so far"
    near = t + " now"
    rows = [(1, t), (1, t), (2, t), (None, t), (3, u), (1, u), (7, near), (None, "only null ids have this text of seven words"),
            (None, "only null ids have this text of seven words"), (5, ""), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter(map(tuple, near_dup.remove_near_duplicates(df).collect()))
    assert left == Counter([(1, t), (1, u), (None, "only null ids have this text of seven words"), (5, ""), (5, ""), (6, None)])


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    """A chain of near copies and many look-alikes below the threshold, with tiny blocks."""
    import random
    monkeypatch.setattr(near_dup, "REGION_ROWS", 8)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 5, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows)


@pytest.mark.parametrize("held", [1 << 21, 300])
def test_blocks_lose_no_link_of_long_texts(spark, monkeypatch, held):
    """Families of several blocks, dealt by rows and by shingles."""
    import random
    monkeypatch.setattr(near_dup, "REGION_ROWS", 2)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dup, "HELD_HASHES", held)
    rng, rows = random.Random(14), []
    for size in (60, 1500):
        base = [f"b{k}" for k in range(size)]
        for i in range(50):
            w = list(base)
            for _ in range(i % 5 * size // 60):
                w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((size * 100 + i, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows)


def test_sets_of_long_texts_stay_out_of_memory(spark, monkeypatch):
    """Blocks hold few long texts, and every pair of blocks is compared."""
    import random
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(near_dup, "HELD_HASHES", 1 << 14)
    rng, n, size = random.Random(15), 100, 4000
    base = [f"w{k}" for k in range(size)]

    def text(k):
        words = list(base)
        for _ in range(60 * (k % 5)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    texts = [text(k) for k in range(n)]
    sets = [set(x.tolist()) for x in near_dup.shingle_sets([t.encode() for t in texts])]
    near = [(i, j) for j in range(n) for i in range(j) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    values = near_dup.Sets((75, 100))
    for t in texts:
        values.add(t)
    half = n // 2
    found = values.links(np.arange(half), np.arange(half, n))
    assert list(zip(*(x.tolist() for x in found))) == sorted((i, j - half) for i, j in near if i < half <= j)

    class Few(near_dup.Sets):
        n = 0

        def add(self, text):
            self.n += 1
            assert self.n <= 32, "two blocks of about four texts each"
            super().add(text)

    rows = spark.createDataFrame([(1, k, k, len(sets[k]), t) for k, t in enumerate(texts)],
                                 "family long, id long, component long, n long, text string")
    links = {(r.a, r.b) for r in near_dup._across(rows, "family", "text", lambda: Few((75, 100)), "n").collect()}
    assert links <= {(b, a) for a, b in near} | set(near)

    def groups(pairs):
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for i, j in pairs:
            parent[root(i)] = root(j)
        return [root(i) == root(j) for i in range(n) for j in range(i)]
    assert groups(links) == groups(near)


def test_depth_follows_the_crowd(spark, monkeypatch):
    """A member's block is its longest crowded prefix, and nobody is lost."""
    import random
    monkeypatch.setattr(near_dup, "REGION_ROWS", 8)
    rng, rows = random.Random(9), []
    for k in range(400):
        depth = rng.choice([0, 0, 1, 3, 64])
        rows.append((7, 400, k, 10, bytes(depth) + bytes(rng.randrange(1, 4) for _ in range(64 - depth))))
    rows += [(8, 5, 1000 + k, 10, bytes(64)) for k in range(5)]
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "region long, size long, id long, n long, tail binary")
    got = near_dup._deepened(df).collect()
    assert Counter(r.id for r in got) == Counter(r[2] for r in rows)
    assert {r.block for r in got if r.region == 8} == {0}
    tails = [r[4] for r in rows if r[0] == 7]
    crowd = Counter(t[:k] for t in tails for k in range(65))
    blocks, want, whole = defaultdict(set), defaultdict(set), set()
    for r in got:
        if r.region == 7 and crowd[bytes(r.tail)] > 8:
            whole.add(r.block)  # equal in the whole order: dealt out
        elif r.region == 7:
            blocks[r.block].add(r.id)
            want[max((bytes(r.tail[:k]) for k in range(65) if crowd[bytes(r.tail[:k])] > 8), key=len)].add(r.id)
    assert sorted(map(sorted, blocks.values())) == sorted(map(sorted, want.values())) and len(blocks) > 3
    assert len(whole) > 1


# ------------------------------------------------------- substring dedup
def brute_substrings(rows, window):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (d, _), w in zip(rows, split):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for (d, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k:k + window])] < d:
                gone |= set(range(k, k + window))
        out[(d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_substrings_equal_brute_force(docs, window):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = substring_dedup.dedup_substrings(docs, window, with_text=True).collect()
    assert Counter(tuple(r)[:4] for r in found) == brute_substrings(rows, window)
    changed = [r for r in found if r.n_removed]
    assert changed and all(sha(r.kept) == r.kept_sha256 for r in changed)
    assert all(sum(s.end - s.start for s in r.intervals) == r.n_removed for r in found)


# ------------------------------------------------------------------- PII
PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := pii.only_digits(s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(pii.only_digits(s)) <= 15),
}


def brute_base(text):
    spans = [(m.start(), m.end(), k) for k, (p, good) in PATTERNS.items() for m in re.finditer(p, text) if good(m[0])]
    return sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    import random
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choices("a1@.+-() \né45%_", k=rng.randrange(1, 60)))
        assert pii.base_spans(text) == brute_base(text), text
    cases = ["a@b.c@d.e.f", "x@@y.z", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.4", "+1 (234) 555-0199.", "é@b.de"]
    for text in cases:
        assert pii.base_spans(text) == brute_base(text)


def test_base_spans_take_linear_time():
    import time
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1." * 100_000, "x" * 300_000 + "1"):
        pii.base_spans(text)
        list(pii._zones(text, {}))
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def private(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        a, b, c, d = rng.integers(1, 255, 4).tolist()
        digits = [4, *rng.integers(0, 10, 14).tolist()]
        digits.append(next(x for x in range(10) if pii.luhn("".join(map(str, [*digits, x])))))
        card = "".join(map(str, digits))
        rows.append((i, [f"Write to u{i}.x@mail{i}.example.org now", f"Host {a}.{b}.{c}.{d} is down",
                         f"call +1 ({a + 100}) 555-{1000 + i} today", f"paid by {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} ok",
                         f"nothing {i} private in 2021"][i % 5]))
    rows += [(900, None), (901, ""), (902, "x 12345 " * 2000), (900, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))


def test_detect_keeps_base_and_adds_apart(private):
    rows = {r.doc_id: r for r in pii.detect(private).collect()}
    for r in private.collect():
        base, got = brute_base(r.text or ""), rows[r.doc_id]
        listed = [f"{k}:{a}:{b}" for a, b, k in base]
        assert got.base_sha256 == sha(",".join(listed))
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        spans = got.spans.split(",") if got.spans else []
        assert set(listed) <= set(spans)
        if r.doc_id % 5 == 4 and r.doc_id < 900:
            assert not spans


def test_field_recovers_shapes(private):
    field = pii.train([r.text for r in private.collect() if r.text and r.doc_id < 200])
    right = total = 0
    for r in private.filter("doc_id BETWEEN 200 AND 299").collect():
        total += 1
        right += set(field.decode(r.text)) == set(brute_base(r.text))
    assert right >= 0.95 * total
    assert pii.mask("ab 1.2.3.4 c", [(3, 10, "ip")]) == "ab <ip> c"


def test_masking_keeps_columns(docs):
    out = pii.mask_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


# --------------------------------------------------------------- quality
@pytest.fixture(scope="module")
def labelled(spark):
    import random
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (None, "abcd efgh"), (3, rows[3][1])]
    labels += [(0, None, 1), (None, 1, 0), (7777, 1, 0), (3, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(0)),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    found = quality.classify(docs, labels).collect()
    assert len(found) == 404
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [r for r in found if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in tested) >= 0.97 * len(tested)


def test_quality_never_learns_from_held_out_rows(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert (a.rows == b.rows).all() and a.bias == b.bias


def test_quality_without_labels(docs, labelled):
    found = quality.classify(docs, labelled[1].limit(0)).collect()
    assert all(r.score == 0.5 for r in found)


def brute_features(word):
    marked = f"<{word}>"
    grams = [marked[k:k + n] for n in (3, 4) for k in range(len(marked) - n + 1)]
    return Counter(zlib.crc32(g.encode()) % quality.BUCKETS for g in ["w" + word, *grams])


@pytest.mark.parametrize("piece", [1, 2, 5, 7, 1 << 16])
def test_words_of_any_length_have_character_grams(piece):
    import random
    rng = random.Random(12)
    for n in (1, 2, 3, 5, 20, 63, 64, 65, 200, 1000):
        for letters in ("abcXYZ09+/", "文字列漢語仮名", "aé文𝒳"):
            word = "".join(rng.choices(letters, k=n))
            want = brute_features(word)
            assert Counter(quality.features_of(word.encode())) == want
            assert Counter(np.concatenate(list(quality.features_of_long(word.encode(), piece))).tolist()) == want


def test_quality_of_texts_without_white_space(spark):
    import random
    rng = random.Random(13)
    words = ["".join(rng.choices([chr(c) for c in range(0x4E00, 0x4E60)], k=2)) for _ in range(60)]
    rows = []
    for i in range(300):
        good = "".join(rng.choices(words, k=rng.randrange(30, 300)))
        bad = "".join(rng.sample(good, len(good))) if i % 4 else "".join(rng.choices("ABCDEFabcdef0123456789+/", k=400))
        rows.append((i, bad if i % 2 else good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    tested = [r for r in quality.classify(docs, labels, 0.5).collect() if r.held_out]
    assert len(tested) > 40
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in tested) >= 0.95 * len(tested)


# ---------------------------------------------------------- empty tables
def test_empty_tables(no_docs, items, labelled):
    assert packing.pack_documents(no_docs, BYTE).count() == 0
    assert quality.classify(no_docs, labelled[1]).count() == 0
    assert decontam.contamination(no_docs, items[1]).count() == 0
    assert token_count.count_tokens(no_docs, WORD).count() == 0
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert pii.detect(no_docs).count() == 0
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_empty_benchmark(docs, items):
    found = decontam.contamination(docs, items[1].limit(0))
    assert found.filter("contaminated OR n_items > 0").count() == 0

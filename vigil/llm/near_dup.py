"""MinHash near-duplicates (7): an LSH forest over word shingles.

1. Every document's set of distinct 5-word shingles gets a signature of
   HASHES minima.  Documents with equal sets become one class.
2. The forest has ORDERS sorted orders of the signatures; each begins with
   DEPTH positions of its own.  Classes that agree in these share a region.  A
   region's depth is its own: while a prefix is shared by more than REGION_ROWS
   classes, these are parted by the next two positions.  What is parted from a
   crowded prefix without being crowded stays together as one region, sorted by
   the rest of the order, so neighbours have the longest common prefix; as two
   short values tell 2^(2 * SKETCH_BITS) prefixes apart, such a region is bounded.
   Classes that agree in the whole order are dealt out at random.  Neighbours
   are candidates.
3. Candidates whose signatures agree enough are compared on their full sets;
   confirmed links are joined into components.
4. The rest, whole: in every region that still holds several components, the
   signatures of all classes of different components are compared, block by
   block.  Classes that agree enough, directly or through others, form a
   family; a family's full sets are compared by shingle postings, again only
   across components, as another link within one changes nothing.  Blocks yield
   forests of the pairs found, never the pairs.

So a pair is tested unless it shares no region at all: at the threshold that
has a chance of (1 - threshold^DEPTH)^ORDERS, about 5e-6 for 0.75.  "Agree enough"
rejects pairs more than 5 standard deviations below the threshold.  The work of
step 4 grows with (classes outside the largest component) x (classes) of a
region or family, in numpy; its rows grow with the classes and the blocks.  Its
memory does not grow with the texts' lengths: a block has BLOCK_ROWS classes or
HELD_HASHES shingles on average, whichever is less, and no file is written beside
Spark's own.

Words: A-Z lower-cased, then ``[^\\x20\\x09-\\x0D]+``.  With fewer words than a
shingle the whole sequence is the one shingle; null or wordless texts have an
empty set and link with nothing.  Rows without a doc_id link with nothing and are
kept; rows that repeat a doc_id each get its component; an empty table gives no
rows; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.components import connected_components
from vigil.llm.shared import BLOCK_BYTES, append, free_name, mixed, runs_of, word_hashes, written

SHINGLE, HASHES, ORDERS, DEPTH = 5, 128, 32, 4
#: Rows to be removed that are sent to every executor.
MOST_BROADCAST = 1 << 20
REGION_ROWS = 512
#: Classes of a block in the comparisons across components, and its shingle hashes unless one set has more.
BLOCK_ROWS, HELD_HASHES = 512, 1 << 21
#: Bits of each position that travel with a class through a sort; two positions to a byte.
SKETCH_BITS = 4
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MULTIPLY = np.random.default_rng(7).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.translate(LOWER).split() for t in data]
    hashes = word_hashes([x for w in words for x in w])
    out, at = [], 0
    base = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
    for w in words:
        h = hashes[at:at + len(w)]
        at += len(w)
        if not len(h):
            out.append(h)
            continue
        n = min(SHINGLE, len(h))
        runs = len(h) - n + 1
        total = np.full(runs, n, np.uint64)
        for k in range(n):
            total = total + h[k:k + runs] * base[k]
        out.append(np.unique(mixed(total)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Upper 32 bits of HASHES minima for each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for a, b in runs_of(np.array([len(s) for s in sets]), 1 << 16):  # a run stays in the cache for all functions
        part = flat[starts[a]:starts[b] if b < len(sets) else len(flat)]
        for k in range(HASHES):
            out[a:b, k] = np.minimum.reduceat(part * MULTIPLY[k], starts[a:b] - starts[a]) >> np.uint64(32)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def start():
        import pyarrow as pa

        def run(data, part):
            sets = shingle_sets(data)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full])):
                    sig[i] = row.tobytes()
            total = [int(np.sum(s).view(np.int64)) if len(s) else 0 for s in sets]
            other = [int(np.sum(mixed(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0 for s in sets]
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(total, pa.int64()), pa.array(other, pa.int64()),
                    pa.array(sig, pa.binary())]
        return run

    return append(docs, start, [("n_shingles", "bigint"), ("h1", "bigint"), ("h2", "bigint"), ("sig", "binary")]).drop("text")


def _sig_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _regions(classes: DataFrame) -> DataFrame:
    """(region, id, ord): the region of every class in every order."""

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not len(batch):
                continue
            sig, ids = _sig_rows(batch.column("sig")).astype(np.uint64), batch.column("id").to_numpy(zero_copy_only=False)
            key = np.zeros((len(sig), ORDERS), np.uint64) + np.arange(ORDERS, dtype=np.uint64)
            for k in range(DEPTH):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k:ORDERS * DEPTH:DEPTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids, ORDERS)),
                 pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(ids)))], ["region", "id", "ord"])

    return classes.select("id", "sig").mapInArrow(run, "region long, id long, ord int")


def _tails(members: DataFrame) -> DataFrame:
    """Sort keys: the signature's short values in the order of the member's sorted order, its own positions last."""

    def run(batches):
        import pyarrow as pa
        place = np.array([[(o * DEPTH + DEPTH + k) % HASHES for k in range(HASHES)] for o in range(ORDERS)])
        for batch in batches:
            if not len(batch):
                continue
            sig = _sig_rows(batch.column("sig"))
            order = batch.column("ord").to_numpy(zero_copy_only=False)
            short = (sig & np.uint32((1 << SKETCH_BITS) - 1)).astype(np.uint8)[np.arange(len(sig))[:, None], place[order]]
            packed = (short[:, ::2] << SKETCH_BITS) | short[:, 1::2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("region", "size", "id", "n")),
                 pa.array([r.tobytes() for r in packed], pa.binary())], ["region", "size", "id", "n", "tail"])

    return members.select("region", "size", "id", "n", "ord", "sig").mapInArrow(
        run, "region long, size long, id long, n long, tail binary")


def _deepened(tails: DataFrame) -> DataFrame:
    """(region, block, id, n, tail): crowded regions parted by longer prefixes, each as deep as it is crowded.

    A block is the longest crowded prefix of its members, 0 in regions that are
    not crowded.  Every round looks at one more byte of the members still crowded.
    """
    columns = ["region", "block", "id", "n", "tail"]
    out = tails.filter(F.col("size") <= REGION_ROWS).withColumn("block", F.lit(0).cast("long")).select(columns)
    still = tails.filter(F.col("size") > REGION_ROWS).withColumn("block", F.lit(0).cast("long"))
    for depth in range(1, HASHES * SKETCH_BITS // 8 + 1):
        parted = still.withColumn("child", F.xxhash64("region", F.substring("tail", 1, depth))).drop("size")
        crowded = written(parted.groupBy("child").agg(F.count("*").alias("size")).filter(F.col("size") > REGION_ROWS))
        n_crowded = crowded.count()
        if not n_crowded:
            break
        if n_crowded <= MOST_BROADCAST:
            crowded = F.broadcast(crowded)
        parted = written(parted.join(crowded, "child", "left"))
        out = out.unionByName(parted.filter("size IS NULL").select(columns))
        still = parted.filter("size IS NOT NULL").withColumn("block", F.col("child")).drop("child")
    else:  # equal in the whole order
        still = still.withColumn("block", F.xxhash64("block", F.pmod(F.xxhash64("id", "region"), F.ceil(F.col("size") / REGION_ROWS))))
    return out.unionByName(still.select(columns))


def _floor(threshold: float) -> float:
    """Least share of agreeing short values for a candidate: 5 standard deviations below the threshold's."""
    same = threshold + (1 - threshold) / (1 << SKETCH_BITS)
    return same - 5 * (same * (1 - same) / HASHES) ** 0.5


def _neighbours(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) among neighbours of the sorted regions; a task keeps a forest of those that look surest."""
    least, sure = _floor(threshold), threshold + (1 - threshold) / (1 << SKETCH_BITS)

    def run(batches):
        import pyarrow as pa
        last, found = None, {}
        for batch in batches:
            if not len(batch):
                continue
            region, block, ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "block", "id", "n"))
            tail = np.frombuffer(b"".join(batch.column("tail").to_pylist()), np.uint8).reshape(len(ids), -1)
            if last is not None:
                region, block, ids, n, tail = (np.concatenate(x) for x in zip(last, (region, block, ids, n, tail)))
            same = (region[1:] == region[:-1]) & (block[1:] == block[:-1])
            at = np.flatnonzero(same)
            low, high = np.minimum(n[at], n[at + 1]), np.maximum(n[at], n[at + 1])
            at = at[low >= threshold * high - 1e-9]
            share = _agreement(tail[at], tail[at + 1])
            for i, s in zip(at[share >= least].tolist(), share[share >= least].tolist()):
                a, b = int(ids[i]), int(ids[i + 1])
                found[(min(a, b), max(a, b))] = s
            last = region[-1:], block[-1:], ids[-1:], n[-1:], tail[-1:]
            if len(found) >= 200_000:
                yield thin(found)
                found = {}
        if found:
            yield thin(found)

    def thin(found):
        """Pairs that are all but certain are needed only where they join what surer ones have not joined."""
        import pyarrow as pa
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        kept = []
        for (a, b), s in sorted(found.items(), key=lambda f: (-f[1], f[0])):
            if s > sure:
                x, y = root(a), root(b)
                if x == y:
                    continue
                parent[x] = y
            kept.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal short values of two packed sketches."""
    z = x ^ y
    return (((z >> SKETCH_BITS) == 0).sum(axis=1) + ((z & ((1 << SKETCH_BITS) - 1)) == 0).sum(axis=1)) / HASHES


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets reach the threshold (a fraction of integers)."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    upper, lower = threshold

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            x, y = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            sizes = pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False)
            for lo, hi in runs_of(sizes):
                same = []
                for a, b in zip(*(shingle_sets(c.slice(lo, hi - lo).to_pylist()) for c in (x, y))):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    same.append(common > 0 and lower * common >= upper * (len(a) + len(b) - common))
                yield batch.slice(lo, hi - lo).select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, group: str, value: str, holder, weight=None) -> DataFrame:
    """Forest edges (a, b) between members of a group in different components.

    rows: (group, id, component, value).  Members outside the group's largest
    component are dealt into blocks, and so are the others; every block of the
    former meets every block of both, so no task holds more than two blocks
    and members of the largest component never meet each other.  A block has
    BLOCK_ROWS members on average, or fewer whose weights sum up to HELD_HASHES.
    holder() takes two blocks' values, add(value) in order; its links(left,
    right), of places in that order, gives (i, j) index arrays into these of the
    pairs that count.  right is None where a block meets itself.
    """
    weight = F.lit(0) if weight is None else F.col(weight)
    parts = rows.groupBy(group, "component").agg(F.struct(F.count("*").alias("n"), F.sum(weight).alias("w"), "component").alias("part"))
    n_blocks = lambda n, w: F.least(n, F.ceil(F.greatest(n / BLOCK_ROWS, w / HELD_HASHES))).cast("int")
    top = written(parts.groupBy(group).agg(F.count("*").alias("k"), F.sum("part.n").alias("n"), F.sum("part.w").alias("w"), F.max("part").alias("top"))
                  .filter("k > 1").select(group, F.col("top.component").alias("main"),
                                          n_blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("n_rest"),
                                          n_blocks(F.col("top.n"), F.col("top.w")).alias("n_main")))
    d = written(rows.select(group, "id", "component")).join(top, group)
    is_main = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("id", group), F.when(is_main, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    meet = lambda lo, hi, main, side: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(main).alias("with_main"), side.alias("side"))
    rest = F.transform(each(F.col("n_rest")), lambda o: meet(F.least(block, o), F.greatest(block, o), False, (block > o).cast("int")))
    rest = F.concat(rest, F.transform(each(F.col("n_main")), lambda o: meet(block, o, True, F.lit(0))))
    main = F.transform(each(F.col("n_rest")), lambda o: meet(o, block, True, F.lit(1)))
    d = d.select(group, "id", "component", F.explode(F.when(is_main, main).otherwise(rest)).alias("m"))
    d = d.select(group, "m.lo", "m.hi", "m.with_main", "m.side", "id", "component")
    d = d.join(rows.select(group, "id", value), [group, "id"])
    keys = [group, "with_main", "lo", "hi"]
    d = d.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "side", "id") \
        .select(*keys, "side", "id", "component", value)

    def forest(members, values):
        import pyarrow as pa
        if len(members) < 2:
            return
        side, ids, components = (np.array(c) for c in zip(*members))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left):
            return
        within = not len(right)
        right = left if within else right
        i, j = values.links(left, None if within else right)
        i, j = left[i], right[j]
        apart = components[i] != components[j]
        parent: dict[int, int] = {}
        out = []
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            a, b = x, y
            while parent.get(a, a) != a:
                a = parent[a]
            while parent.get(b, b) != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        members, values, now = [], None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != now:
                    yield from forest(members, values)
                    members, values, now = [], holder(), row[:4]
                members.append(row[4:7])
                values.add(row[7])
        yield from forest(members, values)

    return d.mapInArrow(run, "a long, b long")


class Sketches(list):
    """Pairs whose sketches agree enough."""

    def __init__(self, threshold: float):
        super().__init__()
        self.least = _floor(threshold)

    add = list.append

    def links(self, left, right):
        x = np.frombuffer(b"".join([self[k] for k in left]), np.uint8).reshape(len(left), -1)
        y = x if right is None else np.frombuffer(b"".join([self[k] for k in right]), np.uint8).reshape(len(right), -1)
        i, j = [], []
        for k in range(len(x)):
            z = x[k] ^ (y[k + 1:] if right is None else y)
            at = np.flatnonzero((((z >> SKETCH_BITS) == 0).sum(axis=1) + ((z & ((1 << SKETCH_BITS) - 1)) == 0).sum(axis=1)) >= self.least * HASHES)
            i.append(np.full(len(at), k))
            j.append(at + k + 1 if right is None else at)
        return np.concatenate(i), np.concatenate(j)


class Sets:
    """Pairs whose full sets reach the threshold, by postings: one lookup counts a set's overlap with a whole block.

    A text is kept as its shingle hashes only.
    """

    def __init__(self, threshold: tuple[int, int]):
        self.threshold, self.held = threshold, []
        self.waiting, self.waiting_bytes = [], 0

    def add(self, text: str) -> None:
        data = text.encode()
        if self.waiting and self.waiting_bytes + len(data) > BLOCK_BYTES:
            self._split()
        self.waiting.append(data)
        self.waiting_bytes += len(data)

    def _split(self) -> None:
        data, self.waiting, self.waiting_bytes = self.waiting, [], 0
        self.held += shingle_sets(data)

    def _postings(self, members) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places in members) by hash."""
        sets = [self.held[m] for m in members.tolist()]
        hashes, owners = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], owners[order]

    def links(self, left, right):
        if self.waiting:
            self._split()
        within, sizes = right is None, np.array([len(own) for own in self.held], np.int64)
        right = left if within else right
        common = np.zeros((len(left), len(right)), np.int64)
        shingles, owner = self._postings(right)
        for k, member in enumerate(left.tolist()):
            mine = self.held[member]
            first, last = np.searchsorted(shingles, mine, "left"), np.searchsorted(shingles, mine, "right")
            n = last - first
            places = np.repeat(first - np.concatenate([[0], np.cumsum(n[:-1])]), n) + np.arange(n.sum())
            common[k] = np.bincount(owner[places], minlength=len(right))
        upper, lower = self.threshold
        i, j = np.nonzero((common > 0) & (lower * common >= upper * (sizes[left][:, None] + sizes[right] - common)))
        return (i[j > i], j[j > i]) if within else (i, j)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links have 100 * |A and B| >= percent * |A or B|."""
    threshold, fraction = percent / 100, (percent, 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(_signed(docs))
    classes = written(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", F.col("n_shingles").alias("n"))
                      .agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig")))
    regions = written(_regions(classes))
    shared = written(regions.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1"))
    members = written(regions.join(shared, "region").select("region", "id", "ord", "size"))
    tails = written(_tails(members.join(classes.select("id", "n", "sig"), "id")))
    rows = _deepened(tails).repartition(F.col("region"), F.col("block")).sortWithinPartitions("region", "block", "tail", "id")
    first = written(_neighbours(rows, threshold).distinct())
    # only texts of classes that share a region are needed again
    near = members.select(F.col("id").alias("doc_id")).distinct()
    texts = written(docs.join(near, "doc_id", "left_semi").withColumnRenamed("doc_id", "id"))
    links = written(_confirmed(first, texts, fraction))
    component = connected_components(links)

    # what the neighbours left open: classes of one region in different components
    placed = written(tails.select("region", "id", "tail").join(component, "id", "left")
                     .withColumn("component", F.coalesce("component", "id")))
    alike = _across(placed, "region", "tail", lambda: Sketches(threshold)).distinct()
    family = connected_components(written(alike))
    family = written(family.unionByName(family.select(F.col("component").alias("id"), "component").distinct())
                     .select("id", F.col("component").alias("family")))
    inside = (texts.join(family, "id").join(component, "id", "left")
              .join(classes.select("id", "n"), "id")
              .select("family", "id", F.coalesce("component", "id").alias("component"), "n", "text"))
    links = links.unionByName(_across(written(inside), "family", "text", lambda: Sets(fraction), "n"))
    component = written(connected_components(links))

    per_class = written(classes.join(component, "id", "left").select("h1", "h2", F.col("n").alias("n_shingles"),
                                                                    F.coalesce("component", "id").alias("component_id")))
    out = signed.drop("sig").join(per_class, ["h1", "h2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def remove_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of near-duplicates, with its columns: the one with the smallest doc_id (null last).

    Rows are judged by their texts: repeated rows, copies without an id and
    different texts under one id each count for themselves.  Rows without words
    are near to nothing and stay.
    """
    row = free_name(docs, "__row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that a row keeps its number
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("row"), "component_id")
    found = written(found.join(numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id")), "row"))
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"))
    gone = written(found.join(stays.select(F.col("least.row").alias("row")), "row", "left_anti").select(F.col("row").alias(row)))
    if gone.count() <= MOST_BROADCAST:  # a few MB of numbers; more of them meet the texts in a shuffle
        gone = F.broadcast(gone)
    return numbered.join(gone, row, "left_anti").drop(row)

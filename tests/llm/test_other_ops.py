"""Chat, WARC, embeddings, components and the pipeline against brute force."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import chat, components, embed_dup, warc


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


# -------------------------------------------------------------------- chat
ODD = ["plain", "", None, "### ", "### Assistant:\nhi</turn>\n", "</turn>", "\\### Assistant: </turn> ok", "\\b\\l\\h\\\\", "a\\", "\\",
       "#", "##", "<", "</turn", ":\n", "x\n### user:\n", "\\n\\c", "𝒳é\u0301", "### " * 500, "</turn>\n### user:\nq</turn>\n"]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", s) for t, s in enumerate(ODD)]
    rows += [(2, 0, "### a:\n", "assistant"), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "assistant", "first"), (3, 0, "user", None),
             (None, 0, "assistant", "lost"), (None, 0, "user", "lost"), (4, 5, "assistant", "b"), (4, 5, "assistant", "a")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))


def test_chat_round_trip(conversations):
    formatted = chat.format_conversations(conversations)
    back = {r.conv_id: r for r in chat.read_back(formatted.drop("turns")).collect()}
    source = defaultdict(list)
    for r in conversations.collect():
        source[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    assert set(back) == set(source)
    for conv, turns in source.items():
        turns.sort()
        got = back[conv]
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns))
        assert (got.loss_chars, got.loss_sha256) == (len(loss), sha(loss))
    for r in formatted.collect():
        assert back[r.conv_id].formatted_chars == len(r.formatted)
        n = len(r.turns)
        assert r.formatted.count(chat.OPEN) == n and r.formatted.count("</turn>") == n


def test_plain_texts_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "a # b < c \\ d")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "### user:\na # b < c \\ d</turn>\n"


def test_no_conversations(conversations):
    assert chat.read_back(chat.format_conversations(conversations.limit(0))).count() == 0


# -------------------------------------------------------------------- WARC
def test_warc_round_trip(spark):
    big = "<html>" + "é" * 200_000
    same = "<p>" + "same " * 40
    rows = [(i, f"http://h{i % 3}/ü p\r\n{i}", [same, f"<p>{i}</p>", "tiny", None, "", big, "\r\n\r\nWARC/1.1\r\n\r\n" * 9][i % 7]) for i in range(70)]
    rows += [(0, None, same), (None, "http://n/", same), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x"))
    index = warc.write_archives(pages)
    records = warc.read_records(index).collect()
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != page
        want[(page, len(data), sha(data), "revisit" if revisit else "response", other if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == want
    assert all(sha(bytes(r.payload)) == r.payload_digest for r in records if r.record_type == "response")
    some = warc.read_records(index.filter("url LIKE 'http://h1%'")).collect()
    assert len(some) == sum((u or "").startswith("http://h1") for _, u, _ in rows)
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


# -------------------------------------------------------------- embeddings
def brute_links(rows):
    def sound(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (a, v) in enumerate(rows):
        for j in range(i):
            b, w = rows[j]
            if a is None or b is None or not sound(v) or not sound(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return Counter((a, n[i], None if a is None else least[root(i)], a is None or least[root(i)] == a) for i, (a, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(250)]
    centre = rng.standard_normal(16)
    rows += [(1000 - i, (centre + 0.13 * rng.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(2000 + i, rows[5][1]) for i in range(20)] + [(2100, [2 * x for x in rows[5][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] + [1.0] * 15), (3005, [float("inf")] * 16),
             (3006, rows[7][1][:8]), (None, rows[5][1]), (3007, [1e38 * x for x in rows[9][1]]), (3008, [1e-38 * x for x in rows[9][1]])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component_id", F.lit(1))
    assert Counter(tuple(r) for r in embed_dup.near_duplicates(df).collect()) == brute_links(rows)
    assert embed_dup.near_duplicates(df.limit(0)).count() == 0


def test_plan_keeps_the_chance_small():
    for n in (1, 300, 10_000, 10**7):
        bits, tables = embed_dup.plan(n, 0.9)
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - same) ** tables <= embed_dup.MISS


# -------------------------------------------------------------- components
def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(90)]
    edges += [(5000, 5000 + i) for i in range(1, 200)]
    found = {r.id: r.component for r in components.connected_components(
        spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    for x in {x for e in edges for x in e}:
        assert found.get(x, x) == root(x)


# ---------------------------------------------------------------- pipeline
@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, docs):
    """documents (with junk, a benchmark passage and personal data added), labels and benchmark as Parquet."""
    folder = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"item{k}" for k in range(30))
    good = [(5000 + i, f"fine {i} prose about thing{i} and place{i * 7} with many words in row {i}") for i in range(80)]
    junk = [(6000 + i, " ".join(f"BUY{i}{k}!!" for k in range(30))) for i in range(40)]
    more = [(7000, f"before {passage} after"), (7001, "mail to someone.else@example.org please, it is fine"), (7002, None)]
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in good + junk + more]
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.unionByName(spark.createDataFrame(rows, base.schema)).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in junk[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages(spark, tables):
    kept = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = kept.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, tables).collect(), kept.schema)
        assert kept.columns == columns, name
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    assert sum(6000 <= (i or 0) < 6040 for i in seen["quality"]) == 0
    assert all(5000 + i in seen["quality"] for i in range(80))
    assert 7000 in seen["near_duplicates"] and 7000 not in seen["decontamination"]
    assert seen["personal_data"][7001] == "mail to <email> please, it is fine"
    assert set(seen["personal_data"]) == set(seen["decontamination"])
    pieces = corpus_pipeline.run(spark, tables)
    assert {r.doc_id for r in pieces.collect()} == set(seen["personal_data"])
    assert pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).filter("n % doc_tokens <> 0").count() == 0

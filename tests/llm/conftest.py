import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyzéß"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = ["".join(random.Random(f"w{rng.randrange(vocabulary)}").choices(LETTERS, k=5)) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with exact copies, near copies, shared passages, empty, null and odd texts."""
    rng = random.Random(3)
    docs = [prose(rng, rng.choice([3, 12, 60, 120, 200])) for _ in range(60)]
    docs += [docs[4], docs[4], docs[10]]
    for k in (8, 9, 11, 12, 13):
        words = docs[k].split()
        if len(words) > 10:
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    passage = prose(rng, 70, 4000)
    docs += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 40) for _ in range(6)]
    docs += ["", None, "   \n\t ", "One", "one", "a b c d", "A B c d", "x " * 300, "é" * 5000, "İΣ ς ' 's ''re don't 'tis 1½",
             "<|endoftext|> a<|startoftext|>b  <|endoftext|>", "tab\there  two spaces \n\n lines \n", "word " * 3000]
    return [(i * 7 % 1000, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with the columns of documents, clashing extra columns, and repeated and null ids."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "x", 1.0, True) for i, t in corpus]
    rows += [rows[4], rows[4], (None, "no id here " * 20, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, score double, kept boolean")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def long_text(n: int) -> str:
    return prose(random.Random(n), n)

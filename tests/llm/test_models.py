"""The trained models against plain versions: all segmentations of a zone, a dense forward pass and gradient."""
import numpy as np
import pytest

from vigil.llm import pii, quality


def segmentations(zone, at=0):
    """All choices of disjoint (segment number, type)."""
    if at >= zone.n:
        yield []
        return
    yield from segmentations(zone, at + 1)  # a token outside of every segment
    for k, (i, j, _) in enumerate(zone.segments):
        if i == at:
            for kind in range(len(pii.KINDS)):
                for rest in segmentations(zone, j):
                    yield [(k, kind), *rest]


TEXTS = ["tel 030 1234", "a@b.de 12 34", "10.0.0.1 5", "x 1234-56 78"]


def zones(rng):
    for text in TEXTS:
        field = pii.Field(rng.normal(0, 0.4, (pii.FEATURES, len(pii.KINDS))))
        for zone in pii._zones(text, field.shapes):
            if zone.segments:
                yield text, field, zone


def test_decoding_finds_the_best_of_all_segmentations():
    seen = 0
    for seed in range(12):
        for text, field, zone in zones(np.random.default_rng(seed)):
            scores = field.scores(zone)
            best = max(sum(scores[k][t] for k, t in way) for way in segmentations(zone))
            places = {(zone.edges[i], zone.edges[j]): k for k, (i, j, _) in enumerate(zone.segments)}
            spans = [s for s in field.decode(text) if (s[0], s[1]) in places]
            got = sum(scores[places[a, b]][pii.KINDS.index(kind)] for a, b, kind in spans)
            assert got == pytest.approx(best)
            seen += 1
    assert seen > 20


def test_a_training_step_is_the_likelihoods_gradient():
    for seed in range(6):
        for _, field, zone in zones(np.random.default_rng(seed)):
            ways = list(segmentations(zone))
            scores = field.scores(zone)
            weight = np.exp([sum(scores[k][t] for k, t in way) for way in ways])
            expected = np.zeros_like(scores)
            for way, w in zip(ways, weight / weight.sum()):
                for k, t in way:
                    expected[k][t] += w
            i, j, _ = zone.segments[seed % len(zone.segments)]
            gold = {(i, j): 1}
            want, slots = field.weights.copy(), zone.slots(field.known)
            for k, segment in enumerate(zone.segments):
                gradient = -expected[k]
                if (segment[0], segment[1]) == (i, j):
                    gradient[1] += 1
                if np.abs(gradient).max() > 1e-4:
                    want[slots[k]] += 0.1 * gradient
            field.step(zone, gold, 0.1, set())
            assert np.allclose(field.weights, want, atol=1e-10)


def dense(examples, epochs, rate, seed):
    """train() with a vector per document and no shortcuts; a text's rows move by their share of its largest weight."""
    rng = np.random.default_rng(seed)
    rows, dims = quality.BUCKETS + 1, quality.DIMS
    vectors, layer = rng.uniform(-1 / dims, 1 / dims, (rows, dims)), rng.uniform(-1 / dims, 1 / dims, (2, dims))
    shares = []
    for text, _ in examples:
        share = np.zeros(rows)
        at, weights = quality.bag(text)
        share[at] = weights
        shares.append(share)
    labels = [y for _, y in examples]
    bias, done = np.log((np.bincount(labels, minlength=2) + 1) / (len(labels) + 2)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            step = rate * (1 - done / (epochs * len(examples)))
            done += 1
            mean = shares[i] @ vectors
            out = layer @ mean + bias
            p = np.exp(out - out.max())
            error = p / p.sum() - np.eye(2)[labels[i]]
            vectors, layer = vectors - step * np.outer(shares[i] / (shares[i].max() or 1), error @ layer), layer - step * np.outer(error, mean)
    return vectors, layer, bias


def test_training_and_scores_equal_a_dense_version(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 512)
    monkeypatch.setattr(quality, "AGAIN", 512)
    rng = np.random.default_rng(1)
    examples = [(" ".join(rng.choice(["good", "bad", "éclair", "the the", "x" * 80, "12"], rng.integers(0, 20))).encode(), int(rng.integers(0, 2)))
                for _ in range(25)]
    model = quality.train(examples, epochs=3, rate=0.5, seed=4)
    vectors, layer, bias = dense(examples, 3, 0.5, 4)
    probabilities = []
    for text, _ in examples:
        at, weights = quality.bag(text)
        out = layer @ (weights @ vectors[at] if len(at) else np.zeros(quality.DIMS)) + bias
        probabilities.append(np.exp(out[1]) / np.exp(out).sum())
        words = text.split()
        plain = quality.margin(words, quality.WordShares(model).__getitem__, model)
        assert 1 / (1 + np.exp(-plain)) == pytest.approx(probabilities[-1], abs=1e-4)
    assert max(probabilities) - min(probabilities) > 1e-3  # the texts matter, not the bias alone

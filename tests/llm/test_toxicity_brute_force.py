"""The toxicity classifier against plain Python: its features, its scores, and the gradients of its first step."""

import math
import random

import numpy as np

from quillspark.llm import toxicity as T

MASK = 2**64 - 1


def slow_features(word):
    """Buckets of one word: the hash of a stretch is a polynomial in the inverse multiplier, by code points."""
    inverse = int(T.INVERSE)

    def bucket(stretch, kind):
        h = kind
        for k, ch in enumerate(stretch):
            h = (h + (ord(ch) + 1) * pow(inverse, k, 2**64)) & MASK
        h ^= h >> 31
        return ((h * 0xC2B2AE3D27D4EB4F) & MASK) >> (64 - T.BUCKET_BITS)

    bare = f"<{word.strip(T.STRIP)}>"
    out = [bucket(bare, 1)]
    if len(bare) > 2:
        out += [bucket(bare[i : i + n], n) for n in T.GRAMS for i in range(len(bare) - n + 1)]
    return sorted(out)


def slow_value(word, scores):
    own = slow_features(word)
    return sum(float(scores[b]) for b in own) / len(own)


def slow_mean(values):
    top = max(values)
    weights = [math.exp(T.SHARP * (v - top)) for v in values]
    return sum(w * v for w, v in zip(weights, values)) / sum(weights)


def texts(n, rng):
    clean = ["house", "tree", "Wasser,", "río", "日本語", "a", "...", "under_score"]
    foul = ["idiot", "idi0t", "stup1d!"]
    docs = [" ".join(rng.choice(clean) for _ in range(rng.randrange(1, 12))) for _ in range(n)]
    labels = [int(rng.random() < 0.4) for _ in docs]
    return [f"{d} {rng.choice(foul)}" if y else d for d, y in zip(docs, labels)], labels


def test_features():
    words = ["a", "idiot", "<>", "...", "Straße", "日本語!", "x" * 30, "o'clock", "\U0001f600ab"]
    flat, of = T.features(words)
    for i, w in enumerate(words):
        assert sorted(flat[of == i].tolist()) == slow_features(w), w


def test_scores():
    rng = random.Random(3)
    model = T.fit(*texts(60, rng), epochs=8)
    scorer = T.Scorer(model)
    for t in [*texts(20, rng)[0], "", "   ", "never-seen wörds here", "z" * 200]:
        values = [slow_value(w, model.scores) for w in T.words_of(t)]
        mean = slow_mean(values) if values else 0.0
        assert math.isclose(scorer(t), 1 / (1 + math.exp(-max(-30, min(30, mean + model.bias)))), rel_tol=1e-5, abs_tol=1e-9), t


def test_first_step_follows_the_gradient():
    """Adam's first step is RATE times the sign of the gradient, here found by differences of the loss."""
    docs, labels = texts(25, random.Random(5))
    rng = np.random.default_rng(7)
    e = rng.normal(0, 0.1, (T.BUCKETS, T.DIM)).astype(np.float32).astype(float)
    w, bias = rng.normal(0, 0.3, (T.DIM, 2)).astype(np.float32).astype(float), -6.0
    rate = (sum(labels) + 1) / (len(labels) + 2)
    of = {x: slow_features(x) for d in docs for x in T.words_of(d)}

    def loss():
        total, d = 0.0, w[:, 1] - w[:, 0]
        value = {x: float(np.mean(e[b] @ d)) for x, b in of.items()}
        for doc, y in zip(docs, labels):
            z = slow_mean([value[x] for x in T.words_of(doc)]) + bias
            total += math.sqrt(0.5 / rate if y else 0.5 / (1 - rate)) * (math.log1p(math.exp(z)) - y * z) / len(docs)
        return total

    def slope(array, at):
        held, h = array[at], 1e-4
        array[at] = held + h
        up = loss()
        array[at] = held - h
        down = loss()
        array[at] = held
        return (up - down) / (2 * h)

    after = T.fit(docs, labels, epochs=1)
    seen = 0
    for b in sorted({b for x in of.values() for b in x})[::9]:
        g = slope(e, (b, 3)) + T.DECAY * e[b, 3]
        if abs(g) > 1e-4:
            assert math.isclose(after.embedding[b, 3] - e[b, 3], -0.2 * T.RATE * math.copysign(1, g), rel_tol=0.02), b
            seen += 1
    for k in range(0, T.DIM, 4):
        for side in (0, 1):
            g = slope(w, (k, side)) + T.DECAY * w[k, side]
            if abs(g) > 1e-4:
                assert math.isclose(after.softmax[k, side] - w[k, side], -0.2 * T.RATE * math.copysign(1, g), rel_tol=0.02)
                seen += 1
    assert seen > 10 and after.bias > bias

"""Training against finite differences of the loss, and scores against a plain walk over words and n-grams."""

from __future__ import annotations

import random

import numpy as np
import pytest

from emberlog.llm import toxicity
from tests.llm.test_corpus_operators import prose


def loss(bag, vec, layer, bias, win, y, weight, decay):
    """As written in the books, window by window and word by word."""
    total = 0.0
    for w, label, k in zip(win, y, weight, strict=True):
        words = bag.stream[bag.begins[w] : bag.ends[w]]
        h = np.zeros(len(layer))
        for word in words:
            h += sum((vec[g] for g, o in zip(bag.flat, bag.owner, strict=True) if o == word), np.zeros(len(layer))) / bag.sizes[word]
        z = h @ layer / max(len(words), 1) + bias[0]
        total += k * (np.logaddexp(0, z) - label * z)
    return total + decay / 2 * ((vec**2).sum() + (layer**2).sum())


@pytest.mark.parametrize("seed", range(4))
def test_gradients_by_finite_differences(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(2, 5, 6)
    owner = np.concatenate([np.full(rng.integers(0, n), k) for k, n in enumerate(sizes)]).astype(np.int64)
    stream = rng.integers(0, 6, 14)
    begins, ends = np.array([0, 2, 5, 9, 9]), np.array([4, 6, 9, 14, 9])  # the last has no word
    bag = toxicity.Bag(rng.integers(0, 5, len(owner)), owner, sizes, stream, begins, ends)
    vec, layer, bias = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=1)
    win, y, weight = np.array([0, 1, 2, 3, 4, 1]), np.array([1.0, 0, 1, 0, 1, 0]), rng.random(6)
    grads = bag.gradients(vec, layer, bias, bag.scores(vec, layer), win, y, weight, 0.01)
    for x, g in zip((vec, layer, bias), grads, strict=True):
        for at in np.ndindex(x.shape):
            kept, step = x[at], 1e-6
            x[at] = kept + step
            high = loss(bag, vec, layer, bias, win, y, weight, 0.01)
            x[at] = kept - step
            low = loss(bag, vec, layer, bias, win, y, weight, 0.01)
            x[at] = kept
            assert g[at] == pytest.approx((high - low) / (2 * step), abs=1e-6, rel=1e-4)


def test_scores_by_a_plain_walk():
    """The automaton gives what each word's n-grams give, looked up one by one, over whole texts and windows."""
    r = random.Random(3)
    s = toxicity.Settings(epochs=30)
    texts = [("grumblat snarkel " if k % 3 == 0 else "") + prose(r.randint(1, 60), r) for k in range(90)]
    model = toxicity.train(texts, [int(k % 3 == 0) for k in range(90)], s)
    assert model.values

    def plain(text):
        words = [sum(model.values.get(g, 0.0) for g in own) / len(own) for w in toxicity.tokens(text) for own in [toxicity.grams(w, s)]]
        begins, ends = toxicity.windows(len(words))
        z = max(sum(words[a:b]) / max(b - a, 1) for a, b in zip(begins, ends, strict=True)) + model.bias
        return 1 / (1 + np.exp(-z))

    of = model.scorer()
    for text in [None, "", "...", "grumblatt!", "a" * 400, "GRUMBLAT, (snarkel)", prose(900, r) + " grumblat snarkel grumblat " + prose(300, r), *texts[:20]]:
        assert of(text) == pytest.approx(plain(text), abs=1e-9)


def test_the_loss_falls():
    """Trained vectors tell what they were trained on, and words that were misspelt in ways never seen."""
    r = random.Random(5)
    texts = [prose(30, r) + (" you grumblat" if k % 2 else "") for k in range(120)]
    of = toxicity.train(texts, [k % 2 for k in range(120)]).scorer()
    assert all((of(t) > 0.5) == bool(k % 2) for k, t in enumerate(texts))
    assert of(prose(30, r) + " you grumblaat") > 0.5 > of(prose(30, r))

"""What the toxicity model's fit holds on the driver beside the votes."""

import tracemalloc

import numpy as np


def test_label_model_works_in_parts():
    from meridex.llm.toxicity import label_model

    rng = np.random.default_rng(5)
    votes = (rng.random((12_000, 100)) < 0.05).astype(np.float32)
    tracemalloc.start()
    try:
        post, right, rho = label_model(votes, 96, np.full(100, 0.9), rounds=11)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert post.shape == (12_000,) and right.shape == (101,) and rho.shape == (100, 100)
    assert peak < 2.5 * votes.nbytes  # whole matrices in double precision were 6 times the votes


def test_logistic_parts_give_the_whole(monkeypatch):
    from meridex.llm import toxicity as t

    rng = np.random.default_rng(6)
    rows, cols = np.repeat(np.arange(50), 4), rng.integers(0, 9, 200)
    y = rng.random(50)
    w, c = t.logistic(rows, cols, 50, 9, y, rounds=20)
    monkeypatch.setattr(t, "MARKS_AT_ONCE", 7)
    v, d = t.logistic(rows, cols, 50, 9, y, rounds=20)
    assert np.allclose(w, v) and np.isclose(c, d)

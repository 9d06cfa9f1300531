"""A score depends on its text alone; windows by unit equal the layers of training."""

import numpy as np

from flowlens.llm.toxicity import STAT_BUCKETS, WINDOW, Network, Scorer, _gru, _pool, fresh_weights, window_logits


def network():
    rng = np.random.default_rng(3)
    return Network(rng.normal(size=STAT_BUCKETS).astype(np.float32), fresh_weights(2), 1.3, -0.2, 0.1)


def test_scores_do_not_depend_on_what_stands_beside_a_text():
    texts = ["", "  \n", "idiot", "a short text", " ".join(f"w{i}" for i in range(70)), "é", " " * 100 + "late"]
    alone = {t: Scorer(network()).scores([t])[0] for t in texts}
    assert alone[""] == alone["  \n"] == 0.1 and alone[" " * 100 + "late"] != 0.1
    for first in ("idiot", "burol", ""):
        scorer = Scorer(network())
        scorer.scores([first])
        for order in (texts, texts[::-1]):
            assert np.allclose(scorer.scores(order), [alone[t] for t in order], atol=1e-5)


def test_windows_by_unit_equal_the_layers():
    net, rng = network(), np.random.default_rng(1)
    words = ["", *(f"w{i}" for i in range(50))]
    x, w = net.inputs(words), net.weights
    assert not x[0].any()
    tables = [x @ w[s + "W"] + w[s + "c"] for s in "fb"]
    rows = rng.integers(1, 51, (9, WINDOW))
    inside = np.arange(WINDOW) < rng.integers(1, WINDOW + 1, 9)[:, None]
    rows[~inside] = 0
    states = [
        _gru(lambda t, table=table: table[rows[:, t]], inside, w[s + "U"], order)[0]
        for s, table, order in (("f", tables[0], range(WINDOW)), ("b", tables[1], range(WINDOW - 1, -1, -1)))
    ]
    want = _pool(np.concatenate(states, axis=2), inside, w)[0]
    assert np.allclose(window_logits(net, tables, rows, inside), want, atol=1e-4)

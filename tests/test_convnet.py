import numpy as np
import pytest

from topicspace.functions.convnet import ConvNet, adagrad


def plain_forward(net, params, x):
    """The same network, value by value."""
    rows = []
    for seq in x:
        cur = seq
        for layer, pool in enumerate(net.pools):
            w, b = params[2 * layer], params[2 * layer + 1]
            m = len(cur) - net.kernel + 1
            y = np.array([np.maximum(cur[i:i + net.kernel].ravel() @ w + b, 0) for i in range(m)])
            cur = np.array([y[i * pool:(i + 1) * pool].max(axis=0) for i in range(m // pool)])
        w1, b1, w2, b2 = params[-4:]
        s = (cur.ravel() @ w1 + b1) @ w2 + b2
        rows.append(s - np.log(np.exp(s).sum()))
    return np.array(rows)


@pytest.mark.parametrize("pools", [(), (3,), (2, 3)])
def test_forward_and_gradient(pools):
    net = ConvNet(3, 4, 40, channels=5, kernel=3, pools=pools, hidden=6)
    rng = np.random.default_rng(1)
    params = [p.astype(np.float64) for p in net.initial(7)]
    x = rng.normal(size=(4, 40, 3))
    labels = np.array([0, 3, 1, 1])
    log_p = net.forward(params, x)
    assert np.allclose(log_p, plain_forward(net, params, x))
    loss, grads = net.gradient(params, x, labels)
    assert np.isclose(loss, -log_p[np.arange(4), labels].sum())
    flat, g = net.flat(params), net.flat(grads)
    for i in rng.choice(len(flat), 60, replace=False):
        near = []
        for step in (1e-6, -1e-6):
            moved = flat.copy()
            moved[i] += step
            p = net.forward(net.shaped(moved), x)
            near.append(-p[np.arange(4), labels].sum())
        assert np.isclose((near[0] - near[1]) / 2e-6, g[i], atol=1e-4)


def test_original_sizes_and_too_short():
    net = ConvNet(100, 15, 1000)
    assert net.pools == [5, 5, 35]
    assert net.shapes[0] == (500, 128) and net.shapes[-4:] == [(128, 1000), (1000,), (1000, 15), (15,)]
    with pytest.raises(ValueError):
        ConvNet(4, 2, 20)


def test_adagrad_learns():
    net = ConvNet(4, 2, 60, channels=6, pools=(5,), hidden=8)
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 40)
    x = rng.normal(size=(40, 60, 4)).astype(np.float32)
    x[labels == 1, 20:24, 0] += 4
    flat = net.flat(net.initial(1)).astype(np.float64)
    acc, losses = np.zeros(len(flat)), []
    for step in range(40):
        loss, grads = net.gradient(net.shaped(flat.astype(np.float32)), x, labels)
        losses.append(loss / 40)
        flat, acc = adagrad(flat, net.flat(grads) / 40, acc, step, 0.01, 0.0002)
    assert losses[-1] < 0.5 * losses[0]
    best = net.forward(net.shaped(flat.astype(np.float32)), x).argmax(axis=1)
    assert (best == labels).mean() > 0.9


def test_padding_that_does_not_count():
    """A sequence cut after the places that decide gives the same result and gradients."""
    net = ConvNet(4, 3, 200, channels=5, hidden=6)
    params, rng = net.initial(3), np.random.default_rng(4)
    for filled in (0, 1, 25, 26, 40, 199, 200):
        x = rng.normal(size=(3, 200, 4)).astype(np.float32)
        x[:, filled:] = 0
        short = x[:, :net.needed(filled)]
        assert short.shape[1] < 200 or filled > 40
        assert np.allclose(net.forward(params, x), net.forward(params, short), atol=1e-6)
        (loss, grads), (own, mine) = (net.gradient(params, v, np.array([0, 1, 2])) for v in (x, short))
        assert abs(loss - own) < 1e-5
        assert all(np.allclose(g, h, atol=1e-6) for g, h in zip(grads, mine))


@pytest.mark.parametrize("pools", [(), (3,), (2, 3)])
def test_words_are_looked_up(pools):
    """Sequences of word indexes give what the sequences of their vectors give, and a sequence
    with several labels what it gives once for each."""
    net = ConvNet(3, 4, 40, channels=5, kernel=3, pools=pools, hidden=6)
    rng = np.random.default_rng(2)
    params = [p.astype(np.float64) for p in net.initial(8)]
    vectors = np.vstack([np.zeros(3), rng.normal(size=(9, 3))])
    seqs = rng.integers(0, 8, (4, 40))
    labels, of = np.array([0, 3, 1, 1, 2, 1]), np.array([0, 0, 1, 2, 3, 3])
    table = net.table(params, vectors)
    assert np.allclose(net.forward(params, seqs, table=table), net.forward(params, vectors[seqs]))
    loss, grads = net.gradient(params, vectors[seqs[of]], labels)
    words, met = np.zeros((3, 10, 5)), np.isin(np.arange(10), seqs)
    own, mine = net.gradient(params, seqs, labels, of, table, words)
    mine[0] = mine[0] + net.first(vectors, words, met)
    assert np.isclose(loss, own) and all(np.allclose(g, h) for g, h in zip(grads, mine))
    # a word without a vector spoils nothing where it does not stand
    vectors[9] = np.nan
    assert np.allclose(net.first(vectors, words, met), grads[0])

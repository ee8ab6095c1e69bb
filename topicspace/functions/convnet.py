"""A text classifier over word-vector sequences: 1-D convolutions with ReLU and max
pooling, two linear layers and a log-softmax, in numpy over a batch of sequences.

The sequences are of a vocabulary's words, so the first convolution looks up what each word
adds at each place of the kernel instead of multiplying its vector anew.

Only the mathematics of one batch is here; ``topicspace.plans.sequence_classifier`` runs it
on Spark partitions.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


class ConvNet:
    """Layer sizes; parameters are a list of arrays in the order of ``shapes``.

    ``pools`` are the pooling widths after each convolution; the last pools whatever is
    left, so that one value of each channel remains.
    """

    def __init__(self, dim: int, classes: int, length: int, channels: int = 128,
                 kernel: int = 5, pools: tuple[int, ...] = (5, 5), hidden: int = 1000):
        self.dim, self.classes, self.length = dim, classes, length
        self.channels, self.kernel, self.hidden = channels, kernel, hidden
        widths, n = [], length
        for pool in (*pools, 0):
            n -= kernel - 1
            if n < max(1, pool):
                raise ValueError(f"sequences of {length} are too short for these layers")
            widths.append(pool or n)
            n = n // pool if pool else 1
        self.pools = widths
        self.shapes = []
        for layer in range(len(widths)):
            self.shapes += [(kernel * (dim if layer == 0 else channels), channels), (channels,)]
        self.shapes += [(channels, hidden), (hidden,), (hidden, classes), (classes,)]

    def initial(self, seed: int) -> list[np.ndarray]:
        """Uniform in +-1/sqrt(inputs), weights and biases."""
        rng = np.random.default_rng(seed)
        found, bound = [], 1.0
        for shape in self.shapes:
            if len(shape) == 2:
                bound = 1.0 / np.sqrt(shape[0])
            found.append(rng.uniform(-bound, bound, shape).astype(np.float32))
        return found

    def flat(self, params: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([p.ravel() for p in params])

    def shaped(self, flat: np.ndarray) -> list[np.ndarray]:
        found, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            found.append(flat[at:at + n].reshape(shape))
            at += n
        return found

    def needed(self, filled: int) -> int:
        """Places of a sequence that decide the result when all from ``filled`` on are
        zeros. Every last-layer value that only such places reach is the same and the
        pooling takes the first of equal ones, so one of them stands for the rest: result
        and gradients of the shorter sequence are those of the whole."""
        step = int(np.prod(self.pools[:-1]))
        n = -(-filled // step) + 1
        for pool in reversed(self.pools[:-1]):
            n = (n + self.kernel - 1) * pool
        return min(self.length, n + self.kernel - 1)

    def table(self, params: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        """What a word at each place of the first kernel adds: (kernel, words, channels). The
        words of a vocabulary are few, so this is done once for all the sequences."""
        return np.matmul(vectors, params[0].reshape(self.kernel, self.dim, self.channels))

    def _pooled(self, y: np.ndarray, pool: int, keep: bool):
        """The largest of every ``pool`` places and, with ``keep``, the first place it is at."""
        out = y.shape[1] // pool
        blocks = y[:, :out * pool].reshape(len(y), out, pool, -1)
        best = blocks[:, :, 0].copy()
        at = np.zeros(best.shape, dtype=np.min_scalar_type(pool)) if keep else None
        for j in range(1, pool):
            if keep:
                np.copyto(at, j, where=blocks[:, :, j] > best)
            np.maximum(best, blocks[:, :, j], out=best)
        return best, at

    def forward(self, params: list[np.ndarray], x: np.ndarray, keep: bool = False,
                table: np.ndarray | None = None):
        """Log-probabilities (rows, classes) of sequences (rows, length, dim), or with the
        ``table`` of the words of sequences of word indexes (rows, length); with ``keep`` also
        what ``gradient`` needs."""
        held = []
        for layer, pool in enumerate(self.pools):
            w, b = params[2 * layer], params[2 * layer + 1]
            rows, n = x.shape[:2]
            m = n - self.kernel + 1
            pool = m if layer == len(self.pools) - 1 else pool
            if layer == 0 and table is not None:
                cols = x
                y = table[0].take(x[:, :m], axis=0)
                for k in range(1, self.kernel):
                    y += table[k].take(x[:, k:k + m], axis=0)
            else:
                cols = np.ascontiguousarray(sliding_window_view(x, self.kernel, axis=1)
                                            .transpose(0, 1, 3, 2)).reshape(rows * m, -1)
                y = (cols @ w).reshape(rows, m, -1)
            x_next, best = self._pooled(y, pool, keep)
            x_next += b
            np.maximum(x_next, 0, out=x_next)
            if keep:
                held.append((cols, x.shape, best, x_next))
            x = x_next
        features = x.reshape(len(x), -1)
        w1, b1, w2, b2 = params[-4:]
        mid = features @ w1 + b1
        score = mid @ w2 + b2
        score = score - score.max(axis=1, keepdims=True)
        log_p = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
        return (log_p, held, features, mid) if keep else log_p

    def gradient(self, params: list[np.ndarray], x: np.ndarray, labels: np.ndarray,
                 of: np.ndarray | None = None, table: np.ndarray | None = None,
                 words: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
        """Summed negative log-likelihood of 0-based labels and its gradients. ``of`` has the
        sequence of each label where a sequence has several. With the ``table`` of the words,
        the sums of the first convolution's weights are added to ``words`` (kernel, words,
        channels) and their gradient, which ``first`` makes of it, is left zero."""
        log_p, held, features, mid = self.forward(params, x, True, table)
        at = np.arange(len(labels)) if of is None else of
        loss = -float(log_p[at, labels].sum(dtype=np.float64))
        d = np.exp(log_p)
        d *= np.bincount(at, minlength=len(x))[:, None].astype(d.dtype)
        np.subtract.at(d, (at, labels), 1)
        w1, _, w2, _ = params[-4:]
        tail = [None, None, mid.T @ d, d.sum(axis=0)]
        d = d @ w2.T
        tail[0], tail[1] = features.T @ d, d.sum(axis=0)
        d = (d @ w1.T).reshape(held[-1][3].shape)
        convs: list[np.ndarray] = []
        for layer in range(len(self.pools) - 1, -1, -1):
            cols, shape, best, out = held[layer]
            rows, n = shape[:2]
            m = n - self.kernel + 1
            pool = m if layer == len(self.pools) - 1 else self.pools[layer]
            d = d * (out > 0)
            # the places of the largest, the only ones that have a gradient
            place = best + np.arange(out.shape[1])[:, None] * pool
            if layer == 0 and table is not None:
                place += np.arange(rows)[:, None, None] * n
                some = np.flatnonzero(d)
                place, channel, own = place.ravel()[some], some % self.channels, d.ravel()[some]
                start = cols.ravel() * self.channels
                for k, sums in enumerate(words):
                    cell = start.take(place + k)
                    cell += channel
                    sums += np.bincount(cell, own, sums.size).reshape(sums.shape)
                convs = [np.zeros_like(params[0]), d.sum(axis=(0, 1)), *convs]
                continue
            dy = np.zeros((rows, m, self.channels), dtype=d.dtype)
            place += np.arange(rows)[:, None, None] * m
            dy.ravel()[place * self.channels + np.arange(self.channels)] = d
            dy = dy.reshape(rows * m, -1)
            convs = [cols.T @ dy, d.sum(axis=(0, 1)), *convs]
            if layer:
                dcols = (dy @ params[2 * layer].T).reshape(rows, m, self.kernel, -1)
                d = np.zeros(shape, dtype=d.dtype)
                for k in range(self.kernel):
                    d[:, k:k + m] += dcols[:, :, k]
        return loss, convs + tail

    def first(self, vectors: np.ndarray, words: np.ndarray, met: np.ndarray) -> np.ndarray:
        """The gradient of the first convolution's weights from the sums of the words that
        were met."""
        own = vectors[met].astype(np.float64)
        return np.concatenate([own.T @ sums[met] for sums in words])


def adagrad(params: np.ndarray, gradient: np.ndarray, acc: np.ndarray, step: int, rate: float,
            decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and squared-gradient sums after one step (counted from 0)."""
    acc = acc + gradient * gradient
    return params - rate / (1 + step * decay) * gradient / (np.sqrt(acc) + 1e-10), acc

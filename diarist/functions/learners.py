"""Small numpy learners for one account's rows, used inside grouped Pandas tasks.

Each takes training arrays ``x``, ``y`` (0/1), its parameters and a random generator, and returns
a scoring function and built-in importances (or None).
"""

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def auc(y, score):
    """Chance that a positive outscores a negative, ties counting half."""
    pos, neg = np.sort(score[y == 1]), np.sort(score[y == 0])
    if not len(pos) or not len(neg):
        return np.nan
    below = np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")
    return below.sum() / 2 / len(pos) / len(neg)


def elastic_net(x, y, params, rng, steps=300):
    """Logistic regression with an L1/L2 penalty, by accelerated proximal gradient."""
    n, d = x.shape
    l1, l2 = params["penalty"] * params["mixture"], params["penalty"] * (1 - params["mixture"])
    step = 1 / (np.linalg.norm(x, 2) ** 2 / (4 * n) + l2 + 0.25)
    w, b, ahead_w, ahead_b = np.zeros(d), 0.0, np.zeros(d), 0.0
    for t in range(steps):
        error = sigmoid(x @ ahead_w + ahead_b) - y
        moved = ahead_w - step * (x.T @ error / n + l2 * ahead_w)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_b = ahead_b - step * error.mean()
        momentum = t / (t + 3)
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return (lambda z: sigmoid(z @ w + b)), np.abs(w)


def rbf_svm(x, y, params, rng, features=200, steps=300):
    """Support vector machine on random Fourier features of the Gaussian kernel, with the margin
    turned into a probability by logistic regression."""
    d = x.shape[1]
    omega = rng.normal(0, np.sqrt(2 * params["rbf_sigma"]), (d, features))
    phase = rng.uniform(0, 2 * np.pi, features)
    lift = lambda z: np.sqrt(2 / features) * np.cos(z @ omega + phase)
    z, sign = lift(x), 2 * y - 1
    decay = 1 / (params["cost"] * len(y))
    w, b = np.zeros(features), 0.0
    for t in range(steps):  # full-batch subgradient with a falling step
        slack = sign * (z @ w + b) < 1
        step = 1 / (decay * (t + 1) + 1)
        w -= step * (decay * w - (sign * slack) @ z / len(y))
        b += step * (sign * slack).mean()
    margin = lambda q: (lift(q) @ w + b)[:, None]
    platt, _ = elastic_net(margin(x), y, {"penalty": 1e-4, "mixture": 0.0}, rng)
    return (lambda q: platt(margin(q))), None


def grow(x, grad, hess, rng, depth, min_n, mtry, min_gain=0.0, gains=None):
    """A regression tree on gradients: nested (feature, cut, left, right) or a leaf value.

    A node splits where the summed score grad**2 / hess gains most; ``min_n`` limits the rows of
    a node that may be split.
    """
    leaf = grad.sum() / (hess.sum() + 1e-9)
    if depth == 0 or len(grad) < max(min_n, 2):
        return leaf
    score = lambda g, h: g * g / (h + 1e-9)
    whole, best = score(grad.sum(), hess.sum()), (min_gain + 1e-9, None, None)
    for f in rng.permutation(x.shape[1])[:mtry]:
        order = np.argsort(x[:, f], kind="stable")
        value = x[order, f]
        ends = np.flatnonzero(value[:-1] < value[1:])
        if not len(ends):
            continue
        g, h = grad[order].cumsum(), hess[order].cumsum()
        gain = score(g[ends], h[ends]) + score(g[-1] - g[ends], h[-1] - h[ends]) - whole
        i = gain.argmax()
        if gain[i] > best[0]:
            best = (gain[i], f, (value[ends[i]] + value[ends[i] + 1]) / 2)
    gain, f, cut = best
    if f is None:
        return leaf
    if gains is not None:
        gains[f] += gain
    left = x[:, f] <= cut
    rest = (rng, depth - 1, min_n, mtry, min_gain, gains)
    return (
        f, cut, grow(x[left], grad[left], hess[left], *rest), grow(x[~left], grad[~left], hess[~left], *rest)
    )


def descend(tree, x):
    """Leaf value of every row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, descend(left, x), descend(right, x))


def forest(x, y, params, rng):
    """Mean of trees grown deep on bootstrap rows."""
    mtry, trees = min(int(params["mtry"]), x.shape[1]), []
    for _ in range(int(params["trees"])):
        rows = rng.integers(0, len(y), len(y))
        ones = np.ones(len(y))
        trees.append(grow(x[rows], y[rows].astype(float), ones, rng, 30, params["min_n"], mtry))
    return (lambda z: np.mean([descend(t, z) for t in trees], axis=0)), None


def boosted(x, y, params, rng):
    """Trees grown in turn on the logistic loss; importance is the total gain."""
    mtry, rate = min(int(params["mtry"]), x.shape[1]), params["learn_rate"]
    gains, trees, f = np.zeros(x.shape[1]), [], np.zeros(len(y))
    size = max(2, int(params["sample_size"] * len(y)))
    for _ in range(int(params["trees"])):
        rows = rng.permutation(len(y))[:size]
        p = sigmoid(f[rows])
        tree = grow(
            x[rows], y[rows] - p, p * (1 - p), rng, int(params["tree_depth"]), params["min_n"], mtry,
            params["loss_reduction"], gains,
        )
        trees.append(tree)
        f += rate * descend(tree, x)
    return (lambda z: sigmoid(rate * np.sum([descend(t, z) for t in trees], axis=0))), gains


LEARNERS = {"rf": forest, "elnet": elastic_net, "svm": rbf_svm, "xgb": boosted}

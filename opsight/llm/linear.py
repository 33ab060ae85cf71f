"""Linear models over hashed sparse features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np

Rows = list[tuple[np.ndarray, np.ndarray]]


def dual_coordinate_descent(
    rows: Rows,
    labels: np.ndarray,
    width: int,
    cost: float | np.ndarray = 1.0,
    epochs: int = 15,
    tolerance: float = 1e-3,
    seed: int = 7,
) -> np.ndarray:
    """Weights of a hinge-loss support vector machine (the last one is the bias).

    ``rows`` are (indices, values), ``labels`` -1 or 1, ``cost`` the bound of each dual
    variable. One pass visits the rows in random order and moves one dual variable at a
    time to its optimum; it stops when no projected gradient exceeds ``tolerance``.
    """
    weights = np.zeros(width + 1)
    dual = np.zeros(len(rows))
    bound = np.broadcast_to(np.asarray(cost, float), (len(rows),))
    square = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            y = labels[i]
            gradient = y * (weights[index] @ value + weights[-1]) - 1.0
            projected = gradient
            if dual[i] <= 0.0:
                projected = min(gradient, 0.0)
            elif dual[i] >= bound[i]:
                projected = max(gradient, 0.0)
            if projected == 0.0:
                continue
            worst = max(worst, abs(projected))
            new = min(max(dual[i] - gradient / square[i], 0.0), bound[i])
            step = (new - dual[i]) * y
            dual[i] = new
            weights[index] += step * value
            weights[-1] += step
        if worst < tolerance:
            break
    return weights


def margins(rows: Rows, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[i] @ v + weights[-1] for i, v in rows])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic_scale(
    scores: np.ndarray, positive: np.ndarray, counts: np.ndarray | float = 1.0, steps: int = 60
) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps, smoothed targets).

    ``counts`` tells how many rows each sampled row stands for.
    """
    counts = np.broadcast_to(np.asarray(counts, float), scores.shape)
    up, down = positive.sum(), (~positive).sum()
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(slope * scores + offset)
        error, weight = counts * (p - target), counts * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([error @ scores, error.sum()])
        curve = np.array(
            [[weight @ scores**2 + 1e-6, weight @ scores], [weight @ scores, weight.sum() + 1e-6]]
        )
        move = np.linalg.solve(curve, gradient)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-7:
            break
    return float(slope), float(offset)

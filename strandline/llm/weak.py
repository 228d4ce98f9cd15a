"""A label model for weak supervision, fitted by expectation maximisation.

Rules vote +1, -1 or abstain (0).  Given the hidden label, rules are taken as
independent; each has its own chances of the three votes under either label (Dawid
and Skene, 1979).  The model is fitted on counts of vote patterns, so its cost does
not depend on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    prior: float
    """Chance that the label is +1."""
    chances: np.ndarray
    """By label (-1, +1), rule and vote (-1, 0, +1)."""

    def accuracies(self) -> np.ndarray:
        """For each rule, the chance that it is right when it votes."""
        weight = np.array([1 - self.prior, self.prior])
        right = weight[0] * self.chances[0, :, 0] + weight[1] * self.chances[1, :, 2]
        wrong = weight[0] * self.chances[0, :, 2] + weight[1] * self.chances[1, :, 0]
        return right / np.maximum(right + wrong, 1e-12)


def _logits(model: LabelModel, votes: np.ndarray) -> np.ndarray:
    log = np.log(model.chances)
    rules = np.arange(votes.shape[1])
    sums = [log[label, rules, votes + 1].sum(axis=1) for label in (0, 1)]
    return np.log(model.prior) - np.log1p(-model.prior) + sums[1] - sums[0]


def posterior(model: LabelModel, votes: np.ndarray) -> np.ndarray:
    """Chance of label +1 for each row of votes."""
    return 1 / (1 + np.exp(-np.clip(_logits(model, votes), -500, 500)))


def fit_accuracies(
    votes: np.ndarray, weight: np.ndarray, prior: float = 0.5, accuracy: float = 0.8, rounds: int = 200, smooth: float = 0.005
) -> LabelModel:
    """Fit on vote patterns (rows of -1, 0, +1) and the number of rows with each.

    ``prior`` and ``accuracy`` start the search; as ``smooth`` of all rows (and two
    rows at least) for each rule and label they also keep chances off 0 and 1 and
    the labels to their meaning.  A rule whose accuracy would sink below one half
    is held there.
    """
    rules = votes.shape[1]
    smooth = 2 + smooth * weight.sum()
    rate = np.array([(weight[:, None] * (votes == v)).sum(axis=0) + smooth / 3 for v in (-1, 0, 1)]).T
    rate /= rate.sum(axis=1, keepdims=True)
    voted = rate[:, 0] + rate[:, 2]
    start = np.empty((2, rules, 3))
    start[:, :, 1] = rate[:, 1]
    start[0, :, 0] = start[1, :, 2] = voted * accuracy
    start[0, :, 2] = start[1, :, 0] = voted * (1 - accuracy)
    model = LabelModel(prior, np.clip(start, 1e-6, 1))
    before = None
    for _ in range(rounds):
        p = posterior(model, votes)
        chances = np.empty_like(start)
        for label, share in ((0, 1 - p), (1, p)):
            mass = weight * share
            for i, v in enumerate((-1, 0, 1)):
                chances[label, :, i] = (mass[:, None] * (votes == v)).sum(axis=0) + smooth * start[label, :, i]
            chances[label] /= chances[label].sum(axis=1, keepdims=True)
        flipped = chances[0, :, 0] * chances[1, :, 2] < chances[0, :, 2] * chances[1, :, 0]
        even = chances[:, flipped].mean(axis=0)
        chances[:, flipped] = even
        total = weight.sum()
        model = LabelModel(float(np.clip(((weight * p).sum() + smooth * prior) / (total + smooth), 1e-4, 1 - 1e-4)), np.clip(chances, 1e-9, 1))
        if before is not None and np.abs(p - before).max() < 1e-7:
            break
        before = p
    return model

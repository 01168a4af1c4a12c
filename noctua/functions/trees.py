"""Ensembles of decision trees in the public text format of gradient-boosting models, scored by numpy.

The format lists for each tree arrays: split_feature, threshold, decision_type, left_child, right_child (a child below zero
is the leaf -child - 1) and leaf_value. All rows go down all trees together: one step of the whole matrix of places for each
level of the deepest tree. Only numeric splits are known; a file with categorical ones is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of decision_type: categorical split, missing values go left; then which values are missing (0 none, 1 zero, 2 NaN).
CATEGORICAL, DEFAULT_LEFT, MISSING_SHIFT, MISSING_ZERO, MISSING_NAN = 1, 2, 2, 1, 2
#: Values so near to zero count as zero.
ZERO = 1e-35


def fields(lines: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in lines if "=" in x)


@dataclass(frozen=True)
class Ensemble:
    """Nodes of all trees, one after another; a child from the number of nodes on is a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    kind: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: np.ndarray
    classes: int
    sigmoid: float
    averaged: bool

    def raw(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """[row, class]: the sum (or mean) of the leaves that a row comes to."""
        if len(x) > rows:
            return np.concatenate([self.raw(x[i : i + rows], rows) for i in range(0, len(x), rows)])
        x, nodes = np.asarray(x, float), len(self.feature)
        at = np.repeat(self.roots[None], len(x), axis=0)
        while (inner := at < nodes).any():
            row, tree = np.nonzero(inner)
            here = at[row, tree]
            at[row, tree] = np.where(self.goes_left(x[row, self.feature[here]], here), self.left[here], self.right[here])
        values = self.leaves[at - nodes].reshape(len(x), -1, self.classes)
        return values.mean(axis=1) if self.averaged else values.sum(axis=1)

    def goes_left(self, value: np.ndarray, node: np.ndarray) -> np.ndarray:
        missing, nan = self.kind[node] >> MISSING_SHIFT & 3, np.isnan(value)
        value = np.where(nan & (missing != MISSING_NAN), 0.0, value)
        absent = (missing == MISSING_NAN) & nan | (missing == MISSING_ZERO) & (np.abs(value) <= ZERO)
        return np.where(absent, self.kind[node] & DEFAULT_LEFT != 0, value <= self.threshold[node])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """[row, class]: probabilities. A model of one score has two classes."""
        z = self.raw(x)
        if self.classes == 1:
            p = 1 / (1 + np.exp(-self.sigmoid * z[:, 0]))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def parse(text: str) -> Ensemble:
    """An ensemble from the text of a model file; binary and multiclass objectives."""
    head, *parts = text.split("end of trees")[0].split("\nTree=")
    facts = fields(head.splitlines())
    objective = facts.get("objective", "").split()
    if not objective or objective[0] not in ("binary", "multiclass"):
        raise ValueError(f"no scoring for the objective {facts.get('objective')}")
    options = dict(o.split(":") for o in objective[1:] if ":" in o)
    trees = [fields(p.splitlines()) for p in parts]
    numbers = lambda t, k, kind: np.array(t.get(k, "").split(), kind)
    sizes = [len(numbers(t, "split_feature", int)) for t in trees]
    total, node, leaf, columns = sum(sizes), 0, 0, {k: [] for k in ("feature", "threshold", "kind", "left", "right")}
    roots, leaves = [], []
    for t, n in zip(trees, sizes):
        values, kind = numbers(t, "leaf_value", float), numbers(t, "decision_type", int)
        if (kind & CATEGORICAL).any():
            raise ValueError("categorical splits are not known")
        for side in ("left", "right"):
            child = numbers(t, f"{side}_child", int)
            columns[side].append(np.where(child >= 0, child + node, total + leaf - child - 1))
        columns["feature"].append(numbers(t, "split_feature", int))
        columns["threshold"].append(numbers(t, "threshold", float))
        columns["kind"].append(kind)
        roots.append(node if n else total + leaf)
        node, leaf = node + n, leaf + len(values)
        leaves.append(values)
    joined = {k: np.concatenate([np.zeros(0, float if k == "threshold" else int), *v]) for k, v in columns.items()}
    return Ensemble(np.array(roots, int), **joined, leaves=np.concatenate([np.zeros(0), *leaves]), classes=int(facts.get("num_tree_per_iteration", facts.get("num_class", "1"))), sigmoid=float(options.get("sigmoid", 1)), averaged="average_output" in head)

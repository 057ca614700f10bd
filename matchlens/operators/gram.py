"""Ridge regression from sums of products.

The sums of all products of one, the features and the labels (the Gram matrix)
hold everything that a ridge fit and its squared error need, and they add up.
One aggregation over the rows therefore gives the sums of every slice of time;
sums of slices train every fold, parts of the matrix leave out any group of
features, and the slice that is tested gives its error. What is solved on the
driver has a row for each feature, however many games there are.

The penalty is a share of each feature's variance, so it does not depend on
units; the intercept is free. A feature that never varies gets coefficient 0.
"""

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTY = 0.1


@dataclass
class Gram:
    """Sums of products of ``[1, *features, *labels]``."""

    features: list[str]
    labels: list[str]
    sums: np.ndarray

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.features, self.labels, self.sums + other.sums)

    @property
    def count(self) -> float:
        return self.sums[0, 0]

    def part(self, features: list[str]) -> "Gram":
        """The same without the other features."""
        names = ["", *self.features, *self.labels]
        kept = [0, *[names.index(c) for c in [*features, *self.labels]]]
        return Gram(features, self.labels, self.sums[np.ix_(kept, kept)])


def gram_sums(rows: DataFrame, features: list[str], labels: list[str], by: str) -> dict:
    """The Gram matrix of every value of ``by``, in one pass; ``by`` has few values."""
    names = [None, *features, *labels]
    value = lambda c: F.lit(1.0) if c is None else F.col(c).cast("double")
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    sums = [F.sum(value(names[i]) * value(names[j])).alias(f"s{i}_{j}") for i, j in pairs]
    out = {}
    for row in rows.groupBy(by).agg(*sums).collect():
        cells = np.zeros((len(names), len(names)))
        for (i, j), total in zip(pairs, row[1:]):
            cells[i, j] = cells[j, i] = total
        out[row[0]] = Gram(features, labels, cells)
    return out


@dataclass
class Ridge:
    """Intercept and coefficients for each label."""

    features: list[str]
    labels: list[str]
    weights: np.ndarray  # a row for the intercept and each feature, a column for each label

    def column(self, label: str) -> Column:
        first, *rest = self.weights[:, self.labels.index(label)].tolist()
        return sum((F.lit(w) * F.col(c) for c, w in zip(self.features, rest)), F.lit(first))


def fit(gram: Gram, penalty: float = PENALTY) -> Ridge:
    k, n = len(gram.features), gram.count
    means = gram.sums[0] / n
    centred = gram.sums - n * np.outer(means, means)
    inner, outer = centred[1 : k + 1, 1 : k + 1].copy(), centred[1 : k + 1, k + 1 :]
    # What rounding leaves of a feature that never varies is no spread.
    spread = np.diag(inner).copy()
    flat = spread <= 1e-9 * np.diag(gram.sums)[1 : k + 1]
    inner[flat, :] = inner[:, flat] = 0.0
    inner[np.diag_indices(k)] = np.where(flat, 1.0, spread * (1 + penalty))
    slopes = np.linalg.solve(inner, np.where(flat[:, None], 0.0, outer)) if k else np.zeros((0, len(gram.labels)))
    first = means[k + 1 :] - means[1 : k + 1] @ slopes
    return Ridge(gram.features, gram.labels, np.vstack([first, slopes]))


def errors(model: Ridge, tested: Gram) -> dict[str, float]:
    """Root mean squared error of each label on the rows behind ``tested``."""
    k, out = len(model.features), {}
    for i, label in enumerate(model.labels):
        # (y - Xw)'(y - Xw) from the sums of products.
        w = np.concatenate([-model.weights[:, i], np.zeros(len(model.labels))])
        w[k + 1 + i] = 1.0
        out[label] = float(np.sqrt(max(0.0, w @ tested.sums @ w) / tested.count))
    return out


def fold_errors(slices: dict, folds: int, features: list[str], penalty: float = PENALTY) -> list[tuple]:
    """``fold, label, rmse, mean_rmse``: each slice tested by a model of all earlier ones, and by their mean."""
    out = []
    for k in range(1, folds + 1):
        earlier = [slices[s] for s in slices if s < k]
        if k not in slices or not earlier:
            continue
        train = sum(earlier[1:], earlier[0])
        found = errors(fit(train.part(features), penalty), slices[k].part(features))
        plain = errors(fit(train.part([]), penalty), slices[k].part([]))
        out += [(k, label, found[label], plain[label]) for label in train.labels]
    return out

"""Elastic net with a grid over penalty and mixing, tuned on expanding folds."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelcast.models.linear import FITTED_ON
from panelcast.models.moments import Moments, moment_rows, problems
from panelcast.models.roles import FOLD_ROLES, TRAIN_SEGMENT

# Grid and iteration limit of the reference model (fixed values).
ALPHAS = np.linspace(1e-3, 1e3, 100)
RATIOS = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
MAX_ITER = 1000
TOLERANCE = 1e-4
# Tickers and steps solved together, which bounds the memory of a task.
CHUNK = 16

SCHEMA = (
    "ticker string, horizon int, role string, y double, y_hat double, alpha double, l1_ratio double"
)


COEFFICIENTS = (
    "ticker string, horizon int, phase string, intercept double, centres array<double>, "
    "scales array<double>, weights array<double>, alpha double, l1_ratio double"
)


def duality_gap(cov, cross, y_var, soft, ridge, w) -> np.ndarray:
    """How far each row of weights is at most from the optimum of its objective."""
    along = np.einsum("pij,pj->pi", cov, w)
    fitted = (w * cross).sum(axis=1)
    residual = y_var - 2 * fitted + (along * w).sum(axis=1)
    slope = np.abs(cross - along - ridge[:, None] * w).max(axis=1)
    shrink = np.where(slope > soft, soft / np.where(slope > 0, slope, 1.0), 1.0)
    squares = (w * w).sum(axis=1)
    return (
        0.5 * residual * (1 + shrink**2)
        + soft * np.abs(w).sum(axis=1)
        - shrink * (y_var - fitted)
        + 0.5 * ridge * (1 + shrink**2) * squares
    )


def coordinate_descent(
    cov: np.ndarray, cross: np.ndarray, y_var: np.ndarray, alpha: np.ndarray, ratio: np.ndarray,
    tolerance: float = TOLERANCE,
) -> np.ndarray:
    """Weights of many independent problems at once, one per row.

    Each minimises half the mean squared error plus ``alpha * ratio`` times the
    L1 norm plus half of ``alpha * (1 - ratio)`` times the squared L2 norm. A
    row is done when its weights hardly move and its duality gap is a small
    share of the label's variance.
    """
    width = cross.shape[1]
    weights = np.zeros((len(alpha), width))
    soft, ridge = alpha * ratio, alpha * (1 - ratio)
    active = np.arange(len(alpha))
    for _ in range(MAX_ITER):
        w = weights[active]
        before = w.copy()
        for j in range(width):
            own = cov[:, j, j]
            partial = cross[:, j] - (w * cov[:, j]).sum(axis=1) + w[:, j] * own
            shrunk = np.sign(partial) * np.maximum(np.abs(partial) - soft, 0.0)
            w[:, j] = np.where(own > 0, shrunk / np.where(own > 0, own + ridge, 1.0), 0.0)
        weights[active] = w
        moved = np.abs(w - before).max(axis=1)
        settled = moved <= tolerance * np.abs(w).max(axis=1)
        if settled.any():
            gap = duality_gap(cov, cross, y_var, soft, ridge, w)
            going = ~(settled & (gap <= tolerance * y_var))
            if not going.all():
                active, cov, cross, y_var = active[going], cov[going], cross[going], y_var[going]
                soft, ridge = soft[going], ridge[going]
        if len(active) == 0:
            break
    return weights


@dataclass
class Fit:
    """One training set of one ticker and step, with the row it is asked to predict."""

    problem: int
    role: str
    moments: Moments
    segment: int
    scale: np.ndarray
    x: np.ndarray
    y: float

    @property
    def cov(self) -> np.ndarray:
        return self.moments.cov[self.segment] / np.outer(self.scale, self.scale)

    @property
    def cross(self) -> np.ndarray:
        return self.moments.cross[self.segment] / self.scale

    def predict(self, weights: np.ndarray) -> np.ndarray:
        centred = (self.x - self.moments.x_mean[self.segment]) / self.scale
        return self.moments.y_mean[self.segment] + weights @ centred


def solve(fits: list[Fit], alpha: np.ndarray, ratio: np.ndarray, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Predictions of every fit for each of its (alpha, ratio) pairs, in one descent.

    ``alpha`` and ``ratio`` have one row per fit.
    """
    points = alpha.shape[1]
    weights = coordinate_descent(
        np.repeat(np.stack([f.cov for f in fits]), points, axis=0),
        np.repeat(np.stack([f.cross for f in fits]), points, axis=0),
        np.repeat([f.moments.y_var[f.segment] for f in fits], points),
        alpha.ravel(),
        ratio.ravel(),
        tolerance,
    )
    return [f.predict(w) for f, w in zip(fits, weights.reshape(len(fits), points, -1))]


def _fits(chunk, roles: dict[str, int], train_scale: bool) -> list[Fit]:
    """The fits of the given roles that have training rows.

    Folds use the scale of all training rows, other fits that of their own rows.
    """
    fits = []
    for i, (row, moments, scored) in enumerate(chunk):
        for role, segment in roles.items():
            if role in scored and moments.count[segment] > 0:
                scale = moments.scale[TRAIN_SEGMENT if train_scale else segment]
                x, y = scored[role]
                y = np.nan if y is None else y - row.y_shift
                fits.append(Fit(i, role, moments, segment, scale, x, y))
    return fits


def tuned_points(chunk, alpha: np.ndarray, ratio: np.ndarray, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The best grid point of several tickers and steps; a single point needs no folds."""
    if len(alpha) == 1:
        return dict.fromkeys(range(len(chunk)), 0)
    folds = _fits(chunk, {role: f for f, role in enumerate(FOLD_ROLES)}, train_scale=True)
    errors: dict[int, np.ndarray] = {}
    if folds:
        grid = np.tile(alpha, (len(folds), 1)), np.tile(ratio, (len(folds), 1))
        for f, predicted in zip(folds, solve(folds, *grid, tolerance)):
            errors[f.problem] = errors.get(f.problem, 0.0) + np.abs(f.y - predicted)
    return {i: int(np.argmin(e)) for i, e in errors.items()}


def fit_chunk(chunk, alpha: np.ndarray, ratio: np.ndarray, tolerance: float = TOLERANCE) -> pd.DataFrame:
    """Tune and forecast several tickers and steps together."""
    return _forecasts(chunk, tuned_points(chunk, alpha, ratio, tolerance), alpha, ratio, tolerance)


def coefficients_of_chunk(chunk, alpha: np.ndarray, ratio: np.ndarray, tolerance: float = TOLERANCE) -> pd.DataFrame:
    """Tune several tickers and steps together, and give the weights of both phases."""
    best = tuned_points(chunk, alpha, ratio, tolerance)
    final = [
        (i, phase, segment)
        for i, (_, moments, _) in enumerate(chunk)
        for phase, segment in FITTED_ON.items()
        if i in best and moments.count[segment] > 0
    ]
    out = []
    if final:
        scales = [chunk[i][1].scale[segment] for i, _, segment in final]
        chosen = np.array([best[i] for i, _, _ in final])
        weights = coordinate_descent(
            np.stack([chunk[i][1].cov[segment] / np.outer(s, s) for (i, _, segment), s in zip(final, scales)]),
            np.stack([chunk[i][1].cross[segment] / s for (i, _, segment), s in zip(final, scales)]),
            np.array([chunk[i][1].y_var[segment] for i, _, segment in final]),
            alpha[chosen],
            ratio[chosen],
            tolerance,
        )
        for (i, phase, segment), scale, own, g in zip(final, scales, weights, chosen):
            row, moments, _ = chunk[i]
            level, centre = moments.y_mean[segment] + row.y_shift, moments.x_mean[segment] + row.x_shift
            out.append((row.ticker, row.horizon, phase, level, centre, scale, own, alpha[g], ratio[g]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])


def _forecasts(chunk, best: dict[int, int], alpha: np.ndarray, ratio: np.ndarray, tolerance: float) -> pd.DataFrame:
    """Validation and test predictions of the problems in ``best`` at their grid point."""
    final = [f for f in _fits(chunk, FITTED_ON, train_scale=False) if f.problem in best]
    out = []
    if final:
        chosen = np.array([best[f.problem] for f in final])
        for f, g, predicted in zip(final, chosen, solve(final, alpha[chosen, None], ratio[chosen, None], tolerance)):
            row = chunk[f.problem][0]
            y = None if np.isnan(f.y) else f.y + row.y_shift
            out.append((row.ticker, row.horizon, f.role, y, predicted[0] + row.y_shift, alpha[g], ratio[g]))
    return pd.DataFrame(out, columns=["ticker", "horizon", "role", "y", "y_hat", "alpha", "l1_ratio"])


def elasticnet_forecast(
    frame: DataFrame,
    features: list[str],
    horizon: int,
    alphas: np.ndarray = ALPHAS,
    ratios: np.ndarray = RATIOS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Tune on the training rows, score the validation row, refit and forecast.

    With one alpha and one ratio nothing is tuned.

    Columns are scaled by the statistics of all training rows before the folds
    are taken. A fold's score is the error of its one test row; the grid point
    with the lowest mean wins, ties go to the first.
    """
    fit = in_chunks(fit_chunk, len(features), alphas, ratios, tolerance)
    return moment_rows(frame, features, horizon).mapInPandas(fit, SCHEMA)


def elasticnet_coefficients(
    frame: DataFrame,
    features: list[str],
    horizon: int,
    alphas: np.ndarray = ALPHAS,
    ratios: np.ndarray = RATIOS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The same fits as a table of weights per ticker, step and phase."""
    fit = in_chunks(coefficients_of_chunk, len(features), alphas, ratios, tolerance)
    return moment_rows(frame, features, horizon, shifts=True).mapInPandas(fit, COEFFICIENTS)


def in_chunks(work, width: int, alphas: np.ndarray, ratios: np.ndarray, tolerance: float):
    alpha = np.repeat(np.asarray(alphas, dtype=float), len(ratios))
    ratio = np.tile(np.asarray(ratios, dtype=float), len(alphas))

    def fit(batches):
        found = problems(batches, width)
        while chunk := list(islice(found, CHUNK)):
            yield work(chunk, alpha, ratio, tolerance)

    return fit

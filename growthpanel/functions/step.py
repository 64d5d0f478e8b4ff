"""The damped Gauss-Newton step on fit-state rows: small systems only, never points.

Each row holds sums of products over the training rows of one fit, for the columns 1, u (shape), d1, d2, d3 (derivatives
of the shape by k, t0, d) and y. All fits of an Arrow batch are stepped at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from growthpanel.functions.shapes import Arrays

# the step travels to the workers with the job, so they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ("one", "u", "d1", "d2", "d3", "y")
PAIRS = [(i, j) for i in range(6) for j in range(i, 6)]
SUMS = [f"s_{COLUMNS[i]}_{COLUMNS[j]}" for i, j in PAIRS]
SHAPE = ["k", "t0", "d"]
# what a fit remembers between passes: accepted shape, its error and sums, damping and its growth, predicted decrease
MEMORY = len(SHAPE) + 4 + len(SUMS)
# what each fit is asked with, beside its curve: rows to train on, rows to be scored on, first shape
ASKED = ["fold", "start", "train_end", "score_from", "score_to", *SHAPE]
# fold of a fit of the whole series; starts whose errors differ by more than this share disagree
WHOLE, AGREE = -1, 1e-3
FIRST_DAMPING, LEAST_DAMPING, MOST_DAMPING = 1e-2, 1e-9, 1e9
# a step that may go less than this share of its way to a height bound counts as being at the bound
NEAR_BOUND = 0.1
# fits stepped together in one task, and numbers that their padded weeks may have, however long a series is
BLOCK, CELLS = 256, 1 << 18
# weeks whose products are summed at a time: every length is added up in the same steps
SLICE = 128


def fresh_memory() -> list[float]:
    return [0.0] * len(SHAPE) + [float("inf"), FIRST_DAMPING, 2.0, 0.0] + [0.0] * len(SUMS)


def _products(flat: np.ndarray) -> np.ndarray:
    gram = np.empty((len(flat), 6, 6))
    for position, (i, j) in enumerate(PAIRS):
        gram[:, i, j] = gram[:, j, i] = flat[:, position]
    return gram


def _divide(top, bottom):
    return np.divide(top, bottom, out=np.zeros_like(np.asarray(top, float)), where=np.asarray(bottom) > 0)


def linear_pair(gram, absolute, low, high):
    """alpha, beta, height and squared error of the best fit for a given shape, the height inside [low, high].

    ``absolute`` marks curves whose height is alpha + beta (Gompertz); elsewhere the height is beta.
    """
    n, su, suu, sy, suy = gram[:, 0, 0], gram[:, 0, 1], gram[:, 1, 1], gram[:, 0, 5], gram[:, 1, 5]
    cuu, cuy, cyy = suu - su * su / n, suy - su * sy / n, gram[:, 5, 5] - sy * sy / n
    slope = _divide(cuy, cuu)
    wanted = np.where(absolute, (sy - slope * su) / n + slope, slope)
    height = np.clip(wanted, low, high)
    held = height != wanted
    held_alpha = _divide((sy - suy) - height * (su - suu), n - 2 * su + suu)
    alpha = np.where(absolute, np.where(held, held_alpha, height - slope), (sy - height * su) / n)
    beta = np.where(absolute, height - alpha, height)
    sse = cyy - 2 * beta * cuy + beta * beta * cuu + n * (alpha - (sy - beta * su) / n) ** 2
    return alpha, beta, height, held, sse


def _solve(matrix, rhs, diagonal, free, damping):
    """Scaled, damped solution with entries that may not move masked out."""
    own = np.einsum("nii->ni", matrix)
    free = free & (own > 1e-13 * diagonal)
    scale = np.where(free, np.sqrt(np.where(free, own, 1.0)), 1.0)
    system = np.where(free[:, :, None] & free[:, None, :], matrix / (scale[:, :, None] * scale[:, None, :]), 0.0)
    system[:, range(3), range(3)] = 1.0 + damping[:, None]
    return np.linalg.solve(system, np.where(free, rhs / scale, 0.0)[..., None])[..., 0] * free / scale


def _outer(a, b):
    return a[:, :, None] * b[:, None, :]


def next_shape(gram, shape, damping, absolute, height_range, low, high, may_move):
    """Trial shape after one step from an accepted shape, and the decrease of the error the linear model predicts.

    alpha and beta are projected out. A step that would take the height past a bound ends at the bound. If the height is
    at a bound or next to it, it is set to the bound and only the remaining direction is projected out.
    """
    alpha, beta, height, held, _ = linear_pair(gram, absolute, *height_range)
    n, su, suu = gram[:, 0, 0, None], gram[:, 0, 1, None], gram[:, 1, 1, None]
    ones, with_u, among = gram[:, 0, 2:5], gram[:, 1, 2:5], gram[:, 2:5, 2:5]
    slope = gram[:, 2:5, 5] - alpha[:, None] * ones - beta[:, None] * with_u
    diagonal = np.einsum("nii->ni", among)
    toward = beta[:, None] * slope
    free = may_move & ~((shape <= low) & (toward < 0)) & ~((shape >= high) & (toward > 0)) & (beta != 0)[:, None]
    size = np.where(beta == 0, 1.0, beta)[:, None]

    centred = with_u - ones * su / n
    spread = np.maximum(suu - su * su / n, np.finfo(float).tiny)
    both = among - _outer(ones, ones) / n[..., None] - _outer(centred, centred) / spread[..., None]
    step = _solve(both, slope, diagonal, free, damping) / size
    d_beta = -(beta[:, None] * centred / spread * step).sum(1)
    d_alpha = -(beta[:, None] * ones * step).sum(1) / n[:, 0] - d_beta * su[:, 0] / n[:, 0]
    expected = height + np.where(absolute, d_alpha + d_beta, d_beta)
    bound = np.clip(expected, *height_range)
    share = np.divide(bound - height, expected - height, out=np.ones_like(height), where=expected != height)
    hold = held | (share < NEAR_BOUND)

    left = np.where(absolute[:, None], ones - with_u, ones)
    length = np.maximum(np.where(absolute[:, None], n - 2 * su + suu, n), np.finfo(float).tiny)
    crossing = with_u - left * np.where(absolute[:, None], su - suu, su) / length
    one = among - _outer(left, left) / length[..., None]
    shifted = slope - (np.where(held, height, bound) - height)[:, None] * crossing
    held_step = _solve(one, shifted, diagonal, free, damping) / size

    step = np.where(hold[:, None], held_step, step * np.clip(share, NEAR_BOUND, 1.0)[:, None])
    trial = np.where(may_move, np.clip(shape + step, low, high), shape)
    matrix = np.where(hold[:, None, None], one, both)
    moved = (trial - shape) * size
    predicted = 2 * (moved * np.where(hold[:, None], shifted, slope)).sum(1) - np.einsum("ni,nij,nj->n", moved, matrix, moved)
    return trial, predicted


def _curve_limits(rows: pd.DataFrame, curve: SimpleNamespace):
    """Whether heights are absolute, the height range, and range and freedom of k, t0 and d, per row."""
    n = len(rows)
    top = np.where(rows["ymax"] > 0, rows["ymax"], 1.0)
    (k_low, k_high), (d_low, d_high) = curve.rate_bounds, curve.asymmetry_bounds
    low = np.column_stack([np.full(n, k_low), rows["xlo"], np.full(n, d_low)]).astype(float)
    high = np.column_stack([np.full(n, k_high), rows["xhi"], np.full(n, d_high)]).astype(float)
    may_move = np.tile([True, curve.fits_midpoint, curve.fits_asymmetry], (n, 1))
    least, most = curve.height_bounds
    return np.full(n, curve.absolute), (least * top, most * top), low, high, may_move


def advance(trial, best, sums, limits, tolerance):
    """Accept or reject the trial shapes, adapt the damping, and propose the next trials.

    ``best`` is the memory of each fit: accepted shape, squared error, damping, damping growth, predicted decrease, sums.
    """
    absolute, height_range, low, high, may_move = limits
    best_shape, best_sse = best[:, :3], best[:, 3]
    damping, growth, predicted, best_sums = best[:, 4], best[:, 5], best[:, 6], best[:, 7:]
    sse = linear_pair(_products(sums), absolute, *height_range)[-1]
    first = np.isinf(best_sse)
    better = sse <= best_sse
    settled = ~first & (np.abs(best_sse - sse) <= tolerance * best_sse) & (damping <= 1.0)
    gain = np.where(predicted > 0, (best_sse - sse) / np.where(predicted > 0, predicted, 1.0), 0.5)
    eased = np.maximum(damping * np.maximum(0.1, 1 - (2 * gain - 1) ** 3), LEAST_DAMPING)
    damping = np.where(first, damping, np.where(better, eased, damping * growth))
    growth = np.where(better, 2.0, growth * 2.0)
    best_shape = np.where(better[:, None], trial, best_shape)
    best_sums = np.where(better[:, None], sums, best_sums)
    best_sse = np.where(better, sse, best_sse)

    gram = np.nan_to_num(_products(best_sums))
    proposed, predicted = next_shape(gram, best_shape, damping, absolute, height_range, low, high, may_move)
    still = (np.abs(proposed - best_shape) <= tolerance * np.abs(best_shape)).all(axis=1)
    done = settled | still | (damping > MOST_DAMPING) | ~np.isfinite(best_sse)
    memory = np.column_stack([best_shape, best_sse, damping, growth, predicted, best_sums])
    return proposed, memory, done, settled | still


def _shape_columns(curve: SimpleNamespace, x, k, t0, d):
    """Shape and its derivatives by k, t0 and d for several trial shapes (rows) at all points (columns)."""
    u = curve.shape(Arrays, x, k, t0, d)
    return u, *(np.broadcast_to(slope, u.shape) for slope in curve.slopes(Arrays, x, k, t0, d))


def _slices(trained):
    """Slices of weeks and the fits that have training rows there."""
    for begin in range(0, int(trained.max()), SLICE):
        yield slice(begin, begin + SLICE), np.flatnonzero(trained > begin)


def _weekly_sums(curve: SimpleNamespace, x, y, weight, trained, shape):
    sums = np.zeros((len(shape), len(PAIRS)))
    for part, some in _slices(trained):
        u, d1, d2, d3 = _shape_columns(curve, x[some, part], *(shape[some][:, [i]] for i in range(3)))
        columns = np.stack([np.ones_like(u), u, d1, d2, d3, y[some, part]], axis=1)
        gram = np.matmul(columns * weight[some, None, part], columns.transpose(0, 2, 1))
        sums[some] += np.column_stack([gram[:, i, j] for i, j in PAIRS])
    return sums


def _squared_error(curve: SimpleNamespace, x, y, weight, trained, shape, alpha, beta):
    """From the residuals themselves, not from differences of large sums."""
    total = np.zeros(len(shape))
    for part, some in _slices(trained):
        u = _shape_columns(curve, x[some, part], *(shape[some][:, [i]] for i in range(3)))[0]
        rest = (y[some, part] - alpha[some, None] - beta[some, None] * u) * weight[some, part]
        total[some] += (rest * rest).sum(1)
    return total


def _scores(curve: SimpleNamespace, fits: pd.DataFrame, series, shape, alpha, beta) -> np.ndarray:
    """R2 of each fit on the rows that choose between starts; NaN where they are fewer than two, or a value is not finite."""
    out = np.full(len(fits), np.nan)
    for i, (begin, end) in enumerate(zip(fits["score_from"], fits["score_to"])):
        x, y = (values[begin:end] for values in series[i])
        if len(y) < 2:
            continue
        rest = y - (alpha[i] + beta[i] * curve.shape(Arrays, x, *shape[i]))
        left, total = float(rest @ rest), float(((y - y.mean()) ** 2).sum())
        out[i] = 1.0 - left / total if total > 0 else float(left == 0) if np.isfinite(left) else np.nan
    return out


def grid_shape(curve: SimpleNamespace, x, y, row, points: int, rounds: int) -> tuple[np.ndarray, float]:
    """The shape with the least error on a grid that is zoomed in ``rounds`` times, and that error.

    Rates and asymmetries are spread evenly by their logarithm, midpoints evenly, ``points`` each from bound to bound; a round
    reaches one step of the last one to either side of its best. Height and offset of a candidate follow in closed form
    from sums over the training rows. Of equal errors the first wins.
    """
    absolute, heights, low, high, may_move = _curve_limits(row, curve)
    into, back = (np.log, lambda v: v, np.log), (np.exp, lambda v: v, np.exp)
    axes = [i for i in range(3) if may_move[0, i]]
    low, high = (np.array([into[i](side[0, i]) if i in axes else 0.0 for i in range(3)]) for side in (low, high))
    begin, end, best = low.copy(), high.copy(), None
    cyy = y @ y
    for _ in range(rounds):
        lines = [np.linspace(begin[i], end[i], points) if i in axes else row[SHAPE[i]].to_numpy(float)[:1] for i in range(3)]
        grid = np.stack(np.meshgrid(*lines, indexing="ij"), -1).reshape(-1, 3)
        errors, step = [], max(1, CELLS // max(1, len(x)))
        for at in range(0, len(grid), step):
            some = [back[i](grid[at : at + step, i]) if i in axes else grid[at : at + step, i] for i in range(3)]
            u = curve.shape(Arrays, x[None, :], *(v[:, None] for v in some))
            gram = np.zeros((len(u), 6, 6))
            gram[:, 0, 0], gram[:, 0, 1], gram[:, 1, 1] = len(x), u.sum(1), (u * u).sum(1)
            gram[:, 0, 5], gram[:, 1, 5], gram[:, 5, 5] = y.sum(), u @ y, cyy
            errors.append(linear_pair(gram, np.repeat(absolute, len(u)), *(np.repeat(h, len(u)) for h in heights))[-1])
        error = np.nan_to_num(np.concatenate(errors), nan=np.inf)
        top = int(error.argmin())
        if best is None or error[top] < best[1]:
            best = np.array([back[i](grid[top, i]) if i in axes else grid[top, i] for i in range(3)]), float(error[top])
        width = (end - begin) / (points - 1)
        begin, end = np.maximum(low, grid[top] - width), np.minimum(high, grid[top] + width)
    return best


def _seeded(curve, fits: pd.DataFrame, series, found: pd.DataFrame, points: int, rounds: int):
    """For groups of starts that did not converge or disagree: one more fit, from the best shape of a grid."""
    first = found.groupby(["owner", "fold"])
    least, most = first["error"].transform("min"), first["error"].transform("max")
    doubtful = ~first["converged"].transform("all") | ~(most - least <= AGREE * least)
    lead = found[doubtful & ~found.duplicated(["owner", "fold"])]
    if not rounds or not len(lead):
        return fits.iloc[:0]
    asked = fits.loc[lead.index].copy()
    asked["start"] = found.groupby(["owner", "fold"])["start"].transform("max").loc[lead.index] + 1
    shapes = []
    for at in lead.index:
        x, y = (values[: int(fits.loc[at, "train_end"])] for values in series[at])
        shapes.append(grid_shape(curve, x, y, fits.loc[[at]], points, rounds)[0])
    asked[SHAPE] = np.array(shapes)
    return asked


def fit_groups(
    batches: Iterator[pd.DataFrame], curves: Mapping[str, SimpleNamespace], tolerance: float, max_passes: int, points: int = 9, rounds: int = 0
) -> Iterator[pd.DataFrame]:
    """All passes for one series and curve per row: its weeks (x, y) and, in arrays, the fits asked for.

    Fits of a batch run side by side in blocks of one curve, so that a pass costs a few array operations per block. Where the
    starts of a fold, or the one of a whole series, did not converge or disagree, a zoomed grid gives one more start; of a
    whole series the better one stays.
    """
    for rows in batches:
        if not len(rows):
            continue
        weeks_of = rows[["x", "y"]].to_numpy()
        facts = rows.drop(columns=["x", "y", *ASKED])
        owner = np.repeat(np.arange(len(rows)), rows["fold"].map(len).to_numpy())
        asked = pd.DataFrame({c: np.concatenate(rows[c].to_numpy()) for c in ASKED})
        flat = facts.iloc[owner].reset_index(drop=True).join(asked)
        for name, same_curve in flat.groupby("model", sort=False):
            curve, series = curves[name], {i: weeks_of[owner[i]] for i in same_curve.index}
            with np.errstate(all="ignore"):
                done = [_fit_block(curve, block, [series[i] for i in block.index], tolerance, max_passes) for block in _blocks(same_curve)]
                found = pd.concat(done)
                brief = found[["fold", "start", "converged"]].assign(owner=owner[found.index], error=found["memory"].map(lambda m: m[3]))
                more = _seeded(curve, same_curve, series, brief, points, rounds)
                if len(more):
                    again = [_fit_block(curve, block, [series[i] for i in block.index], tolerance, max_passes) for block in _blocks(more)]
                    found = _with_seeded(found, pd.concat(again))
            yield found


def grid_groups(batches: Iterator[pd.DataFrame], curves: Mapping[str, SimpleNamespace], points: int, rounds: int) -> Iterator[pd.DataFrame]:
    """The best shape on a zoomed grid for one series and curve per row."""
    for rows in batches:
        best = []
        with np.errstate(all="ignore"):
            for i in range(len(rows)):
                row = rows.iloc[[i]]
                best.append(grid_shape(curves[row["model"].iloc[0]], row["x"].iloc[0], row["y"].iloc[0], row, points, rounds))
        out = rows.drop(columns=["x", "y"])
        out[SHAPE] = np.array([shape for shape, _ in best]).reshape(-1, 3)
        yield out.assign(sse=[sse for _, sse in best])


def _with_seeded(found: pd.DataFrame, again: pd.DataFrame) -> pd.DataFrame:
    """Fits from a grid beside the others of their fold; of a whole series the one that converged, or has less error, stays."""
    whole = again["fold"] == WHOLE
    rank = lambda fits: [(not c, m[3]) for c, m in zip(fits["converged"], fits["memory"])]
    better = [new < old for new, old in zip(rank(again[whole]), rank(found.loc[again[whole].index]))]
    chosen = again[whole][better].assign(start=0)
    return pd.concat([found.drop(index=chosen.index), chosen, again[~whole]])


def _blocks(fits: pd.DataFrame) -> Iterator[pd.DataFrame]:
    begin, width = 0, 0
    lengths = fits["train_end"].to_numpy()
    for i, length in enumerate(lengths):
        width = max(width, int(length))
        if i > begin and (i - begin == BLOCK or (i - begin + 1) * width > CELLS):
            yield fits.iloc[begin:i]
            begin, width = i, int(length)
    yield fits.iloc[begin:]


def _padded(arrays, width: int) -> np.ndarray:
    table = np.zeros((len(arrays), width))
    for row, values in zip(table, arrays):
        row[: min(width, len(values))] = values[:width]
    return table


def _fit_block(curve: SimpleNamespace, fits: pd.DataFrame, series, tolerance: float, max_passes: int) -> pd.DataFrame:
    """Fits of one curve, each with the (x, y) of its series; only training rows have weight."""
    trained = fits["train_end"].to_numpy()
    width = -(-int(trained.max()) // SLICE) * SLICE
    x, y = (_padded([pair[i] for pair in series], width) for i in range(2))
    weight = (np.arange(width)[None, :] < trained[:, None]).astype(float)
    x, y = x * weight, y * weight
    count, limits = len(fits), _curve_limits(fits, curve)
    trial, best = fits[SHAPE].to_numpy(float), np.tile(fresh_memory(), (count, 1))
    passes, converged, moving = np.zeros(count, int), np.zeros(count, bool), np.arange(count)
    for _ in range(max_passes):
        absolute, (low_height, high_height), low, high, may_move = limits
        part = (absolute[moving], (low_height[moving], high_height[moving]), low[moving], high[moving], may_move[moving])
        sums = _weekly_sums(curve, x[moving], y[moving], weight[moving], trained[moving], trial[moving])
        trial[moving], best[moving], done, settled = advance(trial[moving], best[moving], sums, part, tolerance)
        passes[moving] += 1
        converged[moving] = settled
        moving = moving[~done]
        if not len(moving):
            break
    alpha, beta, *_ = linear_pair(np.nan_to_num(_products(best[:, 7:])), limits[0], *limits[1])
    fine = np.isfinite(best[:, 3])
    best[fine, 3] = _squared_error(curve, x, y, weight, trained, best[:, :3], alpha, beta)[fine]
    done = ~np.isin(np.arange(count), moving)
    score = _scores(curve, fits, series, best[:, :3], alpha, beta)
    return fits.assign(memory=list(best), alpha=alpha, beta=beta, passes=passes, done=done, converged=converged, score=score)

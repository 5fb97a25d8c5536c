"""Decoding kernels on NumPy arrays: best label paths of many sequences at once, and the clean-up of short segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells (sequences x frames x labels) whose back-pointers are held at a time.
CELLS = 4_000_000


def _step(best: np.ndarray, penalty: np.ndarray, stay: np.ndarray | None, change: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """From the best scores by label (last axis) to those on entering the next frame, and the labels that they come from.

    The best change into any label is from the best label so far (or the second best, for that one itself), so a step takes
    time in proportion to the labels. Of equal ways the one from the lowest label is taken."""
    moved = best - penalty
    if stay is not None:
        best, moved = best + stay, moved + change
    k = best.shape[-1]
    labels = np.arange(k)
    if k == 1:
        return best, np.zeros(best.shape, np.int64)
    top = moved.argmax(-1)[..., None]
    rest = moved.copy()
    np.put_along_axis(rest, top, -np.inf, -1)
    second = rest.argmax(-1)[..., None]
    own = labels == top
    source = np.where(own, second, top)
    value = np.where(own, np.take_along_axis(rest, second, -1), np.take_along_axis(moved, top, -1))
    use = (best > value) | ((best == value) & (labels < source))
    return np.where(use, best, value), np.where(use, labels, source)


def weights_of(boundary: np.ndarray, weight: np.ndarray, eps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a stay and a change between two frames add, given the probability of a boundary there."""
    p = np.clip(boundary, eps, 1 - eps)
    return weight * np.log1p(-p), weight * np.log(p)


def forward(scores: Sequence[np.ndarray], penalty: np.ndarray, between: Sequence[tuple[np.ndarray, np.ndarray] | None], start: np.ndarray | None = None, back: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Best scores by label in the last frame of each sequence (frames x labels), back-pointers, and the order of the rows:
    longest first. ``between``: for each sequence what a stay and a change add after each frame, or None. ``start``: scores on
    entering the first frame, (sequences, starts, labels)."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    count = np.array([len(scores[i]) for i in order])
    n, k, m = int(count[0]), scores[0].shape[1], len(scores)
    padded = np.zeros((n, m, 1, k))
    plus = any(between[i] is not None for i in range(m))
    stay, change = (np.zeros((n, m, 1, 1)) if plus else None for _ in range(2))
    for row, i in enumerate(order.tolist()):
        padded[: len(scores[i]), row, 0] = scores[i]
        if between[i] is not None:
            stay[: len(between[i][0]), row, 0, 0], change[: len(between[i][1]), row, 0, 0] = between[i]
    best = padded[0] + (0.0 if start is None else start[order])
    pointers = np.zeros((n, *best.shape), np.int32) if back else None
    fine = penalty[order].reshape(-1, 1, 1)
    for t in range(1, n):
        live = int(np.searchsorted(-count, -t))  # sequences of more than t frames
        value, source = _step(best[:live], fine[:live], *((stay[t - 1, :live], change[t - 1, :live]) if plus else (None, None)))
        best[:live] = value + padded[t, :live]
        if back:
            pointers[t, :live] = source
    return best, pointers, order


def best_paths(scores: Sequence[np.ndarray], penalty: np.ndarray, between: Sequence[tuple[np.ndarray, np.ndarray] | None], start: np.ndarray | None = None, last: np.ndarray | None = None) -> list[np.ndarray]:
    """The best path of each sequence of one number of labels. ``start``: scores on entering the first frame (sequences, labels);
    ``last``: the label of the last frame, negative where it is free."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    longest = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: -len(scores[i]))
    at = 0
    while at < len(longest):
        some = longest[at : at + max(1, CELLS // scores[longest[at]].size)]
        at += len(some)
        best, back, order = forward([scores[i] for i in some], penalty[some], [between[i] for i in some], None if start is None else start[some][:, None])
        rows = np.array(some)[order]
        count = np.array([len(scores[i]) for i in rows])
        label = best[:, 0].argmax(-1)
        if last is not None:
            label = np.where(last[rows] >= 0, last[rows], label)
        path = np.zeros((len(rows), int(count[0])), np.int64)
        for t in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -t))
            path[:live, t] = label[:live]
            label[:live] = back[t, np.arange(live), 0, label[:live]] if t else label[:live]
        for i, p, c in zip(rows.tolist(), path, count.tolist(), strict=True):
            out[i] = p[:c]
    return out


def transfers(scores: Sequence[np.ndarray], penalty: float, between: Sequence[tuple[np.ndarray, np.ndarray] | None]) -> list[np.ndarray]:
    """The max-plus matrices of blocks of frames and the step out of each: from the label of its first frame to that of the next
    block's first frame."""
    k = scores[0].shape[1]
    whole = [np.concatenate([x, np.zeros((1, k))]) for x in scores]
    start = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (len(scores), k, k))
    best, _, order = forward(whole, np.full(len(scores), penalty), between, start, back=False)
    out = np.empty_like(best)
    out[order] = best
    return list(out)


def viterbi(scores: np.ndarray, penalty: float = 0.0, boundary: np.ndarray | None = None, weight: float = 0.0, eps: float = 1e-4) -> np.ndarray:
    """The best path where a change of label costs ``penalty``, and the boundary probability between two frames adds the
    weighted log of itself to a change and of its complement to a stay. Of equal ways the one from the lowest label is taken."""
    check(penalty, weight, eps)
    prior = None if boundary is None or weight == 0 else weights_of(np.asarray(boundary, float), weight, eps)
    return best_paths([np.asarray(scores, float)], np.array([float(penalty)]), [prior])[0]


def check(penalty: float, weight: float, eps: float) -> None:
    if penalty < 0 or weight < 0 or not 0 < eps < 0.5:
        raise ValueError("penalty and weight must not be negative, eps between 0 and 0.5")


def clean(start: Sequence[float], end: Sequence[float], label: Sequence, least: float, merge_same: bool = True) -> tuple[list[float], list[float], list]:
    """While a segment is shorter than ``least``, the first such one goes to a neighbour: the first to the next, the last to
    the one before, one between equal labels joins them, another goes to the longer (or the earlier).

    The segments are a doubly linked list. A merge leaves what is before it long enough, so the cursor goes on from the merged
    segment and every segment is linked out at most once: linear."""
    start, end, label, n = list(start), list(end), list(label), len(start)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    head, at, left = 0, 0, n
    while least > 0 and left > 1 and at >= 0:
        if not end[at] - start[at] < least:
            at = after[at]
            continue
        lo, hi = before[at], after[at]
        if lo >= 0 and hi >= 0 and label[lo] == label[hi]:
            first, last, keep = lo, hi, label[lo]
        elif lo < 0:
            first, last, keep = at, hi, label[hi]
        elif hi < 0 or end[lo] - start[lo] >= end[hi] - start[hi]:
            first, last, keep = lo, at, label[lo]
        else:
            first, last, keep = at, hi, label[hi]
        left -= 2 if first == lo and last == hi else 1
        end[first], label[first], after[first] = end[last], keep, after[last]
        if after[last] >= 0:
            before[after[last]] = first
        at = first
    out: tuple[list[float], list[float], list] = ([], [], [])
    at = head if n else -1
    while at >= 0:
        if merge_same and least > 0 and n > 1 and out[2] and out[2][-1] == label[at]:
            out[1][-1] = end[at]
        else:
            for values, x in zip(out, (start[at], end[at], label[at]), strict=True):
                values.append(x)
        at = after[at]
    return out


def clean_segments(segments: Sequence[tuple[float, float, str]], least: float, merge_same: bool = True) -> list[tuple[float, float, str]]:
    """``clean`` on a list of segments."""
    return list(zip(*clean(*([s[i] for s in segments] for i in range(3)), least, merge_same), strict=True))

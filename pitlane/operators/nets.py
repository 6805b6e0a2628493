"""Small models in NumPy: scores of rows and gradients of them, and objectives over rows and lists.

A row is a vector of slots: places in embedding tables, -1 for what isn't known. Parameters are a dict of
arrays. A gradient is a dict of (rows, values): the touched rows of an embedding table, or None and the
whole array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np

Params = dict[str, np.ndarray]
Gradient = dict[str, tuple[np.ndarray | None, np.ndarray]]


def _noise(codes: np.ndarray, width: int, seed: int, scale: float) -> np.ndarray:
    """Start values that depend on code, column and seed alone: uniform, of deviation ``scale``."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x.astype(np.float64) / 2**63 - 1) * (scale * 3**0.5)


def _rows(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Rows of an embedding table; zeros for -1."""
    if not len(table):
        return np.zeros((*slots.shape, table.shape[1]))
    return np.where((slots >= 0)[..., None], table[slots], 0.0)


def _total(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The sum of each row's rows of a table; -1 adds nothing."""
    out = np.zeros((len(slots), table.shape[1]))
    for column in slots.T if len(table) else ():
        some = table[column]
        some[column < 0] = 0.0
        out += some
    return out


def _spread(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots, without -1, and the sums of their values."""
    slots, values = slots.ravel(), values.reshape(slots.size, -1)
    order = np.argsort(slots, kind="stable")
    order = order[np.searchsorted(slots[order], 0) :]
    slots = slots[order]
    starts = np.flatnonzero(np.diff(slots, prepend=-1))
    return slots[starts], np.add.reduceat(values[order], starts, 0) if len(starts) else np.zeros((0, values.shape[1]))


@dataclass(frozen=True)
class FactorisationMachine:
    """bias + weights of the row's slots + products of each two of their vectors of ``k`` components."""

    k: int = 16
    #: Parameters that have a row for each code.
    tables: ClassVar = ("V", "W")
    #: So many times sgd.ROWS_AT_ONCE rows are computed at once.
    more_rows: ClassVar = 1

    def start(self, codes: np.ndarray, seed: int) -> Params:
        return {"V": _noise(codes, self.k, seed, 0.01), "W": np.zeros((len(codes), 1)), "b": np.zeros(1)}

    def seen(self, x: np.ndarray) -> np.ndarray:
        """What all models over the same slots share."""
        return x

    def forward(self, p: Params, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = _rows(p["V"], x)
        s = e.sum(1)
        return p["b"][0] + _rows(p["W"], x).sum((1, 2)) + 0.5 * ((s * s).sum(1) - (e * e).sum((1, 2))), (e, s)

    def backward(self, p: Params, x: np.ndarray, kept: tuple, g: np.ndarray) -> Gradient:
        e, s = kept
        return {"V": _spread(x, g[:, None, None] * (s[:, None, :] - e)), "W": _spread(x, np.repeat(g, x.shape[1])), "b": (None, np.array([g.sum()]))}


#: Pairs of items whose hidden layer is computed at once, and distinct items up to which histories are rows of a matrix over them.
PAIRS_AT_ONCE, MOST_DENSE = 2048, 256


def _summed(places: np.ndarray, values: np.ndarray, out: np.ndarray, order: np.ndarray | None = None) -> None:
    """Adds values to the rows of ``out`` in ``places``, which have this order, their own without one."""
    if order is not None:
        places, values = places[order], values[order]
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    if len(starts):
        out[places[starts]] += np.add.reduceat(values, starts, 0)


@dataclass(frozen=True)
class Histories:
    """What all models over the same rows share: their distinct items, and the distinct pairs of a row's item with a past one.

    items: slots, -1 for unknown ones. item: each row's place in them. at, past: row, and place in items,
    of each past item. first, second: the places of each distinct pair, in order; pair: the pair of each past item.
    """

    fields: np.ndarray
    items: np.ndarray
    item: np.ndarray
    at: np.ndarray
    past: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pair: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, fields: int) -> Histories:
        at, column = np.nonzero(x[:, fields + 1 :] >= 0)
        items, place = np.unique(np.concatenate([x[:, fields], x[at, fields + 1 + column]]), return_inverse=True)
        item, past, d = place[: len(x)], place[len(x) :], max(len(items), 1)
        key = item[at] * d + past
        if d * d <= 4 * len(key) + MOST_DENSE:
            there = np.bincount(key, minlength=1) > 0
            pairs, pair = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
        else:
            pairs, pair = np.unique(key, return_inverse=True)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        return cls(x[:, :fields], items, item, at, past, pairs // d, pairs % d, pair, starts, np.diff(np.append(starts, len(at))))

    def blocks(self) -> Iterator[slice]:
        return (slice(i, i + PAIRS_AT_ONCE) for i in range(0, len(self.first), PAIRS_AT_ONCE))

    def rows(self) -> Iterator[tuple[slice, slice]]:
        """Some rows with a history, and their past items."""
        ends = self.starts + self.lengths
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + PAIRS_AT_ONCE, "right")))
            yield slice(i, j), slice(int(self.starts[i]), int(ends[j - 1]))
            i = j


@dataclass(frozen=True)
class TargetAttention:
    """Attention of a row's item over its user's history, beside the summed vectors of its fields.

    A row is ``fields`` slots, the item's, then those of the history. The interest is the history's
    vectors weighted by the softmax of a hidden layer over (item, past item, difference, product);
    fields, item and interest go through two more layers. Without a history the interest is zero.

    The hidden layer's input is linear in the two items but for their product, so its parts are made once
    for each distinct item, and the layer once for each distinct pair of items.
    """

    fields: int
    k: int = 32
    hidden: int = 64
    tables: ClassVar = ("I", "E")
    #: More rows have more pairs in common.
    more_rows: ClassVar = 4

    def start(self, codes: np.ndarray, seed: int) -> Params:
        rng, k, h = np.random.default_rng(seed), self.k, self.hidden
        p = {"I": _noise(codes, k, seed, 0.01), "E": _noise(codes, k, seed + 7919, 0.01)}
        for name, (a, b) in {"A": (4 * k, h), "Q": (h, 1), "M": (3 * k, h), "N": (h, h // 2), "S": (h // 2, 1)}.items():
            p[name], p[name.lower()] = rng.uniform(-1, 1, (a, b)) / a**0.5, rng.uniform(-1, 1, b) / a**0.5
        return p

    def seen(self, x: np.ndarray) -> Histories:
        return Histories.of(x, self.fields)

    def _layer(self, p: Params, x: Histories, some: slice, items: np.ndarray, own: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of pairs, and the hidden layer over them."""
        both = items[x.first[some]] * items[x.second[some]]
        r = both @ p["A"][3 * self.k :]
        r += own[x.first[some]]
        r += past[x.second[some]]
        return both, np.maximum(r, 0, out=r)

    def _sides(self, p: Params, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What an item adds to the hidden layer as the row's own and as a past one."""
        one, two, three, _ = np.split(p["A"], 4)
        return items @ (one + three) + p["a"], items @ (two - three)

    def forward(self, p: Params, x: np.ndarray | Histories) -> tuple[np.ndarray, tuple]:
        x = x if isinstance(x, Histories) else self.seen(x)
        items = _rows(p["I"], x.items)
        sides = self._sides(p, items)
        of_pair = np.zeros(len(x.first))
        for some in x.blocks():
            of_pair[some] = (self._layer(p, x, some, items, *sides)[1] @ p["Q"])[:, 0] + p["q"]
        a, starts, lengths = of_pair[x.pair], x.starts, x.lengths
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts) if len(starts) else a, lengths))
        w = e / np.repeat(np.add.reduceat(e, starts) if len(starts) else e, lengths)
        n, d = len(x.item), len(items)
        shares, interest = None, np.zeros((n, self.k))
        if d <= MOST_DENSE:
            shares = np.bincount(x.at * d + x.past, w, n * d).reshape(n, d)
            interest = shares @ items
        else:
            for rows, past in x.rows():
                interest[x.at[starts[rows]]] = np.add.reduceat(w[past, None] * items[x.past[past]], starts[rows] - past.start, 0)
        c = np.concatenate([_total(p["E"], x.fields), items[x.item], interest], 1)
        u = np.maximum(c @ p["M"] + p["m"], 0)
        v = np.maximum(u @ p["N"] + p["n"], 0)
        return (v @ p["S"] + p["s"])[:, 0], (x, items, sides, w, shares, c, u, v)

    def backward(self, p: Params, _: np.ndarray | Histories, kept: tuple, g: np.ndarray) -> Gradient:
        x, items, sides, w, shares, c, u, v = kept
        f, k, starts, lengths = self.fields, self.k, kept[0].starts, kept[0].lengths
        out: Gradient = {"S": (None, v.T @ g[:, None]), "s": (None, np.array([g.sum()]))}
        dv = (g[:, None] * p["S"][:, 0]) * (v > 0)
        out |= {"N": (None, u.T @ dv), "n": (None, dv.sum(0))}
        du = (dv @ p["N"].T) * (u > 0)
        out |= {"M": (None, c.T @ du), "m": (None, du.sum(0))}
        dc = du @ p["M"].T
        di, d_items = np.ascontiguousarray(dc[:, 2 * k :]), np.zeros_like(items)
        _summed(x.item, dc[:, k : 2 * k], d_items, np.argsort(x.item, kind="stable"))
        if shares is not None:
            d_items += shares.T @ di
            dw = (di @ items.T)[x.at, x.past]
        else:
            dw = np.zeros(len(w))
            for _, past in x.rows():
                mine = di[x.at[past]]
                dw[past] = np.einsum("pk,pk->p", mine, items[x.past[past]])
                _summed(x.past[past], w[past, None] * mine, d_items, np.argsort(x.past[past], kind="stable"))
        mean = np.repeat(np.add.reduceat(w * dw, starts), lengths) if len(starts) else w * dw
        da = np.bincount(x.pair, w * (dw - mean), len(x.first))[:, None]
        dq, d_own, d_past, d_both = np.zeros((self.hidden, 1)), *(np.zeros_like(s) for s in sides), np.zeros((k, self.hidden))
        last = p["A"][3 * k :]
        for some in x.blocks():
            first, second = x.first[some], x.second[some]
            both, r = self._layer(p, x, some, items, *sides)
            dq += r.T @ da[some]
            dr = (da[some] * p["Q"][:, 0]) * (r > 0)
            d_both += both.T @ dr
            d_product = dr @ last.T
            for places, others, side in ((first, second, d_own), (second, first, d_past)):
                order = None if places is first else np.argsort(places, kind="stable")  # pairs are in the order of the first
                _summed(places, dr, side, order)
                _summed(places, d_product * items[others], d_items, order)
        one, two, three, _ = np.split(p["A"], 4)
        d_items += d_own @ (one + three).T + d_past @ (two - three).T
        d_one, d_two = items.T @ d_own, items.T @ d_past
        out |= {"Q": (None, dq), "q": (None, da.sum(0)), "A": (None, np.concatenate([d_one, d_two, d_one - d_two, d_both])), "a": (None, d_own.sum(0))}
        known = int(np.searchsorted(x.items, 0))
        out["I"] = (x.items[known:], d_items[known:])
        slots = x.fields.ravel()
        order = np.argsort(slots, kind="stable")
        order = order[np.searchsorted(slots[order], 0) :]
        starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
        out["E"] = slots[order[starts]], np.add.reduceat(dc[order // f, :k], starts, 0) if len(starts) else np.zeros((0, k))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


@dataclass(frozen=True)
class Totals:
    """What losses are divided by: the sum of weights, lists with both labels, and positives in these."""

    weight: float
    lists: float
    positives: float


def padded(values: np.ndarray, lengths: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """A row for each list."""
    out = np.full((len(lengths), int(lengths.max(initial=0))), fill)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def totals(y: np.ndarray, w: np.ndarray, lengths: np.ndarray) -> Totals:
    """Of rows in lists; rows of weight 0 don't count."""
    n = padded(w > 0, lengths).sum(1)
    pos = padded((w > 0) & (y > 0.5), lengths).sum(1)
    live = (pos > 0) & (pos < n)
    return Totals(float(w.sum()), float(live.sum()), float(pos[live].sum()))


PAIRWISE = ("bpr", "bpr_gauc", "lambda_ndcg")
OBJECTIVES = ("bce", *PAIRWISE, "listnet", "primary")
#: Lists whose pairs are made at once.
LISTS_AT_ONCE = 256


def objective(kind: str, s: np.ndarray, y: np.ndarray, w: np.ndarray, lengths: np.ndarray, over: Totals, k: int = 5) -> tuple[float, np.ndarray]:
    """The loss of scores and its gradient, both divided by ``over``, so that parts of a batch add up to the batch.

    bce: weighted mean over rows. The others are over lists of rows whose weight isn't 0, those with one
    label left out. bpr: mean pair loss of a list, averaged over lists. bpr_gauc: pairs weighted by 1 /
    negatives of the list, over all positives. listnet: cross entropy of the softmax by positive.
    lambda_ndcg: pairs weighted by what swapping them now changes in nDCG at ``k``, which counts as a
    constant. primary: half of bpr_gauc and half of lambda_ndcg.
    """
    if kind == "bce":
        return float((w * (softplus(s) - y * s)).sum() / over.weight), w * (sigmoid(s) - y) / over.weight
    if kind == "primary":
        (a, da), (b, db) = (objective(x, s, y, w, lengths, over, k) for x in ("bpr_gauc", "lambda_ndcg"))
        return (a + b) / 2, (da + db) / 2
    if kind not in OBJECTIVES:
        raise ValueError(f"{kind} is none of {', '.join(OBJECTIVES)}")
    loss, out, ends = 0.0, np.zeros(len(s)), np.cumsum(lengths)
    for at in range(0, len(lengths), LISTS_AT_ONCE):
        some = lengths[at : at + LISTS_AT_ONCE]
        rows = slice(int(ends[at] - lengths[at]), int(ends[at + len(some) - 1]))
        inside = np.arange(int(some.max(initial=0))) < some[:, None]
        ss, used = padded(s[rows], some), padded(w[rows] > 0, some) > 0
        pos = used & (padded(y[rows], some) > 0.5)
        neg = used & ~pos
        n_pos, n_neg = pos.sum(1), neg.sum(1)
        live = ((n_pos > 0) & (n_neg > 0))[:, None]
        each = (_listnet if kind == "listnet" else _pairs)(kind, ss, pos & live, neg & live, used, np.maximum(n_pos, 1), np.maximum(n_neg, 1), k)
        share = over.positives if kind == "bpr_gauc" else over.lists
        loss += each[0] / max(share, 1)
        out[rows] = each[1][inside] / max(share, 1)
    return float(loss), out


def _listnet(kind, s, pos, neg, used, n_pos, n_neg, k):
    live = pos.any(1)[:, None]
    top = np.where(used, s, -np.inf).max(1, keepdims=True, initial=-1e300)
    e = np.where(used & live, np.exp(np.minimum(s - top, 0)), 0.0)
    z = np.maximum(e.sum(1, keepdims=True), 1e-300)
    loss = (np.where(pos, np.log(z) + top - s, 0.0).sum(1) / n_pos).sum()
    return loss, np.where(live, e / z - pos / n_pos[:, None], 0.0)


def _pairs(kind, s, pos, neg, used, n_pos, n_neg, k):
    weight = pos[:, :, None] & neg[:, None, :]
    if kind == "bpr_gauc":
        weight = weight / n_neg[:, None, None]
    else:
        weight = weight / (n_pos * n_neg)[:, None, None]
        if kind == "lambda_ndcg":
            rank = np.argsort(np.argsort(np.where(used, -s, np.inf), 1, kind="stable"), 1, kind="stable")
            gain = np.where(rank < k, 1 / np.log2(rank + 2.0), 0.0)
            ideal = np.cumsum(1 / np.log2(np.arange(k) + 2.0))[np.minimum(n_pos, k) - 1]
            weight = weight * np.abs(gain[:, :, None] - gain[:, None, :]) / ideal[:, None, None]
    below = s[:, None, :] - s[:, :, None]  # of the negative above the positive
    pull = weight * sigmoid(below)
    return (weight * softplus(below)).sum(), pull.sum(1) - pull.sum(2)

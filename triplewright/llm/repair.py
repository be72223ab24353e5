"""Re-Pair grammars of many sequences at once, and the periodic runs that cross the boundaries of their rules."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np

from .rolling import Powers, mixed, prefixes


@dataclass
class Grammar:
    """Rules made round by round, and the sequence that is left.

    Symbols below ``terminals`` are words. Rule r (symbol terminals + r) gives left[r], right[r]; size[r]
    words, of which left_size[r] from the left; first[r] is the word where it stands first.
    """

    terminals: int
    rounds: list[int]
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    left_size: np.ndarray
    first: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray


def re_pair(ids: np.ndarray) -> Grammar:
    """Replaces pairs that occur twice by new symbols until none does.

    In a round every pair goes whose count is above those of the pairs that overlap it, ties by a
    hash of the pair; the most frequent pair always does. Only pairs that repeat, or touch a new symbol, are
    counted again. Sequences side by side must share no symbol; then no pair crosses their border.
    """
    symbols, starts, sizes = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
    fresh = terminals = int(ids.max()) + 1 if len(ids) else 0
    hot = np.ones(len(ids), bool)  # of a pair by its first place
    rounds, rules = [0], []
    while True:
        hot[-1:] = False
        at = np.flatnonzero(hot)
        if not len(at):
            break
        keys = symbols[at] * fresh + symbols[at + 1]
        names, which = np.unique(keys, return_inverse=True)
        # of aaaa the pairs at every second place count
        chained = np.r_[False, (which[1:] == which[:-1]) & (at[1:] == at[:-1] + 1)]
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        apart = since % 2 == 0
        times = np.bincount(which, minlength=len(names))
        found = np.bincount(which[apart], minlength=len(names))
        live = apart & (found[which] >= 2)
        tie = np.empty(len(names), np.int64)
        tie[np.argsort(mixed(names.astype(np.uint64)))] = np.arange(len(names))
        rank = np.where(live, (found * len(names) + tie)[which], -1)
        near = at[1:] == at[:-1] + 1
        before = np.r_[-1, np.where(near, rank[:-1], -1)]
        after = np.r_[np.where(near, rank[1:], -1), -1]
        taken = live & (rank > before) & (rank > after)
        taken &= (np.bincount(which[taken], minlength=len(names)) >= 2)[which]
        hot[at] = times[which] >= 2
        if not taken.any():
            break
        spots = at[taken]
        _, first, new = np.unique(which[taken], return_index=True, return_inverse=True)
        one = spots[first]
        rules.append((symbols[one], symbols[one + 1], sizes[one] + sizes[one + 1], sizes[one], starts[one]))
        symbols[spots], sizes[spots] = fresh + new, sizes[spots] + sizes[spots + 1]
        fresh += len(first)
        rounds.append(fresh - terminals)
        keep = np.ones(len(symbols), bool)
        keep[spots + 1] = False
        place = np.cumsum(keep)[spots] - 1
        symbols, starts, sizes, hot = symbols[keep], starts[keep], sizes[keep], hot[keep]
        hot[place] = True
        hot[place[place > 0] - 1] = True
    columns = [np.concatenate(c) for c in zip(*rules, strict=True)] if rules else [np.zeros(0, np.int64)] * 5
    return Grammar(terminals, rounds, *columns, symbols, starts)


class Ranges:
    """Hashes of ranges of a sequence, and how far two places agree."""

    def __init__(self, ids: np.ndarray, powers: Powers, seed: int) -> None:
        self.sums = prefixes(mixed(ids.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0xD1342543DE82EF95)), powers)
        self.down = powers.upto(len(ids) + 1)[1]

    def hash(self, i: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[i + size] - self.sums[i]) * self.down[i]

    def agree(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The words in common from i and j on (or before them), at most ``most``."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash(i - mid, mid) == self.hash(j - mid, mid) if back else self.hash(i, mid) == self.hash(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _crossing(ranges: Ranges, bounds: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, times: int) -> np.ndarray:
    """(boundary number, start, stop, period) of the stretches that cross cut[b] within [low[b], high[b]).

    Half of such a stretch lies on one side of the cut, with half a period at least that agrees with
    what stands a period on. So words that start (or end) at the cut, as many as the period asks
    for, stand again a period away; periods go up by doubling, and only what stood twice is looked
    at with twice the words.
    """
    n = int(bounds[-1])
    end = np.repeat(bounds[1:], np.diff(bounds))  # of the sequence of each place
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    alive, found = np.arange(n), []
    # sides have max(least, times * q) / 2 words at least, so that many less q agree
    size, from_q, to_q = max(1, min(-(-max(least, times * q) // 2) - q for q in range(1, 16))), 1, 16
    longest = int((high - low).max(initial=0))
    while times * from_q <= longest:
        alive = alive[alive + size <= end[alive]]
        if not len(alive):
            break
        grams = ranges.hash(alive, size)
        order = np.argsort(grams, kind="stable")
        grams, alive = grams[order], alive[order]
        same = np.r_[False, grams[1:] == grams[:-1]]
        double = same | np.r_[same[1:], False]
        grams, alive = grams[double], alive[double]
        spot = np.full(n + 1, -1, np.int64)
        spot[alive] = np.arange(len(alive))
        for back in (False, True):
            own = cut - size if back else cut
            b = np.flatnonzero((own >= low) & (own >= 0) & (own < high))
            b = b[spot[own[b]] >= 0]
            for step in count(1):
                at = spot[own[b]] + (-step if back else step)
                ok = (at >= 0) & (at < len(alive))
                b, at = b[ok], at[ok]
                there = alive[at]
                q = own[b] - there if back else there - own[b]
                ok = (grams[at] == grams[spot[own[b]]]) & (q < to_q) & (times * q <= high[b] - low[b])
                b, q, there = b[ok], q[ok], there[ok]
                if not len(b):
                    break
                fits = (q >= from_q) & ((there >= low[b]) if back else (there + size <= high[b]))
                found.append((b[fits], q[fits], np.full(fits.sum(), back)))
        size, from_q, to_q = (8, 16, 32) if from_q == 1 else (size * 2, to_q, to_q * 2)
    if not found:
        return np.zeros((0, 4), np.int64)
    b, q, back = (np.concatenate(x) for x in zip(*found, strict=True))
    here = np.where(back, cut[b] - q, cut[b])  # agrees with here + q, on both sides
    left = here - ranges.agree(here, here + q, here - begin[here], back=True)
    right = here + q + ranges.agree(here, here + q, end[here] - here - q)
    start, stop = np.maximum(left, low[b]), np.minimum(right, high[b])
    long = stop - start >= np.maximum(least, times * q)
    rows = np.stack([b, start, stop, q], 1)[long]
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]] if len(rows) else rows  # the smallest period of a stretch


def _placed(g: Grammar, wanted: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rule, start) of every place where a wanted rule stands in the derivation of its sequence."""
    docs = np.unique(np.searchsorted(bounds, g.first[wanted], "right") - 1)
    mine = np.isin(np.searchsorted(bounds, g.starts, "right") - 1, docs)
    rule, at = g.symbols[mine] - g.terminals, g.starts[mine]
    is_wanted = np.zeros(len(g.size) + 1, bool)
    is_wanted[wanted] = True
    rules, places = [], []
    for low in reversed(g.rounds[:-1]):
        now = rule >= low
        r, p = rule[now], at[now]
        hit = is_wanted[r]
        rules.append(r[hit])
        places.append(p[hit])
        below = np.r_[g.left[r], g.right[r]] - g.terminals
        where = np.r_[p, p + g.left_size[r]]
        big = (below >= 0) & (g.size[np.maximum(below, 0)] >= least)
        rule, at = np.r_[rule[~now], below[big]], np.r_[at[~now], where[big]]
    return np.concatenate(rules), np.concatenate(places)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Stretches (start, stop, period) of a period that share a period's words or more are one."""
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    out: list[list[int]] = []
    for start, stop, q in rows.tolist():
        if out and out[-1][2] == q and start + q <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop, q])
    done = np.array(out)
    done = done[np.lexsort(done.T[[2, 1, 0]])]
    done = done[np.r_[True, (done[1:, :2] != done[:-1, :2]).any(1)]]  # the smallest period of equal stretches
    return done[np.lexsort(done.T[[1, 2, 0]])]


def runs_of(ids: np.ndarray, bounds: np.ndarray, powers: Powers, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, stop, period) of every run of the sequences ids[bounds[d]:bounds[d + 1]], by start, then period.

    A run is a longest stretch with a smallest period q whose length is ``least`` and ``times`` * q at
    least; ``times`` is 3 or more. Sequences share no id. Each rule of the grammar gives the runs
    across its boundary once, at its first place; they are translated to all its places, and pieces
    that belong together are merged. Runs are checked word by word; if hashes misled, others are taken.
    """
    none = np.zeros((0, 3), np.int64)
    if len(ids) < least:
        return none
    g = re_pair(ids)
    big = np.flatnonzero(g.size >= least)
    doc = np.searchsorted(bounds, g.starts, "right") - 1
    top = np.flatnonzero((np.diff(bounds)[doc] >= least) & (g.starts > bounds[doc]))
    rule_cut, top_cut = g.first[big] + g.left_size[big], g.starts[top]
    low = np.r_[g.first[big], bounds[doc[top]]]
    high = np.r_[g.first[big] + g.size[big], bounds[doc[top] + 1]]
    cut = np.r_[rule_cut, top_cut]
    for seed in count():
        found = _crossing(Ranges(ids, powers, seed), bounds, cut, low, high, least, times)
        if not len(found):
            return none
        inner = found[:, 0] < len(big)
        parts = [found[~inner][:, 1:]]
        if inner.any():
            own = found[inner]
            rules = big[own[:, 0]]
            rule, place = _placed(g, np.unique(rules), bounds, least)
            order = np.argsort(rules, kind="stable")
            own, rules = own[order], rules[order]
            one, many = np.searchsorted(rules, rule), np.searchsorted(rules, rule, "right")
            which = np.repeat(np.arange(len(rule)), many - one)
            row = np.arange(len(which)) - np.repeat(np.cumsum(many - one) - (many - one), many - one) + one[which]
            shift = place[which] - g.first[rule[which]]
            parts.append(np.stack([own[row, 1] + shift, own[row, 2] + shift, own[row, 3]], 1))
        rows = _merged(np.unique(np.concatenate(parts), axis=0))
        if all((ids[s : e - q] == ids[s + q : e]).all() for s, e, q in rows.tolist()):
            return rows

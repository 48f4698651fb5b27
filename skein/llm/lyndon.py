"""Lyndon arrays by Baier's grouping, and the runs that their roots extend to (used inside workers).

A run of exponent 4 or more holds three whole copies of its Lyndon root in one
of the two orders, and that root is the longest Lyndon word wherever it starts
(Bannai et al., "The runs theorem").  Equal entries of a Lyndon array that are
as far apart as their value therefore point at every such run.
"""

from __future__ import annotations

import numpy as np

GRAM = 5  # see repeated_stretches
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position, symbols compared by ``ranks``.

    Phase one of Baier's suffix sorter.  At any time the sequence is cut into
    factors; factors of equal context form a group, and the groups are linked in
    lexicographic order.  Members of the highest group are final: their context
    is the longest Lyndon word there.  Each joins the nearest factor before it
    that is of a lower group; factors of one group that took on equally many
    move to a new group right above it, more copies higher.  Every position
    leaves once, so behind the first sort the time is linear.
    """
    n = len(ranks)
    result = np.ones(n, np.int64)
    if n < 2:
        return result
    order = np.argsort(ranks, kind="stable")
    cuts = np.flatnonzero(np.diff(ranks[order])) + 1
    members = [part[::-1].tolist() for part in np.split(order, cuts)]  # from the right, as are all lists below
    groups = len(members)
    below, above, length = list(range(-1, groups - 1)), list(range(1, groups + 1)), [1] * groups
    of = np.empty(n, np.int64)
    of[order] = np.repeat(np.arange(groups), np.diff(np.concatenate(([0], cuts, [n]))))
    of = of.tolist()
    left, right, taken = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
    top = groups - 1
    while top >= 0:
        size = length[top]
        grown = []  # factors of lower groups that take on members of this one
        final = [s for s in members[top] if of[s] == top]
        members[top] = []
        if size > 1:
            result[final] = size
        for s in final:
            before, after = left[s], right[s]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                if not taken[before] and of[before] != top:
                    grown.append(before)
                taken[before] += taken[s] + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for u in grown:
            moves.setdefault((of[u], taken[u]), []).append(u)
            taken[u] = 0
        newest: dict[int, int] = {}
        for g, copies in sorted(moves):
            moved = moves[g, copies]
            if len(members[g]) == 1:  # alone there: the group itself grows
                length[g] += copies * size
                continue
            new, under = len(members), newest.get(g, g)
            over = above[under]
            members.append(moved)
            length.append(length[g] + copies * size)
            below.append(under)
            above.append(over)
            above[under] = below[over] = newest[g] = new
            for u in moved:
                of[u] = new
        top = below[top]
    return result


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two arrays, compared in growing chunks."""
    n, at, size = min(len(a), len(b)), 0, 16
    while at < n:
        differ = a[at : min(n, at + size)] != b[at : min(n, at + size)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = at + size, size * 4
    return n


def runs(symbols: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of length max(least, power * period) or more, by start and period.

    ``power`` is 4 or more.  The candidates of a period are extended from left
    to right; those inside a run that is found already are passed over.
    """
    found, n = set(), len(symbols)
    if n < least:
        return []
    for ranks in (symbols, -symbols):
        period = lyndon_array(ranks)
        at = np.flatnonzero(np.arange(n) + 2 * period <= n)
        p = period[at]
        at = at[(period[at + p] == p) & (symbols[at] == symbols[at + p]) & (symbols[at + p - 1] == symbols[at + 2 * p - 1])]
        at = at[np.lexsort((at, period[at]))]
        last, end = 0, 0
        for i, p in zip(at.tolist(), period[at].tolist(), strict=True):
            if p == last and i + p < end:
                continue
            behind = _common(symbols[i:], symbols[i + p :])
            if behind < p:
                continue
            start = i - _common(symbols[:i][::-1], symbols[: i + p][::-1])
            last, end = p, i + p + behind
            if end - start >= max(least, power * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(symbols: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) of one owner each that all runs of exponent 4 and six words or more lie in.

    Every five neighbouring words of such a run stand in it twice at least: of
    period 1 it has two places for them, of period 2 four, of period q > 2 some
    4 q - 4.  So words that no repeated five of their document cover are in no
    run, and what is left falls into stretches.
    """
    n = len(symbols) - GRAM + 1
    if n < 1:
        return []
    whole = owner[:n] == owner[GRAM - 1 :]
    mixed = owner[:n].astype(np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP + symbols[k : n + k].astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _STEP  # equal hashes by chance only make stretches longer
    at = np.flatnonzero(whole)
    at = at[np.argsort(mixed[at], kind="stable")]
    same = mixed[at[1:]] == mixed[at[:-1]]
    twice = np.zeros(n, bool)
    twice[at[1:][same]] = twice[at[:-1][same]] = True
    step = np.zeros(len(symbols) + 1, np.int64)
    step[:n] += twice
    step[GRAM : n + GRAM] -= twice
    covered = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    found = []
    for start, end in edge.reshape(-1, 2).tolist():
        cuts = np.flatnonzero(np.diff(owner[start:end])) + start + 1
        bounds = [start, *cuts.tolist(), end]
        found += zip(bounds[:-1], bounds[1:], strict=True)
    return found

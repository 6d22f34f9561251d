"""The string distances of similarity over whole columns: numpy steps over many pairs at once, with the same values.

Pairs are taken in blocks of like lengths. Longest common subsequences and Jaro-Winkler work on 64-bit masks of the places of
each character; strings that do not fit one go through the kernels of similarity. Partial similarity combs the strands of the
alignment grid of two strings (Tiskin's semi-local longest common subsequence), a diagonal of all pairs of a block at a
time: where strands end gives the common subsequence of the shorter string with every window of the longer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from . import similarity as one

#: Pairs of a block at most, and entries of its table of characters.
_BLOCK, _TABLE = 2048, 1 << 19
#: Pairs of a block of grids, and the longest string that goes through one.
_GRIDS, _LONGEST = 512, 500
_WORD = 64


def _matrix(strings: Sequence[str], width: int) -> np.ndarray:
    """Code points, a row per string, 0 past its end."""
    return np.array(strings, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(strings), -1)


def _blocks(sizes: np.ndarray, other: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of at most most pairs each, in the order of their lengths."""
    order = np.lexsort((other, sizes))
    for start in range(0, len(order), most):
        yield order[start : start + most]


def _coded(a: Sequence[str], la: np.ndarray, b: Sequence[str], lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both as ranks among the characters of the block (from 0), and how many there are."""
    x, y = _matrix(a, int(la.max())), _matrix(b, int(lb.max()))
    met = np.zeros(int(max(x.max(), y.max())) + 1, bool)
    met[x.ravel()] = met[y.ravel()] = True
    ranks = np.cumsum(met, dtype=np.int64) - 1
    return ranks[x], ranks[y], int(ranks[-1]) + 1


def _masked(a: Sequence[str], b: Sequence[str], la: np.ndarray, lb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """places of pairs, both as ranks (a column per pair), and the flat table of the places of each rank in a, a row per pair."""
    for at in _blocks(la, lb, _BLOCK):
        whole = [a[i] for i in at], [b[i] for i in at]
        x, y, n = _coded(whole[0], la[at], whole[1], lb[at])
        step = max(64, _TABLE // n)
        for start in range(0, len(at), step):
            part = slice(start, start + step)
            some = at[part]
            base = np.arange(len(some)) * n
            p, q, table = np.ascontiguousarray((x[part] + base[:, None]).T), np.ascontiguousarray((y[part] + base[:, None]).T), np.zeros(len(some) * n, np.uint64)
            for i in range(int(la[some].max())):
                has = la[some] > i
                table[p[i][has]] |= np.uint64(1 << i)
            yield some, p, q, table


def _lengths(strings: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, strings), np.int64, len(strings))


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The longest common subsequence of each pair."""
    la, lb = _lengths(a), _lengths(b)
    out = np.zeros(len(la), np.int64)
    swapped = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    quick = np.flatnonzero((short > 0) & (short <= _WORD) & (long <= _LONGEST))
    for i in np.flatnonzero((short > _WORD) | ((short > 0) & (long > _LONGEST))):
        out[i] = one.lcs_length(*swapped[i])
    if len(quick):
        ls, ll = short[quick], long[quick]
        for at, _, q, table in _masked([swapped[i][0] for i in quick], [swapped[i][1] for i in quick], ls, ll):
            full = np.where(ls[at] == _WORD, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (ls[at] % _WORD).astype(np.uint64)) - np.uint64(1))
            row, size = full.copy(), ll[at]
            for j in range(int(size.max())):
                match = row & np.where(size > j, table[q[j]], np.uint64(0))
                row = (row + match) | (row - match)
            out[quick[at]] = ls[at] - np.bitwise_count(row & full)
    return out


def indel(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """indel_one of each pair."""
    total = _lengths(a) + _lengths(b)
    return np.where(total > 0, 2 * lcs_lengths(a, b) / np.maximum(total, 1), 1.0)


def token_set(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """token_set_one of each pair.

    The common tokens begin both sides, so they are common to any of them; only each side's own tokens are aligned.
    """
    known: dict[str, tuple[frozenset, str]] = {}
    out = np.zeros(len(a))
    at, own_a, own_b, begun = [], [], [], []
    for i, (s, t) in enumerate(zip(a, b)):
        for x in (s, t):
            if x not in known:
                found = frozenset(x.split())
                known[x] = found, " ".join(sorted(found))
        (x, whole_x), (y, whole_y) = known[s], known[t]
        if not x or not y:
            continue
        both = x & y
        if len(both) == len(x) or len(both) == len(y):
            out[i] = 1.0
            continue
        at.append(i)
        if both:
            own_a.append(" ".join(sorted(x - both)))
            own_b.append(" ".join(sorted(y - both)))
            begun.append(sum(map(len, both)) + len(both) - 1)
        else:
            own_a.append(whole_x)
            own_b.append(whole_y)
            begun.append(0)
    if at:
        n = np.array(begun, np.int64)
        head = np.where(n > 0, n + 1, 0)  # with the space after it
        u, v = head + _lengths(own_a), head + _lengths(own_b)
        best = 2 * (head + lcs_lengths(own_a, own_b)) / (u + v)
        out[at] = np.maximum(best, np.maximum(2 * n / (n + u), 2 * n / (n + v)))
    return out


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """jaro_winkler_one of each pair."""
    la, lb = _lengths(a), _lengths(b)
    out = np.zeros(len(la))
    same = np.fromiter((x == y for x, y in zip(a, b)), bool, len(la))
    out[same] = 1.0
    open_ = ~same & (la > 0) & (lb > 0)
    quick = np.flatnonzero(open_ & (la <= _WORD) & (lb <= _WORD))
    for i in np.flatnonzero(open_ & ((la > _WORD) | (lb > _WORD))):
        out[i] = one.jaro_winkler_one(a[i], b[i])
    if not len(quick):
        return out
    na, nb, none = la[quick], lb[quick], np.uint64(0)
    below = np.array([(1 << i) - 1 for i in range(_WORD + 1)], np.uint64)
    for at, q, p, table in _masked([b[i] for i in quick], [a[i] for i in quick], nb, na):  # table: places in b
        ma, mb = na[at], nb[at]
        reach = np.maximum(0, np.maximum(ma, mb) // 2 - 1)
        used, hits, steps = np.zeros(len(at), np.uint64), [], int(ma.max())
        for i in range(steps):
            window = below[np.minimum(mb, i + reach + 1)] & ~below[np.minimum(mb, np.maximum(0, i - reach))]
            free = np.where(ma > i, table[p[i]] & window & ~used, none)
            low = free & (~free + np.uint64(1))
            used |= low
            hits.append(low != none)
        left, unlike = used.copy(), np.zeros(len(at), np.int64)
        for i in range(steps):
            low = np.where(hits[i], left & (~left + np.uint64(1)), none)
            left ^= low
            unlike += hits[i] & ((table[p[i]] & low) == none)
        m = np.bitwise_count(used).astype(np.int64)
        jaro = (m / ma + m / mb + (m - unlike // 2) / np.maximum(m, 1)) / 3
        prefix, going = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for i in range(min(4, len(p), len(q))):
            going = going & (ma > i) & (mb > i) & (p[i] == q[i])
            prefix += going
        jaro = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
        out[quick[at]] = np.where(m > 0, jaro, 0.0)
    return out


def _comb(x: np.ndarray, y: np.ndarray, kind) -> np.ndarray:
    """Where the strands at the foot of each grid began: from the height of the grid on at its head, else at its side.

    x and y are characters, a column per pair, x from its end to its start. A strand that meets one of an equal pair of
    characters, or that it has crossed before, turns; else they cross. So of two strands the smaller goes on to the right.
    """
    m, n = len(x), len(y)
    h = np.repeat(np.arange(m, dtype=kind)[:, None], x.shape[1], 1)
    v = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], x.shape[1], 1)
    for d in range(m + n - 1):
        first, stop = max(0, d - n + 1), min(m - 1, d)
        s, t = slice(m - 1 - stop, m - first), slice(d - stop, d - first + 1)
        unlike = (x[s] != y[t]).view(np.uint8)
        unlike = np.negative(unlike if kind is np.uint8 else unlike.astype(kind))  # all ones where the characters differ
        right = np.minimum(h[s] | ~unlike, v[t])
        np.maximum(h[s], v[t] & unlike, out=v[t])
        h[s] = right
    return v


def partial_and_indel(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """partial_one and indel_one of each pair, from one grid."""
    la, lb = _lengths(a), _lengths(b)
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    best, whole = np.where(long > 0, 0.0, 1.0), np.where(long > 0, 0.0, 1.0)
    for i in np.flatnonzero((short > 0) & (long > _LONGEST)):
        best[i], whole[i] = one.partial_one(a[i], b[i]), one.indel_one(a[i], b[i])
    quick = np.flatnonzero((short > 0) & (long <= _LONGEST))
    swapped = [(a[i], b[i]) if la[i] <= lb[i] else (b[i], a[i]) for i in quick]
    for at in _blocks(long[quick], short[quick], _GRIDS) if len(quick) else ():
        size, room = short[quick[at]], long[quick[at]]
        m, n, wide = int(size.max()), int(room.max()), len(at)
        x, y, chars = _coded([swapped[i][0] for i in at], size, [swapped[i][1] for i in at], room)
        small = chars < 254
        x, y = x + 2, y + 2
        x[np.arange(m) >= size[:, None]], y[np.arange(n) >= room[:, None]] = 0, 1
        x, y = (np.ascontiguousarray(z.T.astype(np.uint8 if small else np.int32)) for z in (x[:, ::-1], y))
        began = _comb(x, y, np.uint8 if m + n <= 256 else np.uint16).astype(np.int32) - m
        # a strand from place s of the head to place j of the foot takes a character off every window with both: those that
        # begin from j - size + 1 to s; windows are numbered from 1 - size on
        foot, pair = np.arange(n, dtype=np.int32)[:, None], np.arange(wide, dtype=np.int32)
        inside = (began >= 0) & (foot < room)
        whole[quick[at]] = 2 * (room - inside.sum(0)) / (size + room)
        counted = inside & (began + size > foot)
        turn = np.zeros((m + n, wide), np.int16)
        turn[:n] = counted
        turn.reshape(-1)[(((began + size) * wide + pair)[counted])] -= 1
        lost = np.cumsum(turn, axis=0, dtype=np.int16)
        start = np.arange(m + n, dtype=np.int32)[:, None] - (size - 1).astype(np.int32)
        held = np.minimum(room.astype(np.int32), start + size.astype(np.int32)) - np.maximum(start, 0)
        value = 2 * (held - lost) / (size.astype(np.int32) + np.maximum(held, 0))
        best[quick[at]] = np.where(start < room, value, 0.0).max(0)
    return best, whole


def scores(kinds: Sequence[str], a: Sequence[str], b: Sequence[str]) -> dict[str, np.ndarray]:
    """The KERNELS of similarity by name over two lists of strings."""
    out = {}
    if "partial" in kinds:
        out["partial"], out["indel"] = partial_and_indel(a, b)
    for kind, kernel in (("indel", indel), ("token_set", token_set), ("jaro_winkler", jaro_winkler)):
        if kind in kinds and kind not in out:
            out[kind] = kernel(a, b)
    return {k: out[k] for k in kinds}

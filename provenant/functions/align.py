"""Longest common subsequence of two sequences of labels, with the places that it joins.

Rows of the classical table are kept as the bits of one integer: a bit is clear
where the length grows, so that a whole row costs a few operations on wide
integers. The two halves of the first sequence meet where their rows add up to
most (Hirschberg), so no table is kept and the result is exact for sequences of
any length, in memory linear in it.
"""

from __future__ import annotations

import numpy as np

#: First sequences up to this length are traced from their kept rows.
TRACED = 64


def _row(a: list[int], b: list[int]) -> tuple[int, list[int]]:
    """The last row of a against b as bits, and all rows where a is short."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, kept = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if len(a) <= TRACED:
            kept.append(v)
    return v, kept


def _lengths(v: int, n: int) -> np.ndarray:
    """Lengths against the first 0 .. n labels."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-n // 8) or 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _trace(a: list[int], b: list[int], shift_a: int, shift_b: int, out: list[tuple[int, int]]) -> None:
    rows = [np.zeros(len(b) + 1, dtype=np.int64), *(_lengths(v, len(b)) for v in _row(a, b)[1])]
    i, j, found = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((shift_a + i, shift_b + j))
    out += reversed(found)


def _align(a: list[int], b: list[int], shift_a: int, shift_b: int, out: list[tuple[int, int]]) -> None:
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        out.append((shift_a + lead, shift_b + lead))
        lead += 1
    a, b, shift_a, shift_b = a[lead:], b[lead:], shift_a + lead, shift_b + lead
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    last = [(shift_a + len(a) - tail + k, shift_b + len(b) - tail + k) for k in range(tail)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if a and b:
        if len(a) <= TRACED:
            _trace(a, b, shift_a, shift_b, out)
        else:
            half = len(a) // 2
            ahead = _lengths(_row(a[:half], b)[0], len(b))
            behind = _lengths(_row(a[half:][::-1], b[::-1])[0], len(b))[::-1]
            cut = int((ahead + behind).argmax())
            _align(a[:half], b[:cut], shift_a, shift_b, out)
            _align(a[half:], b[cut:], shift_a + half, shift_b + cut, out)
    out += last


def aligned(first: list, second: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, both rising. Labels that only one sequence has are left out before."""
    number = {x: k for k, x in enumerate(dict.fromkeys(first))}
    shared = {number[x] for x in second if x in number}
    a = [(i, number[x]) for i, x in enumerate(first) if number[x] in shared]
    b = [(j, number[x]) for j, x in enumerate(second) if x in number]
    out: list[tuple[int, int]] = []
    _align([x for _, x in a], [x for _, x in b], 0, 0, out)
    return [(a[i][0], b[j][0]) for i, j in out]


def places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of the first sequence in aligned, of labels that are numbers already; equal beginnings are met without a loop."""
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    lead = int(unlike[0]) if len(unlike) else short
    if lead == short:
        return np.arange(lead)
    mine, theirs = lead + np.flatnonzero(np.isin(a[lead:], b)), lead + np.flatnonzero(np.isin(b[lead:], a))
    out: list[tuple[int, int]] = []
    _align(a[mine].tolist(), b[theirs].tolist(), 0, 0, out)
    return np.concatenate([np.arange(lead), mine[[i for i, _ in out]]]) if out else np.arange(lead)

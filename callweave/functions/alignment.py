"""Alignment of an allele to its reference and the simple variants that a complex one is made of."""

from __future__ import annotations

#: Costs of the alignment: of a mismatch, of opening a gap and of each of its bases.
MISMATCH, OPEN, EXTEND = 12, 20, 1
#: Longer alleles are not taken apart.
MOST = 5000


def aligned(ref: str, alt: str) -> tuple[str, str]:
    """Both with gaps as -, of least cost with affine gaps; among equals gaps stand as far left as they can.

    A column is two bases (state 0), a gap in alt (1) or a gap in ref (2). Costs of the rest are kept for one row at a time, the state after
    each cell and state for all cells, in a byte.
    """
    n, m = len(ref), len(alt)
    big = 1 << 40
    follow = [bytearray(3 * (m + 1)) for _ in range(n + 1)]

    def after(cell: list[int], state: int) -> tuple[int, int]:
        """(cost, next state) of the best rest behind a column of that state; gaps first, so that they come early."""
        return min([(cell[1] + OPEN * (state != 1), 0, 1), (cell[2] + OPEN * (state != 2), 1, 2), (cell[0], 2, 0)])[::2]

    below: list[list[int]] = []
    for i in range(n, -1, -1):
        row: list[list[int]] = [[big] * 3 for _ in range(m + 1)]
        for j in range(m, -1, -1):
            here = row[j]
            if i == n and j == m:
                here[0] = 0
                continue
            if i < n and j < m:
                cost, follow[i][3 * j] = after(below[j + 1], 0)
                here[0] = cost + (0 if ref[i] == alt[j] else MISMATCH)
            if i < n:
                cost, follow[i][3 * j + 1] = after(below[j], 1)
                here[1] = cost + EXTEND
            if j < m:
                cost, follow[i][3 * j + 2] = after(row[j + 1], 2)
                here[2] = cost + EXTEND
        below = row
    i = j = 0
    state, one, two = after(below[0], 0)[1], [], []
    while i < n or j < m:
        one.append(ref[i] if state != 2 else "-")
        two.append(alt[j] if state != 1 else "-")
        behind = follow[i][3 * j + state]
        i, j, state = i + (state != 2), j + (state != 1), behind
    return "".join(one), "".join(two)


def columns(ref: str, alts: list[str]) -> list[str]:
    """ref and alts with gaps, all of one length: each alternate is aligned to ref between their shared ends, insertions at one place share columns."""
    pairs = []
    for a in alts:
        most = min(len(ref), len(a))
        tail = next((k for k in range(most) if ref[-1 - k] != a[-1 - k]), most)
        head = next((k for k in range(most - tail) if ref[k] != a[k]), most - tail)
        inner = aligned(ref[head : len(ref) - tail], a[head : len(a) - tail])
        pairs.append(tuple(ref[:head] + x + ref[len(ref) - tail :] for x in inner))
    inserted = [0] * (len(ref) + 1)
    for r, _ in pairs:
        at = run = 0
        for c in r + "$":
            if c == "-":
                run += 1
            else:
                inserted[at] = max(inserted[at], run)
                at, run = at + 1, 0
    out = ["".join("-" * inserted[k] + c for k, c in enumerate(ref)) + "-" * inserted[len(ref)]]
    for r, a in pairs:
        parts, at, run = [], 0, []
        for c, x in [*zip(r, a, strict=True), ("$", "")]:
            if c == "-":
                run.append(x)
            else:
                parts.append("".join(run) + "-" * (inserted[at] - len(run)) + x)
                at, run = at + 1, []
        out.append("".join(parts))
    return out


def pieces(ref: str, alts: list[str]) -> list[tuple[int, list[str]]]:
    """(offset, alleles: reference first) of the simple variants of a site, from the left; the site itself if it isn't taken apart.

    Columns in which alleles differ make runs; a run with gaps takes the base before it as an anchor, or the one after it at the start of the site. Runs that
    would share an anchor are one.
    """
    if not alts or max(map(len, [ref, *alts])) >= MOST or any(not a.isalpha() for a in [ref, *alts]):
        return [(0, [ref, *alts])]
    rows = [ref, *alts] if len({len(a) for a in [ref, *alts]}) == 1 else columns(ref, alts)
    differ = [len({r[k] for r in rows}) > 1 for k in range(len(rows[0]))]
    spans: list[tuple[int, int]] = []
    k, end = 0, len(differ)
    while k < end:
        if not differ[k]:
            k += 1
            continue
        stop = k
        while stop < end and differ[stop]:
            stop += 1
        lo, hi = k, stop
        if any("-" in r[lo:hi] for r in rows):
            lo, hi = (lo - 1, hi) if lo else (lo, min(hi + 1, end))
        if spans and lo < spans[-1][1]:
            lo = spans.pop()[0]
        spans.append((lo, hi))
        k = stop
    return [(len(rows[0][:lo].replace("-", "")), [r[lo:hi].replace("-", "") for r in rows]) for lo, hi in spans] or [(0, [ref, *alts])]

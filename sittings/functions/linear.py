"""Small systems of linear equations solved in SQL expressions."""

from __future__ import annotations

# A regressor that the ones before it explain but for this share of its variance is left out.
DISTINCT = "1e-9"


def swept(matrix: str, diagonal: str, n: int, tolerance: str = DISTINCT) -> str:
    """SQL: the symmetric system `matrix` (n rows of n + 1 or more, right-hand sides behind), each column swept in turn.

    Row i then holds its coefficient in column n. `diagonal` are the pivots before any
    sweep; a column whose pivot is down to `tolerance` of its own is dropped: its row is zeros.
    """
    row = "zip_with(row, m[k], (a, b) -> a - row[k] / m[k][k] * b)"
    pivot = "transform(row, a -> a / m[k][k])"
    kept = f"transform(m, (row, i) -> IF(i = k, {pivot}, {row}))"
    dropped = "transform(m, (row, i) -> IF(i = k, transform(row, a -> 0D), row))"
    step = f"IF(m[k][k] > {tolerance} * get({diagonal}, k) AND get({diagonal}, k) > 0, {kept}, {dropped})"
    return f"aggregate(sequence(0, {n} - 1), {matrix}, (m, k) -> {step})"


def solution(matrix: str, diagonal: str, n: int, tolerance: str = DISTINCT) -> str:
    """SQL: the coefficients that solve the system, 0 where a column was dropped."""
    return f"transform({swept(matrix, diagonal, n, tolerance)}, row -> row[{n}])"


def matrix(entries: dict[tuple[int, int], str], rhs: list[str]) -> str:
    """SQL: the rows of a symmetric system from its upper triangle and right-hand sides."""
    n = len(rhs)
    rows = []
    for i in range(n):
        cells = [f"double({entries[min(i, j), max(i, j)]})" for j in range(n)]
        rows.append(f"array({', '.join([*cells, f'double({rhs[i]})'])})")
    return f"array({', '.join(rows)})"

"""Small tables as text: a distance matrix, a merge tree, edges. All raise above a number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to print")
    return rows


def matrix_text(pairs: DataFrame, digits: int = 3) -> str:
    """Distances ``i, j, dist`` as a square, in id order."""
    rows = _few(pairs, MOST_ROWS * MOST_ROWS // 2)
    ids = sorted({r.i for r in rows} | {r.j for r in rows})
    if len(ids) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} points to print")
    known = {(r.i, r.j): r.dist for r in rows} | {(r.j, r.i): r.dist for r in rows}
    return "\n".join(" ".join(f"{known.get((a, b), 0.0):.{digits}f}" for b in ids) for a in ids)


def edges_text(edges: DataFrame) -> str:
    """``i j weight`` a line, lightest first."""
    return "\n".join(f"{r.i} {r.j} {r.weight}" for r in sorted(_few(edges, MOST_ROWS), key=lambda r: (r.weight, r.i, r.j)))


def tree_text(merges: DataFrame) -> str:
    """A merge tree (``node, left, right, level, size``) from its root on, indented by depth."""
    rows = {r.node: r for r in _few(merges, MOST_ROWS)}
    out, todo = [], [(max(rows), 0)] if rows else []
    while todo:
        v, depth = todo.pop()
        r = rows.get(v)
        out.append("  " * depth + (f"{v} level {r.level} size {r.size}" if r else f"{v}"))
        if r:
            todo += [(r.right, depth + 1), (r.left, depth + 1)]
    return "\n".join(out)


def components_text(members: DataFrame) -> str:
    """``component: nodes`` a line."""
    groups: dict[int, list[int]] = {}
    for r in _few(members, MOST_ROWS):
        groups.setdefault(r.component, []).append(r.node)
    return "\n".join(f"{c}: {' '.join(map(str, sorted(set(n))))}" for c, n in sorted(groups.items()))

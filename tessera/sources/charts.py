"""Charts of small results as SVG text: bars of counts, and flows with bands as wide as their values."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from tessera.operators.scope import flow_bands

_HEAD = '<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="12">'


def bars(rows: DataFrame, label: str, value: str, most: int = 50, width: int = 640) -> str:
    """Horizontal bars, the highest first, of equals the first by name; more than ``most`` are refused."""
    got = rows.orderBy(rows[value].desc(), label).limit(most + 1).select(label, value).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} bars; limit the rows first")
    top = max([float(r[1]) for r in got], default=0) or 1
    parts = [_HEAD.format(w=width, h=20 * len(got) + 10)]
    for i, r in enumerate(got):
        size = max(0.0, float(r[1])) / top * (width - 260)
        parts.append(f'<text x="5" y="{20 * i + 18}">{escape(str(r[0]))}</text><rect x="190" y="{20 * i + 6}" width="{size:.1f}" height="15" fill="#4a7ab5"/><text x="{195 + size:.1f}" y="{20 * i + 18}">{r[1]}</text>')
    return "".join(parts) + "</svg>"


def flows(edges: DataFrame, most: int = 200, width: int = 960, height: int = 480) -> str:
    """A flow chart of (source, target, value).  Nodes stand in columns by their longest way from a
    start; a band's place at a node is the running sum of the bands above it."""
    got = flow_bands(edges).orderBy("source", "target").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} edges")
    column: dict[str, int] = {}
    for _ in got:  # as many rounds as the longest way can have edges
        for e in got:
            column[e.target] = max(column.get(e.target, 0), column.setdefault(e.source, 0) + 1)
    size = {n: max(sum(e.value for e in got if e.source == n), sum(e.value for e in got if e.target == n)) for n in column}
    per = {c: [n for n in sorted(column) if column[n] == c] for c in set(column.values())}
    tallest = max((sum(size[n] for n in names) for names in per.values()), default=1)
    unit = (height - 30 * max((len(names) for names in per.values()), default=1)) / tallest
    step = (width - 160) / max(1, max(per, default=0))
    place = {}
    for c, names in per.items():
        y = 10.0
        for n in names:
            place[n] = (10 + c * step, y)
            y += size[n] * unit + 30
    parts = [_HEAD.format(w=width, h=height)]
    for e in got:
        (x0, y0), (x1, y1) = place[e.source], place[e.target]
        a, b, t, m = y0 + e.source_offset * unit, y1 + e.target_offset * unit, e.value * unit, (x0 + 12 + x1) / 2
        parts.append(f'<path d="M{x0 + 12:.1f},{a:.1f} C{m:.1f},{a:.1f} {m:.1f},{b:.1f} {x1:.1f},{b:.1f} L{x1:.1f},{b + t:.1f} C{m:.1f},{b + t:.1f} {m:.1f},{a + t:.1f} {x0 + 12:.1f},{a + t:.1f} Z" fill="#9db8d9" fill-opacity="0.6"/>')
    for n, (x, y) in place.items():
        parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="12" height="{max(1.0, size[n] * unit):.1f}" fill="#2f4f7f"/><text x="{x + 16:.1f}" y="{y + 12:.1f}">{escape(n)} ({size[n]})</text>')
    return "".join(parts) + "</svg>"

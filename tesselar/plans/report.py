"""A report of a sample as one HTML text: a bounded number of points and rows reaches the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points drawn and rows shown at most; which points is decided by a hash, so a report repeats.
MAX_POINTS, MAX_ROWS = 2000, 50
#: Colours of the first labels (fixed values); further labels begin again.
COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb")


def scatter(points: DataFrame, label: str, size: int = 480, most: int = MAX_POINTS) -> str:
    """An SVG of ``points(i, x, y, label)``."""
    rows = points.select("i", "x", "y", F.col(label).cast("string").alias("l")).orderBy(F.xxhash64("i"), "i").limit(most).collect()
    if not rows:
        return f'<svg width="{size}" height="{size}"></svg>'
    xs, ys = [r.x for r in rows], [r.y for r in rows]
    wide = max(max(xs) - min(xs), max(ys) - min(ys), 1e-12)
    names = sorted({r.l or "" for r in rows})
    dots = "".join(f'<circle cx="{8 + (size - 16) * (r.x - min(xs)) / wide:.1f}" cy="{size - 8 - (size - 16) * (r.y - min(ys)) / wide:.1f}" r="2.5" fill="{COLOURS[names.index(r.l or "") % len(COLOURS)]}"/>' for r in rows)
    return f'<svg width="{size}" height="{size}">{dots}</svg>'


def table(df: DataFrame, most: int = MAX_ROWS) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
    return f"<table><tr>{head}</tr>{body}</table>"


def report(title: str, parts: dict[str, str], log: list[dict]) -> str:
    """Sections in order, then the steps that were taken."""
    steps = "".join(f"<li>{escape(x['step'])}/{escape(x['method'])} {escape(x['version'])} {escape(str(x['params']))}</li>" for x in log)
    sections = "".join(f"<h2>{escape(name)}</h2>{html}" for name, html in parts.items())
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>{sections}<h2>Steps</h2><ol>{steps}</ol>"

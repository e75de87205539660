"""Small results as text: Markdown tables, metric values, histograms. Driver side, for reports of a few rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

COLOURS = {"green": "\033[92m", "red": "\033[91m"}
OFF = "\033[0m"


def metric_value(kind: str, value: Any, fixed: int | None = None) -> str:
    """An int, float, portion (correct, total) or confusion (tp, fp, fn) as shown in tables."""
    if kind == "portion":
        return f"{value['correct']:.{2 if fixed is None and value['correct'] != int(value['correct']) else 0}f} / {value['total']}" if fixed is None else f"{value['correct'] / value['total'] if value['total'] else 0:.{fixed}f}"
    if kind == "confusion_mat":
        return f"P: {value['tp']} / {value['tp'] + value['fp']}, R: {value['tp']} / {value['tp'] + value['fn']}"
    return f"{value:.{fixed}f}" if fixed is not None else str(value)


def markdown_table(rows: Sequence[Sequence[str]], align: Sequence[str] | None = None, colours: Mapping[tuple[int, int], str] | None = None) -> str:
    """The first row is the header. ``colours`` of cells (row, column) show in terminals."""
    widths = {len(r) for r in rows}
    if not rows or len(widths) != 1:
        raise ValueError("a table needs rows of one length")
    align = list(align or ["left"] * len(rows[0]))
    if len(align) != len(rows[0]) or set(align) - {"left", "right", "center"}:
        raise ValueError("one of left, right, center for each column")
    wide = [max(3, *(len(r[c]) for r in rows)) for c in range(len(rows[0]))]
    place = {"left": str.ljust, "right": str.rjust, "center": str.center}

    def cell(r: int, c: int) -> str:
        text = place[align[c]](rows[r][c], wide[c])
        return f"{COLOURS[colours[r, c]]}{text}{OFF}" if colours and (r, c) in colours else text

    marks = [(":" if a == "center" else "-") + "-" * (w - 2) + ("-" if a == "left" else ":") for a, w in zip(align, wide, strict=True)]
    lines = [[cell(r, c) for c in range(len(wide))] for r in range(len(rows))]
    return "\n".join("| " + " | ".join(x) + " |" for x in [lines[0], marks, *lines[1:]])


def histogram(counts: Sequence[tuple[float, int]], width: int = 70) -> str:
    """Bars of (lower edge, count) rows."""
    most = max((n for _, n in counts), default=0)
    return "\n".join(f"{edge:10.4f} {'#' * round(width * n / most) if most else ''} {n}" for edge, n in counts)

"""Plots of small results as self-contained HTML with SVG."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

WIDTH, HEIGHT, MARGIN = 700, 450, 60
COLORS = ("#3366cc", "#dc3912", "#ff9900", "#109618", "#990099", "#0099c6", "#dd4477", "#66aa00")


@dataclass(frozen=True)
class PlotSetting:
    title: str | None = None
    x_label: str | None = None
    y_label: str | None = None
    show_legend: bool = True
    x_range: tuple[float, float] | None = None
    y_range: tuple[float, float] | None = None
    captions: list[str] = field(default_factory=list)


def human_readable_camel(name: str) -> str:
    """``areaUnderROC`` as ``Area Under ROC``."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).split()
    return " ".join(p[:1].upper() + p[1:] for p in parts)


def non_alphanumeric_to_underscore(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", name)


def plot_scatter(series: list[list[tuple[float, float]]], setting: PlotSetting, path: str) -> None:
    _write([([p[0] for p in s], [p[1] for p in s]) for s in series], setting, path, markers=True)


def plot_lines(series: list[list[float]], x: list[float] | None, setting: PlotSetting, path: str) -> None:
    """Lines over common x values, 1, 2, 3 and so on where there are none."""
    _write([(list(x) if x else list(range(1, len(s) + 1)), list(s)) for s in series], setting, path, markers=False)


def plot_xy_lines(series: list[list[tuple[float, float]]], setting: PlotSetting, path: str) -> None:
    _write([([p[0] for p in s], [p[1] for p in s]) for s in series], setting, path, markers=False)


def _range(values: list[float], given: tuple[float, float] | None) -> tuple[float, float]:
    lo, hi = given or (min(values, default=0.0), max(values, default=1.0))
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _write(series: list[tuple[list[float], list[float]]], setting: PlotSetting, path: str, markers: bool) -> None:
    x0, x1 = _range([v for xs, _ in series for v in xs], setting.x_range)
    y0, y1 = _range([v for _, ys in series for v in ys], setting.y_range)
    px = lambda v: MARGIN + (v - x0) / (x1 - x0) * (WIDTH - 2 * MARGIN)
    py = lambda v: HEIGHT - MARGIN - (v - y0) / (y1 - y0) * (HEIGHT - 2 * MARGIN)
    out = [f'<rect x="{MARGIN}" y="{MARGIN}" width="{WIDTH - 2 * MARGIN}" height="{HEIGHT - 2 * MARGIN}" fill="none" stroke="#999"/>']
    for k in range(5):
        x, y = x0 + (x1 - x0) * k / 4, y0 + (y1 - y0) * k / 4
        out.append(f'<text x="{px(x):.1f}" y="{HEIGHT - MARGIN + 18}" text-anchor="middle">{x:.4g}</text><text x="{MARGIN - 6}" y="{py(y) + 4:.1f}" text-anchor="end">{y:.4g}</text>')
    captions = [*setting.captions, *[""] * len(series)]
    for k, (xs, ys) in enumerate(series):
        color = COLORS[k % len(COLORS)]
        points = [(px(a), py(b)) for a, b in zip(xs, ys, strict=False)]
        if markers:
            out += [f'<circle cx="{a:.2f}" cy="{b:.2f}" r="3" fill="{color}"/>' for a, b in points]
        else:
            out.append(f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{a:.2f},{b:.2f}" for a, b in points)}"/>')
        if setting.show_legend and captions[k]:
            out.append(f'<text x="{WIDTH - MARGIN + 4}" y="{MARGIN + 16 * k + 10}" fill="{color}">{html.escape(captions[k])}</text>')
    for text, x, y in ((setting.title, WIDTH / 2, 30), (setting.x_label, WIDTH / 2, HEIGHT - 12), (setting.y_label, 14, MARGIN - 14)):
        if text:
            out.append(f'<text x="{x}" y="{y}" text-anchor="{"start" if x < 20 else "middle"}">{html.escape(text)}</text>')
    body = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">{"".join(out)}</svg>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(setting.title or '')}</title></head><body>{body}</body></html>")

"""Plots of tables of any length.  ``points``: name, x, y; what is drawn is aggregated to pixels first, so that a
picture costs one pass with partial sums and its rows are bounded by its size, not by the table's.

A line is drawn in full by four values of each pixel column: where it enters and leaves, its lowest and highest
place.  Points without an x or y, and values that are no number, are left out; points of one x follow each other
by y; where all x (or y) are equal they stand in column (or row) 0; a null name is a line of its own.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.sinks import bounded

#: Line colors, taken in turn.
COLORS = ["#900", "#00b", "#aa0", "#0aa", "#444"]


def scaled(points: DataFrame, width: int, height: int) -> DataFrame:
    """(name, x, y, column, row): the points on a picture that just holds all of them, row 0 at the bottom."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    have = points.select("name", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(number("x") & number("y"))
    frame = have.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row

    def place(c: str, size: int) -> Column:
        low, high = F.col(f"{c}0"), F.col(f"{c}1")
        return F.when(high > low, F.floor((F.col(c) - low) / (high - low) * (size - 1))).otherwise(0).cast("int")

    return have.join(F.broadcast(frame)).select("name", "x", "y", place("x", width).alias("column"), place("y", height).alias("row"))


def lines(points: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """(name, column, enters, low, high, leaves) of each line and pixel column that it has points in."""
    order = F.struct("x", "y", "row")
    return scaled(points, width, height).groupBy("name", "column").agg(
        F.min(order)["row"].alias("enters"), F.min("row").alias("low"), F.max("row").alias("high"), F.max(order)["row"].alias("leaves")
    )


def bars(points: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """(column, top): a bar for each pixel column with points, up to the highest of them."""
    return scaled(points, width, height).groupBy("column").agg(F.max("row").alias("top"))


def lines_svg(points: DataFrame, width: int = 800, height: int = 600, most: int = 100_000) -> str:
    """SVG of all lines, colors by name in turn, names as titles."""
    paths: dict = {}
    for r in bounded(lines(points, width, height).orderBy("name", "column"), most):
        paths.setdefault(r.name, []).extend(f"{r.column},{height - 1 - y}" for y in (r.enters, r.low, r.high, r.leaves))
    drawn = []
    for k, (name, path) in enumerate(paths.items()):
        title = html.escape("" if name is None else str(name))
        drawn.append(f'<polyline points="{' '.join(path)}" fill="none" stroke="{COLORS[k % len(COLORS)]}"><title>{title}</title></polyline>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(drawn)}</svg>'


def bars_svg(points: DataFrame, width: int = 800, height: int = 600, target: float | None = None) -> str:
    """SVG of the bars, with a line across at the y value ``target``."""
    drawn = "".join(f'<line x1="{r.column}" x2="{r.column}" y1="{height - 1}" y2="{height - 1 - r.top}" stroke="red"/>' for r in bounded(bars(points, width, height).orderBy("column"), width))
    if target is not None:
        y0, y1 = points.agg(F.min("y"), F.max("y")).first()
        if y0 is not None and y1 > y0:
            y = round(height - 1 - (target - y0) / (y1 - y0) * (height - 1), 2)
            drawn = f'<line x1="0" x2="{width - 1}" y1="{y}" y2="{y}" stroke="#090"/>' + drawn
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{drawn}</svg>'

"""Outputs of a run: daily series and pairs as CSV, metrics as JSON, an equity chart, a research log and a summary line.
All go through the file systems that Spark knows, so one output folder is one place, on a cluster too."""

from __future__ import annotations

import datetime
import importlib.util
import io
import json
import math
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import metrics


def plain(v: Any) -> Any:
    """A JSON value: missing and not-a-number become null, dates text."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, replaced if it is there; its folders are made."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content, empty if it is not there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return b""
    stream = system.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def append(spark: SparkSession, path: str, text: str) -> None:
    """Text at the end of a log, which is written anew: not every file system can add to a file."""
    write_bytes(spark, path, read_bytes(spark, path) + text.encode())


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file with a header under path. Only for results bounded by the calendar or the list of pairs."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_pnl(portfolio: DataFrame, out_dir: str) -> None:
    write_csv(portfolio.select("date", "segment_id", "pnl", "cost", "pnl_gross"), f"{out_dir}/pnl.csv", ["date", "segment_id"])


def write_pairs(segment_pairs: DataFrame, out_dir: str) -> None:
    if not segment_pairs.isEmpty():
        write_csv(segment_pairs, f"{out_dir}/pairs_by_segment.csv", ["segment_id", "a", "b"])


def equity_points(portfolio: DataFrame) -> list[tuple]:
    """date, net, gross: a row a day and segment."""
    return [tuple(r) for r in metrics.equity(portfolio).orderBy("date", "segment_id").select("date", "equity", "equity_gross").collect()]


def equity_svg(points: list[tuple], title: str, width: int = 1000, height: int = 400) -> str:
    values = [v for _, net, gross in points for v in (net, gross)] + [0.0]
    lo, hi = min(values), max(values)
    x = lambda i: 50 + i * (width - 70) / max(1, len(points) - 1)
    y = lambda v: height - 40 - (v - lo) / ((hi - lo) or 1.0) * (height - 80)
    line = lambda k, colour: f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{x(i):.1f},{y(p[k]):.1f}" for i, p in enumerate(points))}"/>'
    ends = (str(points[0][0]), str(points[-1][0])) if points else ("", "")
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12"><text x="50" y="20">{title}</text>'
        f'<line x1="50" x2="{width - 20}" y1="{y(0.0):.1f}" y2="{y(0.0):.1f}" stroke="#999"/>{line(2, "#e08214")}{line(1, "#2166ac")}'
        f'<text x="50" y="{height - 10}">{ends[0]}</text><text x="{width - 100}" y="{height - 10}">{ends[1]}</text>'
        f'<text x="{width - 150}" y="20" fill="#2166ac">net</text><text x="{width - 110}" y="20" fill="#e08214">gross</text></svg>'
    )


def write_chart(portfolio: DataFrame, out_dir: str, title: str) -> str:
    """equity.png where matplotlib is there, else the same lines as equity.svg."""
    points = equity_points(portfolio)
    if importlib.util.find_spec("matplotlib") is None:
        write_bytes(portfolio.sparkSession, f"{out_dir}/equity.svg", equity_svg(points, title).encode())
        return "equity.svg"
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots(figsize=(10, 4))
    for k, name in ((1, "net"), (2, "gross")):
        axes.plot([p[0] for p in points], [p[k] for p in points], label=name)
    axes.axhline(0, color="gray", linewidth=0.5)
    axes.set_title(title)
    axes.legend()
    image = io.BytesIO()
    figure.savefig(image, dpi=150, format="png")
    pyplot.close(figure)
    write_bytes(portfolio.sparkSession, f"{out_dir}/equity.png", image.getvalue())
    return "equity.png"


def write_metrics(spark: SparkSession, values: dict[str, Any], out_dir: str) -> None:
    write_bytes(spark, f"{out_dir}/metrics.json", json.dumps({k: plain(v) for k, v in values.items()}, indent=2).encode())


def append_line(spark: SparkSession, values: dict[str, Any], path: str) -> None:
    append(spark, path, json.dumps({k: plain(v) for k, v in values.items()}) + "\n")


def append_log(spark: SparkSession, values: dict[str, Any], path: str, run: str) -> bool:
    """A paragraph of a research log. A log that cannot be written does not spoil the run: returns False."""
    lines = [f"Date: {datetime.date.today()}", f"Run ID: {run}", *(f"{k}: {plain(v)}" for k, v in values.items()), "", "---", "", ""]
    try:
        append(spark, path, "\n".join(lines))
    except Py4JJavaError:
        return False
    return True


def mean_scale(regime: DataFrame) -> float | None:
    return regime.agg(F.avg("scale")).first()[0]

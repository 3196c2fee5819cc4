"""Artifacts of a run: tables as Parquet, bounded results as JSON, and pages as HTML with inline SVG."""

from __future__ import annotations

import datetime as dt
import decimal
import html
import json
import math

from pyspark.sql import DataFrame, Row, SparkSession


def safe(v):
    """What JSON can hold: decimals as numbers, bytes as text, times as ISO, NaN as null."""
    if isinstance(v, Row):
        return {k: safe(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [safe(x) for x in v]
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return v.decode("utf-8", errors="replace")
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat()
    return None if isinstance(v, float) and not math.isfinite(v) else v


def rows(df: DataFrame) -> list[dict]:
    """Of a bounded result."""
    return [safe(r) for r in df.collect()]


def _file(path: str):
    """The file system and path, of any store that Spark writes."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _file(path)
    return fs.exists(p)


def write_text(path: str, text: str) -> str:
    """In place of what was there; folders are made."""
    fs, p = _file(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def read_text(path: str) -> str:
    fs, p = _file(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(path: str, content: dict) -> str:
    stamped = {**content, "generated_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    return write_text(path, json.dumps(safe(stamped), ensure_ascii=False, indent=2))


def read_json(path: str) -> dict:
    return json.loads(read_text(path))


#: What each artifact of a run holds, by field.
ARTIFACTS: dict[str, dict[str, type | tuple]] = {
    "profile": {"file_count": int, "files": dict},
    "cleaning_report": {"passed": bool, "missing_columns": list, "duplicate_rate": float, "rows_before": int, "rows_after": int, "message": str},
    "patterns": {"row_count": int, "statistics": dict, "raw_patterns": list, "insights": list, "source": str},
    "anomalies": {"row_count": int, "anomaly_count": int, "anomalies": list, "entity_index": dict, "source": str},
    "forecast": {"status": str, "horizon_days": int, "history": list, "forecast": list, "narrative": str, "actions": list},
    "graph": {"node_count": int, "edge_count": int, "nodes": list, "edges": list, "hubs": list, "source": str},
    "report_meta": {"executive_summary": str, "top_actions": list, "source": str},
}


def read_artifact(folder: str, name: str) -> dict:
    """An artifact of the run in ``folder`` without its time stamp; raises ValueError where a field is missing or of another type."""
    found = {k: v for k, v in read_json(f"{folder}/{name}.json").items() if k != "generated_at"}
    for field, kind in ARTIFACTS[name].items():
        if not isinstance(found.get(field), (int, float) if kind is float else kind):
            raise ValueError(f"{name}.json: {field} is {type(found.get(field)).__name__}, not {kind.__name__}")
    return found


def write_parquet(df: DataFrame, path: str, single_file: bool = False) -> str:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(path)
    return path


def copy_files(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Raw inputs into the run's folder, through Hadoop's file systems."""
    conf = spark._jsc.hadoopConfiguration()
    Path, util = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.fs.FileUtil
    out = []
    for p in paths:
        source, target = Path(p), Path(f"{folder}/{p.rstrip('/').rsplit('/', 1)[-1]}")
        util.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, True, conf)
        out.append(target.toString())
    return out


def line_svg(history: list[dict], forecast: list[dict], width: int = 720, height: int = 260) -> str:
    """History and forecast as lines, the band as an area."""
    points = history + forecast
    if not points:
        return ""
    every = [x for p in points for x in (p["value"], p.get("lower"), p.get("upper")) if x is not None]
    low, high = min(every), max(every)
    x = lambda i: 20 + i * (width - 40) / max(1, len(points) - 1)
    y = lambda v: height - 20 - (v - low) * (height - 40) / ((high - low) or 1)
    line = lambda ps, at: " ".join(f"{x(at + i):.1f},{y(p['value']):.1f}" for i, p in enumerate(ps))
    n = len(history)
    band = [(x(n + i), y(p["upper"])) for i, p in enumerate(forecast) if p.get("upper") is not None] + [(x(n + i), y(p["lower"])) for i, p in reversed(list(enumerate(forecast))) if p.get("lower") is not None]
    area = f'<polygon points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in band)}" fill="#9cc" opacity=".5"/>' if band else ""
    return (
        f'<svg viewBox="0 0 {width} {height}" role="img">{area}<polyline fill="none" stroke="#246" points="{line(history, 0)}"/>'
        f'<polyline fill="none" stroke="#c52" stroke-dasharray="5 3" points="{line(forecast, n)}"/></svg>'
    )


def bars_svg(points: list[dict], width: int = 720) -> str:
    top = max((abs(p["value"]) for p in points if p["value"] is not None), default=0) or 1
    bars = "".join(
        f'<text x="4" y="{18 + 24 * i}" font-size="12">{html.escape(str(p["date"]))}</text><rect x="160" y="{6 + 24 * i}" height="16" width="{abs(p["value"] or 0) / top * (width - 240):.1f}" fill="#246"/>'
        for i, p in enumerate(points)
    )
    return f'<svg viewBox="0 0 {width} {12 + 24 * len(points)}" role="img">{bars}</svg>'


# How nodes and edges of the graph page look.
COLORS = {"highlight": "#ff4b4b", "anomaly": "#ffa600", "hub": "#2ca02c", "default": "#4c78a8"}
NODE_SIZE, CENTRAL_SIZE, HIGHLIGHT_SIZE, LABEL, EDGE_WIDTH = 12, 30, 8, 24, (1, 4)
# End of fixed values.


def graph_html(nodes: list[dict], edges: list[dict], highlight: set[str] = frozenset(), hubs: list[str] = ()) -> str:
    """The graph on a circle, or a page that says it is empty."""
    if not nodes:
        return "<!doctype html><meta charset=utf-8><p>No graph entities found.</p>"
    at = {n["id"]: (500 + 420 * math.cos(2 * math.pi * i / len(nodes)), 500 + 420 * math.sin(2 * math.pi * i / len(nodes))) for i, n in enumerate(nodes)}
    first = set(list(hubs)[:3])
    lines = "".join(
        f'<line x1="{at[e["source"]][0]:.0f}" y1="{at[e["source"]][1]:.0f}" x2="{at[e["target"]][0]:.0f}" y2="{at[e["target"]][1]:.0f}" stroke="#999" stroke-width="{min(max(e["weight"], EDGE_WIDTH[0]), EDGE_WIDTH[1]):g}"><title>{html.escape(e["relation"])}</title></line>'
        for e in edges
        if e["source"] in at and e["target"] in at
    )
    dots = []
    for n in nodes:
        kind = "highlight" if n["id"] in highlight else "anomaly" if n["is_anomaly"] else "hub" if n["id"] in first else "default"
        size = NODE_SIZE + CENTRAL_SIZE * (n["centrality"] or 0) + HIGHLIGHT_SIZE * (kind == "highlight")
        x, y = at[n["id"]]
        dots.append(f'<g><circle cx="{x:.0f}" cy="{y:.0f}" r="{size / 2:.1f}" fill="{COLORS[kind]}"><title>{html.escape(n["id"])}</title></circle><text x="{x:.0f}" y="{y - size / 2 - 3:.0f}" font-size="11" text-anchor="middle">{html.escape(n["label"][:LABEL])}</text></g>')
    return f'<!doctype html><meta charset="utf-8"><title>Entity graph</title><svg viewBox="0 0 1000 1000" role="img">{lines}{"".join(dots)}</svg>'

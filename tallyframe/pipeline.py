"""The whole run: ingest, clean, patterns, anomalies, forecast, graph, report.

Operators stay DataFrame to DataFrame; this module alone ties them to files. The cleaned table is
written once and read by all later phases. Phases collect bounded results only.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.enrich import Enricher
from tallyframe.functions.names import visible
from tallyframe.operators import anomalies, cleaning, forecast, kgraph, patterns, profile, report
from tallyframe.plans.cleaning_plan import CleaningPlan, heuristic_plan
from tallyframe.sources import readers, sinks

SAMPLE_ROWS = 20


@dataclass
class State:
    run_id: str
    folder: str
    paths: list[str]
    results: dict = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)
    error: str | None = None

    @property
    def headline(self) -> str | None:
        top = next(iter(self.results.get("patterns", {}).get("insights", [])), None)
        return f"{top['title']} — {top['summary']}" if top else None


def build_profile(tables: dict[str, DataFrame], paths: list[str]) -> dict:
    """Of every file: rows, columns with their statistics, a sample, candidate join keys."""
    files = {}
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        df = tables[name]
        stats = profile.column_profile(df).persist()
        found = stats.orderBy("position").collect()  # a row a column
        keys = [r.column for r in profile.join_key_candidates(stats).orderBy("rank", "column").collect()]
        stats.unpersist()
        files[name] = {
            "path": path,
            "row_count": found[0].row_count if found else 0,
            "column_count": len(found),
            "columns": {r.column: {"dtype": r.dtype, "null_count": r.null_count, "null_pct": r.null_pct, "n_unique": r.n_unique} for r in found},
            "sample_rows": sinks.rows(profile.head(df, SAMPLE_ROWS).select(*[F.col(f"`{c}`") for c in visible(df)])) if found else [],
            "candidate_join_keys": keys,
        }
    return {"file_count": len(files), "files": files}


def ingest(spark: SparkSession, state: State, tables: dict[str, DataFrame]) -> None:
    sinks.copy_files(spark, state.paths, f"{state.folder}/raw")
    state.results["profile"] = build_profile(tables, state.paths)
    sinks.write_json(f"{state.folder}/profile.json", state.results["profile"])


def clean(spark: SparkSession, state: State, tables: dict[str, DataFrame], plan: CleaningPlan | None, enricher: Enricher) -> None:
    """Writes the table before a failed validation raises."""
    source = "given"
    if plan is None:
        plan, source = enricher.ask("plan", state.results["profile"], heuristic_plan(state.results["profile"]))
    cleaned, joined = cleaning.execute_plan({n: t for n, t in tables.items() if visible(t)}, plan)
    joined.persist()
    sinks.write_parquet(cleaning.finish(cleaned), f"{state.folder}/cleaned.parquet")
    rows_before = sum(f["row_count"] for f in state.results["profile"]["files"].values())
    v = cleaning.validate(spark.read.parquet(f"{state.folder}/cleaned.parquet"), plan, rows_before, joined)
    joined.unpersist()
    state.results["cleaning"] = {**vars(v), "plan_source": source, "plan": {k: (list(x) if isinstance(x, tuple) else x) for k, x in vars(plan).items() if k not in ("dates", "fills")}}
    sinks.write_json(f"{state.folder}/cleaning_report.json", state.results["cleaning"])
    if not v.passed:
        raise cleaning.CleaningValidationError(v.message)


def find_patterns(spark, state: State, df: DataFrame, enricher: Enricher) -> None:
    found = patterns.discover(df).persist()
    cards = [{k: v for k, v in c.items() if k != "seq"} for c in sorted(sinks.rows(patterns.insight_cards(found)), key=lambda c: (-c["score"], c["seq"]))]
    insights, source = enricher.ask("rank_insights", cards, cards)
    state.results["patterns"] = {
        "row_count": df.count(),
        "statistics": {"numeric_summary": sinks.rows(patterns.numeric_summary(df)), "pattern_counts": {r["type"]: r["count"] for r in sinks.rows(patterns.pattern_counts(found))}},
        "raw_patterns": sinks.rows(found),
        "insights": insights,
        "source": source,
    }
    found.unpersist()
    sinks.write_json(f"{state.folder}/patterns.json", state.results["patterns"])


def find_anomalies(spark, state: State, df: DataFrame, enricher: Enricher, top: int = anomalies.TOP) -> DataFrame:
    rows = anomalies.indexed(df)
    entity = anomalies.entity_column(df)
    found = anomalies.numeric_anomalies(rows, top, entity).unionByName(anomalies.text_anomalies(rows, entity))
    if enricher.flag_texts and (columns := anomalies.text_columns(df)):
        flagged, _ = enricher.ask("flag_texts", sinks.rows(rows.orderBy("row_index").select("row_index", *[F.col(f"`{c}`") for c in columns]).limit(25)), [])
        if flagged:
            more = spark.createDataFrame([("text_model", int(x["row_index"]), str(x["entity"]), entity, str(x["metric"]), float(x["score"]), None, {}, (9 << 40) + i) for i, x in enumerate(flagged)], anomalies.CANDIDATE)
            found = found.unionByName(more.withColumn("severity", anomalies.severity(F.col("score"))))
    records = anomalies.explain(anomalies.merge_candidates(found, top)).persist()
    listed = sorted(sinks.rows(records), key=lambda r: (-r["score"], r["seq"]))
    explained, source = enricher.ask("explain_anomalies", listed, listed)
    state.results["anomalies"] = {
        "row_count": rows.count(),
        "anomaly_count": len(explained),
        "anomalies": explained,
        "entity_index": {r["graph_entity_id"]: r["positions"] for r in sinks.rows(anomalies.entity_index(records))},
        "source": source,
    }
    sinks.write_json(f"{state.folder}/anomalies.json", state.results["anomalies"])
    return records


def find_forecast(spark, state: State, df: DataFrame, enricher: Enricher) -> None:
    f = forecast.run(df)
    points = lambda d: sorted(sinks.rows(d), key=lambda r: r["date"]) if d is not None and f.status == "success" else sinks.rows(d) if d is not None else []
    result = {**{k: v for k, v in vars(f).items() if k not in ("history", "forecast")}, "history": points(f.history), "forecast": points(f.forecast)}
    (result["narrative"], result["actions"]), result["narrative_source"] = enricher.ask("narrate", result, (f.narrative, f.actions))
    state.results["forecast"] = result
    sinks.write_json(f"{state.folder}/forecast.json", result)


def build_graph(spark, state: State, df: DataFrame, records: DataFrame, enricher: Enricher) -> None:
    more, source = enricher.ask("extract_graph", sinks.rows(df.limit(25)) if enricher.extract_graph else [], None)
    extra = (spark.createDataFrame(more[0], kgraph.NODE), spark.createDataFrame(more[1], kgraph.EDGE)) if more else None
    nodes, edges = kgraph.build(df, records, more=extra)
    listed, joined = sorted(sinks.rows(nodes), key=lambda n: n["first_seen"]), sinks.rows(edges)
    hubs = [r.id for r in kgraph.hubs(nodes).collect()]
    start = next((a["graph_entity_id"] for a in state.results.get("anomalies", {}).get("anomalies", [])), None)
    near = sorted(r.id for r in kgraph.neighbourhood(edges, start).collect()) if listed else []
    state.results["graph"] = {"node_count": len(listed), "edge_count": len(joined), "nodes": listed, "edges": joined, "hubs": hubs, "highlight": near, "source": "hybrid" if more else source}
    sinks.write_json(f"{state.folder}/graph.json", state.results["graph"])
    sinks.write_text(f"{state.folder}/graph.html", sinks.graph_html(listed, joined, set(near), hubs))


def write_report(state: State, enricher: Enricher) -> None:
    f = state.results.get("forecast") or {}
    figure = sinks.bars_svg(f["forecast"]) if f.get("status") == "snapshot" else sinks.line_svg(f.get("history", []), f.get("forecast", []))
    if figure:
        sinks.write_text(f"{state.folder}/forecast.svg", figure)
    content, source = enricher.ask("summarise", state.results, report.summary(state.results))
    sinks.write_text(f"{state.folder}/report.html", report.page(state.results, content, figure))
    state.results["report"] = {**content, "source": source, "path": f"{state.folder}/report.html"}
    sinks.write_json(f"{state.folder}/report_meta.json", state.results["report"])


def run(spark: SparkSession, inputs: list[str], folder: str, run_id: str = "run", plan: CleaningPlan | None = None, enricher: Enricher | None = None) -> State:
    """All phases; the first that fails ends the run with RuntimeError, its state being in ``args``."""
    enricher = enricher or Enricher()
    state = State(run_id, os.path.join(folder, run_id), readers.expand(spark, inputs))
    tables = readers.load_files(spark, state.paths)
    shared: dict = {}

    def cleaned() -> DataFrame:
        if "df" not in shared:
            shared["df"] = spark.read.parquet(f"{state.folder}/cleaned.parquet").persist()
        return shared["df"]

    phases: list[tuple[str, Callable[[], None]]] = [
        ("ingest", lambda: ingest(spark, state, tables)),
        ("clean", lambda: clean(spark, state, tables, plan, enricher)),
        ("patterns", lambda: find_patterns(spark, state, cleaned(), enricher)),
        ("anomalies", lambda: shared.update(records=find_anomalies(spark, state, cleaned(), enricher))),
        ("forecast", lambda: find_forecast(spark, state, cleaned(), enricher)),
        ("graph", lambda: build_graph(spark, state, cleaned(), shared["records"], enricher)),
        ("report", lambda: write_report(state, enricher)),
    ]
    for name, phase in phases:
        began = time.time()
        try:
            phase()
        except Exception as e:
            state.error = f"{name}: {e}"
        state.log.append({"phase": name, "duration_sec": round(time.time() - began, 2), "status": "failed" if state.error else "ok"})
        if state.error:
            raise RuntimeError(state.error, state)
    return state


def replay(folder: str) -> State:
    """A finished run's state from its artifacts; nothing is computed."""
    state = State(os.path.basename(folder.rstrip("/")), folder.rstrip("/"), [])
    for name in sinks.ARTIFACTS:
        state.results[{"cleaning_report": "cleaning", "report_meta": "report"}.get(name, name)] = sinks.read_artifact(state.folder, name)
        state.log.append({"phase": name, "duration_sec": 0.0, "status": "replayed"})
    return state


def stale(folder: str) -> dict[str, bool]:
    """Which of the forecast and the graph of a run should be made anew."""
    if not sinks.exists(f"{folder}/cleaned.parquet"):
        return {"forecast": False, "graph": False}

    def old(name: str, bad) -> bool:
        path = f"{folder}/{name}.json"
        return not sinks.exists(path) or bad(sinks.read_json(path))

    from tallyframe.functions.names import NOT_TIME

    return {
        "forecast": old("forecast", lambda d: bool(NOT_TIME.search(d.get("time_column") or "")) or d.get("status") == "skipped" and not d.get("forecast")),
        "graph": old("graph", lambda d: not d.get("node_count")),
    }


def refresh(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Makes stale forecasts and graphs anew; returns what was."""
    need = stale(folder)
    if any(need.values()):
        state = State(os.path.basename(folder), folder, [])
        df = spark.read.parquet(f"{folder}/cleaned.parquet")
        if need["forecast"]:
            find_forecast(spark, state, df, Enricher())
        if need["graph"]:
            build_graph(spark, state, df, find_anomalies(spark, state, df, Enricher()), Enricher())
    return need

"""The reference-shaped operators on small frames and files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyframe import pipeline
from tallyframe.enrich import Enricher
from tallyframe.functions.draws import drawn
from tallyframe.operators import anomalies, cleaning, forecast, iforest, kgraph, patterns, profile
from tallyframe.plans.cleaning_plan import CleaningPlan, DateParser, Fill, heuristic_plan
from tallyframe.sources import readers, sinks
from tallyframe.streaming import trends


@pytest.fixture()
def messy(tmp_path):
    p = tmp_path / "messy.csv"
    p.write_text('order id,amount,order_date\nA-1,"$1,015.00",15/01/2024\nA-2,,2024-01-16\nA-3,$20.50,17-01-2024\nA-1,"$1,015.00",15/01/2024\n')
    return str(p)


@pytest.fixture()
def outlier(tmp_path):
    p = tmp_path / "sales.csv"
    lines = ["order_id,region,sku,amount,order_date"]
    for i in range(1, 9):
        lines.append(f"ORD-{i},{'East' if i % 2 else 'West'},{'S1' if i < 5 else 'S2'},{20 + i},2024-0{1 + i // 5}-{10 + i}")
    lines.append("ORD-9,West,S2,900,2024-02-19")
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_sniffing():
    assert readers.sniff_encoding(b"\xef\xbb\xbfa") == "utf-8-sig"
    assert readers.sniff_encoding("é".encode()) == "utf-8"
    assert readers.sniff_encoding("é".encode("latin-1")) == "latin-1"
    assert readers.sniff_encoding("aé".encode()[:2], cut_short=True) == "utf-8"
    assert readers.sniff_delimiter("a;b;c\n1;2;3\n4;5;6\n") == ";"
    assert readers.sniff_delimiter("") == ","


def test_csv_keeps_dates_as_text(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("sku;n;price;ok;day\na;1;1.5;true;2024-01-01\nb;2;2;false;2024-01-02\n")
    df = readers.load_file(spark, str(p))
    assert dict(df.drop("_row_id").dtypes) == {"sku": "string", "n": "bigint", "price": "double", "ok": "boolean", "day": "string"}


@pytest.mark.parametrize(
    ("name", "text", "rows"),
    [
        ("a.json", '[{"z": 1, "a": "x"}, {"z": 2, "a": "y"}]', 2),
        ("b.jsonl", '{"z": 1, "a": "x"}\n{"z": 2, "a": "y"}\n', 2),
        ("c.json", '{"z": 1, "a": "x"}\n{"z": 2, "a": "y"}\n', 2),
        ("d.json", '{\n "z": 1,\n "a": "x"\n}', 1),
        ("e.json", '{"events": [{"z": 1, "a": "x"}, {"z": 2, "a": "y"}], "n": 2}', 2),
    ],
)
def test_json_shapes(spark, tmp_path, name, text, rows):
    (tmp_path / name).write_text(text)
    df = readers.load_file(spark, str(tmp_path / name)).drop("_row_id")
    assert df.columns == ["z", "a"] and df.count() == rows


def test_empty_and_wrong_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "n.json").write_text("[1, 2]")
    (tmp_path / "x.txt").write_text("a")
    assert readers.load_file(spark, str(tmp_path / "e.csv")).columns == []
    assert readers.load_file(spark, str(tmp_path / "e.json")).columns == []
    with pytest.raises(ValueError):
        readers.load_file(spark, str(tmp_path / "n.json"))
    with pytest.raises(ValueError):
        readers.load_file(spark, str(tmp_path / "x.txt"))
    with pytest.raises(FileNotFoundError):
        readers.expand(spark, [str(tmp_path / "*.nothing")])


def test_csv_is_split_unless_values_hold_line_ends(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f'{i},"x, {i}"\n' for i in range(60_000)))
    (tmp_path / "lines.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = readers.load_file(spark, str(tmp_path / "plain.csv"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 60_000 and df.orderBy("_row_id").first().b == "x, 0"
        assert [r.b for r in readers.load_file(spark, str(tmp_path / "lines.csv")).orderBy("a").collect()] == ["x\ny", "z"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_forest_scores_equal_a_plain_walk():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    forest = iforest.grow(x, trees=20, rows=64)
    points = rng.normal(size=(40, 3)) * 2

    def depth(p, root):
        node = root
        while forest.child[node] != node:
            node = forest.child[node] + (p[forest.feature[node]] >= forest.cut[node])
        return forest.depth[node]

    c = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    want = [2 ** (-np.mean([depth(p, r) for r in forest.roots]) / c) for p in points]
    assert np.allclose(forest.score(points), want)


def test_plan_cleans_messy_orders(spark, messy):
    plan = CleaningPlan(
        renames={"order id": "order_id"}, currency=("amount",), dates=(DateParser("order_date"),), dtypes={"amount": "float", "order_date": "date"},
        fills=(Fill("amount", "median"),), dedup_keys=("order_id",), required=("order_id", "amount"),
    )
    cleaned, joined = cleaning.execute_plan({"messy.csv": readers.load_file(spark, messy)}, plan)
    rows = cleaning.finish(cleaned).collect()
    assert [r.order_id for r in rows] == ["A-2", "A-3", "A-1"]  # the last of each key, in file order
    assert all(r.amount is not None and r.amount >= 15 for r in rows)
    assert rows[2].order_date == dt.date(2024, 1, 15) and rows[1].order_date == dt.date(2024, 1, 17)
    v = cleaning.validate(cleaned, plan, before=joined)
    assert v.passed and v.duplicate_rate == 0 and v.duplicate_rate_before == 0.25


def test_validation_fails_on_duplicates_and_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    v = cleaning.validate(df, CleaningPlan(dedup_keys=("k",), required=("k", "w"), max_duplicate_rate=0.01))
    assert not v.passed and v.missing_columns == ["w"] and v.duplicate_rate == 0.3333 and "are allowed" in v.message


def test_forward_fill_spans_partitions(spark):
    values = [None, 1, None, None, 4, None] + [None] * 30 + [7, None]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(5)
    got = [r.v for r in cleaning.forward_fill(df, "v", "i").orderBy("i").collect()]
    want, last = [], None
    for v in values:
        last = v if v is not None else last
        want.append(last)
    assert got == want


def test_fills_in_order(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, None), (9.0, "b")], "v double, s string")
    out = cleaning.fill_nulls(df, (Fill("s", "drop"), Fill("v", "mean"), Fill("s", "mode")))
    assert sorted(r.v for r in out.collect()) == [1.0, 5.0, 9.0]
    with pytest.raises(ValueError):
        Fill("v", "guess")


def test_dates_that_mostly_fail_are_left_alone(spark):
    df = spark.createDataFrame([("a",), ("b",), ("2024-01-01",)], "update_count string")
    plan = CleaningPlan(dates=(DateParser("update_count"),), dtypes={"update_count": "date"})
    assert cleaning.clean_table(df, plan).dtypes == [("update_count", "date")]
    assert cleaning.clean_table(df, CleaningPlan(dates=plan.dates, dtypes=plan.dtypes, min_parse_rate=0.5)).dtypes == [("update_count", "string")]


def test_join_suffixes_and_union_types(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    b = spark.createDataFrame([(1, "z")], "k int, name string")
    out = cleaning.combine({"a.csv": a, "b.csv": b}, CleaningPlan(join_keys=("k",), primary="a.csv"))
    assert out.columns == ["k", "name", "_source_file", "name_b.csv", "_source_file_b.csv"] and out.count() == 2
    c = spark.createDataFrame([("q", 2.5)], "k string, extra double")
    both = cleaning.combine({"a.csv": a, "c.csv": c}, CleaningPlan())
    assert both.count() == 3 and dict(both.dtypes)["k"] == "string"


def test_profile_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "order_id int, note string")
    p = {r.column: r for r in profile.column_profile(df).collect()}
    assert p["note"].n_unique == 2 and p["note"].null_count == 1 and p["note"].null_pct == 33.33
    assert [r.column for r in profile.join_key_candidates(profile.column_profile(df)).orderBy("rank", "column").collect()] == ["order_id"]
    assert profile.column_profile(df.limit(0)).collect()[0].row_count == 0


def test_heuristic_plan():
    meta = {"columns": ["Order ID", "Total Price", "Ship Date"], "candidate_join_keys": ["Order ID"], "sample_rows": [{"Total Price": "$3"}]}
    plan = heuristic_plan({"files": {"o.csv": meta}})
    assert plan.renames["Order ID"] == "order_id" and plan.currency == ("total_price",) and plan.dedup_keys == ("order_id",)
    assert plan.dtypes == {"total_price": "float", "ship_date": "date"} and plan.primary == "o.csv"


def test_constant_and_null_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5, None), (2.0, 4.1, 5, 1.0), (3.0, 6.0, 5, 2.0)], "a double, b double, c int, d double")
    got = {(r.column_a, r.column_b): r.correlation for r in patterns.correlation_matrix(df).collect()}
    assert got["a", "b"] > 0.99 and all(v is None for k, v in got.items() if k != ("a", "b"))


def test_segment_tie_goes_to_the_larger_mean(spark):
    df = spark.createDataFrame([("East", 53.25), ("West", 20.8725)], "region string, amount double")
    r = patterns.segment_lifts(df).first()
    assert r.segment_value == "East" and r.lift_pct == 43.68 and r.global_mean == 37.0613


def test_discover_and_cards(spark):
    df = spark.createDataFrame([("East" if i % 2 else "West", "a" if i % 3 else "b", float(i), f"2024-01-{i + 1:02d}") for i in range(28)], "region string, kind string, amount double, order_date string")
    found = patterns.discover(df)
    assert {r.type for r in found.collect()} >= {"time_trend", "categorical_combo"}
    cards = patterns.insight_cards(found).collect()
    assert cards and all(c.impact in ("high", "medium", "low") for c in cards)
    none = patterns.insight_cards(patterns.discover(df.limit(0).select("amount")))
    assert [c.title for c in none.collect()] == ["Nothing stands out"]


def test_isolation_forest_ranks_the_outlier_first(spark, outlier):
    found = anomalies.discover(readers.load_file(spark, outlier)).collect()
    assert found[0].entity == "ORD-9" and found[0].metric == "amount" and found[0].score >= 0.5
    assert found[0].graph_entity_id == "order:ORD-9" and found[0].severity == "critical"


def test_forest_is_the_same_for_any_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("row_index"), (F.col("id") % 17).cast("double").alias("v"), (F.col("id") % 5).cast("double").alias("w"))
    one, two = (anomalies.numeric_anomalies(d, entity="row_index").select("row_index", "score").collect() for d in (df.repartition(1), df.repartition(7)))
    assert one == two
    assert float(iforest.search_depth(2)) == 1.0 and float(iforest.search_depth(1)) == 0.0


def test_text_outliers_and_labels(spark):
    rows = [(i, "late" if i < 8 else "x" * 200, None if i == 8 else f"S{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "ticket long, reason string, supplier_id string")
    found = anomalies.text_anomalies(df.select("reason", "supplier_id")).filter("metric = 'reason'").collect()
    assert [r.entity for r in found] == ["Row 9"] and found[0].score > 0.5
    assert anomalies.text_outliers(anomalies.indexed(df.filter("ticket < 8")), "reason", None).count() == 0


def test_forecast_kinds(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + 2 * i) for i in range(12)], "order_date date, amount double")
    f = forecast.run(days)
    points = f.forecast.orderBy("date").collect()
    assert f.status == "success" and len(points) == 30 and points[0].value == 34.0 and points[0].date == dt.date(2024, 1, 13) and len(f.actions) == 2
    assert forecast.run(days.limit(3)).status == "skipped"
    assert forecast.run(days.select("amount")).status == "skipped"
    hr = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("B", 50.0), ("B", 70.0)], "department string, monthlyincome double")
    s = forecast.run(hr)
    assert s.status == "snapshot" and s.forecast.first().date == "B" and s.forecast.first().value == 60.0

    def broken(daily, horizon):
        raise ValueError("no")

    assert forecast.train(forecast.daily_series(days, "order_date", "amount"), 5, {"broken": broken, "linear": forecast.linear_forecast})[1] == "linear"
    assert forecast.run(days, models={"broken": broken}).status == "failed"

    def breaks_when_run(daily, horizon):
        return daily.select(F.raise_error(F.lit("late")).alias("date"))

    assert forecast.train(forecast.daily_series(days, "order_date", "amount"), 5, {"late": breaks_when_run, "linear": forecast.linear_forecast})[1] == "linear"
    assert forecast.run(days).model == "linear"
    weeks = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i + (5 if i % 7 == 2 else 0)) for i in range(28)], "order_date date, amount double")
    f = forecast.run(weeks)
    points = f.forecast.orderBy("date").collect()
    assert f.model == "weekly" and len(points) == 30 and points[2].value - (points[1].value + points[3].value) / 2 > 4 and points[0].lower <= points[0].value <= points[0].upper


def test_graph(spark):
    df = spark.createDataFrame([("East", "a"), ("East", "b"), ("West", "a"), (" ", "a")], "region string, sku string")
    nodes, edges = kgraph.extract(df, kgraph.entity_columns(df))
    assert nodes.count() == 4 and edges.count() == 3
    assert {(r.source, r.target): r.weight for r in edges.collect()}["region:East", "sku:a"] == 1.0
    flagged = kgraph.flag(nodes, spark.createDataFrame([("sku:a",)], "graph_entity_id string"))
    kept, inner = kgraph.prune(kgraph.centrality(flagged, edges), edges, 2)
    assert {r.id for r in kept.collect()} == {"sku:a", "region:East"} and inner.count() == 1
    hops = {r.id: r.hop for r in kgraph.neighbourhood(edges, "sku:b", 2).collect()}
    assert hops == {"sku:b": 0, "region:East": 1, "sku:a": 2}
    assert [r.id for r in kgraph.neighbourhood(edges, "nobody").collect()] == ["nobody"] and kgraph.neighbourhood(edges, None).count() == 0
    both = kgraph.merge_nodes(nodes, nodes.limit(1).withColumn("label", F.lit("")))
    assert both.count() == 4 and both.filter("label = ''").count() == 0
    alone = spark.createDataFrame([("a:1", "1", "a", 0, False, 0.0, {})], kgraph.NODE)
    assert kgraph.centrality(alone, edges.limit(0)).first().centrality == 1.0


def test_json_safe_and_pages():
    assert sinks.safe({"a": float("nan"), "b": b"x", "c": dt.date(2024, 1, 1), "d": (1, 2)}) == {"a": None, "b": "x", "c": "2024-01-01", "d": [1, 2]}
    assert "No graph" in sinks.graph_html([], [])
    assert "&lt;b&gt;" in sinks.graph_html([{"id": "a:<b>", "label": "<b>", "is_anomaly": True, "centrality": 1.0}], [])


def test_pipeline_end_to_end(spark, outlier, tmp_path):
    state = pipeline.run(spark, [outlier], str(tmp_path / "out"), "r1")
    assert state.error is None and [x["phase"] for x in state.log] == ["ingest", "clean", "patterns", "anomalies", "forecast", "graph", "report"]
    for name in ("profile", "cleaning_report", "patterns", "anomalies", "forecast", "graph", "report_meta"):
        assert "generated_at" in json.loads((tmp_path / "out" / "r1" / f"{name}.json").read_text())
    assert state.results["anomalies"]["anomalies"][0]["entity"] == "ORD-9" and state.headline
    assert (tmp_path / "out" / "r1" / "report.html").read_text().startswith("<!doctype html>")
    assert pipeline.stale(state.folder) == {"forecast": False, "graph": False}


def test_artifacts_replay_and_refresh(spark, outlier, tmp_path):
    state = pipeline.run(spark, [outlier], str(tmp_path / "out"), "r1")
    again = pipeline.replay(state.folder)
    assert again.headline == state.headline and again.results["graph"]["node_count"] == state.results["graph"]["node_count"]
    assert patterns.top_insights(again.results["patterns"], 1) == again.results["patterns"]["insights"][:1]
    assert (tmp_path / "out" / "r1" / "forecast.svg").read_text().startswith("<svg")
    sinks.write_json(f"{state.folder}/graph.json", {"node_count": 0})
    with pytest.raises(ValueError, match="edge_count"):
        sinks.read_artifact(state.folder, "graph")
    (tmp_path / "out" / "r1" / "forecast.json").unlink()
    assert pipeline.refresh(spark, state.folder) == {"forecast": True, "graph": True}
    assert pipeline.stale(state.folder) == {"forecast": False, "graph": False}
    assert sinks.read_artifact(state.folder, "graph")["node_count"] == state.results["graph"]["node_count"]
    assert pipeline.stale(str(tmp_path / "nowhere")) == {"forecast": False, "graph": False}


def test_hooks_take_over_and_failing_ones_do_not(spark, outlier, tmp_path):
    seen = []

    def noted(name, answer):
        return lambda context: seen.append(name) or answer

    node = {"id": "note:x", "label": "x", "node_type": "note", "first_seen": 0, "is_anomaly": False, "centrality": 0.0, "metadata": {}}
    hooks = Enricher(
        plan=lambda profile: heuristic_plan(profile), rank_insights=lambda cards: cards[:1], explain_anomalies=lambda found: [{**x, "hypothesis": "said so"} for x in found],
        narrate=noted("narrate", ("told", [("do", "2024-01-01")])), extract_graph=noted("extract", ([node], [])), summarise=noted("summarise", {"executive_summary": "all", "top_actions": []}),
    )
    state = pipeline.run(spark, [outlier], str(tmp_path), "hooked", enricher=hooks)
    r = state.results
    assert r["cleaning"]["plan_source"] == "model" and len(r["patterns"]["insights"]) == 1 and r["anomalies"]["anomalies"][0]["hypothesis"] == "said so"
    assert r["forecast"]["narrative"] == "told" and r["graph"]["source"] == "hybrid" and r["report"]["executive_summary"] == "all" and seen == ["narrate", "extract", "summarise"]
    broken = Enricher(rank_insights=lambda cards: 1 / 0, summarise=lambda run: None)
    assert broken.ask("rank_insights", [1], "own") == ("own", "heuristic") and broken.ask("summarise", {}, "own") == ("own", "heuristic")
    texts = spark.createDataFrame([(i, "fine" if i else "odd one") for i in range(8)], "ticket_id long, reason string")
    state = pipeline.State("t", str(tmp_path / "t"), [])
    flags = Enricher(flag_texts=lambda rows: [{"row_index": r["row_index"], "entity": "0", "metric": "reason", "score": 0.9} for r in rows if r["reason"] == "odd one"])
    records = pipeline.find_anomalies(spark, state, texts, flags).filter("source = 'text_model'").collect()
    assert [(r.row_index, r.severity) for r in records] == [(0, "critical")]


def test_pipeline_stops_at_the_first_failure(spark, messy, tmp_path):
    with pytest.raises(RuntimeError, match="clean"):
        pipeline.run(spark, [messy], str(tmp_path), "bad", plan=CleaningPlan(required=("nothing",)))
    assert (tmp_path / "bad" / "cleaned.parquet").exists()


def test_streaming_weeks_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = trends.weekly(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.week, r.value) for r in trends.weekly(df, "ts", "value").collect()}
    assert {(r.week, r.value) for r in spark.sql("select * from weeks").collect()} == want
    assert {(r.week, r.value) for r in patterns.weekly(df, "ts", "value").collect()} == want


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0, 1.0, 3.0, 3.0, 9.0], [None, 2.0, 2.0, 7.0, 8.0], list(map(float, range(101))), [None, None], []])
def test_distributed_median_and_mode(spark, values):
    from statistics import median, mode

    from tallyframe.operators import stats

    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    there = sorted(v for v in values if v is not None)
    assert stats.medians(df, ["v"], ["m"], one_task_rows=-1).first().m == stats.medians(df, ["v"], ["m"]).first().m == (median(there) if there else None)
    assert stats.mode(df, "v", "m").first().m == (mode(there) if there else None)


def test_value_counts_leave_out_columns_of_many(spark):
    from tallyframe.operators import stats

    df = spark.range(500).selectExpr("cast(id as string) many", "cast(id % 3 as string) few", "if(id % 2 = 0, null, 'x') holes", "cast(id % 26 as string) edge")
    assert stats.value_counts(df, df.columns, 25) == {"few": 3, "holes": 2}
    assert stats.value_counts(df, df.columns, 26)["edge"] == 26


def test_draws_of_any_number_of_rows(spark):
    """Three thousand million rows, more than a 32-bit draw times its rows leaves room for."""
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for rows, least, most in ((3 * 10**9, 0, 20), (10**13, 0, 2), (200_000, 15_700, 17_100), (100, 200_000, 200_000), (0, 200_000, 200_000)):
        for given in (rows, F.lit(rows).cast("long")):
            assert least <= hashes.filter(drawn(F.col("h"), 16_384, given)).count() <= most

"""Registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.catalog import views as v
from flowlens.functions import timerange as tr
from flowlens.functions.agreement import METRICS, agreement, contingency, long_metrics
from flowlens.functions.labels import label_bots, malicious
from flowlens.operators import graph, stats
from flowlens.operators import windows as win
from flowlens.operators.concepts import label_concepts, two_means
from flowlens.operators.detectors import (
    DETECTORS,
    Adwin,
    Ddm,
    Eddm,
    HddmA,
    HddmW,
    Kswin,
    PageHinkley,
    consensus,
    detect,
)
from flowlens.operators.windows import SECOND, WindowGrid
from flowlens.plans import adapt as ad
from flowlens.plans import ensemble as en
from flowlens.plans import features as fe
from flowlens.plans.models import select_model
from flowlens.schema import FEATURES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SPREADS = ["Svar", "SITvar"], ["Rvar", "RITvar"]


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _all(capture: fe.Capture) -> WindowGrid:
    return capture.windows_in_period(capture.start, capture.end)


# --- times and windows -------------------------------------------------------------------


@query("capture_bounds")
def capture_bounds(spark, sf):
    return win.capture_bounds(v.event_packets(spark, sf))


def _time_range(low: bool | None, high: bool | None) -> Query:
    def run(spark, sf):
        packets = v.event_packets(spark, sf)
        start, end = win.read_bounds(packets)
        day = 24 * v.HOUR * SECOND
        ranged = tr.in_time_range(
            packets,
            None if low is None else start if high is not None else start + 3 * day,
            None if high is None else end if low is not None else end - 3 * day,
            bool(low), bool(high),
        )
        return ranged.select("Source", "Destination", "parsed_time", "frame_len")

    return run


for _name, _low, _high in [
    ("cc", True, True), ("co", True, False), ("oc", False, True), ("oo", False, False),
    ("from", True, None), ("to", None, True),
]:
    QUERIES[f"time_range_{_name}"] = _time_range(_low, _high)


@query("between_time")
def between_time(spark, sf):
    packets = v.event_packets(spark, sf)
    start, end = win.read_bounds(packets)
    return tr.between_time(packets, "parsed_time", start, end, False, True).select("Source", "parsed_time")


@query("padded_slice")
def padded_slice(spark, sf):
    packets = v.event_packets(spark, sf)
    start, _ = win.read_bounds(packets)
    day = 24 * v.HOUR * SECOND
    sliced = tr.padded_slice(packets, start + 2 * day, start + 9 * day)
    return sliced.select("Source", "Destination", "parsed_time", "frame_len")


@query("segment_split")
def segment_split(spark, sf):
    packets = v.event_packets(spark, sf)
    start, end = win.read_bounds(packets)
    middle = start + 10 * 24 * v.HOUR * SECOND
    train, test = tr.segment_split(
        packets.select("Source", "parsed_time", "frame_len"), (start, middle), (middle, end)
    )
    return train.withColumn("segment", F.lit("train")).unionByName(test.withColumn("segment", F.lit("test")))


@query("packet_table")
def packet_table(spark, sf):
    """Epoch seconds to times and back: the derived packet columns."""
    from flowlens.sources.packets import parsed_time

    packets = v.event_packets(spark, sf).select(
        "Source", "Destination", "Protocol", "frame_len",
        F.unix_seconds(F.col("parsed_time").cast("timestamp")).cast("double").alias("time_epoch"),
    )
    return v.civil(packets.withColumn("parsed_time", parsed_time(F.col("time_epoch"))))


def _capture_file(spark, sf) -> str:
    """The event packets written down as a capture CSV."""
    from flowlens.plans.adapt import scratch_table

    packets = v.event_packets(spark, sf)
    folder = scratch_table(packets, "capture")
    packets.selectExpr(
        "CAST(parsed_time AS string) AS `frame.time`", "CAST(time_epoch AS decimal(16,6)) AS `frame.time_epoch`",
        "Source AS `_ws.col.Source`", "Destination AS `_ws.col.Destination`", "Protocol AS `_ws.col.Protocol`",
        "frame_len AS `frame.len`",
    ).write.csv(folder, sep=";", header=True)
    return folder


@query("packets_csv")
def packets_csv(spark, sf):
    """A capture CSV read with its schema. Times are cut to microseconds from a double, so whole seconds show."""
    from flowlens.sources.packets import complete_packets, read_packets_csv

    packets = complete_packets(read_packets_csv(spark, _capture_file(spark, sf)))
    return packets.select(
        "Source", "Destination", "Protocol", "frame_len",
        F.floor("time_epoch").alias("second"), F.unix_seconds("parsed_time").alias("parsed_second"),
    )


@query("packets_csv_bad_lines")
def packets_csv_bad_lines(spark, sf):
    """A capture in which lines of three protocols are broken, each in another way, read with its bad lines."""
    from flowlens.plans.adapt import scratch_table
    from flowlens.schema import PACKET_COLUMNS
    from flowlens.sources.packets import read_packets_csv

    packets = v.event_packets(spark, sf)
    folder = scratch_table(packets, "bad_capture")
    packets.selectExpr(
        "concat_ws(';', CAST(parsed_time AS string), CAST(CAST(time_epoch AS decimal(16,6)) AS string), Source, Destination, "
        "CASE WHEN Protocol = 'click' THEN concat(Protocol, ';', frame_len, ';', frame_len) "
        "WHEN Protocol = 'error' THEN concat(Protocol, ';', frame_len, ' bytes') "
        "WHEN Protocol = 'signup' THEN Protocol ELSE concat(Protocol, ';', frame_len) END) "
        f"AS `{';'.join(PACKET_COLUMNS)}`"
    ).write.option("header", True).option("quote", "\u0000").csv(folder)
    read = read_packets_csv(spark, folder, bad_lines=True)
    return read.groupBy("Protocol").agg(
        F.count("*").alias("n_lines"), F.count("bad_line").alias("n_bad"),
        F.sum(F.expr("CASE WHEN bad_line IS NULL THEN frame_len END")).alias("good_length"),
    )


@query("packet_ids")
def packet_ids(spark, sf):
    """Row ids and the global order, both on request only: ids are unique, the order is by time."""
    from flowlens.sources.packets import read_packets_csv

    packets = read_packets_csv(spark, _capture_file(spark, sf), row_id=True, ordered=True)
    return packets.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query("incomplete_packets")
def incomplete_packets(spark, sf):
    """Packets without an endpoint are counted; here those of one event type lose their receiver."""
    from flowlens.sources.packets import count_incomplete

    packets = v.event_packets(spark, sf)
    hidden = packets.withColumn("Destination", F.expr("CASE WHEN Protocol <> 'error' THEN Destination END"))
    return count_incomplete(hidden)


@query("windows_next")
def windows_next(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    return v.civil(win.window_table(spark, capture.windows_next(100, capture.skip(100))))


@query("windows_until")
def windows_until(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    anchor = capture.skip(4)
    return v.civil(win.window_table(spark, capture.windows_until(anchor + 7 * 24 * v.HOUR * SECOND, anchor)))


@query("windows_in_period")
def windows_in_period(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    last = capture.end + 2 * 24 * v.HOUR * SECOND
    return v.civil(win.window_table(spark, capture.windows_in_period(capture.start, last)))


@query("remaining_windows")
def remaining_windows(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    anchors = [capture.start, capture.skip(10), capture.skip(115), capture.end]
    rows = [(a, capture.n_remaining(a), int(capture.has_more(a))) for a in anchors]
    return spark.createDataFrame(rows, "anchor_us long, n_remaining long, has_more int")


@query("cursor_moves")
def cursor_moves(spark, sf):
    offset = v.FEATURES[1] * SECOND
    start = tr.micros_of("capture_start")
    moves = {
        "restart": start,
        "skip_3": win.skip_windows(start, 3, offset),
        "rewind_2": win.rewind_windows(win.skip_windows(start, 3, offset), 2, offset),
    }
    pairs = [F.struct(F.lit(k).alias("move"), c.alias("pointer_us")) for k, c in moves.items()]
    return win.capture_bounds(v.event_packets(spark, sf)).select(F.inline(F.array(*pairs)))


@query("window_counts")
def window_counts(spark, sf):
    capture = v.event_capture(spark, sf, v.STATS)
    grid = _all(capture)
    counts = win.assign_windows(capture.packets, grid).groupBy("window_index").agg(F.count("*").alias("n"))
    return v.civil(win.window_times(counts, grid))


@query("tumbling_counts")
def tumbling_counts(spark, sf):
    capture = v.event_capture(spark, sf, (6 * v.HOUR, 6 * v.HOUR))
    grid = _all(capture)
    return win.assign_windows(capture.packets, grid).groupBy("window_index").agg(F.count("*").alias("n"))


@query("gapped_counts")
def gapped_counts(spark, sf):
    """Windows shorter than their distance: packets in between belong to none."""
    capture = v.event_capture(spark, sf, (2 * v.HOUR, 5 * v.HOUR))
    grid = _all(capture)
    return win.assign_windows(capture.packets, grid).groupBy("window_index").agg(F.count("*").alias("n"))


def _sender_rows(spark, sf) -> DataFrame:
    """(window, sender) pairs with their window start, as feature rows have them."""
    capture = v.event_capture(spark, sf, v.STATS)
    grid = _all(capture)
    pairs = win.assign_windows(capture.packets, grid).select("window_index", "Source").distinct()
    return win.window_times(pairs, grid)


@query("sliding_batches")
def sliding_batches(spark, sf):
    rows = _sender_rows(spark, sf)
    day = 24 * v.HOUR * SECOND
    return v.civil(win.batch_counts(rows, "window_start", day, day // 4))


@query("large_batches")
def large_batches(spark, sf):
    rows = _sender_rows(spark, sf)
    day = 24 * v.HOUR * SECOND
    return v.civil(win.batch_counts(rows, "window_start", day, day // 4, min_rows=2))


@query("iso_window_start")
def iso_window_start(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    table = win.window_table(spark, _all(capture))
    text = table.select("window_index", tr.iso_string(F.col("window_start")).alias("start_text"))
    return v.civil(text.withColumn("window_start", tr.iso_to_timestamp(F.col("start_text"))))


# --- statistics --------------------------------------------------------------------------


def _gaps(spark, sf, role: str) -> DataFrame:
    capture = v.event_capture(spark, sf, v.STATS)
    seen = stats.window_time_diff(capture.packets, _all(capture), role)
    return seen.select("window_index", role, "parsed_time", f"{role}_time_diff")


@query("time_diff_source")
def time_diff_source(spark, sf):
    return _gaps(spark, sf, "Source")


@query("time_diff_destination")
def time_diff_destination(spark, sf):
    return _gaps(spark, sf, "Destination")


@query("source_metrics")
def source_metrics(spark, sf):
    capture = v.event_capture(spark, sf, v.STATS)
    return v.rounded(stats.source_metrics(capture.packets, _all(capture)), *SPREADS[0])


UNSIZED = "CASE WHEN Source <> '10.0.0.5' AND frame_len % 3 <> 0 THEN frame_len END"


def _unsized_capture(spark, sf) -> fe.Capture:
    """The event packets, about a third without a length, and all that one address sends."""
    return fe.Capture.open(v.event_packets(spark, sf).withColumn("frame_len", F.expr(UNSIZED)), *v.STATS)


@query("source_metrics_missing_lengths")
def source_metrics_missing_lengths(spark, sf):
    """Packets without a length count, but play no part in the sizes."""
    capture = _unsized_capture(spark, sf)
    return v.rounded(stats.source_metrics(capture.packets, _all(capture)), *SPREADS[0])


@query("destination_metrics")
def destination_metrics(spark, sf):
    capture = v.event_capture(spark, sf, v.STATS)
    return v.rounded(stats.destination_metrics(capture.packets, _all(capture)), *SPREADS[1])


@query("edges")
def edges(spark, sf):
    capture = v.event_capture(spark, sf, v.STATS)
    return stats.edges(capture.packets, _all(capture))


@query("pane_metrics")
def pane_metrics(spark, sf):
    """Both roles over packets with many equal times."""
    capture = fe.Capture.open(v.shipment_packets(spark, sf), *v.SHIPMENTS)
    found = stats.packet_stats(capture.packets, _all(capture))
    return v.rounded(found, *SPREADS[0], *SPREADS[1])


@query("shipment_edges")
def shipment_edges(spark, sf):
    capture = fe.Capture.open(v.shipment_packets(spark, sf), *v.SHIPMENTS)
    return stats.edges(capture.packets, _all(capture))


# --- graph -------------------------------------------------------------------------------


def _graph_edges(spark, sf) -> DataFrame:
    capture = v.event_capture(spark, sf, v.GRAPH)
    return stats.edges(capture.packets, _all(capture))


@query("nodes")
def nodes(spark, sf):
    return graph.nodes(_graph_edges(spark, sf))


@query("degrees")
def degrees(spark, sf):
    return graph.degrees(_graph_edges(spark, sf))


@query("betweenness")
def betweenness(spark, sf):
    return v.rounded(graph.betweenness(_graph_edges(spark, sf)), "centrality")


@query("eigenvector")
def eigenvector(spark, sf):
    return v.rounded(graph.eigenvector(_graph_edges(spark, sf)), "eigenvector_centrality")


@query("graph_metrics")
def graph_metrics(spark, sf):
    found = graph.graph_metrics(_graph_edges(spark, sf))
    return v.rounded(found, "centrality", "eigenvector_centrality")


# --- feature tables ----------------------------------------------------------------------


def _shown(features: DataFrame) -> DataFrame:
    return v.rounded(
        v.civil(features), *SPREADS[0], *SPREADS[1], "centrality", "eigenvector_centrality"
    )


@query("sender_receiver_join")
def sender_receiver_join(spark, sf):
    capture = v.event_capture(spark, sf, v.STATS)
    filled = fe.fill_missing(stats.packet_stats(capture.packets, _all(capture)))
    return v.rounded(filled, *SPREADS[0], *SPREADS[1])


@query("features_next_n")
def features_next_n(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    return _shown(capture.next_samples(40, capture.skip(90)))


@query("features_next")
def features_next(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    return _shown(capture.next_samples(anchor=capture.skip(2)))


@query("features_until")
def features_until(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    return _shown(capture.samples_until(capture.skip(60), capture.skip(7)))


@query("features_in_period")
def features_in_period(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    return _shown(capture.samples_in_period(capture.rewind(3), capture.skip(50)))


@query("features_remaining")
def features_remaining(spark, sf):
    capture = v.event_capture(spark, sf, v.FEATURES)
    return _shown(capture.remaining_samples(capture.skip(80)))


@query("features_all")
def features_all(spark, sf):
    return _shown(v.event_capture(spark, sf, v.FEATURES).all_samples())


@query("labelled_features")
def labelled_features(spark, sf):
    packets = v.event_packets(spark, sf)
    start, end = win.read_bounds(packets)
    return _shown(fe.labelled_features(packets, v.BOTS, start, end, *v.FEATURES))


@query("feature_columns")
def feature_columns(spark, sf):
    """The model input: numeric features without window, address and label."""
    packets = v.event_packets(spark, sf)
    start, end = win.read_bounds(packets)
    labelled = fe.labelled_features(packets, v.BOTS, start, end, *v.FEATURES)
    return v.rounded(
        fe.feature_columns(labelled), *SPREADS[0], *SPREADS[1], "centrality", "eigenvector_centrality"
    )


@query("bot_table_label")
def bot_table_label(spark, sf):
    """Labels from a table of bots: the addresses that ever sent a very large packet."""
    capture = v.event_capture(spark, sf, v.GRAPH)
    bots = capture.packets.filter("frame_len > 28000").select(F.col("Source").alias("IP"))
    return label_bots(graph.nodes(stats.edges(capture.packets, _all(capture))), bots)


@query("malicious_packets")
def malicious_packets(spark, sf):
    packets = v.event_packets(spark, sf)
    return packets.select(
        "Source", "Destination", "parsed_time", malicious(v.BOTS).cast("int").alias("malicious")
    )


@query("stored_features")
def stored_features(spark, sf):
    """Sender metrics written under their request and read back from the stored partition."""
    from flowlens.plans.adapt import scratch_table
    from flowlens.sources.feature_table import FeatureKey, read_or_compute

    capture = v.event_capture(spark, sf, v.STATS)
    key = FeatureKey(
        f"{sf}/events.parquet", *v.STATS, tr.from_micros(capture.start), tr.from_micros(capture.end)
    )
    root = scratch_table(capture.packets, "features")
    stored = read_or_compute(
        spark, root, key, lambda: stats.source_metrics(capture.packets, _all(capture))
    )
    return v.rounded(stored, *SPREADS[0])


# --- concepts ----------------------------------------------------------------------------


def _concepts(spark, sf) -> DataFrame:
    rows = v.embedding_rows(spark, sf)
    return label_concepts(
        rows.filter("label < 5"), rows.filter("label >= 5"), v.EMBEDDING_COLUMNS, [0, 1, 2]
    )


@query("concept_union")
def concept_union(spark, sf):
    return _concepts(spark, sf)


def _rule_table(spark, sf) -> DataFrame:
    ruled = _concepts(spark, sf).withColumn("cluster", (F.col("f0") > F.col("f1")).cast("int"))
    return contingency(ruled, ["batch_id"])


@query("contingency")
def contingency_table(spark, sf):
    return _rule_table(spark, sf)


@query("agreement_metrics")
def agreement_metrics(spark, sf):
    return v.rounded(agreement(_rule_table(spark, sf), ["batch_id"]), *METRICS)


@query("two_means_fixed_steps")
def two_means_fixed_steps(spark, sf):
    rows = _concepts(spark, sf).persist()
    found = two_means(rows, v.EMBEDDING_COLUMNS, steps=2, tolerance=-1.0)
    return found.groupBy("batch_id", "concept", "cluster").agg(F.count("*").alias("n"))


@query("two_means_starts")
def two_means_starts(spark, sf):
    """Clusters from several starts, each run until no centroid moves."""
    rows = _concepts(spark, sf)
    found = two_means(rows, v.EMBEDDING_COLUMNS, tolerance=0.0, starts=3)
    return found.groupBy("batch_id", "concept", "cluster").agg(F.count("*").alias("n"))


@query("user_metrics")
def user_metrics(spark, sf):
    """Two metrics of a user beside the six: the pair-counting Fowlkes-Mallows index, and the rows compared."""
    own = {
        "fowlkes_mallows": "(c00 * (c00 - 1D) + c01 * (c01 - 1D) + c10 * (c10 - 1D) + c11 * (c11 - 1D)) / sqrt("
        "((c00 + c01) * (c00 + c01 - 1D) + (c10 + c11) * (c10 + c11 - 1D))"
        " * ((c00 + c10) * (c00 + c10 - 1D) + (c01 + c11) * (c01 + c11 - 1D)))",
        "n_rows": F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11"),
    }
    measured = agreement(_rule_table(spark, sf), ["batch_id"], own)
    return v.rounded(long_metrics(measured, ["batch_id"], list(own)), "value")


# --- detectors ---------------------------------------------------------------------------


def _detected(spark, sf, name: str, make) -> DataFrame:
    return detect(v.hourly_series(spark, sf), ["series"], panel={name: make})


@query("ddm")
def ddm(spark, sf):
    return _detected(spark, sf, "DDM", Ddm)


@query("eddm")
def eddm(spark, sf):
    return _detected(spark, sf, "EDDM", Eddm)


@query("hddm_a")
def hddm_a(spark, sf):
    return _detected(spark, sf, "HDDM_A", HddmA)


@query("hddm_w")
def hddm_w(spark, sf):
    return _detected(spark, sf, "HDDM_W", HddmW)


@query("page_hinkley")
def page_hinkley(spark, sf):
    return _detected(spark, sf, "PageHinkley", lambda: PageHinkley(threshold=5.0))


@query("ddm_below_zero")
def ddm_below_zero(spark, sf):
    """A series that leaves the range of error rates on both sides."""
    series = v.hourly_series(spark, sf).withColumn("value", F.expr("1.6 * value - 0.3"))
    return detect(series, ["series"], panel={"DDM": Ddm})


@query("detector_state_calls")
def detector_state_calls(spark, sf):
    """Three calls with ever more of the series; each goes on from the states of the one before."""
    from flowlens.plans.adapt import scratch_table
    from flowlens.plans.detector_store import DetectorStore

    series = v.hourly_series(spark, sf)
    store = DetectorStore(
        scratch_table(series, "detector_states"), ["series"], panel={"DDM": Ddm, "HDDM_A": HddmA}
    )
    for last in (200, 450):
        store.detect(series.where(F.col("seq") <= last))
    store.detect(series)
    return store.log(spark)


@query("adwin")
def adwin(spark, sf):
    return _detected(spark, sf, "ADWIN", Adwin)


@query("kswin")
def kswin(spark, sf):
    return _detected(spark, sf, "KSWIN", Kswin)


@query("epoch_reset")
def epoch_reset(spark, sf):
    series = en.with_epochs(v.hourly_series(spark, sf), [30, 500, 501])
    return detect(series, ["series", "epoch"], panel={"DDM": Ddm})


@query("detector_grid")
def detector_grid(spark, sf):
    """Every classifier, metric and detector, once per batch."""
    measured = long_metrics(agreement(_rule_table(spark, sf), ["batch_id"]), ["batch_id"])
    log = en.prediction_log(measured.withColumn("classifier", F.lit("KMeans")), DETECTORS)
    return log.select("classifier", "metric", "detector", "batch_id")


@query("consensus")
def consensus_query(spark, sf):
    found = detect(v.hourly_series(spark, sf), ["series"], panel={"DDM": Ddm})
    return consensus(found, ["seq"], "change")


@query("drift_regions")
def drift_regions(spark, sf):
    capture = v.event_capture(spark, sf, v.STATS)
    found = consensus(detect(v.hourly_series(spark, sf), ["series"], panel={"DDM": Ddm}), ["seq"], "change")
    start = tr.instant(F.lit(capture.start) + F.col("seq") * (v.HOUR * SECOND))
    return v.civil(
        ad.drift_regions(found.select(F.col("consensus").alias("drift_detection"), start.alias("batch_start")))
    )


@query("ensemble_fit_predict")
def ensemble_fit_predict(spark, sf):
    rows = v.embedding_rows(spark, sf)
    _, log = en.fit_predict(
        rows.filter("label < 5"), rows.filter("label >= 5"), v.EMBEDDING_COLUMNS
    )
    return log


# --- models ------------------------------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    """Labelled features, all of them, written down once: models read them again and again."""
    from flowlens.functions.durable import durable

    return durable(label_bots(v.event_capture(spark, sf, v.FEATURES).all_samples(), v.BOTS))


@query("model_selection")
def model_selection(spark, sf):
    rows = _labelled(spark, sf)
    chosen = select_model(rows, FEATURES, time_limit=None)
    return chosen.predict(rows).select("window_index", "IP", "isBot", "prediction")


def _adaptive_parts(spark, sf) -> tuple[DataFrame, DataFrame, ad.Adaptive]:
    """Ten days to learn from, the rest to watch in batches of three days."""
    rows = _labelled(spark, sf)
    start, _ = win.read_bounds(rows, "window_start")
    middle = start + 10 * 24 * v.HOUR * SECOND
    settings = ad.Adaptive(
        batch_seconds=3 * 24 * v.HOUR, offset_seconds=24 * v.HOUR,
        select=lambda df: select_model(df, FEATURES, time_limit=None),
    )
    train = tr.in_time_range(rows, start, middle, include_upper=False, on="window_start")
    return train, tr.in_time_range(rows, middle, on="window_start"), settings


@query("adaptive_run")
def adaptive_run(spark, sf):
    return v.civil(ad.adapt(*_adaptive_parts(spark, sf)))


# --- streams -----------------------------------------------------------------------------


def _streamed(spark, sf, frame, name: str) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    from flowlens.plans.adapt import scratch_table

    folder = scratch_table(table_of(spark, sf), name)
    run = (
        frame.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


def table_of(spark, sf) -> DataFrame:
    return v.table(spark, sf, "events")


def _event_stream(spark, sf) -> DataFrame:
    """The event packets as a stream of the files that hold the table."""
    batch = table_of(spark, sf)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return v.as_packets(stream)


DELAY_SECONDS = 600


@query("stream_window_stats")
def stream_window_stats(spark, sf):
    from flowlens.streaming.stats import stream_packet_stats

    capture = v.event_capture(spark, sf, v.STATS)
    frame = stream_packet_stats(
        _event_stream(spark, sf), capture.start, capture.size, capture.offset, f"{DELAY_SECONDS} seconds"
    )
    found = _streamed(spark, sf, frame, "stream_window_stats")
    return v.civil(v.rounded(found, "Svar", "Rvar"))


@query("stream_window_stats_missing_lengths")
def stream_window_stats_missing_lengths(spark, sf):
    from flowlens.streaming.stats import stream_packet_stats

    capture = _unsized_capture(spark, sf)
    packets = _event_stream(spark, sf).withColumn("frame_len", F.expr(UNSIZED))
    frame = stream_packet_stats(packets, capture.start, capture.size, capture.offset, f"{DELAY_SECONDS} seconds")
    return v.civil(v.rounded(_streamed(spark, sf, frame, "stream_unsized_stats"), "Svar", "Rvar"))


@query("stream_edges")
def stream_edges(spark, sf):
    from flowlens.streaming import stats as st

    capture = v.event_capture(spark, sf, v.GRAPH)
    frame = st.stream_edges(
        _event_stream(spark, sf), capture.start, capture.size, capture.offset, f"{DELAY_SECONDS} seconds"
    )
    return v.civil(_streamed(spark, sf, frame, "stream_edges"))


@query("stream_inter_arrival")
def stream_inter_arrival(spark, sf):
    """Slot summaries from a stream, merged into windows that closed before the watermark."""
    from flowlens.streaming.stats import stream_slot_stats

    capture = v.event_capture(spark, sf, v.STATS)
    closed = capture.end - DELAY_SECONDS * SECOND - capture.size - SECOND
    grid = capture.windows_in_period(capture.start, closed)
    frame = stream_slot_stats(
        _event_stream(spark, sf), grid, f"{DELAY_SECONDS} seconds", slot=60 * SECOND, block=v.DAY * SECOND
    )
    slots = _streamed(spark, sf, frame, "stream_slots")
    inside = slots.filter(F.col("last") < grid.end - grid.anchor)
    found = stats.window_stats(stats.pane_stats(inside, grid, 60 * SECOND), grid)
    return v.rounded(found, *SPREADS[0], *SPREADS[1])


@query("stream_features")
def stream_features(spark, sf):
    """The whole feature table of the stream, for the windows that surely closed before its end."""
    from flowlens.plans.adapt import scratch_table
    from flowlens.streaming.features import FeatureSink

    capture = v.event_capture(spark, sf, v.FEATURES)
    closed = capture.end - DELAY_SECONDS * SECOND - 2 * capture.size
    grid = capture.windows_in_period(capture.start, closed)
    folder = scratch_table(capture.packets, "stream_features")
    sink = FeatureSink(f"{folder}/sink", grid, f"{DELAY_SECONDS} seconds", block=v.DAY * SECOND)
    run = (
        sink.parts(_event_stream(spark, sf)).writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return _shown(sink.features(spark))


@query("stream_detectors")
def stream_detectors(spark, sf):
    """The hourly series written down in no order and read as a stream of several micro-batches."""
    from flowlens.plans.adapt import scratch_table
    from flowlens.streaming.detect import stream_detect

    start = v.event_capture(spark, sf, v.STATS).start
    hour = F.timestamp_micros(F.lit(start) + F.col("seq") * (v.HOUR * SECOND))
    series = v.hourly_series(spark, sf).withColumn("hour", hour)
    folder = scratch_table(series, "series")
    # each file holds a part of every day's hours: later micro-batches fill the gaps of the first
    series.repartitionByRange(3, F.col("seq") % 3).write.parquet(folder)
    # an element far behind the end lets the watermark pass all others
    far = spark.range(1).selectExpr("'end' AS series", "100000L AS seq", "1D AS value").withColumn("hour", hour)
    far.write.mode("append").parquet(folder)
    frame = stream_detect(
        spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(folder), ["series"],
        "hour", "400 days", panel={"DDM": Ddm, "HDDM_A": HddmA},
    )
    return _streamed(spark, sf, frame, "stream_detectors").where("series <> 'end'")


@query("stream_adaptive_run")
def stream_adaptive_run(spark, sf):
    """The adaptive loop as a sink of a stream of labelled feature rows."""
    from flowlens.streaming.adapt import AdaptiveSink

    train, test, settings = _adaptive_parts(spark, sf)
    folder = ad.scratch_table(test, "stream_adaptive")
    test.write.parquet(f"{folder}/rows")
    start, _ = win.read_bounds(test, "window_start")
    sink = AdaptiveSink(f"{folder}/loop", settings)
    sink.begin(train, start)
    run = (
        spark.readStream.schema(test.schema).parquet(f"{folder}/rows").writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    sink.finish(spark, test.schema)
    return v.civil(sink.statistics(spark))

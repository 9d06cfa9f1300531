"""Ensemble drift detection: clusterings x agreement metrics x change detectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.agreement import METRICS, Metric, agreement, contingency, long_metrics
from flowlens.functions.durable import durable
from flowlens.operators.concepts import MAX_BATCHES, batch_ids, label_concepts, standardize, two_means
from flowlens.operators.detectors import DETECTORS, Detector, consensus, detect
from flowlens.plans.detector_store import DetectorStore
from flowlens.schema import FEATURES

# The name of the one clustering in the panel.
CLASSIFIERS = {"KMeans": two_means}
METRIC_SCHEMA = "classifier string, batch_id long, metric string, value double"


def with_epochs(series: DataFrame, resets: Sequence[int], seq: str = "seq") -> DataFrame:
    """Add ``epoch``, the number of reset points up to an element.

    Detectors keyed by the epoch start anew at every reset. ``resets`` has the first element
    of every new reference; the caller set those references, so it knows the list.
    """
    passed = [(F.col(seq) >= point).cast("long") for point in resets]
    return series.withColumn("epoch", sum(passed, F.lit(0).cast("long")))


def batch_metrics(
    reference: DataFrame,
    batches: DataFrame,
    columns: Sequence[str] = tuple(FEATURES),
    classifiers: Mapping[str, Callable[..., DataFrame]] = CLASSIFIERS,
    scaled: bool = False,
    metrics: Mapping[str, Metric] | None = None,
    **options,
) -> DataFrame:
    """(classifier, batch_id, metric, value): how far each batch can be told from the reference.

    ``metrics`` adds agreement metrics by name, see :func:`flowlens.functions.agreement.agreement`;
    ``classifiers`` names the clusterings, functions of rows and columns that add ``cluster``.

    Values near 0 (accuracy aside) say that clusters ignore the concept, so nothing changed.
    """
    ids = batch_ids(batches)
    if not ids:
        return reference.sparkSession.createDataFrame([], METRIC_SCHEMA)
    # kept once each: the reference is repeated for the batches while it is read
    old = reference.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    new = batches.select("batch_id", *columns).persist(StorageLevel.MEMORY_AND_DISK)
    tables = []
    for name, cluster in classifiers.items():
        cells: list = []
        for begin in range(0, len(ids), MAX_BATCHES):
            some = ids[begin : begin + MAX_BATCHES]
            part = new if len(ids) <= MAX_BATCHES else new.where(F.col("batch_id").between(some[0], some[-1]))
            rows = label_concepts(old, part, columns, some)
            rows = standardize(rows, columns) if scaled else rows
            counted = contingency(cluster(rows, columns, **options), ["batch_id"])
            cells += counted.collect()  # four numbers for each batch
        table = rows.sparkSession.createDataFrame(cells, counted.schema)
        measured = long_metrics(agreement(table, ["batch_id"], metrics), ["batch_id"], list(metrics or ()))
        tables.append(measured.select(F.lit(name).alias("classifier"), "batch_id", "metric", "value"))
    old.unpersist()
    new.unpersist()
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def prediction_log(
    metrics: DataFrame, panel: Mapping[str, Callable[[], Detector]] = DETECTORS, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per (classifier, metric, detector, batch) with ``prediction`` 0 or 1."""
    series = ["classifier", "metric", *keys]
    return _log(detect(metrics, series, "batch_id", "value", panel), keys)


def _log(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return found.select(
        "classifier", "metric", "detector", *keys, "batch_id", F.col("change").alias("prediction")
    )


def fit_predict(
    reference: DataFrame,
    batches: DataFrame,
    columns: Sequence[str] = tuple(FEATURES),
    panel: Mapping[str, Callable[[], Detector]] = DETECTORS,
    store: DetectorStore | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Consensus over all batches and the prediction log.

    With a ``store`` (see :func:`ensemble_store`) the detectors go on from the call before, and
    batches that an earlier call has judged are left out; without one they start afresh.
    """
    metrics = durable(batch_metrics(reference, batches, columns, **options))
    log = prediction_log(metrics, panel) if store is None else _log(store.detect(metrics))
    return consensus(log), log


def ensemble_store(folder: str, panel: Mapping[str, Callable[[], Detector]] = DETECTORS) -> DetectorStore:
    """Detector states of the ensemble, kept in ``folder`` from one :func:`fit_predict` to the next.

    Call its ``reset`` with every new reference.
    """
    return DetectorStore(folder, ("classifier", "metric"), "batch_id", "value", panel)


__all__ = ["METRICS", "batch_metrics", "consensus", "ensemble_store", "fit_predict", "prediction_log", "with_epochs"]

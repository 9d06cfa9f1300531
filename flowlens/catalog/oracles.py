"""The registered queries once more, as plain SQL over the same tables.

The SQL takes another road on purpose: windows by a range join, lags inside each window,
betweenness from all pairs, detectors as recursive queries.
"""

from __future__ import annotations

from flowlens.catalog.views import BOTS, EMBEDDING_COLUMNS, FEATURES, GRAPH, HOUR, SHIPMENTS, STATS

US = 1_000_000
DAY_US = 24 * HOUR * US

EVENT_PACKETS = """
p AS (SELECT '10.0.0.' || (user_id % 24) AS "Source",
             '10.0.0.' || ((event_id * 7 + user_id) % 24) AS "Destination",
             event_type AS "Protocol", ts AS parsed_time, epoch_us(ts) AS us,
             CAST(floor(value * 100) AS INTEGER) AS frame_len
      FROM events),
b AS (SELECT min(us) AS cs, max(us) AS ce FROM p)"""

SHIPMENT_PACKETS = """
p AS (SELECT 'N' || c_nationkey AS "Source", 'N' || s_nationkey AS "Destination",
             l_shipdate AS parsed_time, epoch_us(l_shipdate) AS us, CAST(l_quantity AS INTEGER) AS frame_len
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
b AS (SELECT min(us) AS cs, max(us) AS ce FROM p)"""


def _windows(geometry: tuple[int, int], anchor: str = "cs", keep: str = "a < ce", limit: int = 100000) -> str:
    """Windows whose start ``a`` satisfies a condition, numbered from the anchor."""
    size, offset = geometry[0] * US, geometry[1] * US
    return f"""
w AS (SELECT k AS window_index, a AS ws, a + {size} AS we
      FROM (SELECT k, {anchor} + k * {offset} AS a, cs, ce FROM b, range(0, {limit}) r(k)) g
      WHERE {keep}),
pw AS (SELECT w.window_index, p.* FROM w JOIN p ON p.us >= w.ws AND p.us < w.we)"""


def _unsized(sql: str) -> str:
    """The same over packets of which some have no length."""
    packets = sql.replace("\np AS (", "\np0 AS (", 1)
    unsized = """p AS (SELECT * REPLACE (CASE WHEN "Source" <> '10.0.0.5' AND frame_len % 3 <> 0 THEN frame_len END AS frame_len) FROM p0),
b AS ("""
    return packets.replace("b AS (", unsized, 1)


GAPS = """
g AS (SELECT *, us - lag(us) OVER (PARTITION BY window_index, "Source" ORDER BY us) AS sgap,
             us - lag(us) OVER (PARTITION BY window_index, "Destination" ORDER BY us) AS dgap
      FROM pw)"""


def _spread(value: str) -> str:
    return f"round(stddev_samp({value}), 6)"


def _gap_columns(tag: str, gap: str) -> str:
    return f"""min({gap}) / 1e6 AS {tag}ITmin, max({gap}) / 1e6 AS {tag}ITmax,
  CAST(sum({gap}) AS DOUBLE) / count({gap}) / 1e6 AS {tag}ITavg,
  round(stddev_samp(CAST({gap} AS DOUBLE)) / 1e6, 6) AS {tag}ITvar"""


SENDERS = f"""
s AS (SELECT window_index, "Source" AS "IP", count(*) AS "Spc", CAST(sum(frame_len) AS BIGINT) AS "Tss",
  min(frame_len) AS "Smin", max(frame_len) AS "Smax", CAST(sum(frame_len) AS DOUBLE) / count(frame_len) AS "Savg",
  {_spread("frame_len")} AS "Svar", {_gap_columns("S", "sgap")}
  FROM g GROUP BY 1, 2)"""

RECEIVERS = f"""
r AS (SELECT window_index, "Destination" AS "IP", count(*) AS "Rpc", CAST(sum(frame_len) AS BIGINT) AS "Tsr",
  CAST(sum(frame_len) AS DOUBLE) / count(frame_len) AS "Ravg", {_spread("frame_len")} AS "Rvar", {_gap_columns("R", "dgap")}
  FROM g GROUP BY 1, 2)"""

SENDER_NAMES = ["Spc", "Tss", "Smin", "Smax", "Savg", "Svar", "SITmin", "SITmax", "SITavg", "SITvar"]
RECEIVER_NAMES = ["Rpc", "Tsr", "Ravg", "Rvar", "RITmin", "RITmax", "RITavg", "RITvar"]
FILLED = ", ".join(f'coalesce({n}, 0) AS "{n}"' for n in SENDER_NAMES + RECEIVER_NAMES)
RAW = ", ".join(SENDER_NAMES + RECEIVER_NAMES)

EDGES = """
e AS (SELECT window_index, "Source", "Destination", count(*) AS "count" FROM pw GROUP BY 1, 2, 3)"""

NODES = """
n AS (SELECT DISTINCT window_index, "IP" FROM
      (SELECT window_index, "Source" AS "IP" FROM e UNION ALL SELECT window_index, "Destination" FROM e)),
nn AS (SELECT window_index, count(*) AS size FROM n GROUP BY 1)"""

DEGREES = """
d AS (SELECT n.window_index, n."IP", count(DISTINCT i."Source") AS in_degree, count(DISTINCT o."Destination") AS out_degree
      FROM n LEFT JOIN e i ON i.window_index = n.window_index AND i."Destination" = n."IP"
      LEFT JOIN e o ON o.window_index = n.window_index AND o."Source" = n."IP"
      GROUP BY 1, 2)"""

# Walks of length d; the shortest walk between two nodes counts the shortest paths.
BETWEENNESS = """
walks AS (
  SELECT window_index, "IP" AS s, "IP" AS t, 0 AS len, 1.0::DOUBLE AS paths FROM n
  UNION ALL
  SELECT k.window_index, k.s, e."Destination", k.len + 1, sum(k.paths)
  FROM walks k JOIN e ON e.window_index = k.window_index AND e."Source" = k.t AND e."Source" <> e."Destination"
  WHERE k.len < 23 GROUP BY 1, 2, 3, 4),
sp AS (SELECT window_index, s, t, len, paths FROM walks
       QUALIFY len = min(len) OVER (PARTITION BY window_index, s, t)),
bw AS (SELECT a.window_index, a.t AS "IP", sum(a.paths * c.paths / whole.paths) AS raw
       FROM sp whole
       JOIN sp a ON a.window_index = whole.window_index AND a.s = whole.s
       JOIN sp c ON c.window_index = a.window_index AND c.s = a.t AND c.t = whole.t
       WHERE a.len + c.len = whole.len AND a.t <> whole.s AND a.t <> whole.t
       GROUP BY 1, 2),
cb AS (SELECT n.window_index, n."IP",
              CASE WHEN size > 2 THEN round(coalesce(raw, 0) / ((size - 1) * (size - 2)), 6) ELSE 0 END AS centrality
       FROM n JOIN nn USING (window_index) LEFT JOIN bw USING (window_index, "IP"))"""

EIGENVECTOR = """
steps AS (
  SELECT n.window_index, n."IP", size, 1.0::DOUBLE / size AS x, 0 AS step, false AS done FROM n JOIN nn USING (window_index)
  UNION ALL
  SELECT window_index, "IP", size, y / norm, step + 1,
         sum(abs(y / norm - last)) OVER (PARTITION BY window_index) < size * 1e-6
  FROM (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY window_index)) AS norm FROM
        (SELECT k.window_index, l."Destination" AS "IP", k.size, k.step, sum(k.x) AS y, max(CASE WHEN l.self THEN k.x END) AS last
         FROM steps k JOIN (SELECT window_index, "Source", "Destination", false AS self FROM e
                            UNION ALL SELECT window_index, "IP", "IP", true FROM n) l
           ON l.window_index = k.window_index AND l."Source" = k."IP"
         WHERE NOT k.done AND k.step < 100 GROUP BY 1, 2, 3, 4) sums) norms),
ev AS (SELECT n.window_index, n."IP", round(coalesce(max(CASE WHEN done THEN x END), 0), 6) AS eigenvector_centrality
       FROM n LEFT JOIN steps USING (window_index, "IP") GROUP BY 1, 2)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


def _feature_query(
    windows: str, label: str = "", only_numbers: bool = False, packets: str = EVENT_PACKETS
) -> str:
    meta = "" if only_numbers else 'f."IP", make_timestamp(w.ws) AS window_start, make_timestamp(w.we) AS window_end, window_index, '
    return _with(
        packets, windows, GAPS, SENDERS, RECEIVERS, EDGES, NODES, DEGREES, BETWEENNESS, EIGENVECTOR,
        f"""
f AS (SELECT window_index, "IP", {FILLED} FROM s FULL JOIN r USING (window_index, "IP"))""",
        recursive=True,
    ) + f"""SELECT {meta}{RAW}, in_degree, out_degree, centrality, eigenvector_centrality{label}
FROM f JOIN d USING (window_index, "IP") JOIN cb USING (window_index, "IP") JOIN ev USING (window_index, "IP")
JOIN w USING (window_index)"""


def _bots() -> str:
    return ", ".join(f"'{ip}'" for ip in BOTS)


IS_BOT = f', CASE WHEN f."IP" IN ({_bots()}) THEN 1 ELSE 0 END AS "isBot"'


# --- times and windows -------------------------------------------------------------------


def _ranged(condition: str) -> str:
    return _with(EVENT_PACKETS) + (
        f'SELECT "Source", "Destination", parsed_time, frame_len FROM p, b WHERE {condition}'
    )


def _counts(size: int, offset: int, times: bool) -> str:
    shown = ", make_timestamp(any_value(w.ws)) AS window_start, make_timestamp(any_value(w.we)) AS window_end" if times else ""
    return _with(EVENT_PACKETS, _windows((size, offset))) + (
        f"SELECT window_index, count(*) AS n{shown} FROM pw JOIN w USING (window_index) GROUP BY 1"
    )


def _listed(windows: str) -> str:
    return _with(EVENT_PACKETS, windows) + (
        "SELECT window_index, make_timestamp(ws) AS window_start, make_timestamp(we) AS window_end FROM w"
    )


def _batches(least: int) -> str:
    return _with(
        EVENT_PACKETS, _windows(STATS),
        f"""
rows AS (SELECT DISTINCT w.ws, pw."Source" FROM pw JOIN w USING (window_index)),
range_ AS (SELECT min(ws) AS first, max(ws) AS last FROM rows),
batch AS (SELECT k AS batch_id, first + k * {DAY_US // 4} AS low FROM range_, range(0, 100000) r(k)
          WHERE first + k * {DAY_US // 4} <= last - {DAY_US} + {DAY_US // 4})""",
    ) + f"""SELECT batch_id, make_timestamp(low) AS lower_bound, make_timestamp(low + {DAY_US // 4}) AS batch_start,
 make_timestamp(low + {DAY_US}) AS batch_end, count(ws) AS n_rows
FROM batch LEFT JOIN rows ON ws >= low AND ws < low + {DAY_US} GROUP BY batch_id, low HAVING count(ws) >= {least}"""


F_OFF = FEATURES[1] * US

SQL: dict[str, str] = {
    "capture_bounds": "SELECT min(ts) AS capture_start, max(ts) AS capture_end FROM events",
    "time_range_cc": _ranged("us >= cs AND us <= ce"),
    "time_range_co": _ranged("us >= cs AND us < ce"),
    "time_range_oc": _ranged("us > cs AND us <= ce"),
    "time_range_oo": _ranged("us > cs AND us < ce"),
    "time_range_from": _ranged(f"us >= cs + {3 * DAY_US}"),
    "time_range_to": _ranged(f"us <= ce - {3 * DAY_US}"),
    "between_time": _with(EVENT_PACKETS)
    + 'SELECT "Source", parsed_time FROM p, b WHERE us > cs AND us <= ce',
    "padded_slice": _ranged(
        f"us >= cs + {2 * DAY_US} - {10 * US} AND us <= cs + {9 * DAY_US} + {10 * US}"
    ),
    "segment_split": _with(EVENT_PACKETS)
    + f"""SELECT "Source", parsed_time, frame_len, CASE WHEN us < cs + {10 * DAY_US} THEN 'train' ELSE 'test' END AS segment
FROM p, b WHERE us >= cs AND us < ce""",
    "packet_table": _with(EVENT_PACKETS)
    + """SELECT "Source", "Destination", "Protocol", frame_len, CAST(us // 1000000 AS DOUBLE) AS time_epoch,
 date_trunc('second', parsed_time) AS parsed_time FROM p""",
    "packets_csv": _with(EVENT_PACKETS)
    + '''SELECT "Source", "Destination", "Protocol", frame_len, us // 1000000 AS second, us // 1000000 AS parsed_second FROM p''',
    "packet_ids": "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events",
    "incomplete_packets": "SELECT count(*) AS n_incomplete FROM events WHERE event_type = 'error'",
    "windows_next": _listed(_windows(FEATURES, f"cs + 100 * {F_OFF}", "k < 100 AND a <= ce")),
    "windows_until": _listed(
        _windows(FEATURES, f"cs + 4 * {F_OFF}", f"a < cs + 4 * {F_OFF} + {7 * DAY_US} AND a <= ce")
    ),
    "windows_in_period": _listed(_windows(FEATURES, "cs", f"a < ce + {2 * DAY_US}")),
    "remaining_windows": _with(EVENT_PACKETS)
    + f"""SELECT anchor_us, n_remaining, CASE WHEN n_remaining > 0 THEN 1 ELSE 0 END AS has_more FROM (
 SELECT a AS anchor_us, (SELECT count(*) FROM range(0, 100000) r(k) WHERE a + k * {F_OFF} < ce) AS n_remaining
 FROM (SELECT ce, unnest([cs, cs + 10 * {F_OFF}, cs + 115 * {F_OFF}, ce]) AS a FROM b))""",
    "cursor_moves": _with(EVENT_PACKETS)
    + f"""SELECT 'restart' AS move, cs AS pointer_us FROM b UNION ALL SELECT 'skip_3', cs + 3 * {F_OFF} FROM b
UNION ALL SELECT 'rewind_2', cs + {F_OFF} FROM b""",
    "window_counts": _counts(*STATS, True),
    "tumbling_counts": _counts(6 * HOUR, 6 * HOUR, False),
    "gapped_counts": _counts(2 * HOUR, 5 * HOUR, False),
    "sliding_batches": _batches(0),
    "large_batches": _batches(2),
    "iso_window_start": _with(EVENT_PACKETS, _windows(FEATURES))
    + """SELECT window_index, make_timestamp(ws) AS window_start,
 CASE WHEN ws % 1000000 = 0 THEN strftime(make_timestamp(ws), '%Y-%m-%dT%H:%M:%S')
      ELSE strftime(make_timestamp(ws), '%Y-%m-%dT%H:%M:%S.%f') END AS start_text
FROM w""",
}

# --- statistics --------------------------------------------------------------------------

STATS_BASE = (EVENT_PACKETS, _windows(STATS), GAPS)
SHIPPED = (SHIPMENT_PACKETS, _windows(SHIPMENTS), GAPS)

SQL |= {
    "time_diff_source": _with(*STATS_BASE)
    + 'SELECT window_index, "Source", parsed_time, sgap / 1e6 AS "Source_time_diff" FROM g',
    "time_diff_destination": _with(*STATS_BASE)
    + 'SELECT window_index, "Destination", parsed_time, dgap / 1e6 AS "Destination_time_diff" FROM g',
    "source_metrics": _with(*STATS_BASE, SENDERS) + "SELECT * FROM s",
    "source_metrics_missing_lengths": _unsized(_with(*STATS_BASE, SENDERS) + "SELECT * FROM s"),
    "destination_metrics": _with(*STATS_BASE, RECEIVERS) + "SELECT * FROM r",
    "stored_features": _with(*STATS_BASE, SENDERS) + "SELECT * FROM s",
    "edges": _with(EVENT_PACKETS, _windows(STATS), EDGES) + "SELECT * FROM e",
    "pane_metrics": _with(*SHIPPED, SENDERS, RECEIVERS)
    + f'SELECT window_index, "IP", {RAW} FROM s FULL JOIN r USING (window_index, "IP")',
    "shipment_edges": _with(SHIPMENT_PACKETS, _windows(SHIPMENTS), EDGES) + "SELECT * FROM e",
    "sender_receiver_join": _with(*STATS_BASE, SENDERS, RECEIVERS)
    + f'SELECT window_index, "IP", {FILLED} FROM s FULL JOIN r USING (window_index, "IP")',
}

# --- graph and features ------------------------------------------------------------------

GRAPH_BASE = (EVENT_PACKETS, _windows(GRAPH), EDGES, NODES)

SQL |= {
    "nodes": _with(*GRAPH_BASE) + 'SELECT window_index, "IP" FROM n',
    "degrees": _with(*GRAPH_BASE, DEGREES) + "SELECT * FROM d",
    "betweenness": _with(*GRAPH_BASE, BETWEENNESS, recursive=True) + "SELECT * FROM cb",
    "eigenvector": _with(*GRAPH_BASE, EIGENVECTOR, recursive=True) + "SELECT * FROM ev",
    "graph_metrics": _with(*GRAPH_BASE, DEGREES, BETWEENNESS, EIGENVECTOR, recursive=True)
    + 'SELECT * FROM d JOIN cb USING (window_index, "IP") JOIN ev USING (window_index, "IP")',
    "features_next_n": _feature_query(_windows(FEATURES, f"cs + 90 * {F_OFF}", "k < 40 AND a <= ce")),
    "features_next": _feature_query(_windows(FEATURES, f"cs + 2 * {F_OFF}", "k < 1")),
    "features_until": _feature_query(
        _windows(FEATURES, f"cs + 7 * {F_OFF}", f"a < cs + 60 * {F_OFF} AND a <= ce")
    ),
    "features_in_period": _feature_query(_windows(FEATURES, f"cs - 3 * {F_OFF}", f"a < cs + 50 * {F_OFF}")),
    "features_remaining": _feature_query(_windows(FEATURES, f"cs + 80 * {F_OFF}", "a < ce")),
    "features_all": _feature_query(_windows(FEATURES)),
    "labelled_features": _feature_query(_windows(FEATURES), IS_BOT),
    "feature_columns": _feature_query(_windows(FEATURES), only_numbers=True),
    "bot_table_label": _with(*GRAPH_BASE)
    + """SELECT window_index, "IP", CASE WHEN "IP" IN (SELECT "Source" FROM p WHERE frame_len > 28000) THEN 1 ELSE 0 END AS "isBot" FROM n""",
    "malicious_packets": _with(EVENT_PACKETS)
    + f"""SELECT "Source", "Destination", parsed_time,
 CASE WHEN "Source" IN ({_bots()}) OR "Destination" IN ({_bots()}) THEN 1 ELSE 0 END AS malicious FROM p""",
}

# --- concepts ----------------------------------------------------------------------------

_PARTS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(EMBEDDING_COLUMNS))
CONCEPTS = f"""
x AS (SELECT label, vec_id % 3 AS batch_id, {_PARTS} FROM embeddings),
u AS (SELECT k AS batch_id, {", ".join(EMBEDDING_COLUMNS)}, 0 AS concept FROM x, range(0, 3) r(k) WHERE label < 5
      UNION ALL SELECT batch_id, {", ".join(EMBEDDING_COLUMNS)}, 1 FROM x WHERE label >= 5)"""

CELLS = """
c AS (SELECT batch_id, count(*) FILTER (concept = 0 AND k = 0) AS c00, count(*) FILTER (concept = 0 AND k = 1) AS c01,
             count(*) FILTER (concept = 1 AND k = 0) AS c10, count(*) FILTER (concept = 1 AND k = 1) AS c11
      FROM (SELECT *, CASE WHEN f0 > f1 THEN 1 ELSE 0 END AS k FROM u) GROUP BY 1)"""

AGREEMENT = """
cells AS (SELECT batch_id, unnest([c00, c01, c10, c11])::DOUBLE AS nij,
   unnest([c00 + c01, c00 + c01, c10 + c11, c10 + c11])::DOUBLE AS a,
   unnest([c00 + c10, c01 + c11, c00 + c10, c01 + c11])::DOUBLE AS b, (c00 + c01 + c10 + c11)::DOUBLE AS n FROM c),
info AS (SELECT batch_id, n, sum(CASE WHEN nij > 0 THEN nij / n * ln(nij * n / (a * b)) ELSE 0 END) AS mi,
   sum(nij * (nij - 1) / 2) AS pairs FROM cells GROUP BY 1, 2),
ha AS (SELECT batch_id, -sum(CASE WHEN a > 0 THEN a / n * ln(a / n) ELSE 0 END) AS hc, sum(a * (a - 1) / 2) AS pc
   FROM (SELECT DISTINCT batch_id, a, n, i FROM (SELECT batch_id, n, unnest([c00 + c01, c10 + c11])::DOUBLE AS a, unnest([0, 1]) AS i
         FROM (SELECT *, (c00 + c01 + c10 + c11)::DOUBLE AS n FROM c))) GROUP BY 1),
hb AS (SELECT batch_id, -sum(CASE WHEN b > 0 THEN b / n * ln(b / n) ELSE 0 END) AS hk, sum(b * (b - 1) / 2) AS pk
   FROM (SELECT batch_id, n, unnest([c00 + c10, c01 + c11])::DOUBLE AS b FROM (SELECT *, (c00 + c01 + c10 + c11)::DOUBLE AS n FROM c)) GROUP BY 1),
terms AS (SELECT batch_id, a, b, n, unnest(range(greatest(1, CAST(a + b - n AS BIGINT)), CAST(least(a, b) AS BIGINT) + 1)) AS k FROM cells),
em AS (SELECT batch_id, sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1)
   - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM terms GROUP BY 1),
m AS (SELECT batch_id, (c00 + c11) / n AS acc, mi / hc AS hom, mi / hk AS com, pairs, pc, pk, pc * pk / (n * (n - 1) / 2) AS chance,
   mi, emi, (hc + hk) / 2 AS norm
   FROM c JOIN info USING (batch_id) JOIN ha USING (batch_id) JOIN hb USING (batch_id) JOIN em USING (batch_id))"""

_F = EMBEDDING_COLUMNS


def _apart(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in _F)


def _averages(table: str) -> str:
    return ", ".join(f"avg({table}.{c}) AS {c}" for c in _F)


def _lloyd(step: int) -> str:
    was = step - 1
    return f"""
l{step} AS (SELECT u.*, CASE WHEN {_apart('u', 'b')} < {_apart('u', 'a')} THEN 1 ELSE 0 END AS near
      FROM u JOIN a{was} a USING (batch_id) JOIN b{was} b USING (batch_id)),
a{step} AS (SELECT batch_id, {_averages(f'l{step}')} FROM l{step} WHERE near = 0 GROUP BY 1),
b{step} AS (SELECT batch_id, {_averages(f'l{step}')} FROM l{step} WHERE near = 1 GROUP BY 1)"""


_LIST = ", ".join(_F)
TWO_MEANS = f"""
mid AS (SELECT batch_id, {_averages('u')} FROM u GROUP BY 1),
a0 AS (SELECT u.batch_id, {", ".join("u." + c for c in _F)} FROM u JOIN mid USING (batch_id)
       QUALIFY row_number() OVER (PARTITION BY u.batch_id ORDER BY {_apart('u', 'mid')} DESC, {", ".join("u." + c for c in _F)}) = 1),
b0 AS (SELECT u.batch_id, {", ".join("u." + c for c in _F)} FROM u JOIN a0 USING (batch_id)
       QUALIFY row_number() OVER (PARTITION BY u.batch_id ORDER BY {_apart('u', 'a0')} DESC, {", ".join("u." + c for c in _F)}) = 1)"""

SQL |= {
    "concept_union": _with(CONCEPTS) + "SELECT * FROM u",
    "contingency": _with(CONCEPTS, CELLS) + "SELECT * FROM c",
    "agreement_metrics": _with(CONCEPTS, CELLS, AGREEMENT)
    + """SELECT batch_id, round(acc, 6) AS accuracy_score, round(hom, 6) AS homogeneity_score, round(com, 6) AS completeness_score,
 round(2 * hom * com / (hom + com), 6) AS v_measure_score,
 round((pairs - chance) / ((pc + pk) / 2 - chance), 6) AS adjusted_rand_score,
 round((mi - emi) / (norm - emi), 6) AS adjusted_mutual_info_score FROM m""",
    "two_means_fixed_steps": _with(CONCEPTS, TWO_MEANS, _lloyd(1), _lloyd(2))
    + f"""SELECT batch_id, concept,
 CASE WHEN ({_apart('u', 'b')} < {_apart('u', 'a')}) <> (({", ".join("b." + c for c in _F)}) < ({", ".join("a." + c for c in _F)})) THEN 1 ELSE 0 END AS cluster,
 count(*) AS n FROM u JOIN a2 a USING (batch_id) JOIN b2 b USING (batch_id) GROUP BY 1, 2, 3""",
    "detector_grid": """SELECT 'KMeans' AS classifier, metric, detector, batch_id
FROM (SELECT unnest(['accuracy_score', 'homogeneity_score', 'completeness_score', 'v_measure_score', 'adjusted_rand_score',
 'adjusted_mutual_info_score']) AS metric),
 (SELECT unnest(['ADWIN', 'DDM', 'EDDM', 'HDDM_A', 'HDDM_W', 'KSWIN', 'PageHinkley']) AS detector),
 (SELECT DISTINCT vec_id % 3 AS batch_id FROM embeddings)""",
}

# --- detectors ---------------------------------------------------------------------------

SERIES = f"""
raw AS (SELECT event_type AS series, value, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {HOUR * US} AS seq FROM events),
x AS (SELECT series, seq, sum(CASE WHEN value > 10 + 20 * ((seq // 120) % 3) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS value
      FROM raw GROUP BY 1, 2)"""


def _numbered(keys: str) -> str:
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS i FROM x)"""


INF = "1e300::DOUBLE"


def _ddm(keys: list[str]) -> str:
    body = f"""
d AS (SELECT {", ".join(keys)}, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS n, 0::DOUBLE AS rate, {INF} AS low, 0::DOUBLE AS dev, 0 AS change
      FROM (SELECT DISTINCT {", ".join(keys)} FROM o)
      UNION ALL
      SELECT {", ".join(keys)}, i, seq, n, rate, low, dev, CASE WHEN n >= 30 AND rate + s > low + 3 * dev THEN 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN hit THEN rate ELSE low0 END AS low, CASE WHEN hit THEN s ELSE dev0 END AS dev
            FROM (SELECT *, coalesce(n >= 30 AND rate + s <= low0 + dev0, false) AS hit
                  FROM (SELECT *, CASE WHEN rate * (1 - rate) >= 0 THEN sqrt(rate * (1 - rate) / n) END AS s
                        FROM (SELECT {", ".join("o." + k for k in keys)}, o.i, o.seq,
                              CASE WHEN change = 1 THEN 1 ELSE n + 1 END AS n,
                              CASE WHEN change = 1 THEN o.value ELSE rate + (o.value - rate) / (n + 1) END AS rate,
                              CASE WHEN change = 1 THEN {INF} ELSE low END AS low0,
                              CASE WHEN change = 1 THEN 0 ELSE dev END AS dev0
                              FROM d JOIN o ON {" AND ".join(f"o.{k} = d.{k}" for k in keys)} AND o.i = d.i + 1) q1) q2) q3) q4)"""
    return body


EDDM = f"""
d AS (SELECT series, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS errors, 0::BIGINT AS last, 0::DOUBLE AS mean,
             0::DOUBLE AS squares, 0::DOUBLE AS highest, 0 AS change FROM (SELECT DISTINCT series FROM o)
      UNION ALL
      SELECT series, i, seq, n, errors, last, mean, squares,
             CASE WHEN hit AND n >= 30 AND reach > highest THEN reach ELSE highest END,
             CASE WHEN hit AND n >= 30 AND reach <= highest AND errors >= 30 AND reach < 0.9 * highest THEN 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN hit THEN mean + 2 * sqrt(squares / errors) ELSE 0 END AS reach
            FROM (SELECT series, i, seq, n, hit, highest, CASE WHEN hit THEN errors0 + 1 ELSE errors0 END AS errors,
                         CASE WHEN hit THEN n ELSE last0 END AS last,
                         CASE WHEN hit THEN mean0 + (gap - mean0) / (errors0 + 1) ELSE mean0 END AS mean,
                         CASE WHEN hit THEN squares0 + (gap - (mean0 + (gap - mean0) / (errors0 + 1))) * (gap - mean0) ELSE squares0 END AS squares
                  FROM (SELECT *, n - last0 AS gap FROM
                        (SELECT o.series, o.i, o.seq, o.value = 1.0 AS hit, CASE WHEN change = 1 THEN 1 ELSE n + 1 END AS n,
                                CASE WHEN change = 1 THEN 0 ELSE errors END AS errors0, CASE WHEN change = 1 THEN 0 ELSE last END AS last0,
                                CASE WHEN change = 1 THEN 0 ELSE mean END AS mean0, CASE WHEN change = 1 THEN 0 ELSE squares END AS squares0,
                                CASE WHEN change = 1 THEN 0 ELSE highest END AS highest
                         FROM d JOIN o ON o.series = d.series AND o.i = d.i + 1) q1) q2) q3) q4)"""

# In HDDM_A and HDDM_W "over" marks any restart, also the quiet one after a fall.
HDDM_A = """
d AS (SELECT series, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS n, 0::DOUBLE AS total, 0::BIGINT AS ln, 0::DOUBLE AS lc, 0::BIGINT AS hn, 0::DOUBLE AS hc,
             false AS over, 0 AS change FROM (SELECT DISTINCT series FROM o)
      UNION ALL
      SELECT series, i, seq, n, total, ln, lc, hn, hc, up OR (hn < n AND sqrt((n - hn) / (hn::DOUBLE * n) / 2 * ln(2 / 0.001)) <= hc / hn - total / n),
             CASE WHEN up THEN 1 ELSE 0 END
      FROM (SELECT *, ln < n AND sqrt((n - ln) / (ln::DOUBLE * n) / 2 * ln(2 / 0.001)) <= total / n - lc / ln AS up
            FROM (SELECT series, i, seq, n, total, CASE WHEN lower THEN n ELSE ln0 END AS ln, CASE WHEN lower THEN total ELSE lc0 END AS lc,
                         CASE WHEN higher THEN n ELSE hn0 END AS hn, CASE WHEN higher THEN total ELSE hc0 END AS hc
                  FROM (SELECT *, lc0 / ln0 + sqrt(ln(1 / 0.001) / (2 * ln0)) >= total / n + sqrt(ln(1 / 0.001) / (2 * n)) AS lower,
                                  hc0 / hn0 - sqrt(ln(1 / 0.001) / (2 * hn0)) <= total / n - sqrt(ln(1 / 0.001) / (2 * n)) AS higher
                        FROM (SELECT o.series, o.i, o.seq, CASE WHEN over THEN 1 ELSE n + 1 END AS n,
                                     CASE WHEN over THEN o.value ELSE total + o.value END AS total,
                                     CASE WHEN over OR n = 0 THEN 1 ELSE ln END AS ln0, CASE WHEN over OR n = 0 THEN o.value ELSE lc END AS lc0,
                                     CASE WHEN over OR n = 0 THEN 1 ELSE hn END AS hn0, CASE WHEN over OR n = 0 THEN o.value ELSE hc END AS hc0
                              FROM d JOIN o ON o.series = d.series AND o.i = d.i + 1) q1) q2) q3) q4)"""


def _ewma(average: str, value: str) -> str:
    return f"coalesce(0.05 * {value} + 0.95 * {average}, {value})"


def _weight(weight: str) -> str:
    return f"coalesce(0.0025 + 0.9025 * {weight}, 1)"


_NONE = "CAST(NULL AS DOUBLE)"
_BOUND = "sqrt({} * ln(1 / 0.001) / 2)"
HDDM_W = f"""
d AS (SELECT series, 0::BIGINT AS i, 0::BIGINT AS seq, {_NONE} AS t, {_NONE} AS tw, {_NONE} AS l, {_NONE} AS lw, {_NONE} AS al, {_NONE} AS alw, {INF} AS lb,
             {_NONE} AS h, {_NONE} AS hw, {_NONE} AS ah, {_NONE} AS ahw, -{INF} AS hb, false AS over, 0 AS change FROM (SELECT DISTINCT series FROM o)
      UNION ALL
      SELECT series, i, seq, t, tw, l, lw, al, alw, lb, h, hw, ah, ahw, hb,
             up OR coalesce(h - ah > {_BOUND.format('(hw + ahw)')}, false), CASE WHEN up THEN 1 ELSE 0 END
      FROM (SELECT *, coalesce(al - l > {_BOUND.format('(lw + alw)')}, false) AS up
            FROM (SELECT series, i, seq, t, tw,
                    CASE WHEN lower THEN t ELSE l0 END AS l, CASE WHEN lower THEN tw ELSE lw0 END AS lw,
                    CASE WHEN lower THEN NULL ELSE {_ewma('al0', 'value')} END AS al, CASE WHEN lower THEN NULL ELSE {_weight('alw0')} END AS alw,
                    CASE WHEN lower THEN t + bound ELSE lb0 END AS lb,
                    CASE WHEN higher THEN t ELSE h0 END AS h, CASE WHEN higher THEN tw ELSE hw0 END AS hw,
                    CASE WHEN higher THEN NULL ELSE {_ewma('ah0', 'value')} END AS ah, CASE WHEN higher THEN NULL ELSE {_weight('ahw0')} END AS ahw,
                    CASE WHEN higher THEN t - bound ELSE hb0 END AS hb
                  FROM (SELECT *, t + bound < lb0 AS lower, t - bound > hb0 AS higher
                        FROM (SELECT *, {_BOUND.format('tw')} AS bound
                              FROM (SELECT o.series, o.i, o.seq, o.value,
                                      {_ewma('CASE WHEN over THEN NULL ELSE t END', 'o.value')} AS t, {_weight('CASE WHEN over THEN NULL ELSE tw END')} AS tw,
                                      CASE WHEN over THEN NULL ELSE l END AS l0, CASE WHEN over THEN NULL ELSE lw END AS lw0,
                                      CASE WHEN over THEN NULL ELSE al END AS al0, CASE WHEN over THEN NULL ELSE alw END AS alw0,
                                      CASE WHEN over THEN {INF} ELSE lb END AS lb0,
                                      CASE WHEN over THEN NULL ELSE h END AS h0, CASE WHEN over THEN NULL ELSE hw END AS hw0,
                                      CASE WHEN over THEN NULL ELSE ah END AS ah0, CASE WHEN over THEN NULL ELSE ahw END AS ahw0,
                                      CASE WHEN over THEN -{INF} ELSE hb END AS hb0
                                    FROM d JOIN o ON o.series = d.series AND o.i = d.i + 1) q1) q2) q3) q4) q5)"""

PAGE_HINKLEY = """
d AS (SELECT series, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS n, 0::DOUBLE AS mean, 0::DOUBLE AS rise, 0 AS change FROM (SELECT DISTINCT series FROM o)
      UNION ALL
      SELECT series, i, seq, n, mean, rise, CASE WHEN n >= 30 AND rise > 5 THEN 1 ELSE 0 END
      FROM (SELECT series, i, seq, n, mean, greatest(0, 0.9999 * rise0 + value - mean - 0.005) AS rise
            FROM (SELECT o.series, o.i, o.seq, o.value, CASE WHEN change = 1 THEN 1 ELSE n + 1 END AS n,
                         CASE WHEN change = 1 THEN o.value ELSE mean + (o.value - mean) / (n + 1) END AS mean,
                         CASE WHEN change = 1 THEN 0 ELSE rise END AS rise0
                  FROM d JOIN o ON o.series = d.series AND o.i = d.i + 1) q1) q2)"""


def _detected(name: str, body: str) -> str:
    return _with(SERIES, _numbered("series"), body, recursive=True) + (
        f"SELECT series, seq, '{name}' AS detector, change FROM d WHERE i > 0"
    )


EPOCHS = SERIES.replace("x AS", "x0 AS") + """,
x AS (SELECT *, (CASE WHEN seq >= 30 THEN 1 ELSE 0 END + CASE WHEN seq >= 500 THEN 1 ELSE 0 END + CASE WHEN seq >= 501 THEN 1 ELSE 0 END)::BIGINT AS epoch FROM x0)"""

SQL |= {
    "ddm": _detected("DDM", _ddm(["series"])),
    "ddm_below_zero": _detected("DDM", _ddm(["series"])).replace("::DOUBLE / count(*) AS value", "::DOUBLE / count(*) * 1.6 - 0.3 AS value"),
    "eddm": _detected("EDDM", EDDM),
    "hddm_a": _detected("HDDM_A", HDDM_A),
    "hddm_w": _detected("HDDM_W", HDDM_W),
    "page_hinkley": _detected("PageHinkley", PAGE_HINKLEY),
    "epoch_reset": _with(EPOCHS, _numbered("series, epoch"), _ddm(["series", "epoch"]), recursive=True)
    + "SELECT series, epoch, seq, 'DDM' AS detector, change FROM d WHERE i > 0",
    "consensus": _with(SERIES, _numbered("series"), _ddm(["series"]), recursive=True)
    + "SELECT seq, max(change) AS consensus FROM d WHERE i > 0 GROUP BY 1",
    "drift_regions": _with(SERIES, _numbered("series"), _ddm(["series"]), recursive=True)
    + f"""SELECT make_timestamp(low) AS region_start, make_timestamp(low + {60 * US}) AS region_end
FROM (SELECT (SELECT min(epoch_us(ts)) FROM events) + seq * {HOUR * US} AS low FROM d WHERE i > 0 GROUP BY seq HAVING max(change) = 1)""",
}

# --- streams -----------------------------------------------------------------------------

# A stream puts out the windows that end no later than the last watermark.
DELAY_US = 600 * US


def _closed(geometry: tuple[int, int]) -> str:
    return _windows(geometry, "cs", f"a + {geometry[0] * US} <= ce - {DELAY_US}")


SQL |= {
    "stream_window_stats": _with(EVENT_PACKETS, _closed(STATS), GAPS, SENDERS, RECEIVERS)
    + """SELECT window_index, make_timestamp(ws) AS window_start, make_timestamp(we) AS window_end, "IP",
 coalesce("Spc", 0) AS "Spc", "Tss", "Smin", "Smax", "Savg", "Svar", coalesce("Rpc", 0) AS "Rpc", "Tsr", "Ravg", "Rvar"
FROM s FULL JOIN r USING (window_index, "IP") JOIN w USING (window_index)""",
    "stream_edges": _with(EVENT_PACKETS, _closed(GRAPH), EDGES)
    + """SELECT window_index, make_timestamp(ws) AS window_start, make_timestamp(we) AS window_end, "Source", "Destination", "count"
FROM e JOIN w USING (window_index)""",
    "stream_inter_arrival": _with(
        EVENT_PACKETS,
        _windows(STATS, "cs", f"a < ce - {DELAY_US} - {STATS[0] * US} - {US}"),
        GAPS, SENDERS, RECEIVERS,
    )
    + f'SELECT window_index, "IP", {RAW} FROM s FULL JOIN r USING (window_index, "IP")',
    "stream_detectors": _with(SERIES, _numbered("series"), _ddm(["series"]).replace("\nd AS", "\nd1 AS").replace("FROM d JOIN", "FROM d1 d JOIN"),
                              HDDM_A, recursive=True)
    + """SELECT series, seq, 'DDM' AS detector, change FROM d1 WHERE i > 0
UNION ALL SELECT series, seq, 'HDDM_A', change FROM d WHERE i > 0""",
}

SQL["stream_window_stats_missing_lengths"] = _unsized(SQL["stream_window_stats"])
SQL["detector_state_calls"] = SQL["stream_detectors"]
SQL["stream_features"] = _feature_query(
    _windows(FEATURES, "cs", f"a < ce - {DELAY_US} - {2 * FEATURES[0] * US}")
)

SQL["packets_csv_bad_lines"] = _with(EVENT_PACKETS) + """SELECT "Protocol", count(*) AS n_lines,
 count(*) FILTER ("Protocol" IN ('click', 'error', 'signup')) AS n_bad,
 CAST(sum(frame_len) FILTER ("Protocol" NOT IN ('click', 'error', 'signup')) AS BIGINT) AS good_length
FROM p GROUP BY 1"""


# --- clusters from several starts ---------------------------------------------------------

STARTS, STEPS = 3, 40


def _settled() -> str:
    """Every start of every batch goes on, step by step, with averages over the long table of components."""
    cells = ", ".join(_F)
    start = """c0 AS MATERIALIZED (
  SELECT batch_id, 0 AS start, 0 AS side, i, v FROM far JOIN cell USING (batch_id, r) WHERE side = 0
  UNION ALL SELECT batch_id, 0, 1, i, v FROM far JOIN cell USING (batch_id, r) WHERE side = 1
  UNION ALL SELECT batch_id, start, side, i, v FROM ends JOIN cell USING (batch_id, r))"""
    steps = []
    for n in range(STEPS):
        steps.append(f"""
n{n} AS MATERIALIZED (SELECT batch_id, start, r, CASE WHEN max(d) FILTER (side = 1) < max(d) FILTER (side = 0) THEN 1 ELSE 0 END AS side, min(d) AS d
  FROM (SELECT batch_id, start, side, r, sum((cell.v - c.v) * (cell.v - c.v)) AS d FROM cell JOIN c{n} c USING (batch_id, i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
c{n + 1} AS MATERIALIZED (SELECT o.batch_id, o.start, o.side, o.i, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
  SELECT batch_id, start, side, i, avg(v) AS v FROM n{n} JOIN cell USING (batch_id, r) GROUP BY 1, 2, 3, 4) m
  ON m.batch_id = o.batch_id AND m.start = o.start AND m.side = o.side AND m.i = o.i)""")
    last = STEPS - 1
    return f"""
ur AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM u),
cell AS MATERIALIZED (SELECT batch_id, r, i, v FROM (SELECT batch_id, r, unnest(range({len(_F)})) AS i, unnest([{cells}]) AS v FROM ur)),
mean AS (SELECT batch_id, i, avg(v) AS v, var_pop(v) AS s FROM cell GROUP BY 1, 2),
far0 AS MATERIALIZED (SELECT batch_id, r FROM (SELECT batch_id, r, sum((cell.v - mean.v) * (cell.v - mean.v)) AS d FROM cell JOIN mean USING (batch_id, i) GROUP BY 1, 2)
  JOIN ur USING (batch_id, r) QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY d DESC, {cells}) = 1),
far1 AS (SELECT batch_id, r FROM (SELECT cell.batch_id, cell.r, sum((cell.v - o.v) * (cell.v - o.v)) AS d FROM cell JOIN far0 ON cell.batch_id = far0.batch_id
  JOIN cell o ON o.batch_id = far0.batch_id AND o.r = far0.r AND o.i = cell.i GROUP BY 1, 2)
  JOIN ur USING (batch_id, r) QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY d DESC, {cells}) = 1),
far AS (SELECT batch_id, r, 0 AS side FROM far0 UNION ALL SELECT batch_id, r, 1 FROM far1),
widest AS (SELECT batch_id, i, row_number() OVER (PARTITION BY batch_id ORDER BY s DESC, i) AS start FROM mean QUALIFY start < {STARTS}),
ends AS MATERIALIZED (
  SELECT batch_id, start, 0 AS side, r FROM widest JOIN cell USING (batch_id, i) JOIN ur USING (batch_id, r)
    QUALIFY row_number() OVER (PARTITION BY batch_id, start ORDER BY v, {cells}) = 1
  UNION ALL
  SELECT batch_id, start, 1, r FROM widest JOIN cell USING (batch_id, i) JOIN ur USING (batch_id, r)
    QUALIFY row_number() OVER (PARTITION BY batch_id, start ORDER BY v DESC, {", ".join(c + " DESC" for c in _F)}) = 1),
{start},{",".join(steps)},
won AS (SELECT batch_id, start FROM (SELECT batch_id, start, round(sum(d), 6) AS inertia FROM n{last} GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY inertia, start) = 1),
shape AS (SELECT batch_id, side, list(v ORDER BY i) AS point FROM c{last} JOIN won USING (batch_id, start) GROUP BY 1, 2),
turned AS (SELECT a.batch_id, b.point < a.point AS swap FROM shape a JOIN shape b ON a.batch_id = b.batch_id AND a.side = 0 AND b.side = 1)"""


SQL["two_means_starts"] = _with(CONCEPTS, _settled()) + f"""SELECT batch_id, concept, CASE WHEN swap THEN 1 - side ELSE side END AS cluster, count(*) AS n
FROM n{STEPS - 1} JOIN won USING (batch_id, start) JOIN ur USING (batch_id, r) JOIN turned USING (batch_id) GROUP BY 1, 2, 3"""

SQL["user_metrics"] = _with(CONCEPTS, CELLS, AGREEMENT) + """, six AS (SELECT batch_id, acc AS accuracy_score, hom AS homogeneity_score,
 com AS completeness_score, 2 * hom * com / (hom + com) AS v_measure_score, (pairs - chance) / ((pc + pk) / 2 - chance) AS adjusted_rand_score,
 (mi - emi) / (norm - emi) AS adjusted_mutual_info_score FROM m),
pair AS (SELECT l.batch_id, count(*) FILTER (l.concept = r.concept) AS same_concept,
  count(*) FILTER ((l.f0 > l.f1) = (r.f0 > r.f1)) AS same_cluster,
  count(*) FILTER (l.concept = r.concept AND (l.f0 > l.f1) = (r.f0 > r.f1)) AS same_both
  FROM (SELECT *, row_number() OVER () AS k FROM u) l JOIN (SELECT *, row_number() OVER () AS k FROM u) r ON l.batch_id = r.batch_id AND l.k < r.k GROUP BY 1)
SELECT batch_id, metric, round(value, 6) AS value FROM (UNPIVOT six ON COLUMNS(* EXCLUDE batch_id) INTO NAME metric VALUE value)
UNION ALL SELECT batch_id, 'fowlkes_mallows', round(same_both / sqrt(same_concept::DOUBLE * same_cluster), 6) FROM pair
UNION ALL SELECT batch_id, 'n_rows', count(*)::DOUBLE FROM u GROUP BY 1"""

"""Column names and schemas shared by the whole package."""

from pyspark.sql import types as T

# The columns of the packet CSV and the short names used after reading.
PACKET_COLUMNS = {
    "frame.time": "time",
    "frame.time_epoch": "time_epoch",
    "_ws.col.Source": "Source",
    "_ws.col.Destination": "Destination",
    "_ws.col.Protocol": "Protocol",
    "frame.len": "frame_len",
}

# The feature columns, sender side, receiver side, traffic graph.
SOURCE_METRICS = [
    "Spc", "Tss", "Smin", "Smax", "Savg", "Svar", "SITmin", "SITmax", "SITavg", "SITvar",
]
DESTINATION_METRICS = ["Rpc", "Tsr", "Ravg", "Rvar", "RITmin", "RITmax", "RITavg", "RITvar"]
GRAPH_METRICS = ["in_degree", "out_degree", "centrality", "eigenvector_centrality"]
FEATURES = SOURCE_METRICS + DESTINATION_METRICS + GRAPH_METRICS
META_COLUMNS = ["IP", "isBot", "window_start", "window_end", "window_index"]

_LONGS = {"Spc", "Tss", "Rpc", "Tsr", "in_degree", "out_degree"}
_INTS = {"Smin", "Smax"}


def packet_schema() -> T.StructType:
    """Schema of the packet CSV: text, except the epoch seconds and the frame length."""
    kinds = {"frame.time_epoch": T.DoubleType(), "frame.len": T.IntegerType()}
    return T.StructType(
        [T.StructField(name, kinds.get(name, T.StringType())) for name in PACKET_COLUMNS]
    )


def feature_schema(labelled: bool = False) -> T.StructType:
    """Schema of the feature table: one row per window and address."""

    def kind(name: str) -> T.DataType:
        if name in _LONGS:
            return T.LongType()
        return T.IntegerType() if name in _INTS else T.DoubleType()

    fields = [T.StructField("IP", T.StringType())]
    fields += [T.StructField(name, kind(name)) for name in FEATURES]
    fields += [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("window_index", T.LongType()),
    ]
    if labelled:
        fields.append(T.StructField("isBot", T.IntegerType()))
    return T.StructType(fields)

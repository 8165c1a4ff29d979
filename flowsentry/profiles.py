"""Dataset profiles: the feature contract, categoricals, preview columns and label rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Model names in their display order, and the spellings used in
# result documents for the two that are abbreviated in tables.
MODEL_ORDER = ("Random Forest", "Logistic Regression", "Linear SVM", "kNN", "ANN")
COMPARE_ALL = "Compare all models"
DOCUMENT_NAMES = {"k-Nearest Neighbors": "kNN", "Artificial Neural Network": "ANN"}
DOCUMENT_NAME_OF = {short: long for long, short in DOCUMENT_NAMES.items()}

# Seeds of the repeated study, in run order.
STUDY_SEEDS = (42, 13, 2027, 21, 8)

# The ordered raw columns each dataset must provide.
CICIDS2017_FEATURES = (
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean",
    "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean",
    "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Fwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance", "FIN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "ECE Flag Count", "Down/Up Ratio",
    "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Subflow Fwd Bytes", "Subflow Bwd Bytes", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward", "Active Mean",
    "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)
UNSW_NB15_FEATURES = (
    "dur", "proto", "service", "state", "spkts", "dpkts", "sbytes", "dbytes", "rate",
    "sttl", "dttl", "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit",
    "swin", "stcpb", "dtcpb", "dwin", "tcprtt", "synack", "ackdat", "smean", "dmean",
    "trans_depth", "response_body_len", "ct_srv_src", "ct_state_ttl", "ct_dst_ltm",
    "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "is_ftp_login", "ct_ftp_cmd",
    "ct_flw_http_mthd", "ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports",
)


@dataclass(frozen=True)
class FlowProfile:
    """What one kind of flow table looks like.

    ``normal_value`` is the raw label of harmless traffic; ``None`` means the label
    column already holds 0/1.
    """

    name: str
    artifact: str
    features: tuple[str, ...]
    categoricals: tuple[str, ...] = ()
    preview: tuple[str, ...] = ()
    label: str = "label"
    normal_value: str | None = None

    @property
    def numerics(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if f not in self.categoricals)

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(f, T.StringType() if f in self.categoricals else T.DoubleType())
             for f in self.features]
        )


CICIDS2017 = FlowProfile(
    name="CICIDS2017",
    artifact="CICIDS2017",
    features=CICIDS2017_FEATURES,
    preview=("Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets"),
    label="Label",
    normal_value="BENIGN",
)
UNSW_NB15 = FlowProfile(
    name="UNSW-NB15",
    artifact="UNSW_NB15",
    features=UNSW_NB15_FEATURES,
    categoricals=("proto", "service", "state"),
    preview=("proto", "service", "state", "dur", "sbytes", "dbytes"),
    label="label",
)
PROFILES = {p.name: p for p in (CICIDS2017, UNSW_NB15)}


def load_profile(name: str) -> FlowProfile:
    """Look a profile up by display name or by artifact prefix."""
    for profile in PROFILES.values():
        if name in (profile.name, profile.artifact):
            return profile
    raise KeyError(f"unknown dataset {name!r}; known: {sorted(PROFILES)}")


def read_feature_contract(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Read an ordered feature contract from a file holding one JSON array of names."""
    row = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", T.ArrayType(T.StringType())).alias("names"))
        .head()
    )
    if row is None or not row.names:
        raise ValueError(f"{path} holds no JSON array of column names")
    return tuple(row.names)


def normalise_model_name(column: str = "model"):
    """Long model names of result documents to the short ones used in tables."""
    mapping = F.create_map(*[F.lit(x) for pair in DOCUMENT_NAMES.items() for x in pair])
    return F.coalesce(mapping[F.col(column)], F.col(column))


def binarise_label(df: DataFrame, profile: FlowProfile, output: str = "label") -> DataFrame:
    """Derive the 0/1 label: anything but normal traffic is an attack."""
    raw = F.col(f"`{profile.label}`")
    if profile.normal_value is None:
        return df.withColumn(output, raw.cast("int"))
    return df.withColumn(output, (F.trim(raw) != profile.normal_value).cast("int"))

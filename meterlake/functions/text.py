"""Masking and report text as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beginnings of meter ids in free text; a deployment passes its own.
ID_PREFIXES = ("MTR", "SM", "METER")
MASKED = "[masked-meter]"
REDACTED = "[redacted]"
METER_NAMES = ("meterid", "meter_id")
HIDDEN_NAMES = ("consumer_id", "consumerid", "address", "mapsurl", "latitude", "longitude", "lat", "lon")
LIST_LIMIT = 80

# Plain names of features
FEATURE_NAMES = {
    "kwh_lag_96": "consumption vs. yesterday same hour",
    "kwh_lag_672": "consumption vs. last week same hour",
    "z_vs_peer": "deviation from peer group",
    "load_factor_day": "daily load factor (avg/peak)",
    "night_ratio": "night-time vs day-time usage ratio",
    "is_flatline": "consecutive zero-variance readings",
    "peer_dev_ratio": "ratio to peer group mean",
    "roll_mean_96": "24-hour rolling average",
    "roll_std_96": "24-hour consumption volatility",
    "upstream_loss_ratio": "feeder energy balance deficit",
    "power_factor_computed": "power factor (physics check)",
    "temp_c": "ambient temperature",
    "is_holiday": "holiday flag",
    "kwh_delta_1d": "day-over-day change rate",
    "cumulative_rollback": "cumulative meter rollback detected",
    "gnn_node_score": "graph-level anomaly (topology check)",
    "feeder_load_share": "share of feeder's total load",
}


def id_pattern(prefixes: Sequence[str] = ID_PREFIXES) -> str:
    """A word that begins with one of the prefixes, without look-ahead: a group for the first three characters and one
    for the last two of each kind."""
    kinds = []
    for p in prefixes:
        head = re.escape(p[:3]) + "[A-Z0-9_-]" * (3 - len(p[:3]))
        rest = re.escape(p[3:]) + ("[A-Z0-9_-]+" if len(p) >= 3 else "[A-Z0-9_-]*")
        kinds.append(f"({head}){rest}([A-Z0-9-]{{2}})")
    return rf"(?i)\b(?:{'|'.join(kinds)})\b"


def id_replacement(prefixes: Sequence[str] = ID_PREFIXES, mark: str = "$") -> str:
    odd = "".join(f"{mark}{2 * i + 1}" for i in range(len(prefixes)))
    return odd + "..." + "".join(f"{mark}{2 * i + 2}" for i in range(len(prefixes)))


def mask_text(c: Column, prefixes: Sequence[str] = ID_PREFIXES) -> Column:
    """Ids in a text keep their first three and last two characters."""
    return F.regexp_replace(c, id_pattern(prefixes), id_replacement(prefixes))


def mask_id(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) <= 4, MASKED).otherwise(F.concat(F.substring(s, 1, 3), F.lit("..."), F.right(s, F.lit(2))))


def _hide(name: str, c: Column, kind: T.DataType, limit: int | None) -> Column:
    low = name.lower()
    if low in METER_NAMES:
        return mask_id(c)
    if low in HIDDEN_NAMES:
        return F.lit(REDACTED)
    if isinstance(kind, T.StructType):
        return F.struct(*[_hide(f.name, c[f.name], f.dataType, limit).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        shown = c if limit is None else F.slice(c, 1, limit)
        return F.transform(shown, lambda x: _hide("", x, kind.elementType, limit))
    if isinstance(kind, T.StringType):
        return mask_text(c)
    return c


def redact(df: DataFrame, limit: int | None = LIST_LIMIT) -> DataFrame:
    """Rewrite every column by its name and type: ids masked, places hidden, free text scanned for ids.

    Lists show their first ``limit`` items, all of them with None.
    """
    return df.select(*[_hide(f.name, F.col(f.name), f.dataType, limit).alias(f.name) for f in df.schema.fields])


def feature_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FEATURE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), F.replace(c, F.lit("_"), F.lit(" ")))


def grouped(c: Column) -> Column:
    """Whole number with thousands separators, halves away from zero."""
    return F.format_string("%,d", F.floor(c + F.lit(0.5)))


def decimals(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)

"""Role-dependent views. The schema is walked once; at run time it is a single projection."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import SENSITIVE_KEYS, VIEWER_HIDDEN_DETECTION_KEYS

MASK = "[REDACTED]"


def _masked(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_field(value[f.name], f.name, f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda x: _masked(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        cover = F.lit(MASK if isinstance(kind.valueType, T.StringType) else None)
        return F.transform_values(value, lambda k, v: F.when(
            F.lower(k).isin(SENSITIVE_KEYS), cover).otherwise(_masked(v, kind.valueType)))
    return value


def _field(value: Column, name: str, kind: T.DataType) -> Column:
    return F.lit(MASK) if name.lower() in SENSITIVE_KEYS else _masked(value, kind)


def _hide(node):
    if isinstance(node, dict):
        return {k: MASK if k.lower() in SENSITIVE_KEYS else _hide(v) for k, v in node.items()}
    return [_hide(x) for x in node] if isinstance(node, list) else node


def _masked_json(text: str | None) -> str | None:
    """The text with sensitive keys masked; a text that is no JSON may hold anything, so it is masked whole."""
    if text is None:
        return None
    try:
        return json.dumps(_hide(json.loads(text)), ensure_ascii=False)
    except ValueError:
        return MASK


@F.pandas_udf(T.StringType())
def _mask_json(texts: pd.Series) -> pd.Series:
    return texts.map(_masked_json)


def redact(df: DataFrame, json_columns: Sequence[str] = ()) -> DataFrame:
    """Mask every sensitive key at any depth, also inside JSON text columns."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        out.append((_mask_json(col) if f.name in json_columns and f.name.lower() not in SENSITIVE_KEYS
                    else _field(col, f.name, f.dataType)).alias(f.name))
    return df.select(*out)


def redact_for_role(df: DataFrame, role: str, kind: str = "alerts",
                    json_columns: Sequence[str] = ()) -> DataFrame:
    """View of ``kind`` (alerts, actions, local_security or detections) for a role.

    Admins see everything. Analysts see masked alerts and detections, viewers masked detections
    without three keys. Response actions and host inventory are for admins only.
    """
    if role == "admin":
        return df
    if kind in ("actions", "local_security") or (kind == "alerts" and role == "viewer"):
        return df.where(F.lit(False))
    if kind == "detections" and role == "viewer":
        df = df.drop(*VIEWER_HIDDEN_DETECTION_KEYS)
    return redact(df, json_columns)

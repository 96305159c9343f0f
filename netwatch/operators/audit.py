"""Queries over the append-only audit log."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import AUDIT_HASH_COLUMNS


def query_audit(events: DataFrame, action: str | None = None, since: float | None = None,
                limit: int = 100) -> DataFrame:
    """Newest events first; the limit is kept within 1..500."""
    if action:
        events = events.where(F.col("action") == action)
    if since is not None:
        events = events.where(F.col("occurred_at") >= since)
    return events.orderBy(F.desc("occurred_at"), F.desc("seq")).limit(max(1, min(limit, 500)))


@F.pandas_udf(T.StringType())
def _event_hash(rows: pd.DataFrame) -> pd.Series:
    # JSON text of floats and non-ASCII characters differs between the JVM and the writer of the
    # log, so the canonical form is rendered here, one Arrow batch at a time.
    def one(values):
        payload = {n: None if v is None or v != v else v for n, v in zip(rows.columns, values)}
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode("utf-8")).hexdigest()
    return pd.Series([one(v) for v in rows.itertuples(index=False, name=None)])


def check_audit_chain(events: DataFrame) -> DataFrame:
    """Per event, whether it links to its predecessor and whether its hash matches its content.

    The predecessor is met by an equi-join on the sequence number, which spreads over tasks; a global
    ``lag`` would need one.
    """
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_expected"),
                           F.lit(True).alias("_has"))
    first = F.col("_has").isNull()
    # Only a chain's first event may lack both a predecessor and a previous hash.
    linked = F.when(first, F.col("previous_hash").isNull()).otherwise(
        F.col("previous_hash").eqNullSafe(F.col("_expected")))
    return events.join(before, "seq", "left").withColumns({
        "link_ok": linked,
        "hash_ok": F.col("event_hash") == _event_hash(F.struct(*AUDIT_HASH_COLUMNS)),
    }).drop("_expected", "_has")


def verify_audit_chain(events: DataFrame) -> DataFrame:
    """The events at which the chain breaks; an empty result means the log is intact."""
    return check_audit_chain(events).where(~(F.col("link_ok") & F.coalesce("hash_ok", F.lit(False))))

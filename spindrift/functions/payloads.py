"""JSON payloads of any shape, in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parts of the names of fields that are not written to logs, and what stands for them.
SENSITIVE = ("api_key", "authorization", "password", "question", "secret", "token")
MARK = "[REDACTED]"


def without_secrets(value):
    """The value with every field of a sensitive name, at any depth, replaced by the mark."""
    if isinstance(value, dict):
        return {str(k): MARK if any(s in str(k).lower() for s in SENSITIVE) else without_secrets(v) for k, v in value.items()}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def _redacted(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else json.dumps(without_secrets(json.loads(p)), ensure_ascii=False, separators=(",", ":")))


def redacted(payload: Column) -> Column:
    """A JSON text without what its sensitive fields hold; only payloads that name such a field go to Python.

    Texts that are no JSON become null, as there is no telling what they hold; null stays null.
    """
    valid = F.when(F.try_parse_json(payload).isNotNull(), payload)
    hit = F.rlike(F.lower(valid), F.lit("|".join(SENSITIVE)))
    return F.when(hit, _redacted(F.when(hit, valid))).otherwise(valid)

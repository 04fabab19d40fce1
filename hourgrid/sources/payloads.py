"""Provider payloads landed as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid import schemas
from hourgrid.functions import scalar as S


def classify_envelope(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the parsed rows, ``outcome`` (success, no data, error) and the error ``message``.

    A missing header or status means success. A status other than success means no data where it or
    the message contains one of the known phrases, otherwise an error.
    """
    header: Column = F.get(F.col("_e.Header"), F.lit(0))
    status = F.coalesce(header["status"], F.lit("Success"))
    message = F.coalesce(header["error"], header["message"], status)
    quiet = reduce(lambda a, b: a | b, (
        F.lower(text).contains(phrase) for text in (message, status) for phrase in C.NO_DATA_PHRASES
    ))
    outcome = (
        F.when(F.col("_e").isNull(), F.lit("error"))
        .when(status == "Success", F.lit("success")).when(quiet, F.lit("no data")).otherwise(F.lit("error"))
    )
    parsed = S.with_json(payloads, "_e", payload, schemas.ENVELOPE)
    return parsed.withColumns({
        "outcome": outcome,
        "message": F.when(F.col("_e").isNull(), F.lit("unreadable payload")).when(outcome != "success", message),
        "_rows": F.when(outcome == "success", F.col("_e.Data")),
    }).drop("_e")


def unwrap_envelope(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Rows of the successful payloads, and the failed payloads with their message."""
    classified = classify_envelope(payloads, payload)
    keys = [c for c in payloads.columns if c != payload]
    rows = classified.filter(F.col("outcome") == "success").select(*keys, F.inline("_rows"))
    return rows, classified.filter(F.col("outcome") == "error").select(*keys, "message")

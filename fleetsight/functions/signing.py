"""Keyed record signatures over canonical JSON text."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_sha256(payload: Column, secret: str) -> Column:
    """Hex SHA-256 of payload followed by the secret (built-in, no Python)."""
    return F.sha2(F.concat(payload, F.lit(secret)), 256)


def _canonical(text: str | None, drop: str | None) -> tuple[str | None, object]:
    """Key-sorted JSON text of an object and the value of the dropped field."""
    try:
        record = json.loads(text)
    except (TypeError, ValueError):
        return None, None
    if not isinstance(record, dict):
        return None, None
    dropped = record.pop(drop, None) if drop else None
    return json.dumps(record, sort_keys=True), dropped


def canonical_json(raw: Column, drop: str | None = None) -> Column:
    """Key-sorted JSON text of the *raw line*.

    Spark's JSON functions print floats in another notation, so byte-exact text needs the
    Python encoder; it runs as an Arrow-batched UDF on the one text column.
    """

    @F.pandas_udf("string")
    def render(lines: pd.Series) -> pd.Series:
        return lines.map(lambda t: _canonical(t, drop)[0])

    return render(raw)


def sign_line(raw: Column, secret: str) -> Column:
    """Signature of an unsigned raw line: canonical text in Python, hashing in the JVM."""
    return keyed_sha256(canonical_json(raw, drop="signature"), secret)


def verify_signature(raw: Column, secret: str) -> Column:
    """True when the line's ``signature`` matches its content; missing means mismatch.

    Only canonicalization is Python. The claimed signature comes along in the same UDF call
    so that each line is parsed once there; hashing and comparing are built-in.
    """

    @F.pandas_udf("canonical string, claimed string")
    def split(lines: pd.Series) -> pd.DataFrame:
        parts = [_canonical(t, "signature") for t in lines]
        return pd.DataFrame(
            {
                "canonical": [p[0] for p in parts],
                "claimed": [p[1] if isinstance(p[1], str) else None for p in parts],
            }
        )

    parts = split(raw)
    return F.coalesce(
        keyed_sha256(parts["canonical"], secret) == parts["claimed"], F.lit(False)
    )


def sign_text(text: str, secret: str) -> str:
    """Driver-side twin for building fixtures."""
    return hashlib.sha256((text + secret).encode()).hexdigest()

"""Masking of secret-looking settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The replacement text and the setting names treated as secret.
HIDDEN = "[HIDDEN]"
SECRET_NAME_PATTERN = (
    r"(?i)(password|passwd|passphrase|(^|[._-])(pwd|pass)([._-]|$)|secret|token|credential"
    r"|(api|private|access|account|signing|encryption|shared|storage|master)[._-]?key)"
)


def mask_secret(name: Column, value: Column, pattern: str = SECRET_NAME_PATTERN) -> Column:
    """``value``, or ``[HIDDEN]`` when ``name`` looks like a secret (NULL values stay NULL)."""
    return F.when(name.rlike(pattern) & value.isNotNull(), F.lit(HIDDEN)).otherwise(value)

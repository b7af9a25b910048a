"""The whole HTML entity table, from the standard library, over Arrow batches."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A reference that its semicolon closes; names are looked up.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def _decoded(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0]


@F.pandas_udf(StringType())
def html_unescape_closed(texts: pd.Series) -> pd.Series:
    """Only references closed by a semicolon: one that a cut title left open (`&amp` before a tag) stays as it stands."""
    return texts.map(lambda t: None if t is None else _CLOSED.sub(_decoded, t))

"""Table adapter: any (key, text) table becomes ``source_files``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_as_source(df: DataFrame, key: str | Column, text: str | Column, prefix: str,
                    language: str | Column = "python", ext: str = "txt") -> DataFrame:
    """source_files(path, language, content) from a text table.

    path = '<prefix>/<key>.<ext>'.  The language decides which fact rules run
    on the rows ('rust' or any language without fact rules = fallback only).
    """
    k = F.col(key) if isinstance(key, str) else key
    t = F.col(text) if isinstance(text, str) else text
    lang = F.lit(language) if isinstance(language, str) else language
    return df.select(F.concat(F.lit(prefix + "/"), k.cast("string"), F.lit("." + ext)).alias("path"),
                     lang.alias("language"), F.coalesce(t, F.lit("")).alias("content"))

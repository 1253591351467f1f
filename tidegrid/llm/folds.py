"""Which rows a model may learn from, by a remainder of their id's checksum; names that a table does not use."""

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id reads as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def unused_names(df: DataFrame, *stems: str) -> list[str]:
    """The given names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out

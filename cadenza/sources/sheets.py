"""Text sheets to line tables.

A sheet is one row, so its lines are cut, labelled and numbered inside the row with array
functions: the corpus is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import SPACE, let, trimmed

INLINE_SPACE = SPACE.replace("\\n", "")
LINE_CHAR = "[^\\n\\r\\x{2028}\\x{2029}]"

# The line forms of a sheet.
SECTION = f"^\\[({LINE_CHAR}+)\\]{INLINE_SPACE}*$"
HEADER = f"^##{SPACE}*([Tt][Ii][Tt][Ll][Ee]|[Aa][Rr][Tt][Ii][Ss][Tt]){SPACE}*:{SPACE}*({LINE_CHAR}+)$"
STAMP = f"^\\[[0-9]{{1,2}}:[0-9]{{2}}([.:][0-9]{{1,3}})?\\]{SPACE}*"


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _labelled(block: Column) -> Column:
    """Lines of one block; a block starts with its section mark, if it has one."""

    def rows(lines: Column, section: Column) -> Column:
        kept = F.filter(lines, lambda x: ~x.rlike(SECTION) & ~x.rlike(HEADER))
        texts = F.transform(kept, lambda x: trimmed(F.regexp_replace(x, STAMP, "")))
        return F.transform(
            texts,
            lambda t: F.struct(t.alias("text"), section.alias("section"), (t == "").alias("instrumental")),
        )

    def with_section(lines: Column) -> Column:
        mark = F.when(lines[0].rlike(SECTION), trimmed(F.regexp_extract(lines[0], SECTION, 1)))
        return let(mark, lambda section: rows(lines, section))

    return let(F.split(block, "\n"), with_section)


def parsed_lines(text: Column) -> Column:
    """Array of ``(text, section, instrumental)``, blank rows trimmed at both ends."""
    blocks = F.split(unix_lines(text), f"\\n(?=\\[{LINE_CHAR}+\\]{INLINE_SPACE}*(\\n|$))")
    return F.flatten(F.transform(blocks, _labelled))


def sheet_lines(docs: DataFrame) -> DataFrame:
    """``docs[doc_id, text]`` -> ``[doc_id, idx, text, section, instrumental]``."""
    sung = F.transform("__rows", lambda r: ~r["instrumental"])
    first = F.array_position(sung, True)
    last = F.size("__rows") - F.array_position(F.reverse(sung), True) + 1
    kept = F.when(first > 0, F.slice("__rows", first.cast("int"), (last - first + 1).cast("int")))
    return (
        docs.select("doc_id", parsed_lines(F.col("text")).alias("__rows"))
        .select("doc_id", F.posexplode(kept))
        .select("doc_id", F.col("pos").cast("bigint").alias("idx"), "col.*")
    )


def sheet_headers(docs: DataFrame) -> DataFrame:
    """Title and artist of each sheet; the last header of a kind wins."""
    headers = F.filter(F.split(unix_lines(F.col("text")), "\n"), lambda x: x.rlike(HEADER))

    def last(kind: str) -> Column:
        of_kind = F.filter(
            "__headers", lambda x: F.lower(F.regexp_extract(x, HEADER, 1)) == kind
        )
        return trimmed(F.regexp_extract(F.try_element_at(of_kind, F.lit(-1)), HEADER, 2)).alias(kind)

    return docs.withColumn("__headers", headers).select("doc_id", last("title"), last("artist"))

"""Compatibility decomposition to plain ASCII, entirely inside the JVM.

Spark has no function for the NFKD form. Since every non-ASCII character is dropped after the
decomposition, the result is a per-character substitution. The substitution tables are derived
from the Unicode data of the Python standard library when the plan is built.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def substitutions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that leave one ASCII character behind, and those that leave several."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        left = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(left) == 1:
            single[char] = left
        elif left:
            several[char] = left
    return single, several


def ascii_fold(col: Column) -> Column:
    """Decompose and drop what is not ASCII: ``São`` to ``Sao``, ``ﬁ`` to ``fi``, ``ß`` to nothing.

    A text is cut around its other characters, which are looked up one by one; what lies between stays as it is.
    """
    single, several = substitutions()
    table = F.create_map(*[F.lit(part) for pair in several.items() for part in pair])

    def folded(piece: Column) -> Column:
        # the membership test is a hash lookup, the map is searched entry by entry
        expanded = F.when(piece.isin(list(several)), F.try_element_at(table, piece)).otherwise(
            F.translate(piece, "".join(single), "".join(single.values())))
        return F.when(F.ascii(piece) < 128, piece).when(F.ascii(expanded) < 128, expanded).otherwise("")

    # never between the two halves of a character beyond the first plane
    pieces = F.split(col, rf"(?![\x{{DC00}}-\x{{DFFF}}])(?:(?<={_OTHER})|(?={_OTHER}))")
    return F.when(col.rlike(_OTHER), F.array_join(F.transform(pieces, folded), "")).otherwise(col)

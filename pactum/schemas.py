"""Row shapes and closed value sets.

Severity is ordered, so it is compared by rank, never as a string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from least to most, with the points each is worth.
SEVERITIES = ("BILGI", "DUSUK", "ORTA", "YUKSEK", "KRITIK")
POINTS = {"KRITIK": 5.0, "YUKSEK": 3.0, "ORTA": 1.5, "DUSUK": 0.6, "BILGI": 0.0}
#: Obligations of a clause type, finding types, kinds of change.
OBLIGATIONS = ("ZORUNLU", "ONERILEN", "OPSIYONEL", "YASAK")
FINDING_TYPES = ("MISSING", "WEAK", "ONE_SIDED", "RED_LINE", "AMBIGUOUS", "INTERNAL_CONFLICT", "CROSS_REF_ERROR", "DRAFTING_DEFECT", "INFO")
CHANGES = ("EKLENDI", "SILINDI", "DEGISTI", "TASINDI", "AYNI")


def severity_rank(severity: Column) -> Column:
    """0 for the least severe; null for a value that is none of the five."""
    return F.when(severity.isin(*SEVERITIES), F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1)


def severity_points(severity: Column) -> Column:
    """Points of a severity; an unknown one counts 1."""
    out = F.lit(1.0)
    for name, points in POINTS.items():
        out = F.when(severity == name, F.lit(points)).otherwise(out)
    return out

"""Name -> query, and name -> SQL of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakeloom.operators.regions import p4_found
from quakeloom.operators.timestamps import p2_found, p2_incremental
from quakeloom.operators.units import p1_found
from quakeloom.plans import catalog, formats, picks, timesql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p2_incremental": p2_incremental, "p4_found": p4_found}
QUERIES |= catalog.QUERIES | picks.QUERIES | formats.QUERIES

SQL: dict[str, str] = {
    "p4_found": """
SELECT DISTINCT e.event_uid, s.site_id AS place_id
FROM catalog_event e JOIN station_site s
  ON 12742.0e0 * asin(sqrt(pow(sin(radians(s.latitude - e.lat) / 2e0), 2)
       + cos(radians(e.lat)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - e.lon) / 2e0), 2))) <= 3e0
UNION
SELECT e.event_uid, z.zone_id
FROM catalog_event e JOIN reloc_zone z
  ON e.lat BETWEEN z.lat_min AND z.lat_max AND e.lon BETWEEN z.lon_min AND z.lon_max
""",
}

SQL["p1_found"] = "WITH " + picks.UNITS_SQL + """
SELECT DISTINCT mag_id, CAST(round(ml * 100) AS INTEGER) AS ml_centi FROM um WHERE TRY_CAST(given AS DOUBLE) IS NULL OR abs(TRY_CAST(given AS DOUBLE) - magnitude) > 1e-9
"""
SQL |= {"p2_found": timesql.P2_FOUND, "p2_incremental": timesql.P2}
SQL |= catalog.SQL | picks.SQL | formats.SQL

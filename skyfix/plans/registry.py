"""Every query of the library beside those of ``llm``, with the SQL that must agree with it."""

from . import astronomy, boxes, calibration, catalogue, feeds, measurement, pictures, series, sighting, sweep, terrain, verdict

QUERIES = {**sighting.QUERIES, **measurement.QUERIES, **calibration.QUERIES, **feeds.QUERIES, **series.QUERIES, **catalogue.QUERIES, **astronomy.QUERIES, **terrain.QUERIES, **sweep.QUERIES, **verdict.QUERIES, **pictures.QUERIES, **boxes.QUERIES}
SQL = {**sighting.SQL, **measurement.SQL, **calibration.SQL, **feeds.SQL, **series.SQL, **catalogue.SQL, **astronomy.SQL, **terrain.SQL, **sweep.SQL, **verdict.SQL, **pictures.SQL, **boxes.SQL}
FLAGSHIP = "los_fix_triangulate"

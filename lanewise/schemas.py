"""Schemas of the tables that operators exchange."""

NODES = "node_id BIGINT, lon DOUBLE, lat DOUBLE"
POINT = "STRUCT<lon:DOUBLE,lat:DOUBLE>"
EDGES = (
    "edge_id BIGINT, u BIGINT, v BIGINT, length_m DOUBLE, highway STRING, lanes INT, oneway BOOLEAN, "
    f"capacity_vph DOUBLE, free_flow_kmph DOUBLE, free_flow_s DOUBLE, geometry ARRAY<{POINT}>"
)
ELEMENTS = "type STRING, id BIGINT, lon DOUBLE, lat DOUBLE, nodes ARRAY<BIGINT>, tags MAP<STRING,STRING>"
OBSERVED = (
    "slot_utc STRING, edge_id BIGINT, cls INT, weight DOUBLE, f_green DOUBLE, f_orange DOUBLE, f_red DOUBLE, "
    "f_darkred DOUBLE, coverage DOUBLE, vc_ratio DOUBLE, n_samples INT, source STRING"
)
COMPLETE = OBSERVED + ", method STRING, hops INT"
READINGS = "capture STRING, ts TIMESTAMP, edge_id BIGINT, level TINYINT, painted BOOLEAN"
TILE_AUDIT = "x INT, y INT, bytes BIGINT, sha256 STRING, opaque_frac DOUBLE, traffic_frac DOUBLE, status STRING"
MANIFEST = (
    "name STRING, captured_utc STRING, series STRING, zoom INT, tile_px INT, "
    "bbox STRUCT<north:DOUBLE,south:DOUBLE,east:DOUBLE,west:DOUBLE>, tile_range STRUCT<x0:INT,x1:INT,y0:INT,y1:INT>, "
    "status STRING, coverage_pct DOUBLE, expected_tiles INT, received_tiles INT, tiles_nonempty INT, mean_traffic_frac DOUBLE, "
    "checks MAP<STRING,STRUCT<ok:BOOLEAN,detail:STRING>>, warnings ARRAY<STRING>, stage_seconds MAP<STRING,DOUBLE>, total_seconds DOUBLE"
)

"""DuckDB SQL of the road network and of what queries make of it."""

from __future__ import annotations

from reachgrid.functions.tags import ALLOW, BIKE_HIGHWAYS, BIKE_KPH, CAR_HIGHWAYS, CAR_KPH, DENY, NO_SPEED, ROAD_CLASSES, ROUTABLE_HIGHWAYS, SPEED_TOKEN, WALK_HIGHWAYS, WALK_KPH, WALK_SPEED


def _in(values) -> str:  # noqa: ANN001
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(key: str, values: dict[int, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


def _map(column: str, values: dict[str, int], rest: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {rest} END"


def speed(column: str) -> str:
    """km/h of a speed tag."""
    value = f"lower(trim({column}))"
    one = (
        f"CASE WHEN t IN {_in(NO_SPEED)} THEN 0 "
        f"WHEN regexp_matches(t, '{SPEED_TOKEN}') THEN CAST(least(round_even(CAST(regexp_extract(t, '{SPEED_TOKEN}', 1) AS DOUBLE) * "
        f"CASE WHEN regexp_extract(t, '{SPEED_TOKEN}', 2) = 'mph' THEN 1.60934 ELSE 1.0 END, 0), 65535) AS INT) END"
    )
    parts = f"list_transform(string_split_regex({value}, '[;|]'), lambda x: trim(x))"
    read = f"list_filter(list_transform({parts}, lambda t: {one}), lambda v: v IS NOT NULL)"
    return f"CASE WHEN {column} IS NULL THEN 0 WHEN {value} IN {_in(WALK_SPEED)} THEN 5 ELSE coalesce(({read})[1], 0) END"


_ALLOW, _DENY = _in(ALLOW), _in(DENY)


def _override(mask: str, column: str, bits: int) -> str:
    v = f"lower(trim({column}))"
    return f"((({mask}) & CASE WHEN {v} IN {_DENY} THEN {7 & ~bits} ELSE 7 END) | CASE WHEN {v} IN {_ALLOW} THEN {bits} ELSE 0 END)"


NETWORK = f"""
c AS (SELECT count(*) AS p, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
n AS (
  SELECT p_partkey AS node_id, 120 * (p_partkey % w) + p_size AS x_m, 120 * (p_partkey // w) + p_partkey % 7 AS y_m,
         CAST(52.30 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (p_partkey // w) AS lat, CAST(13.05 AS DOUBLE) + CAST(0.0015 AS DOUBLE) * (p_partkey % w) AS lon, p_size
  FROM part, c),
l0 AS (
  SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_partkey, l_suppkey
  FROM lineitem),
r AS (
  SELECT way_id, pos, CAST(sum(CASE WHEN pos = 0 THEN l_partkey WHEN l_suppkey % 2 = 0 THEN 1 ELSE w END) OVER (PARTITION BY way_id ORDER BY pos) AS BIGINT) AS node_id
  FROM l0, c),
o AS (
  SELECT o_orderkey AS way_id,
         {list(ROAD_CLASSES)}[(o_orderkey // 4) % 15 + 1] AS highway,
         {_case("o_custkey % 11", {0: "private", 1: "yes", 2: "no", 3: " Permissive "})} AS access,
         {_case("o_custkey % 7", {0: "yes", 1: "no", 2: "designated"})} AS foot,
         {_case("o_custkey % 5", {0: "no", 1: "yes"})} AS bicycle,
         {_case("o_custkey % 13", {0: "no"})} AS vehicle,
         {_case("o_custkey % 17", {0: "yes", 1: "no"})} AS motor_vehicle,
         {_case("o_orderkey % 9", {0: "track"})} AS cycleway,
         {_case("o_orderkey % 6", {0: "yes"})} AS oneway,
         {_case("o_orderkey % 10", {0: "yes"})} AS oneway_foot,
         {_case("o_orderkey % 14", {0: "Roundabout"})} AS junction,
         {_case("o_custkey % 3", {0: "both", 1: "no"})} AS sidewalk,
         {_case("o_custkey % 2", {0: "asphalt"})} AS surface,
         {_case("o_custkey % 12", dict(enumerate(["50", "30 mph", "walk", "none", "50;70", "signals;30", "abc", "80 km/h", "20kph", "7.5"])))} AS maxspeed,
         {_case("o_custkey % 8", {0: "30", 1: "bad"})} AS fwd,
         {_case("o_custkey % 8", {0: "20"})} AS bwd
  FROM orders),
cand AS (
  SELECT o.*, k FROM o JOIN (SELECT way_id, count(*) AS k FROM r GROUP BY way_id) USING (way_id) WHERE k >= 2 AND highway IN {_in(ROUTABLE_HIGHWAYS)}),
bad AS (SELECT DISTINCT way_id FROM r WHERE node_id NOT IN (SELECT node_id FROM n)),
kept AS (SELECT * FROM cand WHERE way_id NOT IN (SELECT way_id FROM bad))"""

_MASK = f"(CASE WHEN highway IN {_in(WALK_HIGHWAYS)} THEN 1 ELSE 0 END | CASE WHEN highway IN {_in(BIKE_HIGHWAYS)} THEN 2 ELSE 0 END | CASE WHEN highway IN {_in(CAR_HIGHWAYS)} THEN 4 ELSE 0 END | CASE WHEN cycleway IS NOT NULL THEN 2 ELSE 0 END)"
_MASK = f"(CASE WHEN lower(trim(access)) IN {_DENY} THEN 0 WHEN lower(trim(access)) IN {_ALLOW} THEN 7 ELSE {_MASK} END)"
for _column, _bits in (("foot", 1), ("bicycle", 2), ("vehicle", 6), ("motor_vehicle", 4)):
    _MASK = _override(_MASK, _column, _bits)

_FALLBACK = (
    f"coalesce(greatest(CASE WHEN mode_mask & 1 > 0 THEN {_map('highway', WALK_KPH, '5')} END, CASE WHEN mode_mask & 2 > 0 THEN {_map('highway', BIKE_KPH, 'NULL')} END, "
    f"CASE WHEN mode_mask & 4 > 0 THEN {_map('highway', CAR_KPH, 'NULL')} END), 0)"
)

WAYS = f"""{NETWORK},
a0 AS (
  SELECT *, CASE WHEN lower(trim(foot)) IN {_DENY} THEN true WHEN lower(trim(foot)) IN {_ALLOW} THEN false WHEN lower(trim(access)) IN {_DENY} THEN true ELSE false END AS disallowed,
         {_MASK} AS mode_mask
  FROM kept),
a1 AS (
  SELECT *, CASE WHEN fwd IS NOT NULL THEN {speed("fwd")} ELSE {speed("maxspeed")} END AS f0, CASE WHEN bwd IS NOT NULL THEN {speed("bwd")} ELSE {speed("maxspeed")} END AS b0
  FROM a0),
a AS (
  SELECT way_id, disallowed, CAST(mode_mask AS INT) AS mode_mask, CAST(CASE WHEN f0 > 0 THEN f0 ELSE {_FALLBACK} END AS INT) AS forward_kph,
         CAST(CASE WHEN b0 > 0 THEN b0 ELSE {_FALLBACK} END AS INT) AS backward_kph, CAST({_map("highway", {h: i for i, h in enumerate(ROAD_CLASSES, 1)}, "0")} AS INT) AS road_class_id,
         CAST(CASE WHEN sidewalk NOT IN ('no', 'none') THEN 1 ELSE 0 END | CASE WHEN oneway IS NOT NULL THEN 256 ELSE 0 END | CASE WHEN lower(junction) = 'roundabout' THEN 1024 ELSE 0 END
         | CASE WHEN fwd IS NOT NULL OR bwd IS NOT NULL THEN 2048 ELSE 0 END AS INT) AS flags, coalesce(oneway_foot = 'yes', false) AS foot_oneway
  FROM a1)"""

EDGES = f"""{WAYS},
g AS (
  SELECT r.way_id, r.pos, r.node_id, x_m, y_m, lead(r.node_id) OVER o AS to_id, lead(x_m) OVER o AS to_x, lead(y_m) OVER o AS to_y
  FROM r JOIN n USING (node_id) WHERE r.way_id IN (SELECT way_id FROM a WHERE NOT disallowed AND mode_mask > 0) WINDOW o AS (PARTITION BY r.way_id ORDER BY r.pos)),
e AS (
  SELECT way_id, CAST(pos AS INT) AS pos, turn, CASE turn WHEN 0 THEN node_id ELSE to_id END AS source_id, CASE turn WHEN 0 THEN to_id ELSE node_id END AS target_id,
         CAST(greatest(1, round_even(sqrt(CAST((to_x - x_m) * (to_x - x_m) + (to_y - y_m) * (to_y - y_m) AS DOUBLE)) / CAST(1.39 AS DOUBLE), 0)) AS BIGINT) AS cost_seconds, flags, mode_mask,
         CASE turn WHEN 0 THEN forward_kph ELSE backward_kph END AS maxspeed_kph, road_class_id
  FROM (SELECT *, unnest([0, 1]) AS turn FROM g JOIN a USING (way_id) WHERE to_id IS NOT NULL) WHERE turn = 0 OR NOT foot_oneway)"""


def seconds(mask: int) -> str:
    """Seconds of an edge for the best mode of a mask."""
    metres = "greatest(CAST(1 AS DOUBLE), cost_seconds * CAST(1.39 AS DOUBLE))"
    return (
        f"least(CASE WHEN mode_mask & {mask & 1} != 0 AND road_class_id != 15 THEN CAST(cost_seconds AS DOUBLE) END, "
        f"CASE WHEN mode_mask & {mask & 2} != 0 AND road_class_id != 15 AND least(20, maxspeed_kph) > 0 THEN {metres} / (CAST(least(20, maxspeed_kph) * 1000 AS DOUBLE) / 3600) END, "
        f"CASE WHEN mode_mask & {mask & 4} != 0 THEN {metres} / (CAST(CASE WHEN maxspeed_kph > 0 THEN maxspeed_kph ELSE 30 END * 1000 AS DOUBLE) / 3600) END)"
    )


def timed(mask: int, name: str = "m") -> str:
    """Edges of a mask with seconds and ticks."""
    return f"{name} AS (SELECT way_id * 64 + pos * 2 + turn AS edge_index, source_id, target_id, s AS seconds, CAST(least(ceil(s * 1000), 4294967295) AS BIGINT) AS ticks FROM (SELECT *, {seconds(mask)} AS s FROM e) WHERE s IS NOT NULL)"


def field(limit_ticks: int, sources: str, edges: str = "m", name: str = "f") -> str:
    """Least ticks from each source (a list of node ids) within a limit."""
    return f"""{name}(source_id, node_index, ticks) USING KEY (source_id, node_index) AS (
  SELECT s, s, CAST(0 AS BIGINT) FROM (SELECT unnest({sources}) AS s)
  UNION
  SELECT x.source_id, x.target_id, x.ticks FROM (
    SELECT {name}.source_id, {edges}.target_id, min({name}.ticks + {edges}.ticks) AS ticks
    FROM {name} JOIN {edges} ON {edges}.source_id = {name}.node_index
    WHERE {name}.ticks + {edges}.ticks <= {limit_ticks} GROUP BY {name}.source_id, {edges}.target_id) x
  LEFT JOIN recurring.{name} k ON k.source_id = x.source_id AND k.node_index = x.target_id
  WHERE k.ticks IS NULL OR x.ticks < k.ticks)"""


def raster(limit_ticks: int, sources: str) -> str:
    """Pixels of nodes, visible segments and their lines: px, s, z (pixel, seconds)."""
    return f"""{EDGES}, {timed(1)}, {field(limit_ticks, sources)},
dim AS (SELECT CAST(ceil(max(x_m) / 10.0) AS INT) AS width, CAST(ceil(max(y_m) / 10.0) AS INT) AS height FROM n),
px AS (SELECT node_id, CAST(greatest(0, least(x_m // 10, width - 1)) AS INT) AS x_px, CAST(greatest(0, least(height - 1 - y_m // 10, height - 1)) AS INT) AS y_px FROM n, dim),
t AS (SELECT node_index, ticks / 1000 AS sec, x_px, y_px FROM f JOIN px ON px.node_id = f.node_index),
s AS (
  SELECT edge_index, p.x_px AS x0, p.y_px AS y0, p.sec AS t0, q.x_px AS x1, q.y_px AS y1, p.sec + m.seconds AS t1
  FROM m JOIN t p ON p.node_index = m.source_id JOIN t q ON q.node_index = m.target_id WHERE p.sec + m.seconds <= q.sec + 0.75),
k AS (SELECT *, abs(x1 - x0) AS ax, abs(y1 - y0) AS ay, greatest(abs(x1 - x0), abs(y1 - y0)) AS steps FROM s),
z AS (
  SELECT edge_index, step, CAST(x0 + sign(x1 - x0) * CASE WHEN ax >= ay THEN step ELSE (2 * step * ax + greatest(steps, 1)) // (2 * greatest(steps, 1)) END AS INT) AS x_px,
         CAST(y0 + sign(y1 - y0) * CASE WHEN ax >= ay THEN (2 * step * ay + greatest(steps, 1)) // (2 * greatest(steps, 1)) ELSE step END AS INT) AS y_px,
         t0 + (t1 - t0) * CASE WHEN steps > 0 THEN step / steps ELSE 0 END AS seconds
  FROM (SELECT *, unnest(range(0, steps + 1)) AS step FROM k)),
y AS (
  SELECT x_px, y_px, min(seconds) AS seconds FROM (SELECT x_px, y_px, seconds FROM z UNION ALL SELECT x_px, y_px, sec FROM t) GROUP BY x_px, y_px)"""


def band(column: str, cycle: int = 75) -> str:
    ratio = f"(({column} / 60) % CAST({cycle} AS DOUBLE)) / CAST({cycle} AS DOUBLE)"
    return f"CASE WHEN {ratio} <= 0.2 THEN 0 WHEN {ratio} <= 0.4 THEN 1 WHEN {ratio} <= CAST(3 AS DOUBLE) / 5 THEN 2 WHEN {ratio} <= 0.8 THEN 3 ELSE 4 END"

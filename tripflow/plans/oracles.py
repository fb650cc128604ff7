"""The named queries as SQL for an independent engine, over the same tables."""

from __future__ import annotations

# The derived inputs of inputs.py. Each may use the ones before it.
VIEWS = {
    "trips": """
SELECT concat(CASE WHEN quarter(l_shipdate) <= 2 THEN 'Q2' ELSE 'Q4' END,
              CASE WHEN dayofweek(l_shipdate) IN (0, 6) THEN ' Saturday' ELSE ' Thursday' END) AS dataset,
  l_orderkey AS person_id,
  CASE WHEN l_quantity = 50 THEN 'OTHER_TRAVEL_MODE' WHEN l_quantity = 49 THEN NULL
       ELSE ['PRIVATE_AUTO','WALKING','BIKING','PUBLIC_TRANSIT','CARPOOL','ON_DEMAND_AUTO','COMMERCIAL'][l_linenumber]
  END AS mode,
  CASE WHEN l_orderkey % 97 = 0 THEN 999.0::DOUBLE ELSE (3795 + l_suppkey % 10)::DOUBLE / 100 END AS start_lat,
  (-12173 + (l_suppkey // 10) % 3 * 4)::DOUBLE / 100 AS start_lng,
  (3737 + l_partkey % 5 * 3)::DOUBLE / 100 AS end_lat,
  (-12220 + (l_partkey // 5) % 4 * 4)::DOUBLE / 100 AS end_lng,
  l_quantity - 1 AS distance_miles,
  CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_quantity * 1.5::DOUBLE + l_linenumber END AS duration_minutes,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN []::BIGINT[]
       ELSE list_transform(range(l_linenumber),
              lambda i: CASE WHEN (l_partkey % 40 + i) % 11 = 0 THEN -1 - i ELSE l_partkey % 40 * 3 + i * 37 END)
  END AS network_link_ids,
  concat('T', l_suppkey % 10) AS origin_census_tract,
  concat('T', l_partkey % 10) AS destination_census_tract,
  l_linenumber AS passengers,
  CASE WHEN dayofweek(l_shipdate) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type,
  concat('Q', quarter(l_shipdate)) AS quarter
FROM lineitem""",
    "valid": """
SELECT * FROM trips WHERE start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180
  AND end_lat BETWEEN -90 AND 90 AND end_lng BETWEEN -180 AND 180""",
    "usable": "SELECT * FROM trips WHERE distance_miles > 0 AND duration_minutes > 0",
    "boxed": """
SELECT * FROM trips WHERE start_lat BETWEEN 37.98 AND 38.02 AND start_lng BETWEEN -121.73 AND -121.67
  AND end_lat BETWEEN 37.39 AND 37.47 AND end_lng BETWEEN -122.18 AND -122.10""",
    "population": """
SELECT unnest(CASE WHEN o_orderkey % 17 = 0 THEN ['Q2', 'Q4', 'Q2'] ELSE ['Q2', 'Q4'] END) AS season,
  o_orderkey AS person_id
FROM orders WHERE o_orderkey % 13 <> 0""",
    "peopled": """
SELECT t.*, split_part(t.dataset, ' ', 1) AS season FROM trips t
JOIN population p ON p.season = split_part(t.dataset, ' ', 1) AND p.person_id = t.person_id""",
    "segments": """
SELECT unnest(CASE WHEN p_partkey % 29 = 0 THEN ['Q2', 'Q4', 'Q4'] ELSE ['Q2', 'Q4'] END) AS season,
  p_partkey::VARCHAR AS stableEdgeId,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE concat(
    'LINESTRING(-122.', lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0'), ' 37.', lpad((p_partkey % 70 + 10)::VARCHAR, 2, '0'),
    ', -122.', lpad(((p_partkey + 37) % 90 + 10)::VARCHAR, 2, '0'), ' 37.', lpad(((p_partkey + 37) % 70 + 10)::VARCHAR, 2, '0'), ')')
  END AS geometry
FROM part""",
    "edges": "SELECT season, stableEdgeId, min(geometry) AS geometry FROM segments GROUP BY ALL",
    "numbered": """
SELECT *, row_number() OVER () AS trip_row_id, split_part(dataset, ' ', 1) AS season
FROM boxed WHERE len(network_link_ids) > 0""",
    "links": """
SELECT trip_row_id, season, unnest(network_link_ids) AS link_id,
  generate_subscripts(network_link_ids, 1) AS pos FROM numbered""",
    "matched": """
SELECT l.trip_row_id, string_agg(e.geometry, '|' ORDER BY l.pos) AS trajectory_segments,
  count(e.geometry) AS matched_segments, count(l.link_id) AS total_links
FROM links l LEFT JOIN edges e ON e.season = l.season AND e.stableEdgeId = l.link_id::VARCHAR
GROUP BY l.trip_row_id""",
    "trajectories": """
SELECT n.dataset, n.person_id, n.mode, n.start_lat, n.start_lng, n.end_lat, n.end_lng,
  n.distance_miles, n.duration_minutes, m.trajectory_segments, m.matched_segments, m.total_links
FROM numbered n JOIN matched m USING (trip_row_id)
WHERE m.matched_segments > 0 AND m.matched_segments / m.total_links >= 0.5""",
    "patterns": """
SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, trajectory_segments,
  count(*) AS trip_count, round(avg(distance_miles), 2) AS avg_distance_miles,
  round(avg(duration_minutes), 2) AS avg_duration_min
FROM trajectories GROUP BY ALL""",
    "pattern_points": """
SELECT p.*, k.part AS part, k.spot AS spot, k.lat AS lat, k.lng AS lng
FROM (SELECT *, row_number() OVER () AS pid FROM patterns) p,
LATERAL (
  SELECT part, spot, split_part(pair, ' ', 2)::DOUBLE AS lat, split_part(pair, ' ', 1)::DOUBLE AS lng
  FROM (
    SELECT part, unnest(string_split(replace(replace(seg, 'LINESTRING(', ''), ')', ''), ', ')) AS pair,
      unnest(range(1, 3)) AS spot
    FROM (SELECT unnest(string_split(p.trajectory_segments, '|')) AS seg,
                 unnest(range(1, 1 + len(string_split(p.trajectory_segments, '|')))) AS part)
  )
) k""",
    # All lines here have two points, so the last point kept is the previous line's end.
    "kept_points": """
SELECT * FROM (
  SELECT *, lag(lat) OVER w AS last_lat, lag(lng) OVER w AS last_lng
  FROM pattern_points WINDOW w AS (PARTITION BY pid ORDER BY part, spot)
) WHERE NOT (spot = 1 AND part > 1 AND abs(last_lat - lat) < 0.0005 AND abs(last_lng - lng) < 0.0005)""",
    "lines": """
SELECT pid, dataset, mode, start_lat, start_lng, end_lat, end_lng, trajectory_segments, trip_count,
  avg_distance_miles, avg_duration_min, count(*) AS n_points,
  string_agg(concat(round(lat * 1e6)::BIGINT, ' ', round(lng * 1e6)::BIGINT), ';' ORDER BY part, spot) AS points
FROM kept_points GROUP BY ALL""",
    "stop_text": """
SELECT *, strftime(ts, '%H:%M:%S') AS clock,
  CASE WHEN event_id % 50 = 7 THEN strftime(ts, '%H:%M')
       WHEN event_id % 53 = 5 THEN concat(hour(ts) + 24, strftime(ts, ':%M:%S'))
       ELSE strftime(ts, '%H:%M:%S') END AS txt
FROM events""",
    "stop_times": """
SELECT CASE WHEN user_id % 3 = 0 THEN 'bus' ELSE 'rail' END AS agency,
  concat(user_id, '-', day(ts)) AS trip_id, event_type AS stop_id, event_id AS stop_sequence,
  CASE WHEN regexp_full_match(txt, '[0-9]+:[0-9]+:[0-9]+')
       THEN split_part(txt, ':', 1)::BIGINT * 3600 + split_part(txt, ':', 2)::BIGINT * 60 + split_part(txt, ':', 3)::BIGINT
  END AS secs
FROM stop_text""",
    "places": """
SELECT * FROM (VALUES ('rail','Harbor','click'), ('rail','Airport','error'), ('rail','Market','purchase'),
  ('rail','College','signup'), ('rail','Viewpoint','view'),
  ('bus','Harbor','click'), ('bus','Market','purchase'), ('bus','Viewpoint','view')) v(agency, place, stop_id)""",
    "fares": """
SELECT * FROM (VALUES ('rail','click','error',6.4::DOUBLE), ('rail','purchase','view',3.9::DOUBLE),
  ('bus','click','purchase',3.0::DOUBLE)) v(agency, from_stop, to_stop, fare)""",
    "requests": """
SELECT o_orderkey AS request_id,
  ['Harbor','Airport','Market','College','Viewpoint','Island'][o_orderkey % 6 + 1] AS origin,
  ['Harbor','Airport','Market','College','Viewpoint','Island'][(o_orderkey + 1 + o_custkey % 5) % 6 + 1] AS destination,
  o_orderdate + to_seconds(o_custkey * 61 % 86400) AS requested_at
FROM orders WHERE o_orderkey % 19 <> 0""",
    "asks": """
SELECT r.request_id, o.agency, r.origin, r.destination, o.stop_id AS origin_stop, d.stop_id AS dest_stop,
  r.requested_at,
  hour(requested_at) * 3600 + minute(requested_at) * 60 + second(requested_at) AS now_secs
FROM requests r JOIN places o ON o.place = r.origin
JOIN places d ON d.place = r.destination AND d.agency = o.agency""",
    "departures": """
SELECT agency, stop_id, secs AS dep_secs, min(trip_id) AS trip_id FROM stop_times
WHERE secs IS NOT NULL GROUP BY ALL""",
    "arrivals": """
SELECT agency, trip_id, stop_id, first(secs ORDER BY stop_sequence) AS arr, true AS calls FROM stop_times
GROUP BY agency, trip_id, stop_id""",
    "answered": """
SELECT * FROM (
  SELECT a.*, d.dep_secs, d.trip_id,
    CASE WHEN r.calls THEN r.arr WHEN a.agency = 'rail' THEN d.dep_secs END AS arr_secs
  FROM asks a ASOF JOIN departures d
    ON d.agency = a.agency AND d.stop_id = a.origin_stop AND d.dep_secs >= a.now_secs
  LEFT JOIN arrivals r ON r.agency = a.agency AND r.trip_id = d.trip_id AND r.stop_id = a.dest_stop
) WHERE arr_secs IS NOT NULL""",
    "priced": """
SELECT a.*, round_even((arr_secs - dep_secs) / 60, 0)::BIGINT AS eta_min,
  coalesce(f.fare, CASE WHEN a.agency = 'rail' THEN 4.5 ELSE 2.5 END::DOUBLE) AS cost
FROM answered a LEFT JOIN fares f
  ON f.agency = a.agency AND f.from_stop = a.origin_stop AND f.to_stop = a.dest_stop""",
    "offers": """
SELECT request_id, agency, eta_min, cost, agency AS mode,
  CASE WHEN agency = 'rail' THEN origin END AS origin,
  CASE WHEN agency = 'rail' THEN destination END AS destination,
  CASE WHEN agency = 'rail' THEN strftime(requested_at, '%Y-%m-%d %H:%M:%S') END AS departure_time
FROM priced
UNION ALL SELECT request_id, 'air', 35, 140.0, 'shuttle_plane', NULL, NULL, NULL FROM requests
UNION ALL SELECT request_id, 'ride', 75, 48.0, 'shared_car', NULL, NULL, NULL FROM requests""",
    "log": """
SELECT conv_id // 25 AS agent_id, conv_id % 25 * 1000 + turn AS idx,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes((conv_id % 25 * 1000 + turn)::INT) AS time,
  CASE WHEN turn = 0 THEN ['ScenarioUnderstanding','ParticipantUnderstanding','SelfUnderstanding','ThoughtProcessForAction'][conv_id % 4 + 1]
       WHEN role <> 'system' THEN role ELSE '' END AS tag,
  CASE WHEN turn <> 0 THEN text
       WHEN conv_id % 12 = 0 THEN '[x] no marker: ' || text
       WHEN conv_id % 4 = 0 THEN '[ScenarioUnderstanding] [01 Jan 2024 08:00 - 12:00]: <Scenario> ' || text
       WHEN conv_id % 4 = 1 THEN '<Participant> ' || text
       WHEN conv_id % 4 = 2 THEN '[SelfUnderstanding] [now]: <SelfUnderstanding> ' || text
       ELSE 'ThoughtProcessForAction ``` ' || text END AS text
FROM conversations""",
    "msgs": """
SELECT *, round_even(length(coalesce(text, '')) / 4, 0)::BIGINT AS tokens FROM log
WHERE tag NOT IN ('ScenarioUnderstanding','ParticipantUnderstanding','SelfUnderstanding','ThoughtProcessForAction')""",
    "suffix": """
SELECT *, sum(tokens) OVER (PARTITION BY agent_id ORDER BY idx DESC)::BIGINT AS suffix_tokens FROM msgs""",
    "budget": "SELECT * FROM suffix WHERE suffix_tokens <= 2500 AND tokens > 2",
    "tail": """
SELECT t.* FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY idx DESC) AS back FROM suffix WHERE tokens > 5
) t JOIN (
  SELECT agent_id, list_sort([count(*) FILTER (suffix_tokens <= 600 AND tokens > 5), 10,
                              floor(count(*) * 0.1::DOUBLE)::BIGINT])[2] AS keep
  FROM suffix GROUP BY agent_id
) k USING (agent_id) WHERE keep = 0 OR back <= keep""",
    "latest": """
SELECT agent_id, tag, max(idx) AS idx, arg_max(text, idx) AS text FROM log
WHERE (tag = 'ScenarioUnderstanding' AND contains(lower(text), '<scenario>'))
   OR (tag = 'ParticipantUnderstanding' AND contains(lower(text), '<participant>'))
   OR (tag = 'SelfUnderstanding' AND contains(lower(text), '<selfunderstanding>'))
   OR (tag = 'ThoughtProcessForAction' AND contains(lower(text), 'thoughtprocessforaction'))
GROUP BY agent_id, tag""",
    "sections": """
SELECT agent_id, tag, CASE
    WHEN tag <> 'ThoughtProcessForAction' AND contains(text, ']: ') AND contains(split_part(text, ']: ', 1), '] [')
    THEN concat('Based on observations in the timeframe ', split_part(trim(split_part(text, ']: ', 1)), '] [', 2),
                chr(10), trim(split_part(text, ']: ', 2)))
    ELSE text END AS body
FROM latest""",
    "agent_text": """
SELECT agent_id, string_agg(concat('[', strftime(time, '%Y-%m-%d %H:%M:%S'), '] ', text), chr(10) ORDER BY idx) AS context,
  min(time) AS time_start, max(time) AS time_end FROM tail GROUP BY agent_id""",
    "answers": """
SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'CHOICE' ELSE 'FLOAT' END AS output_type,
  event_type, props, user_id, value FROM events""",
    "flows": """
SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, count(*) AS trip_count FROM valid GROUP BY ALL""",
    "ranked_flows": """
SELECT *, row_number() OVER (PARTITION BY dataset, mode ORDER BY trip_count DESC,
  start_lat, start_lng, end_lat, end_lng) AS rank FROM flows""",
    "top_flows": "SELECT * FROM ranked_flows WHERE rank <= 1000",
    "mode_counts": """
SELECT dataset, mode, count(*) AS n FROM usable GROUP BY ALL""",
    "popularity": """
SELECT dataset, mode, n AS total_individual_trips,
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset), 1) AS percentage FROM mode_counts""",
    "frequent": """
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY trip_count DESC, mode NULLS FIRST,
    start_lat, start_lng, end_lat, end_lng) AS rank
FROM (SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, count(*) AS trip_count,
        round(avg(distance_miles), 2) AS avg_distance_miles, round(avg(duration_minutes), 2) AS avg_duration_min,
        min(distance_miles) AS min_distance_miles, max(distance_miles) AS max_distance_miles
      FROM valid WHERE distance_miles > 0 AND duration_minutes > 0 GROUP BY ALL)
QUALIFY rank <= 20""",
    "stats": """
SELECT dataset, sum(total)::BIGINT AS total_route_instances, max(largest) AS max_route_frequency,
  sum(total)::DOUBLE / sum(n)::DOUBLE AS avg_route_frequency,
  string_agg(coalesce(mode, 'UNKNOWN'), ', ' ORDER BY place) FILTER (place <= 3) AS top_route_modes
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY total DESC, mode NULLS FIRST) AS place
      FROM (SELECT dataset, mode, sum(trip_count) AS total, max(trip_count) AS largest, count(*) AS n
            FROM flows GROUP BY ALL))
GROUP BY dataset""",
    "top_od": """
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY trip_count DESC, mode NULLS FIRST,
    start_lat, start_lng, end_lat, end_lng) AS rank
FROM (SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, count(*) AS trip_count FROM peopled GROUP BY ALL)
QUALIFY rank <= 500""",
    "origins": """
SELECT dataset, mode, concat('POINT(', start_lng, ' ', start_lat, ')') AS origin_wkt, trip_count,
  row_number() OVER (PARTITION BY dataset ORDER BY trip_count DESC, mode NULLS FIRST, start_lat, start_lng) AS rank,
  start_lng AS x, start_lat AS y
FROM (SELECT dataset, mode, start_lat, start_lng, count(*) AS trip_count FROM peopled
      WHERE start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180 GROUP BY ALL)
QUALIFY rank <= 500""",
    "palette": """
SELECT unnest(['#1f77b4','#2ca02c','#9467bd','#ff7f0e','#d62728','#17becf','#8c564b','#e377c2','#7f7f7f','#bcbd22']) AS colour,
  unnest(range(10)) AS slot""",
    "size_colours": """
SELECT dataset, mode, position, colour FROM (
  SELECT dataset, coalesce(mode, 'UNKNOWN') AS mode,
    row_number() OVER (PARTITION BY dataset ORDER BY largest DESC, mode NULLS FIRST) AS position
  FROM (SELECT dataset, mode, max(trip_count) AS largest FROM patterns GROUP BY ALL)
) JOIN palette ON slot = (position - 1) % 10""",
}

_SPOT = "concat(round({0}_lat * 1e6)::BIGINT, ' ', round({0}_lng * 1e6)::BIGINT)"
_START, _END = _SPOT.format("start"), _SPOT.format("end")
_OD_KEYS = "start_lat::VARCHAR, start_lng::VARCHAR, end_lat::VARCHAR, end_lng::VARCHAR"
_NO_TEXT = "NULL::VARCHAR"


def _decimals(column: str, digits: int) -> str:
    return f"coalesce(format('{{:.{digits}f}}', {column}), 'n/a')"


_TOP_LABEL = f"""concat_ws(chr(10), concat('Rank #', rank, ' Route'), concat('Dataset: ', dataset),
  concat('Mode: ', mode), concat('Trip Count: ', format('{{:,}}', trip_count)),
  concat('Avg Distance: ', {_decimals('avg_distance_miles', 1)}, ' mi'),
  concat('Avg Duration: ', {_decimals('avg_duration_min', 1)}, ' min'),
  concat('Distance Range: ', {_decimals('min_distance_miles', 1)}, ' - ', {_decimals('max_distance_miles', 1)}, ' mi'))"""

# Each body with the views it starts from.
BODIES: dict[str, str] = {
    "trips_scan": """SELECT dataset, person_id, mode, start_lat, start_lng, end_lat, end_lng,
  distance_miles, duration_minutes, len(network_link_ids) AS link_count,
  CASE WHEN network_link_ids IS NOT NULL THEN coalesce(array_to_string(network_link_ids, ','), '') END AS links
FROM trips""",
    "datasets_union": """SELECT dataset, count(*) AS trip_count, sum(distance_miles) AS distance_miles
FROM trips GROUP BY dataset""",
    "companion_tables": """SELECT table_name, concat(prefix, '_population') AS population_table,
  concat(prefix, '_network_segments') AS segments_table
FROM (SELECT DISTINCT concat('bay_2024_', split_part(dataset, ' ', 1), '_', lower(split_part(dataset, ' ', 2)), '_trip') AS table_name,
             concat('bay_2024_', split_part(dataset, ' ', 1)) AS prefix FROM trips)""",
    "gtfs_stop_times": """SELECT agency, trip_id, stop_id, stop_sequence, secs AS dep_secs, secs AS arr_secs
FROM stop_times""",
    "valid_coords": "SELECT dataset, person_id, mode, start_lat, start_lng, end_lat, end_lng FROM valid",
    "od_bbox_trips": "SELECT dataset, person_id, mode, start_lat, start_lng, end_lat, end_lng FROM boxed",
    "quarter_daytype": """SELECT start_lat AS origin_lat, start_lng AS origin_lon, end_lat AS dest_lat,
  end_lng AS dest_lon, passengers, day_type, quarter FROM trips
WHERE quarter IN ('Q2', 'Q4') AND day_type = 'weekday'""",
    "od_flows": "SELECT * FROM flows",
    "top_flows_per_mode": "SELECT * FROM top_flows WHERE rank <= 20",
    "flow_rank": "SELECT * FROM top_flows",
    "top_flows_with_population": """SELECT *, row_number() OVER (PARTITION BY dataset, mode ORDER BY trip_count DESC,
  start_lat, start_lng, end_lat, end_lng) AS rank
FROM (SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, count(*) AS trip_count FROM peopled
      WHERE start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180
        AND end_lat BETWEEN -90 AND 90 AND end_lng BETWEEN -180 AND 180 GROUP BY ALL)
QUALIFY rank <= 20""",
    "top_od_500": "SELECT * FROM top_od",
    "flow_stats": "SELECT * FROM stats",
    "trips_with_population": """SELECT dataset, season, person_id, mode, start_lat, start_lng, end_lat, end_lng
FROM peopled""",
    "mode_summary": """SELECT dataset, mode, total_trips, avg_distance_miles, avg_duration_min,
  round(total_trips * 100.0::DOUBLE / sum(total_trips) OVER (PARTITION BY dataset), 2) AS percentage
FROM (SELECT dataset, mode, count(*) AS total_trips, round(avg(distance_miles), 2) AS avg_distance_miles,
             round(avg(duration_minutes), 2) AS avg_duration_min FROM usable GROUP BY ALL)""",
    "mode_popularity": "SELECT * FROM popularity",
    "mode_statistics": """SELECT dataset, mode, count(*) AS total_trips,
  round(avg(distance_miles), 2) AS avg_distance_miles, round(avg(duration_minutes), 2) AS avg_duration_min,
  round(stddev_samp(duration_minutes), 2) AS std_duration_min,
  quantile_disc(duration_minutes, 0.5) AS median_duration_min,
  count(DISTINCT (start_lat, start_lng, end_lat, end_lng)) AS unique_routes
FROM usable GROUP BY dataset, mode""",
    "mode_ranking": """SELECT dataset, mode, total_trips, avg_distance_miles, avg_duration_min,
  round(total_trips * 100.0::DOUBLE / sum(total_trips) OVER (PARTITION BY dataset), 2) AS percentage,
  row_number() OVER (PARTITION BY dataset ORDER BY total_trips DESC, mode NULLS FIRST) AS rank
FROM (SELECT dataset, mode, count(*) AS total_trips, round(avg(distance_miles), 2) AS avg_distance_miles,
             round(avg(duration_minutes), 2) AS avg_duration_min FROM usable GROUP BY ALL)
QUALIFY rank <= 5""",
    "route_frequency": """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY route_frequency DESC,
    mode NULLS FIRST, start_lat, start_lng, end_lat, end_lng) AS rank
FROM (SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, count(*) AS route_frequency,
        round(avg(distance_miles), 2) AS avg_distance_miles, round(avg(duration_minutes), 2) AS avg_duration_min
      FROM usable GROUP BY ALL)
QUALIFY rank <= 10""",
    "frequent_trips": "SELECT * FROM frequent",
    "origin_counts": "SELECT * FROM origins",
    "tract_flows": """SELECT dataset, origin_census_tract, destination_census_tract, count(*) AS trip_count
FROM trips GROUP BY ALL""",
    "bbox_mode_details": """SELECT dataset, mode, count(*) AS total_trips,
  round(avg(distance_miles), 2) AS avg_distance_miles, round(avg(duration_minutes), 2) AS avg_duration_min,
  min(distance_miles) AS min_distance_miles, max(distance_miles) AS max_distance_miles,
  min(duration_minutes) AS min_duration_min, max(duration_minutes) AS max_duration_min
FROM boxed WHERE distance_miles > 0 AND duration_minutes > 0 GROUP BY dataset, mode""",
    "bbox_mode_share": """SELECT dataset, mode, n AS total_trips,
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset), 1) AS percentage
FROM (SELECT dataset, mode, count(*) AS n FROM boxed
      WHERE distance_miles > 0 AND duration_minutes > 0 GROUP BY ALL)""",
    "trip_links": """SELECT dataset, person_id, mode, generate_subscripts(network_link_ids, 1) - 1 AS link_position,
  unnest(network_link_ids) AS link_id FROM trips""",
    "trip_trajectories": "SELECT * FROM trajectories",
    "route_patterns": "SELECT * FROM patterns",
    "stitched_routes": """SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, trajectory_segments,
  n_points, points FROM lines""",
    "missing_trajectory": """SELECT dataset, mode, count(*) AS route_patterns, sum(n)::BIGINT AS trip_count FROM (
  SELECT dataset, mode, start_lat, start_lng, end_lat, end_lng, network_link_ids, count(*) AS n FROM trips t
  WHERE len(network_link_ids) > 0 AND NOT EXISTS (
    SELECT 1 FROM edges e WHERE e.season = split_part(t.dataset, ' ', 1) AND e.geometry IS NOT NULL
      AND list_contains(t.network_link_ids, e.stableEdgeId::BIGINT))
  GROUP BY ALL) GROUP BY ALL""",
    "place_to_stop": "SELECT request_id, agency, origin, destination, origin_stop, dest_stop FROM asks",
    "fare_lookup": """SELECT a.request_id, a.agency, a.origin_stop, a.dest_stop,
  coalesce(f.fare, CASE WHEN a.agency = 'rail' THEN 4.5 ELSE 2.5 END::DOUBLE) AS cost
FROM asks a LEFT JOIN fares f ON f.agency = a.agency AND f.from_stop = a.origin_stop AND f.to_stop = a.dest_stop""",
    "next_departure": """SELECT request_id, agency, trip_id, now_secs, dep_secs, arr_secs, eta_min FROM priced""",
    "offers_union": "SELECT * FROM offers",
    "best_offer": """SELECT * FROM offers
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY eta_min, cost, agency) = 1""",
    "token_suffix_sum": "SELECT agent_id, idx, tokens, suffix_tokens FROM suffix",
    "token_budget_context": "SELECT agent_id, idx, time, tag, tokens, text FROM budget",
    "adaptive_tail_context": "SELECT agent_id, idx, time, tag, tokens, text FROM tail",
    "context_span": "SELECT agent_id, min(time) AS time_start, max(time) AS time_end FROM budget GROUP BY agent_id",
    "context_text": """SELECT agent_id,
  string_agg(concat('[', strftime(time, '%Y-%m-%d %H:%M:%S'), '] ', text), chr(10) ORDER BY idx) AS context
FROM budget GROUP BY agent_id""",
    "understanding_context": """SELECT b.*, k.tag, l.text AS previous FROM (
  SELECT agent_id, min(time) AS time_start, max(time) AS time_end,
    string_agg(concat('[', strftime(time, '%Y-%m-%d %H:%M:%S'), '] ', text), chr(10) ORDER BY idx) AS context
  FROM budget GROUP BY agent_id) b
CROSS JOIN (SELECT unnest(['ScenarioUnderstanding', 'ParticipantUnderstanding', 'SelfUnderstanding']) AS tag) k
LEFT JOIN latest l ON l.agent_id = b.agent_id AND l.tag = k.tag""",
    "latest_by_tag": "SELECT * FROM latest",
    "latest_by_text_tag": "SELECT * FROM latest",
    "last_entries": """SELECT agent_id, idx, time, text, row_number() OVER (PARTITION BY agent_id ORDER BY idx DESC) AS rank
FROM log QUALIFY rank <= 5""",
    "agent_context": """SELECT agent_id, concat('Agent', agent_id) AS agent_name, concat('goal ', agent_id) AS motivation,
  concat(agent_id % 24, ':30') AS current_time,
  CASE WHEN agent_id % 3 <> 0 THEN (agent_id * 10)::VARCHAR ELSE 'No information provided' END AS endowment,
  time_start, time_end,
  CASE WHEN now::DATE = before::DATE
       THEN concat(strftime(before, '%d %b %Y [%H:%M:%S  '), strftime(now, '- %H:%M:%S]: '))
       ELSE concat(strftime(before, '[%d %b %Y %H:%M:%S  '), strftime(now, '- %d %b %Y  %H:%M:%S]: ')) END AS interval_label,
  replace(concat_ws(chr(10) || chr(10), '# Scenario Understanding' || chr(10) || s.body,
    '# Participant Understanding' || chr(10) || p.body, '# Self Understanding' || chr(10) || f.body,
    '# Guidance from Trusted Advisor' || chr(10) || g.body, '# Most Recent Observations' || chr(10) || x.context),
    '```', chr(10)) AS context
FROM (SELECT DISTINCT agent_id, TIMESTAMP '2024-01-20 00:30:00' + to_hours(agent_id % 24) AS now,
             TIMESTAMP '2024-01-19 20:30:00' + to_hours(agent_id % 24) AS before FROM log) c
LEFT JOIN (FROM sections WHERE tag = 'ScenarioUnderstanding') s USING (agent_id)
LEFT JOIN (FROM sections WHERE tag = 'ParticipantUnderstanding') p USING (agent_id)
LEFT JOIN (FROM sections WHERE tag = 'SelfUnderstanding') f USING (agent_id)
LEFT JOIN (FROM sections WHERE tag = 'ThoughtProcessForAction') g USING (agent_id)
LEFT JOIN agent_text x USING (agent_id)""",
    "normalise_answers": """SELECT id, output_type,
  CASE output_type WHEN 'FREE' THEN concat('Agent ', event_type, ' ')
                   WHEN 'CHOICE' THEN ['accept', 'reject', event_type][user_id % 4 + 1] END AS answer_text,
  CASE WHEN output_type = 'FLOAT' THEN
    CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 0.0
         WHEN id % 13 = 0 THEN concat('10', floor(value)::BIGINT)::DOUBLE
         ELSE concat(floor(value * 4)::BIGINT, 'e-2')::DOUBLE END END AS answer_number
FROM answers""",
    "mode_colours": """SELECT dataset, mode, position, colour FROM (
  SELECT dataset, coalesce(mode, 'UNKNOWN') AS mode,
    row_number() OVER (PARTITION BY dataset ORDER BY mode NULLS FIRST) AS position
  FROM (SELECT DISTINCT dataset, mode FROM valid)
) JOIN palette ON slot = (position - 1) % 10""",
    "mode_colours_by_size": "SELECT * FROM size_colours",
    "origin_sample": f"""SELECT dataset, coalesce(mode, 'UNKNOWN') AS mode, start_lat, start_lng, end_lat, end_lng, trip_count,
  row_number() OVER (PARTITION BY dataset, mode ORDER BY md5(concat_ws('|', {_OD_KEYS}, '0')),
    start_lat, start_lng, end_lat, end_lng) AS pick
FROM top_flows QUALIFY pick <= 5""",
    "layer_features": f"""SELECT * FROM (
  WITH best AS (
    SELECT * REPLACE (coalesce(mode, 'UNKNOWN') AS mode),
      dense_rank() OVER (PARTITION BY dataset ORDER BY mode NULLS FIRST) AS position,
      row_number() OVER (PARTITION BY dataset, mode ORDER BY md5(concat_ws('|', {_OD_KEYS}, '0')),
        start_lat, start_lng, end_lat, end_lng) AS pick
    FROM top_flows WHERE rank <= 20),
  styled AS (SELECT best.*, colour FROM best JOIN palette ON slot = (position - 1) % 10),
  ahead AS (SELECT * REPLACE (coalesce(mode, 'UNKNOWN') AS mode) FROM frequent WHERE rank <= 10)
  SELECT dataset, mode, rank, 'flow' AS kind, concat({_START}, ';', {_END}) AS coords, colour,
    round(1 + pow(trip_count::DOUBLE, 0.3::DOUBLE), 6) AS size, 0.6::DOUBLE AS opacity, {_NO_TEXT} AS dash,
    concat_ws(' | ', dataset, mode, concat('trips: ', trip_count), concat('rank: #', rank)) AS tooltip, {_NO_TEXT} AS popup
  FROM styled
  UNION ALL SELECT dataset, mode, rank, 'origin', {_START}, colour, 2.0, 0.5, NULL, NULL, NULL FROM styled WHERE pick <= 5
  UNION ALL SELECT dataset, mode, rank, 'top_route', concat({_START}, ';', {_END}), '#d32f2f', 6 + (11 - rank) * 0.5, 0.9, NULL,
    concat('#', rank, ': ', format('{{:,}}', trip_count), ' trips (', mode, ')'), {_TOP_LABEL} FROM ahead
  UNION ALL SELECT dataset, mode, rank, 'top_route_start', {_START}, 'green', 8.0, 0.7, NULL, NULL, concat('Start: Rank #', rank) FROM ahead
  UNION ALL SELECT dataset, mode, rank, 'top_route_end', {_END}, 'red', 8.0, 0.7, NULL, NULL, concat('End: Rank #', rank) FROM ahead
)""",
    "network_features": f"""SELECT * FROM (
  WITH styled AS (
    SELECT l.* REPLACE (coalesce(l.mode, 'UNKNOWN') AS mode), c.colour,
      row_number() OVER (PARTITION BY l.dataset, l.mode
        ORDER BY md5(concat_ws('|', {_OD_KEYS}, trajectory_segments, '0')),
        start_lat, start_lng, end_lat, end_lng, trajectory_segments) AS pick
    FROM lines l JOIN size_colours c ON c.dataset = l.dataset AND c.mode = coalesce(l.mode, 'UNKNOWN'))
  SELECT dataset, mode, NULL::BIGINT AS rank, 'network_route' AS kind,
    CASE WHEN n_points > 1 THEN points ELSE concat({_START}, ';', {_END}) END AS coords, colour,
    round(2 + pow(trip_count::DOUBLE, 0.4::DOUBLE), 6) AS size,
    CASE WHEN n_points > 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS opacity,
    CASE WHEN n_points > 1 THEN NULL ELSE '5, 10' END AS dash,
    concat('East to Bay | ', mode, ' | trips: ', trip_count, ' (same route) | ~', {_decimals('avg_distance_miles', 0)}, 'mi, ',
      {_decimals('avg_duration_min', 0)}, 'min',
      CASE WHEN n_points > 1 THEN ' (Continuous Route)' ELSE ' (Direct Line - No Network Data)' END) AS tooltip,
    {_NO_TEXT} AS popup
  FROM styled
  UNION ALL SELECT dataset, mode, pick, 'network_origin', {_START}, colour, 3.0, 0.6, NULL, NULL,
    concat('Origin: ', mode, ' trips') FROM styled WHERE pick <= 10
)""",
    "od_line_features": f"""SELECT dataset, coalesce(mode, 'UNKNOWN') AS mode, rank, 'od_line' AS kind,
  concat({_START}, ';', {_END}) AS coords,
  CASE mode WHEN 'BIKING' THEN 'pink' WHEN 'PRIVATE_AUTO' THEN 'blue' WHEN 'CARPOOL' THEN 'green'
    WHEN 'ON_DEMAND_AUTO' THEN 'purple' WHEN 'WALKING' THEN 'orange' WHEN 'COMMERCIAL' THEN 'red'
    WHEN 'PUBLIC_TRANSIT' THEN 'yellow' WHEN 'OTHER_TRAVEL_MODE' THEN 'grey' ELSE 'gray' END AS colour,
  2.0::DOUBLE AS size, 0.6::DOUBLE AS opacity, {_NO_TEXT} AS dash, {_NO_TEXT} AS tooltip, {_NO_TEXT} AS popup
FROM top_od""",
    "origin_features": f"""SELECT dataset, coalesce(mode, 'UNKNOWN') AS mode, rank, 'origin_count' AS kind,
  concat(round(y * 1e6)::BIGINT, ' ', round(x * 1e6)::BIGINT) AS coords,
  CASE WHEN mode IN ('PRIVATE_AUTO', 'CARPOOL', 'ON_DEMAND_AUTO') THEN 'blue' ELSE 'green' END AS colour,
  round(2 + pow(trip_count::DOUBLE, 0.2::DOUBLE), 6) AS size, 0.6::DOUBLE AS opacity, {_NO_TEXT} AS dash, {_NO_TEXT} AS tooltip,
  concat_ws(chr(10), dataset, concat('Mode: ', coalesce(mode, 'UNKNOWN')), concat('Trips: ', trip_count)) AS popup
FROM origins
UNION ALL SELECT dataset, coalesce(mode, 'UNKNOWN'), rank, 'origin_point',
  concat(round(y * 1e6)::BIGINT, ' ', round(x * 1e6)::BIGINT),
  CASE WHEN mode = 'PRIVATE_AUTO' THEN 'blue' ELSE 'red' END, round(pow(trip_count::DOUBLE, 0.3::DOUBLE), 6), 0.5, NULL, NULL, NULL
FROM origins""",
    "dataset_report": """SELECT s.*, p.top_mode, p.top_mode_percentage, p.top_mode_trips, p.top_modes,
  f.mode AS top_route_mode, f.trip_count AS top_route_trips,
  f.avg_distance_miles AS top_route_distance_miles, f.avg_duration_min AS top_route_duration_min
FROM stats s
LEFT JOIN (
  SELECT dataset, max(mode) FILTER (place = 1) AS top_mode, max(percentage) FILTER (place = 1) AS top_mode_percentage,
    max(total_individual_trips) FILTER (place = 1) AS top_mode_trips,
    string_agg(coalesce(mode, 'UNKNOWN'), ', ' ORDER BY place) FILTER (place <= 3) AS top_modes
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY total_individual_trips DESC, mode NULLS FIRST) AS place
        FROM popularity) GROUP BY dataset) p USING (dataset)
LEFT JOIN (FROM frequent WHERE rank = 1) f USING (dataset)""",
}


BODIES["stored_od_box"] = BODIES["od_bbox_trips"]
BODIES["mode_medians_merged"] = """SELECT dataset, mode, count(*) AS trips, min(duration_minutes) AS shortest,
  max(duration_minutes) AS longest, true AS within FROM usable GROUP BY ALL"""
for _same in ("gtfs_feed_folders", "gtfs_feed_zips"):
    BODIES[_same] = BODIES["gtfs_stop_times"]
BODIES["layer_files"] = BODIES["layer_features"]
BODIES["layer_geojson"] = f"""SELECT dataset, mode, 'Feature' AS type,
  CASE WHEN contains(coords, ';') THEN 'LineString' ELSE 'Point' END AS geometry, coords, kind, colour, dash, tooltip, popup, size, opacity
FROM ({BODIES["layer_features"]}) f"""


def _needed(sql: str, found: set[str]) -> None:
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name in VIEWS:
        if name in words and name not in found:
            found.add(name)
            _needed(VIEWS[name], found)


def oracle(name: str) -> str:
    """One statement: the views a body uses, in order, then the body."""
    found: set[str] = set()
    _needed(BODIES[name], found)
    views = [f"{view} AS ({sql.strip()})" for view, sql in VIEWS.items() if view in found]
    return "WITH " + ",\n".join(views) + "\n" + BODIES[name]

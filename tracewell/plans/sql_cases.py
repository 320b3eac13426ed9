"""SQL texts with what their analysis must say, for the registered SQL queries and the tests.

A case is (inventory row, dialect, catalog, SQL, lines). {k} stands for a number, so that a case makes as many texts as
wanted. The catalog lists relations as name(column, ...), with `...` last where there may be others. A line that begins
with > states a statement: kind, relations read, what it writes, diagnostics. Other lines state its outputs in order:
name, ordinal (? unknown), transform, sources (- none), reasons after !, and * with what an open segment stands behind.
A single line "error" means that the text is refused.
"""

from __future__ import annotations

Case = tuple[str, str, str, str, list[str]]

CASES: list[Case] = [
    # statements
    ("A1", "postgres", "", "SELECT hull, crew * 2 AS doubled FROM ship{k}", ["> query reads ship{k}", "hull 0 direct ship{k}.hull", "doubled 1 expression ship{k}.crew"]),
    ("A2", "postgres", "", "INSERT INTO log{k} (vessel, at_sea) SELECT hull, days FROM ship{k}", ["> insert reads ship{k} writes log{k}", "vessel 0 direct ship{k}.hull", "at_sea 1 direct ship{k}.days"]),
    ("A2", "postgres", "", "INSERT INTO log{k} (vessel, at_sea, port) SELECT hull, days FROM ship{k}", ["> insert reads ship{k} writes log{k} ! target_width 3 columns, 2 values", "vessel 0 direct ship{k}.hull", "at_sea 1 direct ship{k}.days"]),
    ("A3", "duckdb", "", "CREATE OR REPLACE TABLE fleet{k} AS SELECT max(draft) AS deepest FROM ship{k}", ["> create reads ship{k} writes fleet{k}", "deepest 0 aggregation ship{k}.draft"]),
    ("A3", "duckdb", "", "CREATE TABLE fleet{k} (deepest INT, widest INT)", ["> other"]),
    ("A4", "postgres", "", "UPDATE berth{k} SET fee = tariff{k}.rate * 2, note = 'due' FROM tariff{k} WHERE berth{k}.zone = tariff{k}.zone", ["> update reads tariff{k} writes berth{k}", "fee 0 expression tariff{k}.rate", "note 1 direct -"]),
    ("A5", "postgres", "", "DELETE FROM berth{k} USING ship{k} WHERE ship{k}.id = berth{k}.ship_id", ["> delete reads ship{k} writes berth{k}"]),
    ("A6", "snowflake", "", "MERGE INTO PORT{k} p USING ARRIVAL{k} a ON p.CODE = a.CODE WHEN MATCHED AND a.GONE THEN DELETE WHEN MATCHED THEN UPDATE SET CALLS = p.CALLS + a.CALLS WHEN NOT MATCHED THEN INSERT (CODE, CALLS) VALUES (a.CODE, 1)", ["> merge reads ARRIVAL{k},PORT{k} writes PORT{k} ! duplicate_output CALLS", "CALLS 0 expression ARRIVAL{k}.CALLS,PORT{k}.CALLS", "CODE 1 direct ARRIVAL{k}.CODE", "CALLS 2 direct -"]),
    ("A6", "databricks", "arrival{k}(code, calls)", "MERGE INTO port{k} AS p USING arrival{k} AS a ON p.code = a.code WHEN NOT MATCHED THEN INSERT *", ["> merge reads arrival{k},port{k} writes port{k}", "code 0 direct arrival{k}.code", "calls 1 direct arrival{k}.calls"]),
    ("A7", "postgres", "", "GRANT SELECT ON ship{k} TO harbour", ["> other"]),
    ("A7", "postgres", "", "ALTER TABLE ship{k} ADD COLUMN keel TEXT", ["> other"]),
    ("A8", "postgres", "", "SELECT hull FROM ship{k}; VACUUM; SELECT code FROM port{k}", ["> query reads ship{k}", "hull 0 direct ship{k}.hull", "> other", "> query reads port{k}", "code 0 direct port{k}.code"]),
    ("A8", "postgres", "", "SELECT hull FROM ship{k}; SELECT (hull FROM ship{k}", ["error"]),
    # relations
    ("A9", "postgres", "", "SELECT s.hull FROM depot.yard.ship{k} AS s", ["> query reads depot.yard.ship{k}", "hull 0 direct depot.yard.ship{k}.hull"]),
    ("A10", "postgres", "", "WITH ship{k} AS (SELECT keel AS id FROM hulk{k}) SELECT ship{k}.id, y.id AS yard_id FROM ship{k}, yard.ship{k} AS y", ["> query reads hulk{k},yard.ship{k}", "id 0 direct hulk{k}.keel", "yard_id 1 direct yard.ship{k}.id"]),
    ("A11", "postgres", "", "SELECT d.tons FROM (SELECT weight / 1000 AS tons FROM cargo{k}) AS d", ["> query reads cargo{k}", "tons 0 expression cargo{k}.weight"]),
    ("A11", "trino", "", "SELECT tons FROM (SELECT weight AS tons FROM cargo{k})", ["> query reads cargo{k}", "tons 0 direct cargo{k}.weight"]),
    ("A12", "postgres", "", "SELECT l.top FROM ship{k} AS s CROSS JOIN LATERAL (SELECT max(c.weight) AS top FROM cargo{k} AS c WHERE c.ship_id = s.id) AS l", ["> query reads ship{k},cargo{k}", "top 0 aggregation cargo{k}.weight"]),
    ("A12", "tsql", "", "SELECT l.near FROM ship{k} AS s OUTER APPLY (SELECT TOP 1 s.lat + p.lat AS near FROM port{k} AS p) AS l", ["> query reads ship{k},port{k}", "near 0 expression port{k}.lat,ship{k}.lat"]),
    ("A13", "postgres", "ship{k}(id, hull) crew{k}(cook)", "SELECT j.hull, j.cook FROM (ship{k} CROSS JOIN crew{k}) AS j", ["> query reads ship{k},crew{k}", "hull 0 direct ship{k}.hull", "cook 1 direct crew{k}.cook"]),
    ("A13", "postgres", "", "SELECT s.hull, c.cook FROM (ship{k} s CROSS JOIN crew{k} c)", ["> query reads ship{k},crew{k}", "hull 0 direct ship{k}.hull", "cook 1 direct crew{k}.cook"]),
    ("A14", "postgres", "", "SELECT v.ton, v.mate FROM (SELECT weight, chief FROM cargo{k}) AS v(ton, mate)", ["> query reads cargo{k}", "ton 0 direct cargo{k}.weight", "mate 1 direct cargo{k}.chief"]),
    ("A14", "postgres", "cargo{k}(weight, chief)", "SELECT v.ton, v.chief FROM cargo{k} AS v(ton)", ["> query reads cargo{k}", "ton 0 direct cargo{k}.weight", "chief 1 direct cargo{k}.chief"]),
    ("A14", "postgres", "", "SELECT v.ton FROM cargo{k} AS v(ton)", ["> query reads cargo{k}", "ton 0 direct - ! alias_position ton"]),
    ("A15", "bigquery", "", "SELECT stop FROM route{k} AS r CROSS JOIN UNNEST(r.stops) AS stop", ["> query reads route{k}", "stop 0 expression route{k}.stops"]),
    ("A15", "bigquery", "route{k}(stops)", "SELECT stop, nth FROM route{k} AS r, UNNEST(r.stops) AS stop WITH OFFSET AS nth", ["> query reads route{k}", "stop 0 expression route{k}.stops", "nth 1 direct -"]),
    ("A15", "postgres", "", "SELECT u.stop FROM route{k} AS r CROSS JOIN UNNEST(r.stops) AS u(stop)", ["> query reads route{k}", "stop 0 expression route{k}.stops"]),
    ("A16", "bigquery", "route{k}(a, b)", "SELECT leg, cost FROM route{k} AS r, UNNEST([STRUCT(r.a AS leg, 1 AS cost), STRUCT(r.b AS leg, 2 AS cost)])", ["> query reads route{k}", "leg 0 direct route{k}.a,route{k}.b", "cost 1 direct -"]),
    ("A17", "duckdb", "", "SELECT unnest FROM unnest([3, 1, 2])", ["> query", "unnest 0 expression -"]),
    ("A18", "snowflake", "", "SELECT G.V FROM TABLE(GENERATOR(ROWCOUNT => 5)) AS G", ["> query", "V 0 direct - ! unsupported table function"]),
    ("A19", "mysql", "", "SELECT b.n, s.id FROM ship{k} AS s, JSON_TABLE(s.papers, '$[*]' COLUMNS (n INT PATH '$.n', NESTED PATH '$.m' COLUMNS (m INT PATH '$'))) AS b", ["> query reads ship{k}", "n 0 direct - ! unsupported json table", "id 1 direct ship{k}.id"]),
    ("A19", "tsql", "", "SELECT b.n FROM ship{k} AS s CROSS APPLY OPENJSON(s.papers) WITH (n int '$.n') AS b", ["> query reads ship{k}", "n 0 direct - ! unsupported openjson"]),
    ("A19", "postgres", "", "SELECT b.n FROM ship{k} AS s, XMLTABLE('/m/r' PASSING s.manifest COLUMNS n int PATH 'n') AS b", ["> query reads ship{k}", "n 0 direct - ! unsupported xmltable"]),
    ("A20", "snowflake", "", "SELECT V.TOTAL FROM SEMANTIC_VIEW(FREIGHT{k} METRICS TOTAL DIMENSIONS LANE) AS V", ["> query reads FREIGHT{k}", "TOTAL 0 direct - ! unsupported semantic view"]),
    ("A21", "snowflake", "", "SELECT P.Q1 FROM CARGO{k} PIVOT(SUM(TONS) FOR QUARTER IN ('1', '2')) AS P", ["> query reads CARGO{k}", "Q1 0 direct - ! unsupported pivot"]),
    ("A21", "duckdb", "", "SELECT * FROM cargo{k} UNPIVOT (tons FOR quarter IN (q1, q2)) AS u", ["> query reads cargo{k}", "- ? direct - ! unsupported unpivot * unpivot"]),
    ("A22", "snowflake", "", "SELECT M.LAST_LAT FROM TRACK{k} MATCH_RECOGNIZE (PARTITION BY SHIP ORDER BY AT MEASURES LAST(LAT) AS LAST_LAT PATTERN (A+) DEFINE A AS LAT > 0) AS M", ["> query reads TRACK{k}", "LAST_LAT 0 direct - ! unsupported match_recognize"]),
    ("A24", "postgres", "", "INSERT INTO port{k} (code, calls) VALUES ('A', 1), ('B', 2)", ["> insert writes port{k}", "code 0 direct -", "calls 1 direct -"]),
    ("A24", "postgres", "", "SELECT * FROM (VALUES (1, 2), (3)) AS v", ["error"]),
    ("A25", "postgres", "port{k}(code, calls)", "TABLE port{k}", ["> query reads port{k}", "code 0 direct port{k}.code", "calls 1 direct port{k}.calls"]),
    ("A26", "duckdb", "port{k}(code)", "FROM port{k} WHERE calls > 2", ["> query reads port{k}", "code 0 direct port{k}.code"]),
    ("A27", "bigquery", "", "FROM port{k} |> WHERE calls > 2", ["error"]),
    # projection
    ("A28", "postgres", "", 'SELECT code, upper(code), code || \'!\' AS "Loud Code", calls shout FROM port{k}', ["> query reads port{k}", "code 0 direct port{k}.code", "upper 1 expression port{k}.code", "Loud Code 2 expression port{k}.code", "shout 3 direct port{k}.calls"]),
    ("A29", "postgres", "port{k}(code, calls)", "SELECT p.*, 1 AS one FROM port{k} AS p", ["> query reads port{k}", "code 0 direct port{k}.code", "calls 1 direct port{k}.calls", "one 2 direct -"]),
    ("A29", "postgres", "", "SELECT *, 1 AS one FROM port{k}", ["> query reads port{k}", "- ? direct - ! behind_star port{k} * port{k}", "one ? direct -"]),
    ("A30", "bigquery", "port{k}(code, calls, zone)", "SELECT * EXCEPT (zone) REPLACE (calls + 1 AS calls) FROM port{k}", ["> query reads port{k}", "code 0 direct port{k}.code", "calls 1 expression port{k}.calls"]),
    ("A30", "snowflake", "PORT{k}(CODE, CALLS, ZONE)", "SELECT * ILIKE '%O%' RENAME (ZONE AS AREA) FROM PORT{k}", ["> query reads PORT{k}", "CODE 0 direct PORT{k}.CODE", "AREA 1 direct PORT{k}.ZONE"]),
    ("A30", "duckdb", "port{k}(code, calls)", "SELECT * EXCLUDE code FROM port{k}", ["> query reads port{k}", "calls 0 direct port{k}.calls"]),
    # joins
    ("B1", "mysql", "", "SELECT s.hull, p.code FROM ship{k} s STRAIGHT_JOIN port{k} p ON s.home = p.id CROSS JOIN tide{k}", ["> query reads ship{k},port{k},tide{k}", "hull 0 direct ship{k}.hull", "code 1 direct port{k}.code"]),
    ("B1", "postgres", "ship{k}(id, hull) mast{k}(id)", "SELECT id FROM ship{k} INNER JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct mast{k}.id,ship{k}.id"]),
    ("B2", "postgres", "ship{k}(id) mast{k}(id)", "SELECT id FROM ship{k} FULL OUTER JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct mast{k}.id,ship{k}.id"]),
    ("B3", "postgres", "ship{k}(id) mast{k}(id)", "SELECT id FROM ship{k} LEFT OUTER JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct ship{k}.id"]),
    ("B4", "databricks", "ship{k}(id) mast{k}(id)", "SELECT id FROM ship{k} LEFT SEMI JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct ship{k}.id"]),
    ("B4", "databricks", "ship{k}(id) mast{k}(id)", "SELECT id FROM ship{k} ANTI JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct ship{k}.id"]),
    ("B5", "postgres", "ship{k}(id) mast{k}(id)", "SELECT id FROM ship{k} RIGHT JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct mast{k}.id"]),
    ("B6", "duckdb", "ship{k}(id, at) fix{k}(id, at, lat)", "SELECT id, lat FROM ship{k} ASOF JOIN fix{k} USING (id, at)", ["> query reads ship{k},fix{k}", "id 0 direct ship{k}.id", "lat 1 direct fix{k}.lat"]),
    ("B7", "tsql", "", "SELECT s.id, d.far FROM ship{k} s CROSS APPLY (SELECT s.lat * 60 AS far) d", ["> query reads ship{k}", "id 0 direct ship{k}.id", "far 1 expression ship{k}.lat"]),
    ("B8", "clickhouse", "route{k}(id, stops)", "SELECT id, stop FROM route{k} ARRAY JOIN stops AS stop", ["> query reads route{k}", "id 0 direct route{k}.id", "stop 1 expression route{k}.stops"]),
    ("B9", "postgres", "", "SELECT s.hull FROM ship{k} s JOIN port{k} p ON s.draft < p.depth AND p.open", ["> query reads ship{k},port{k}", "hull 0 direct ship{k}.hull"]),
    ("B10", "postgres", "ship{k}(hull, id) mast{k}(wood, id)", "SELECT * FROM ship{k} JOIN mast{k} USING (id)", ["> query reads ship{k},mast{k}", "id 0 direct mast{k}.id,ship{k}.id", "hull 1 direct ship{k}.hull", "wood 2 direct mast{k}.wood"]),
    ("B11", "postgres", "ship{k}(hull, id) mast{k}(wood, id)", "SELECT id, wood FROM ship{k} NATURAL JOIN mast{k}", ["> query reads ship{k},mast{k}", "id 0 direct mast{k}.id,ship{k}.id", "wood 1 direct mast{k}.wood"]),
    ("B12", "postgres", "", "SELECT hull FROM ship{k}, mast{k}", ["> query reads ship{k},mast{k}", "hull 0 direct - ! ambiguous hull"]),
    ("B12", "postgres", "", "SELECT s.hull FROM ship{k} AS s, mast{k} AS s", ["> query reads ship{k},mast{k}", "hull 0 direct - ! ambiguous s.hull"]),
    ("B13", "postgres", "", "SELECT (SELECT max(m.height + s.draft) FROM mast{k} AS m WHERE m.ship = s.id) AS clearance FROM ship{k} AS s", ["> query reads ship{k},mast{k}", "clearance 0 aggregation mast{k}.height,ship{k}.draft"]),
    ("B13", "postgres", "ship{k}(draft) mast{k}(height)", "SELECT (SELECT min(draft) FROM mast{k}) AS d FROM ship{k}", ["> query reads ship{k},mast{k}", "d 0 aggregation ship{k}.draft"]),
    # aggregates and windows
    ("C1", "postgres", "", "SELECT sum(a) AS s, avg(b) AS v, min(c) AS lo, stddev(d) AS sd, string_agg(e, ',') AS names, count_if(f) AS n FROM tide{k}", ["> query reads tide{k}", "s 0 aggregation tide{k}.a", "v 1 aggregation tide{k}.b", "lo 2 aggregation tide{k}.c", "sd 3 aggregation tide{k}.d", "names 4 aggregation tide{k}.e", "n 5 expression tide{k}.f"]),
    ("C2", "postgres", "", "SELECT count(*) AS n FROM tide{k}", ["> query reads tide{k}", "n 0 aggregation -"]),
    ("C3", "postgres", "", "SELECT percentile_disc(0.9) WITHIN GROUP (ORDER BY level DESC) AS p90 FROM tide{k}", ["> query reads tide{k}", "p90 0 aggregation tide{k}.level"]),
    ("C4", "postgres", "", "SELECT sum(level) FILTER (WHERE gauge IN (SELECT id FROM gauge{k})) AS s FROM tide{k}", ["> query reads tide{k},gauge{k}", "s 0 aggregation tide{k}.level"]),
    ("C4", "postgres", "", "SELECT array_agg(level ORDER BY at) AS xs FROM tide{k}", ["> query reads tide{k}", "xs 0 aggregation tide{k}.level"]),
    ("C5", "postgres", "", "SELECT DISTINCT gauge, count(DISTINCT level) AS n FROM tide{k} GROUP BY gauge", ["> query reads tide{k}", "gauge 0 direct tide{k}.gauge", "n 1 aggregation tide{k}.level"]),
    ("C6", "postgres", "", "SELECT gauge FROM tide{k} GROUP BY gauge, moon HAVING max(level) > (SELECT cap FROM limits{k})", ["> query reads tide{k},limits{k}", "gauge 0 direct tide{k}.gauge"]),
    ("C7", "postgres", "", "SELECT gauge, moon, sum(level) AS s FROM tide{k} GROUP BY GROUPING SETS ((gauge), (moon), ())", ["> query reads tide{k}", "gauge 0 direct tide{k}.gauge", "moon 1 direct tide{k}.moon", "s 2 aggregation tide{k}.level"]),
    ("C7", "postgres", "", "SELECT gauge, sum(level) AS s FROM tide{k} GROUP BY ROLLUP (gauge, moon)", ["> query reads tide{k}", "gauge 0 direct tide{k}.gauge", "s 1 aggregation tide{k}.level"]),
    ("C8", "postgres", "", "SELECT sum(level) OVER (PARTITION BY gauge ORDER BY at DESC) AS run FROM tide{k}", ["> query reads tide{k}", "run 0 expression tide{k}.at,tide{k}.gauge,tide{k}.level"]),
    ("C9", "postgres", "", "SELECT avg(level) OVER w AS smooth, lag(level) OVER (ORDER BY at ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS was FROM tide{k} WINDOW w AS (PARTITION BY gauge)", ["> query reads tide{k}", "smooth 0 expression tide{k}.level", "was 1 expression tide{k}.at,tide{k}.level"]),
    ("C10", "snowflake", "", "SELECT GAUGE FROM TIDE{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY GAUGE ORDER BY AT) = 1 ORDER BY LEVEL LIMIT 5", ["> query reads TIDE{k}", "GAUGE 0 direct TIDE{k}.GAUGE"]),
    ("C11", "postgres", "", "SELECT v + 1 AS w FROM (SELECT CASE WHEN moon THEN sum(level) ELSE 0 END AS v FROM tide{k} GROUP BY moon) AS x", ["> query reads tide{k}", "w 0 aggregation tide{k}.level,tide{k}.moon"]),
    # set operations, common table expressions, subqueries
    ("D1", "postgres", "", "SELECT hull AS name FROM ship{k} UNION ALL SELECT code FROM port{k} UNION SELECT title FROM chart{k}", ["> query reads ship{k},port{k},chart{k}", "name 0 direct chart{k}.title,port{k}.code,ship{k}.hull"]),
    ("D2", "postgres", "", "SELECT hull FROM ship{k} INTERSECT ALL SELECT name FROM wreck{k}", ["> query reads ship{k},wreck{k}", "hull 0 direct ship{k}.hull,wreck{k}.name"]),
    ("D2", "postgres", "", "SELECT a FROM x{k} UNION SELECT b FROM y{k} INTERSECT SELECT c FROM z{k}", ["> query reads x{k},y{k},z{k}", "a 0 direct x{k}.a,y{k}.b,z{k}.c"]),
    ("D3", "snowflake", "", "SELECT HULL FROM SHIP{k} MINUS SELECT NAME FROM WRECK{k}", ["> query reads SHIP{k},WRECK{k}", "HULL 0 direct SHIP{k}.HULL"]),
    ("D4", "postgres", "", "SELECT hull, s.* FROM ship{k} AS s UNION ALL SELECT name, w.* FROM wreck{k} AS w", ["> query reads ship{k},wreck{k}", "hull 0 direct ship{k}.hull,wreck{k}.name", "- ? direct - ! alignment *,behind_star ship{k} * ship{k}"]),
    ("D5", "duckdb", "", "SELECT hull, year FROM ship{k} UNION ALL BY NAME SELECT year, hull FROM wreck{k}", ["> query reads ship{k},wreck{k}", "hull 0 direct ship{k}.hull,wreck{k}.hull", "year 1 direct ship{k}.year,wreck{k}.year"]),
    ("D5", "postgres", "", "SELECT hull FROM ship{k} UNION BY NAME SELECT hull FROM wreck{k}", ["> query reads ship{k},wreck{k}", "hull 0 direct ship{k}.hull ! unsupported by name"]),
    ("D6", "postgres", "", "SELECT hull, year FROM ship{k} EXCEPT SELECT hull FROM wreck{k} UNION SELECT 1", ["> query reads ship{k},wreck{k} ! set_arity 2 and 1", "hull 0 direct ship{k}.hull", "year 1 direct ship{k}.year"]),
    ("D7", "postgres", "", "WITH a AS (SELECT hull AS h FROM ship{k}), b AS (SELECT h FROM a) SELECT b.h, (WITH a AS (SELECT max(year) AS y FROM wreck{k}) SELECT y FROM a) AS y FROM b", ["> query reads ship{k},wreck{k}", "h 0 direct ship{k}.hull", "y 1 aggregation wreck{k}.year"]),
    ("D7", "postgres", "", "WITH b AS (SELECT h FROM a), a AS (SELECT hull AS h FROM ship{k}) SELECT b.h FROM b", ["> query reads a,ship{k}", "h 0 direct a.h"]),
    ("D8", "postgres", "", "WITH RECURSIVE up AS (SELECT boss, rank FROM crew{k} UNION ALL SELECT c.boss, u.rank FROM crew{k} c JOIN up u ON c.id = u.boss) SELECT boss, rank FROM up", ["> query reads crew{k}", "boss 0 direct crew{k}.boss", "rank 1 direct crew{k}.rank ! recursive up"]),
    ("D9", "bigquery", "", "SELECT ARRAY(SELECT s.tons FROM cargo{k} AS s) AS loads, (SELECT max(m.high) FROM mast{k} AS m) AS top, t.id IN (SELECT w.id FROM wreck{k} AS w) AS lost FROM ship{k} AS t", ["> query reads ship{k},cargo{k},mast{k},wreck{k}", "loads 0 expression cargo{k}.tons", "top 1 aggregation mast{k}.high", "lost 2 expression ship{k}.id,wreck{k}.id"]),
    ("D9", "postgres", "", "SELECT (SELECT a, b FROM cargo{k}) AS pair FROM ship{k}", ["> query reads ship{k},cargo{k}", "pair 0 expression - ! unsupported subquery shape"]),
    ("D10", "postgres", "", "SELECT NOT EXISTS (SELECT 1 FROM wreck{k} w WHERE w.id = s.id) AS afloat FROM ship{k} s", ["> query reads ship{k},wreck{k}", "afloat 0 expression -"]),
    ("D11", "postgres", "", "SELECT flag IN (home, 'X', lower(alt)) AS own FROM ship{k}", ["> query reads ship{k}", "own 0 expression ship{k}.alt,ship{k}.flag,ship{k}.home"]),
    ("D11", "sqlite", "wreck{k}(id)", "SELECT s.id IN wreck{k} AS lost FROM ship{k} AS s", ["> query reads ship{k},wreck{k}", "lost 0 expression ship{k}.id,wreck{k}.id"]),
    ("D11", "bigquery", "", "SELECT s.flag IN UNNEST(s.flags) AS own FROM ship{k} AS s", ["> query reads ship{k}", "own 0 expression ship{k}.flag,ship{k}.flags"]),
    # expressions
    ("E1", "postgres", "", 'SELECT hull, s.keel, "Odd Name" FROM yard.ship{k} AS s', ["> query reads yard.ship{k}", "hull 0 direct yard.ship{k}.hull", "keel 1 direct yard.ship{k}.keel", "Odd Name 2 direct yard.ship{k}.Odd Name"]),
    ("E1", "bigquery", "", "SELECT s FROM ship{k} AS s", ["> query reads ship{k}", "s 0 direct - ! row_value s"]),
    ("E1", "postgres", "ship{k}(s, hull)", "SELECT s FROM ship{k} AS s", ["> query reads ship{k}", "s 0 direct ship{k}.s"]),
    ("E2", "postgres", "", "SELECT 4.5 AS n, 'it''s' AS q, DATE '2020-01-31' AS d, TIMESTAMP '2020-01-31 10:00:00' AS ts FROM ship{k}", ["> query reads ship{k}", "n 0 direct -", "q 1 direct -", "d 2 direct -", "ts 3 direct -"]),
    ("E3", "postgres", "", "SELECT CAST(tons AS NUMERIC(10, 2)) AS a, tons::double precision AS b, flag COLLATE \"C\" AS c FROM ship{k}", ["> query reads ship{k}", "a 0 direct ship{k}.tons", "b 1 direct ship{k}.tons", "c 2 direct ship{k}.flag"]),
    ("E3", "tsql", "", "SELECT CONVERT(varchar(10), built, 120) AS b, TRY_CONVERT(int, crew) AS c, TRY_CAST(tons AS float) AS t FROM ship{k}", ["> query reads ship{k}", "b 0 direct ship{k}.built", "c 1 direct ship{k}.crew", "t 2 direct ship{k}.tons"]),
    ("E3", "mysql", "", "SELECT CONVERT(tons, UNSIGNED) AS t, CONVERT(flag USING utf8mb4) AS f FROM ship{k}", ["> query reads ship{k}", "t 0 direct ship{k}.tons", "f 1 direct ship{k}.flag"]),
    ("E4", "postgres", "", "SELECT sunk IS NOT NULL AS a, leak IS TRUE AS b, home IS DISTINCT FROM flag AS c FROM ship{k}", ["> query reads ship{k}", "a 0 expression ship{k}.sunk", "b 1 expression ship{k}.leak", "c 2 expression ship{k}.flag,ship{k}.home"]),
    ("E5", "postgres", "", "SELECT trim(BOTH x FROM a) AS t, substring(b FROM 2 FOR n) AS s, overlay(c PLACING d FROM 1) AS o, position(e IN f) AS p, g LIKE h ESCAPE '!' AS l, i SIMILAR TO j AS m FROM ship{k}", ["> query reads ship{k}", "t 0 expression ship{k}.a,ship{k}.x", "s 1 expression ship{k}.b,ship{k}.n", "o 2 expression ship{k}.c,ship{k}.d", "p 3 expression ship{k}.e,ship{k}.f", "l 4 expression ship{k}.g,ship{k}.h", "m 5 expression ship{k}.i,ship{k}.j"]),
    ("E6", "postgres", "", "SELECT extract(month FROM built) AS m, built AT TIME ZONE zone AS z, built + INTERVAL '1 day' AS n FROM ship{k}", ["> query reads ship{k}", "m 0 expression ship{k}.built", "z 1 expression ship{k}.built,ship{k}.zone", "n 2 expression ship{k}.built"]),
    ("E7", "postgres", "", "SELECT -a AS n, NOT b AS f, c BETWEEN d AND e AS r, ceil(g) AS u, h = ANY(i) AS y, (j + k) % 3 AS md FROM ship{k}", ["> query reads ship{k}", "n 0 expression ship{k}.a", "f 1 expression ship{k}.b", "r 2 expression ship{k}.c,ship{k}.d,ship{k}.e", "u 3 expression ship{k}.g", "y 4 expression ship{k}.h,ship{k}.i", "md 5 expression ship{k}.j,ship{k}.k"]),
    ("E8", "duckdb", "", "SELECT [a, b] AS xs, {'p': c, 'q': d} AS st, (e, f) AS tu, MAP {'x': g} AS mp FROM ship{k}", ["> query reads ship{k}", "xs 0 expression ship{k}.a,ship{k}.b", "st 1 expression ship{k}.c,ship{k}.d", "tu 2 expression ship{k}.e,ship{k}.f", "mp 3 expression ship{k}.g"]),
    ("E9", "snowflake", "", "SELECT DOC:owner.name::string AS o, TAGS[0] AS t FROM SHIP{k}", ["> query reads SHIP{k}", "o 0 expression SHIP{k}.DOC", "t 1 expression SHIP{k}.TAGS"]),
    ("E9", "bigquery", "", "SELECT s.papers.owner AS o, s.tags[OFFSET(0)] AS t FROM ship{k} AS s", ["> query reads ship{k}", "o 0 expression ship{k}.papers", "t 1 expression ship{k}.tags"]),
    ("E10", "postgres", "", "SELECT CASE zone WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS pick, coalesce(d, e) AS filled FROM ship{k}", ["> query reads ship{k}", "pick 0 conditional ship{k}.a,ship{k}.b,ship{k}.c,ship{k}.zone", "filled 1 expression ship{k}.d,ship{k}.e"]),
    ("E11", "snowflake", "", "SELECT F(A, B => C, D) AS V FROM SHIP{k}", ["> query reads SHIP{k}", "V 0 expression SHIP{k}.A,SHIP{k}.C,SHIP{k}.D"]),
    ("E12", "bigquery", "", "SELECT DATE_TRUNC(built, QUARTER) AS q, NORMALIZE(name, NFKC) AS n, DATE_DIFF(a, b, DAY) AS d FROM ship{k}", ["> query reads ship{k}", "q 0 expression ship{k}.built", "n 1 expression ship{k}.name", "d 2 expression ship{k}.a,ship{k}.b"]),
    ("E12", "tsql", "", "SELECT DATEADD(month, n, built) AS a, DATEPART(week, built) AS w FROM ship{k}", ["> query reads ship{k}", "a 0 expression ship{k}.built,ship{k}.n", "w 1 expression ship{k}.built"]),
    ("E12", "spark", "", "SELECT dateadd(month, n, built) AS a FROM ship{k}", ["> query reads ship{k}", "a 0 expression ship{k}.built,ship{k}.month,ship{k}.n"]),
    ("E13", "snowflake", "", "SELECT CONNECT_BY_ROOT NAME AS TOP, PRIOR ID AS UP FROM CREW{k} START WITH BOSS IS NULL CONNECT BY PRIOR ID = BOSS", ["> query reads CREW{k}", "TOP 0 expression CREW{k}.NAME", "UP 1 expression CREW{k}.ID"]),
    ("E13", "mysql", "", "SELECT a MEMBER OF (b) AS m FROM ship{k}", ["> query reads ship{k}", "m 0 expression ship{k}.a,ship{k}.b"]),
    ("E14", "duckdb", "", "SELECT list_filter(loads, x -> x > 2) AS big FROM ship{k}", ["> query reads ship{k}", "big 0 expression ship{k}.loads ! unsupported lambda"]),
    ("E14", "mysql", "", "SELECT MATCH (a, b) AGAINST ('reef') AS hit FROM chart{k}", ["> query reads chart{k}", "hit 0 expression - ! unsupported match against"]),
    # resolution
    ("F1", "postgres", "", "SELECT a.x FROM T{k} AS a JOIN t{k} AS b ON a.id = b.id WHERE EXISTS (SELECT 1 FROM Other{k}) ORDER BY (SELECT max(z) FROM last{k})", ["> query reads T{k},Other{k},last{k}", "x 0 direct T{k}.x"]),
    ("F2", "postgres", "ship{k}(hull) mast{k}(wood, ...)", "SELECT hull, wood FROM ship{k} CROSS JOIN mast{k}", ["> query reads ship{k},mast{k}", "hull 0 direct - ! ambiguous hull", "wood 1 direct mast{k}.wood"]),
    ("F2", "postgres", "ship{k}(hull)", "SELECT keel FROM ship{k}", ["> query reads ship{k}", "keel 0 direct - ! absent keel"]),
    ("F3", "postgres", "ship{k}(hull, keel, ...)", "SELECT * FROM ship{k}", ["> query reads ship{k}", "hull ? direct ship{k}.hull", "keel ? direct ship{k}.keel", "- ? direct - ! behind_star ship{k} * ship{k}"]),
    ("F4", "postgres", "ship{k}(hull) mast{k}(wood)", "SELECT 1 AS one, s.*, x.*, 2 AS two, m.* FROM ship{k} s, unknown{k} x, mast{k} m", ["> query reads ship{k},unknown{k},mast{k}", "one 0 direct -", "hull 1 direct ship{k}.hull", "- ? direct - ! behind_star unknown{k} * unknown{k}", "two ? direct -", "wood ? direct mast{k}.wood"]),
    ("F5", "postgres", "ship{k}(hull, hull, keel, ...)", "SELECT hull, keel, mast FROM ship{k}", ["> query reads ship{k}", "hull 0 direct - ! ambiguous hull", "keel 1 direct ship{k}.keel", "mast 2 direct ship{k}.mast"]),
    ("F6", "postgres", "ship{k}(hull) mast{k}(wood)", "SELECT hull, wood, sail FROM ship{k}, mast{k}", ["> query reads ship{k},mast{k}", "hull 0 direct ship{k}.hull", "wood 1 direct mast{k}.wood", "sail 2 direct - ! absent sail"]),
    ("F7", "postgres", "", "SELECT s.a + s.a + s.b + s.A AS t FROM ship{k} s", ["> query reads ship{k}", "t 0 expression ship{k}.a,ship{k}.b"]),
    ("F9", "postgres", "", "WITH RECURSIVE a AS (SELECT x FROM b), b AS (SELECT x FROM a) SELECT x FROM a", ["> query", "x 0 direct - ! recursive b"]),
    ("F10", "postgres", "", "SELECT a AS x, b AS x, c AS y FROM ship{k}", ["> query reads ship{k} ! duplicate_output x", "x 0 direct ship{k}.a", "x 1 direct ship{k}.b", "y 2 direct ship{k}.c"]),
    ("F11", "snowflake", "", 'SELECT A AS X, B AS "X", C AS "x" FROM SHIP{k}', ["> query reads SHIP{k} ! duplicate_output X", "X 0 direct SHIP{k}.A", "X 1 direct SHIP{k}.B", "x 2 direct SHIP{k}.C"]),
    ("F12", "postgres", "", "SELECT FROM ship{k} WHERE hull > 1", ["> query reads ship{k} ! empty_projection "]),
]


def schemas(catalog: str):
    """The catalog of a case's text."""
    import re

    from tracewell.sql.lineage import Schema

    out = {}
    for name, cols in re.findall(r"(\S+)\(([^)]*)\)", catalog):
        names = [c.strip() for c in cols.split(",")]
        out[name] = Schema([c for c in names if c != "..."], "..." not in names)
    return out


def lines(sql: str, dialect: str, catalog: str) -> list[str]:
    """What the analysis of a text says, in the cases' notation."""
    from tracewell.sql.dialects import DIALECTS
    from tracewell.sql.lexer import SqlError
    from tracewell.sql.lineage import analyze

    try:
        found = analyze(sql, DIALECTS[dialect], schemas(catalog))
    except SqlError:
        return ["error"]
    out = []
    for a in found:
        said = [f"> {a.kind}"]
        said += [f"reads {','.join(a.reads)}"] if a.reads else []
        said += [f"writes {a.written}"] if a.written else []
        said += ["! " + "; ".join(f"{k} {x}" for k, x in a.diagnostics)] if a.diagnostics else []
        out.append(" ".join(said))
        for o in a.outputs:
            line = f"{o.name or '-'} {'?' if o.ordinal is None else o.ordinal} {o.transform} {','.join(f'{r}.{c}' for r, c in o.sources) or '-'}"
            line += f" ! {','.join(f'{k} {x}' for k, x in o.reasons)}" if o.reasons else ""
            out.append(line + (f" * {o.star}" if o.star else ""))
    return out

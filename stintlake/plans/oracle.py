"""The SQL each query is checked against, in the dialect of the checking engine."""

import re

from stintlake import constants as K
from stintlake.operators import boosting
from stintlake.plans import fixtures
from stintlake.plans import queries as Q

LAP = "Year, GrandPrix, Driver, LapNumber"
DRIVER = "Year, GrandPrix, Driver"
DRY = "('SOFT', 'MEDIUM', 'HARD')"


def up(value: str, digits: int) -> str:
    """Half-up rounding of the binary value."""
    factor = f"1e{digits}"
    return f"floor(({value}) * {factor} + 0.5e0) / {factor}"


def _cases(column: str, values: dict, default: str) -> str:
    def quoted(value):
        return f"'{value}'" if isinstance(value, str) else f"CAST({value} AS DOUBLE)"

    whens = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {default} END"


def _title(slug: str) -> str:
    """Slug without suffix in title case."""
    words = f"string_split(replace(replace({slug}, '_grand_prix', ''), '_', ' '), ' ')"
    word = "upper(substr(w, 1, 1)) || lower(substr(w, 2))"
    return f"array_to_string(list_transform({words}, lambda w: {word}), ' ')"


def _name(slug: str) -> str:
    return _cases(slug, K.CIRCUIT_NAMES, _title(slug))


def _loss(slug: str) -> str:
    return _cases(slug, K.PIT_LOSS, f"CAST({K.PIT_LOSS_DEFAULT} AS DOUBLE)")


def mean(value: str, digits: int) -> str:
    return up(up(value, 9), digits)


TABLES = {}

TABLES["laps"] = """
WITH b AS (
 SELECT CAST(year(l_shipdate) AS INT) AS Year, lower(replace(n_name,' ','_')) AS GrandPrix,
  l_suppkey, n_nationkey, l_discount, l_tax, l_linenumber, (l_partkey*7919 + l_orderkey*31) % 800 AS noise,
  CAST(row_number() OVER (PARTITION BY year(l_shipdate), l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS LapNumber
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey),
c AS (SELECT *, CAST(floor((LapNumber-1)/25) AS INT)+1 AS Stint, (LapNumber-1)%25+1 AS TyreLife FROM b),
d AS (SELECT *, CASE (l_suppkey+Year+Stint)%4 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' ELSE 'INTERMEDIATE' END AS Compound FROM c),
e AS (SELECT *, CASE WHEN l_linenumber=7 AND round(l_tax*100)=8 THEN NULL ELSE
   80000 + 1000*(n_nationkey%20) + 55*(60-LapNumber) + noise
   + TyreLife*(CASE Compound WHEN 'SOFT' THEN 90 WHEN 'MEDIUM' THEN 60 WHEN 'HARD' THEN 35 ELSE 20 END)
   + CASE WHEN Compound='INTERMEDIATE' THEN 9000 ELSE 0 END + CASE WHEN round(l_discount*100)=10 THEN 15000 ELSE 0 END END AS ms FROM d)
SELECT Year, GrandPrix, 'S' || lpad(CAST(l_suppkey AS STRING),4,'0') AS Driver, 'T' || CAST(l_suppkey%10 AS STRING) AS Team,
 LapNumber, Stint, Compound, TyreLife, CAST(ms AS DOUBLE)/CAST(1000 AS DOUBLE) AS LapTime,
 CAST(ms*30 AS DOUBLE)/CAST(100000 AS DOUBLE) AS Sector1Time, CAST(ms*40 AS DOUBLE)/CAST(100000 AS DOUBLE) AS Sector2Time, CAST(ms*30 AS DOUBLE)/CAST(100000 AS DOUBLE) AS Sector3Time FROM e
"""

TABLES["feed"] = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT *, CAST(floor((rn-1)/22) AS INT)+1 AS LapNumber, 40 + (event_id*37)%420 AS arc_dm FROM a),
c AS (SELECT *, CAST(sum(arc_dm) OVER (PARTITION BY user_id, LapNumber ORDER BY rn) AS BIGINT) AS dist_dm FROM b),
d AS (SELECT *, CAST(round(3000*cos(CAST(dist_dm AS DOUBLE)/3000)) AS INT) AS x0, CAST(round(3000*sin(CAST(dist_dm AS DOUBLE)/3000)) AS INT) AS y0 FROM c),
e AS (SELECT *, lag(x0) OVER (PARTITION BY user_id, LapNumber ORDER BY rn) AS xp, lag(y0) OVER (PARTITION BY user_id, LapNumber ORDER BY rn) AS yp,
  (event_id%6=0 OR (user_id%7=0 AND event_id%3<>0)) AS frozen FROM d)
SELECT CAST(2024+user_id%3 AS INT) AS Year, 'gp_' || CAST(user_id%8 AS STRING) AS GrandPrix, 'D' || lpad(CAST(user_id AS STRING),4,'0') AS Driver,
 LapNumber, CAST(dist_dm AS DOUBLE)/CAST(10 AS DOUBLE) AS Distance, CAST(CASE WHEN event_id%97=0 THEN 0 ELSE 60+(event_id*53)%270 END AS DOUBLE) AS Speed,
 CAST(8000+(event_id*17)%4500 AS INT) AS RPM, CAST(1+event_id%8 AS INT) AS nGear, CAST((event_id*13)%101 AS DOUBLE) AS Throttle,
 CASE WHEN event_type='click' THEN 1 ELSE 0 END AS Brake, CASE WHEN event_type='view' THEN 12 ELSE 8 END AS DRS,
 CASE WHEN event_type='error' AND event_id%5=0 THEN 0 WHEN frozen THEN coalesce(xp,x0) ELSE x0 END AS X,
 CASE WHEN event_type='error' AND event_id%5=0 THEN 0 WHEN frozen THEN coalesce(yp,y0) ELSE y0 END AS Y,
 event_id, user_id, dist_dm,
 CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE)/CAST(1000000 AS DOUBLE) AS SessionTime FROM e
"""

TABLES["telemetry"] = (
    "SELECT * EXCLUDE (event_id, user_id, dist_dm, SessionTime) FROM feed"
)

TABLES["calendar"] = """
WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS Year FROM lineitem UNION SELECT max(CAST(year(l_shipdate) AS INT))+1 FROM lineitem)
SELECT Year, CAST(n_nationkey+1 AS INT) AS RoundNumber, n_name AS EventName,
 make_date(Year, CAST(1+n_nationkey%12 AS INT), CAST(1+n_nationkey AS INT)) AS EventDate FROM y CROSS JOIN nation
"""

TABLES["roster"] = """
WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS Year FROM lineitem)
SELECT Year, lower(replace(n_name,' ','_')) AS GrandPrix, 'S' || lpad(CAST(s_suppkey AS STRING),4,'0') AS Abbreviation, s_name AS FullName FROM y CROSS JOIN supplier JOIN nation ON s_nationkey=n_nationkey
UNION ALL
SELECT Year, lower(replace(n_name,' ','_')), 'R' || lpad(CAST(n_nationkey AS STRING),4,'0'), 'Reserve ' || n_name FROM y CROSS JOIN nation
"""

TABLES["race_events"] = """
SELECT CAST(year(o_orderdate) AS INT) AS Year, lower(replace(n_name,' ','_')) AS GrandPrix, CAST(o_orderdate AS STRING) AS Time,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Flag' WHEN '2-HIGH' THEN 'SafetyCar' ELSE 'Other' END AS Category,
 CASE WHEN o_orderpriority='1-URGENT' THEN (CASE o_orderstatus WHEN 'F' THEN 'RED' WHEN 'O' THEN 'YELLOW' ELSE 'GREEN' END) END AS Flag,
 CASE WHEN o_orderkey%10=0 THEN 'x' ELSE CAST(1+o_orderkey%60 AS STRING) END AS LapText, o_orderkey
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
"""

TABLES["called"] = """
SELECT Year, GrandPrix, Day, max(race_status) AS race_status FROM
 (SELECT Year, GrandPrix, CAST(date_diff('day', DATE '1970-01-01', CAST(Time AS DATE)) AS DOUBLE) AS Day,
   CASE WHEN Category = 'SafetyCar' THEN 'SC' ELSE Flag END AS race_status FROM race_events)
WHERE race_status IS NOT NULL GROUP BY 1, 2, 3
"""

TABLES["timed"] = "SELECT * FROM laps WHERE LapTime IS NOT NULL"

TABLES["grid"] = """
SELECT compound, stint, tyre, lap,
 tyre * (CASE compound WHEN 'SOFT' THEN 90e-3 WHEN 'MEDIUM' THEN 60e-3 ELSE 35e-3 END)
 + (stint - 1) * 5e-2 - lap * 2e-3 AS pred
FROM (SELECT unnest(['SOFT', 'MEDIUM', 'HARD']) AS compound),
 (SELECT unnest([1, 2]) AS stint),
 (SELECT CAST(unnest(generate_series(0, 59)) AS INT) AS tyre),
 (SELECT CAST(unnest(generate_series(0, 79)) AS INT) AS lap)
"""

TABLES["named_races"] = f"""
SELECT Year, coalesce({fixtures.SLUGS!r}[CAST(regexp_extract(GrandPrix, '(\\d+)$', 1) AS INT) + 1], GrandPrix) AS GrandPrix,
 count(*) AS laps
FROM laps GROUP BY Year, laps.GrandPrix
"""

TABLES["bronze"] = """
SELECT Year, GrandPrix, Driver, event_id, 'T' || CAST(user_id%10 AS STRING) AS Team,
 CASE WHEN event_id%41<>0 THEN LapNumber END AS LapNumber,
 CASE WHEN event_id%19<>0 THEN 'SOFT' END AS Compound,
 CASE WHEN event_id%23<>0 THEN Distance END AS SessionTime, Distance,
 CASE WHEN event_id%29<>0 THEN Speed END AS Speed, CASE WHEN event_id%5<>0 THEN RPM END AS RPM,
 CASE WHEN event_id%7<>0 THEN nGear END AS nGear, CASE WHEN event_id%11<>0 THEN Throttle END AS Throttle,
 CASE WHEN event_id%13<>0 THEN Brake=1 END AS Brake, CASE WHEN event_id%17<>0 THEN DRS END AS DRS,
 CASE WHEN event_id%31<>0 THEN X END AS X, CASE WHEN event_id%37<>0 THEN Y END AS Y,
 CASE WHEN event_id%4<>0 THEN Driver END AS DriverAhead,
 CASE WHEN event_id%3<>0 THEN CAST(event_id%13000-500 AS DOUBLE) END AS DistanceToDriverAhead
FROM feed
"""

TABLES["silver_feed"] = """
SELECT Year, GrandPrix, Driver, Team, LapNumber, Compound, coalesce(SessionTime, 0e0) AS SessionTime,
 Distance, Speed, coalesce(RPM, 0) AS RPM, coalesce(nGear, 0) AS nGear, coalesce(Throttle, 0e0) AS Throttle,
 CASE WHEN Brake THEN 1 ELSE 0 END AS Brake, coalesce(DRS, 0) AS DRS, CAST(coalesce(X, 0) AS DOUBLE) AS X,
 CAST(coalesce(Y, 0) AS DOUBLE) AS Y, DriverAhead, coalesce(DistanceToDriverAhead, 0e0) AS DistanceToDriverAhead
 FROM bronze WHERE Speed > 0 AND LapNumber > 0
"""

TABLES["tel_laps"] = """
SELECT Year, GrandPrix, Driver, LapNumber,
 CASE WHEN user_id%11<>0 THEN CAST(max(dist_dm) AS DOUBLE)/60e0 END AS LapTime
FROM feed GROUP BY Year, GrandPrix, Driver, LapNumber, user_id
"""

TABLES["lap_windows"] = """
SELECT Year, GrandPrix, Driver, LapNumber, 'T' || Driver AS Team,
 CASE WHEN LapNumber%2=0 THEN 'SOFT' ELSE 'HARD' END AS Compound, t0 AS LapStart,
 coalesce(lead(t0) OVER (PARTITION BY Driver ORDER BY LapNumber), t1 + 1e0) AS LapEnd
FROM (SELECT Year, GrandPrix, Driver, LapNumber, min(SessionTime) AS t0, max(SessionTime) AS t1
 FROM feed GROUP BY ALL)
"""

TABLES["names"] = f"""
SELECT DISTINCT lower(replace(EventName, ' ', '_')) AS slug,
 {_name("lower(replace(EventName, ' ', '_'))")} AS nombre
FROM calendar WHERE RoundNumber % 2 = 0
"""

TABLES["deltas"] = """
SELECT Year, GrandPrix, Driver, LapNumber, Distance, Distance - lag(Distance) OVER w AS arc,
 sqrt((X - lag(X) OVER w) * (X - lag(X) OVER w) + (Y - lag(Y) OVER w) * (Y - lag(Y) OVER w)) / 10e0 AS chord
FROM telemetry WINDOW w AS (PARTITION BY Year, GrandPrix, Driver, LapNumber ORDER BY Distance)
"""

TABLES["lap_quality"] = f"""
SELECT {LAP}, samples, CASE WHEN samples >= 20 AND driven IS NOT NULL
 THEN {up('1e0 - lost / driven', 3)} ELSE 0e0 END AS quality
FROM (SELECT {LAP}, count(*) AS samples, {up('sum(arc) FILTER (arc > 0.5)', 6)} AS driven,
 {up('coalesce(sum(arc) FILTER (arc > 0.5 AND chord < arc * 0.5e0), 0e0)', 6)} AS lost
 FROM deltas GROUP BY {LAP})
"""

TABLES["race_pick"] = f"""
SELECT Year, GrandPrix, Driver, ls[CAST(floor(len(ls) / 2) AS INT) + 1] AS LapNumber
FROM (SELECT Year, GrandPrix, Driver, list_sort(list(DISTINCT LapNumber)) AS ls
 FROM telemetry SEMI JOIN (SELECT Year, GrandPrix, min(Driver) AS Driver FROM telemetry GROUP BY 1, 2) f
 USING ({DRIVER}) GROUP BY 1, 2, 3)
"""

TABLES["race_quality"] = f"SELECT {LAP}, quality FROM lap_quality SEMI JOIN race_pick USING ({LAP})"


def _paced(source: str, by: str, name: str) -> str:
    return f"""
SELECT t.*, LapTime - 55e-3 * (total - LapNumber) AS LapTimeFuelAdj,
 (LapTime - 55e-3 * (total - LapNumber))
  - min(LapTime - 55e-3 * (total - LapNumber)) OVER (PARTITION BY {by}, Driver) AS {name}
FROM (SELECT *, max(LapNumber) OVER (PARTITION BY {by}) AS total FROM
 (SELECT *, median(LapTime) OVER (PARTITION BY {by}) AS mid FROM {source})
 WHERE LapTime <= mid * 107e-2) t
"""


TABLES["paced_circuit"] = _paced(
    f"(SELECT * FROM timed WHERE Compound IN {DRY})", "GrandPrix", "LapTimeDelta"
)
TABLES["paced_race"] = _paced("timed", "Year, GrandPrix", "DeltaRitmo")
ERA = "CASE " + " ".join(
    f"WHEN Year IN ({', '.join(map(str, years))}) THEN '{'-'.join(map(str, years))}'" for years in Q.ERAS
) + " END"
TABLES["era"] = _paced(
    f"(SELECT *, {ERA} AS era FROM timed WHERE Compound IN {DRY})", "era, GrandPrix", "LapTimeDelta"
)
TABLES["warehouse"] = f"""
SELECT Year, CAST(Year AS STRING) AS Temporada, GrandPrix, coalesce(nombre, GrandPrix) AS Circuito, Driver, Team,
 LapNumber, Stint, Compound, TyreLife, Compound NOT IN {DRY} AS EsLluvia, LapTime,
 {up('LapTimeFuelAdj', 3)} AS LapTimeFuelAdj, {up('DeltaRitmo', 3)} AS DeltaRitmo,
 Sector1Time, Sector2Time, Sector3Time
FROM paced_race LEFT JOIN names ON slug = GrandPrix
"""
TABLES["held_out"] = (
    "SELECT era, GrandPrix, count(*) AS laps FROM era GROUP BY 1, 2"
    " QUALIFY row_number() OVER (PARTITION BY era ORDER BY count(*) DESC, GrandPrix) = 1"
)
TABLES["split"] = (
    "SELECT e.*, e.GrandPrix = h.GrandPrix AS validation FROM era e JOIN held_out h USING (era)"
)
_FLAGS = ", ".join(
    f"CASE WHEN Compound = '{name}' THEN 1 ELSE 0 END AS Compound_{name}" for name in K.DRY_COMPOUNDS
)


def _clipped(name: str) -> str:
    return f"CAST(greatest(0, least({boosting.VALUES[name] - 1}, {name})) AS INT) AS {name}"


TABLES["tree_cells"] = f"""
SELECT era, {', '.join(map(_clipped, ('TyreLife', 'LapNumber', 'Stint')))}, {_FLAGS},
 CAST(CAST('0x' || substr(md5(concat_ws('|', 'share', 42, {LAP})), 1, 8) AS BIGINT) % {boosting.SHARES} AS INT) AS share,
 count(*) AS rows, CAST(sum(CAST(round(LapTimeDelta * 1e6) AS BIGINT)) AS BIGINT) AS total
FROM split WHERE NOT validation GROUP BY ALL
"""
_FEATURES = ["TyreLife", "LapNumber", "Stint", *[f"Compound_{name}" for name in K.DRY_COMPOUNDS]]
TABLES["first_split"] = f"""
SELECT era, feature, threshold, gain, left_n, n - left_n AS right_n, n,
 -left_g / (left_n + 1) AS left_value, (left_g - g) / (n - left_n + 1) AS right_value, mean
FROM (SELECT *, left_g * left_g / (left_n + 1) + (g - left_g) * (g - left_g) / (n - left_n + 1)
   - g * g / (n + 1) AS gain FROM
 (SELECT era, place, feature, v AS threshold, any_value(mean) AS mean, any_value(n) AS n, 0e0 AS g,
   sum(sum(rows)) OVER w AS left_n,
   sum(sum(rows)) OVER w * any_value(mean) - sum(sum(total)) OVER w / 1e6 AS left_g
  FROM (SELECT era, rows, total, unnest([{', '.join(_FEATURES)}]) AS v,
    unnest([{', '.join(f"'{name}'" for name in _FEATURES)}]) AS feature,
    unnest([{', '.join(map(str, range(len(_FEATURES))))}]) AS place,
    sum(rows) OVER (PARTITION BY era) AS n,
    sum(total) OVER (PARTITION BY era) / 1e6 / sum(rows) OVER (PARTITION BY era) AS mean FROM tree_cells)
  GROUP BY era, place, feature, v WINDOW w AS (PARTITION BY era, place ORDER BY v))
 WHERE left_n < n)
QUALIFY row_number() OVER (PARTITION BY era ORDER BY round(gain, 6) DESC, place, threshold) = 1
"""
TABLES["predicted"] = (
    "SELECT *, median(LapTime) OVER (PARTITION BY GrandPrix, Compound) AS hat FROM timed"
)

TABLES["requests"] = f"""
WITH one AS (SELECT {DRIVER}, arg_min(Compound, LapNumber) AS first_compound, min(LapNumber) AS start_lap,
  min(TyreLife) AS start_tyre, count(*) AS stint1_laps FROM timed WHERE Stint = 1 GROUP BY ALL),
two AS (SELECT {DRIVER}, arg_min(Compound, LapNumber) AS fitted, min(LapNumber) AS pit_real
  FROM timed WHERE Stint = 2 GROUP BY ALL),
total AS (SELECT Year, GrandPrix, max(LapNumber) AS total_laps FROM timed GROUP BY ALL)
SELECT one.Year, one.GrandPrix, one.Driver, first_compound, start_lap, CAST(start_tyre AS INT) AS start_tyre,
 stint1_laps, pit_real, total_laps,
 CASE WHEN fitted IN {DRY} THEN fitted WHEN first_compound = 'HARD' THEN 'MEDIUM' ELSE 'HARD' END AS second_compound,
 {_loss('one.GrandPrix')} AS pit_loss
FROM one LEFT JOIN two USING ({DRIVER}) JOIN total USING (Year, GrandPrix)
WHERE first_compound IN {DRY}
"""

TABLES["solved"] = f"""
WITH keys AS (SELECT DISTINCT first_compound, second_compound, start_lap, start_tyre, total_laps, pit_loss FROM requests),
stops AS (SELECT *, CAST(unnest(generate_series(start_lap + 3, total_laps - 3)) AS INT) AS stop FROM keys
  WHERE total_laps - 3 > start_lap + 3),
driven AS (SELECT *, CAST(unnest(generate_series(start_lap, total_laps)) AS INT) AS lap_no FROM stops),
cost AS (SELECT s.first_compound, s.second_compound, s.start_lap, s.start_tyre, s.total_laps, s.pit_loss, s.stop,
   {up('sum(g.pred) + s.pit_loss', 6)} AS cost
  FROM driven s JOIN grid g ON g.compound = CASE WHEN lap_no <= stop THEN first_compound ELSE second_compound END
   AND g.stint = CASE WHEN lap_no <= stop THEN 1 ELSE 2 END
   AND g.tyre = least(CASE WHEN lap_no <= stop THEN start_tyre + lap_no - start_lap ELSE lap_no - stop END, 59)
   AND g.lap = least(lap_no, 79)
  GROUP BY s.first_compound, s.second_compound, s.start_lap, s.start_tyre, s.total_laps, s.pit_loss, s.stop)
SELECT first_compound, second_compound, start_lap, start_tyre, total_laps, pit_loss,
 arg_min(stop, (cost, stop)) AS pit_window, {up('min(cost)', 2)} AS cost
FROM cost GROUP BY 1, 2, 3, 4, 5, 6
"""

TABLES["predictions"] = f"""
SELECT Year AS year, GrandPrix AS gp, Driver AS driver, r.first_compound AS compound_inicial,
 r.second_compound AS compound_siguiente, r.total_laps AS total_vueltas, pit_window, pit_real,
 abs(pit_window - pit_real) AS error_vueltas,
 {up(up('(a.pred - b.pred) / 15e0', 9), 3)} AS degradacion_s_vuelta,
 cost AS costo_estimado_s, r.pit_loss AS pit_loss_usado, stint1_laps AS vueltas_stint1
FROM requests r
LEFT JOIN solved s USING (first_compound, second_compound, start_lap, start_tyre, total_laps, pit_loss)
JOIN grid a ON a.compound = r.first_compound AND a.stint = 1 AND a.tyre = 20 AND a.lap = least(start_lap, 79)
JOIN grid b ON b.compound = r.first_compound AND b.stint = 1 AND b.tyre = 5 AND b.lap = least(start_lap, 79)
"""

TABLES["cat_tel"] = (
    "SELECT * REPLACE (Year - 29 AS Year, replace(GrandPrix, 'gp_', 'nation_') AS GrandPrix, "
    "replace(Driver, 'D', 'S') AS Driver) FROM telemetry"
)
TABLES["team_laps"] = """
SELECT * REPLACE (CASE WHEN LapNumber%3=0 THEN 'T' || CAST(CAST(substr(Driver, 2, 4) AS INT)%7 AS STRING)
 WHEN LapNumber%2=0 THEN 'T9' ELSE Team END AS Team) FROM timed
"""


def _race_teams(source: str) -> str:
    return (
        f"SELECT {DRIVER}, Team FROM (SELECT {DRIVER}, Team, count(*) AS n FROM {source} GROUP BY ALL) "
        f"QUALIFY row_number() OVER (PARTITION BY {DRIVER} ORDER BY n DESC, Team) = 1"
    )


def _season_teams(source: str) -> str:
    return (
        f"SELECT Year, Driver, Team FROM {source} "
        "QUALIFY row_number() OVER (PARTITION BY Year, Driver ORDER BY GrandPrix) = 1"
    )


TABLES["swap_teams"] = _race_teams("team_laps")
TABLES["race_teams"] = _race_teams("timed")
TABLES["season_teams"] = _season_teams("race_teams")
TABLES["full_names"] = """
SELECT r.Year, Abbreviation AS Driver, arg_min(FullName, (RoundNumber, FullName)) AS name
FROM roster r JOIN calendar c ON r.Year = c.Year AND r.GrandPrix = lower(replace(EventName, ' ', '_'))
WHERE Abbreviation <> '' AND FullName <> ''
 AND (r.Year, r.GrandPrix) IN (SELECT DISTINCT Year, GrandPrix FROM cat_tel) GROUP BY 1, 2
"""
TABLES["cat_laps"] = "SELECT Year, GrandPrix, max(LapNumber) AS vueltas FROM timed GROUP BY 1, 2"


def _on_catalogue(name: str) -> str:
    """The text of a table with the relabelled telemetry as its input."""
    return f"WITH telemetry AS (SELECT * FROM cat_tel) {TABLES[name].strip()}"


TABLES["cat_quality"] = f"""
WITH telemetry AS (SELECT * FROM cat_tel), deltas AS ({TABLES["deltas"]}),
lap_quality AS ({TABLES["lap_quality"]}), race_pick AS ({TABLES["race_pick"]})
{TABLES["race_quality"]}
"""
TABLES["cat_races"] = f"""
WITH c AS (SELECT Year, lower(replace(EventName, ' ', '_')) AS GrandPrix, RoundNumber, EventDate FROM calendar),
stored AS (SELECT DISTINCT Year, GrandPrix FROM cat_tel)
SELECT c.Year AS year, c.GrandPrix AS slug, {_name('c.GrandPrix')} AS nombre, RoundNumber AS ronda,
 strftime(EventDate, '%Y-%m-%d') AS fecha, EventDate < DATE '{Q.AS_OF}' AS corrida,
 stored.Year IS NOT NULL AS tiene_datos, coalesce(quality, 0e0) AS posicion_calidad,
 coalesce(quality, 0e0) >= 0.75 AS posicion_ok, vueltas
FROM c LEFT JOIN stored ON stored.Year = c.Year AND stored.GrandPrix = c.GrandPrix
LEFT JOIN cat_quality q ON q.Year = c.Year AND q.GrandPrix = c.GrandPrix
LEFT JOIN cat_laps l ON l.Year = c.Year AND l.GrandPrix = c.GrandPrix
"""
TABLES["cat_drivers"] = f"""
SELECT t.Year AS year, t.GrandPrix AS slug, t.Driver AS code,
 coalesce(rt.Team, st.Team, 'Sin equipo') AS team, coalesce(n.name, t.Driver) AS name
FROM (SELECT DISTINCT {DRIVER} FROM cat_tel) t
SEMI JOIN calendar c ON c.Year = t.Year AND lower(replace(c.EventName, ' ', '_')) = t.GrandPrix
LEFT JOIN race_teams rt ON rt.Year = t.Year AND rt.GrandPrix = t.GrandPrix AND rt.Driver = t.Driver
LEFT JOIN season_teams st ON st.Year = t.Year AND st.Driver = t.Driver
LEFT JOIN full_names n ON n.Year = t.Year AND n.Driver = t.Driver
"""

_GRID = f"""
WITH s AS (SELECT {LAP}, Distance, Speed, Throttle, Brake, lag(Distance) OVER w AS d0, lag(Speed) OVER w AS s0,
  lag(Throttle) OVER w AS t0, lag(Brake) OVER w AS b0 FROM telemetry WINDOW w AS (PARTITION BY {LAP} ORDER BY Distance)),
p AS (SELECT *, unnest(generate_series(CAST(coalesce(floor(d0 / $step) + 1, ceil(Distance / $step)) AS BIGINT),
  CAST(floor(Distance / $step) AS BIGINT))) AS point FROM s)
SELECT {LAP}, point, point * $step AS Distance,
 CASE WHEN point * $step = Distance THEN Speed ELSE s0 + (Speed - s0) * ((point * $step - d0) / (Distance - d0)) END AS Speed,
 CASE WHEN point * $step = Distance THEN Throttle ELSE t0 + (Throttle - t0) * ((point * $step - d0) / (Distance - d0)) END AS Throttle,
 CASE WHEN point * $step = Distance THEN Brake ELSE b0 END AS Brake FROM p
"""
TABLES["grid_25"] = _GRID.replace("$step", "25e0")
TABLES["grid_10"] = _GRID.replace("$step", "10e0")
TABLES["placed"] = "SELECT * FROM telemetry WHERE X <> 0 OR Y <> 0"
TABLES["available"] = f"""
SELECT {LAP}, CAST(row_number() OVER (PARTITION BY {DRIVER} ORDER BY LapNumber) - 1 AS INT) AS place,
 count(*) OVER (PARTITION BY {DRIVER}) AS n
FROM (SELECT DISTINCT {LAP} FROM placed)
"""
TABLES["middle"] = f"SELECT {LAP} FROM available WHERE place = floor(n / 2)"
TABLES["points"] = f"""
SELECT {LAP}, '' AS compound, {up('Distance', 1)} AS distance, {up('Speed', 1)} AS speed, RPM AS rpm,
 nGear AS gear, CAST(floor(Throttle + 0.5e0) AS INT) AS throttle, Brake AS brake, DRS AS drs, X AS x, Y AS y
FROM placed
"""
TABLES["ranked"] = f"""
SELECT *, CAST(round(distance * 10) AS BIGINT) AS dm,
 row_number() OVER (PARTITION BY {LAP} ORDER BY distance) AS place, count(*) OVER (PARTITION BY {LAP}) AS n
FROM points
"""
TABLES["reach"] = f"""
SELECT p.Year, p.GrandPrix, p.Driver, p.LapNumber, p.dm,
 coalesce(max(q.dm) FILTER (q.dm <= p.dm - 200), min(q.dm)) AS b_dm,
 coalesce(min(q.dm) FILTER (q.dm >= p.dm + 200), max(q.dm)) AS a_dm
FROM ranked p JOIN ranked q USING ({LAP}) WHERE p.place > 1 AND p.place < p.n GROUP BY ALL
"""
TABLES["near"] = f"""
SELECT p.*, b.dm AS b_dm, b.x AS bx, b.y AS b_y, b.speed AS bs, a.dm AS a_dm, a.x AS ax, a.y AS ay, a.speed AS asp
FROM ranked p LEFT JOIN reach r USING ({LAP}, dm)
LEFT JOIN ranked b ON b.Year = p.Year AND b.GrandPrix = p.GrandPrix AND b.Driver = p.Driver AND b.LapNumber = p.LapNumber AND b.dm = r.b_dm
LEFT JOIN ranked a ON a.Year = p.Year AND a.GrandPrix = p.GrandPrix AND a.Driver = p.Driver AND a.LapNumber = p.LapNumber AND a.dm = r.a_dm
"""
TABLES["bends"] = """
WITH h AS (SELECT *, speed / 36e-1 AS v, (a_dm - b_dm) / 20e0 AS ds,
  atan2(CAST(ay - y AS DOUBLE), CAST(ax - x AS DOUBLE)) - atan2(CAST(y - b_y AS DOUBLE), CAST(x - bx AS DOUBLE)) AS turn,
  (dm - b_dm) / 10e0 AS arc_in, (a_dm - dm) / 10e0 AS arc_out,
  sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y)) / 10e0 AS chord_in,
  sqrt((ax - x) * (ax - x) + (ay - y) * (ay - y)) / 10e0 AS chord_out FROM near)
SELECT *, CASE WHEN ds > 1 THEN abs(CASE WHEN turn > pi() THEN turn - 2 * pi() WHEN turn < -pi() THEN turn + 2 * pi() ELSE turn END) / ds END AS bend,
 arc_in > 1 AND arc_out > 1 AND chord_in <= arc_in * 115e-2 AND chord_out <= arc_out * 115e-2 AS coherent
FROM h
"""
TABLES["forces"] = f"""
SELECT *, CASE WHEN coherent AND ds > 1 THEN v * v * bend / 981e-2 ELSE 0e0 END AS g_lat,
 CASE WHEN a_dm - b_dm > 10 THEN v * (((asp - bs) / 36e-1) / ((a_dm - b_dm) / 10e0)) / 981e-2 ELSE 0e0 END AS g_lon
FROM bends
"""
TABLES["smooth"] = f"""
SELECT * EXCLUDE (g_lat, g_lon, l7, o7), l7[CAST(floor(len(l7) / 2) AS INT) + 1] AS g_lat, o7[CAST(floor(len(o7) / 2) AS INT) + 1] AS g_lon
FROM (SELECT *, list_sort(list(g_lat) OVER w) AS l7, list_sort(list(g_lon) OVER w) AS o7 FROM forces
 WINDOW w AS (PARTITION BY {LAP} ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
"""
TABLES["enriched"] = f"""
SELECT * REPLACE ({up('least(greatest(g_lat, 0e0), 52e-1)', 2)} AS g_lat,
 {up('least(greatest(g_lon, -6e0), 25e-1)', 2)} AS g_lon) FROM smooth
"""
TABLES["checked"] = f"""
SELECT {LAP}, place, distance, speed, v * v * bend / 981e-2 AS g_raw,
 quantile_cont(CASE WHEN coherent THEN v * v * bend / 981e-2 ELSE 0e0 END, 0.5) OVER
  (PARTITION BY {LAP} ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS g,
 CASE WHEN coherent AND bend > 1e-6 THEN 1e0 / bend END AS radius_m
FROM bends WHERE ds > 1
"""
TABLES["drawn"] = f"""
WITH m AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0,
  CASE WHEN max(x) OVER w = min(x) OVER w THEN 1 ELSE max(x) OVER w - min(x) OVER w END AS sx,
  CASE WHEN max(y) OVER w = min(y) OVER w THEN 1 ELSE max(y) OVER w - min(y) OVER w END AS sy
 FROM points WINDOW w AS (PARTITION BY {LAP})),
s AS (SELECT *, least(348e0 / sx, 268e0 / sy) AS su, least(348e0 / sy, 268e0 / sx) AS st FROM m),
o AS (SELECT *, CASE WHEN su >= st THEN su ELSE st END AS scale, CASE WHEN su >= st THEN sx ELSE sy END AS wide,
  CASE WHEN su >= st THEN sy ELSE sx END AS high, CASE WHEN su >= st THEN x - x0 ELSE y - y0 END AS rgt,
  CASE WHEN su >= st THEN y - y0 ELSE x1 - x END AS upw FROM s)
SELECT {LAP}, distance, brake, (400 - wide * scale) / 2e0 + rgt * scale AS map_x,
 320 - ((320 - high * scale) / 2e0 + upw * scale) AS map_y, scale * 10e0 AS units_per_metre FROM o
"""
TABLES["cut"] = f"""
WITH d AS (SELECT *, sqrt(pow(map_x - lag(map_x) OVER w, 2) + pow(map_y - lag(map_y) OVER w, 2)) AS chord,
  greatest((distance - lag(distance) OVER w) * units_per_metre, 0e0) AS expected
 FROM drawn WINDOW w AS (PARTITION BY {LAP} ORDER BY distance)),
f AS (SELECT *, CASE WHEN chord > greatest(expected * 18e-1, 8e0) THEN 1 ELSE 0 END AS is_cut FROM d)
SELECT *, CAST(sum(is_cut) OVER w AS INT) AS segment,
 CAST(sum(CASE WHEN brake = 0 THEN 1 ELSE is_cut END) OVER w AS INT) AS zone
FROM f WINDOW w AS (PARTITION BY {LAP} ORDER BY distance)
"""

ORDER = list(TABLES)


def sql(body: str) -> str:
    """`body` preceded by the tables it needs, directly or through other tables."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(TABLES[name])
    parts = [f"{name} AS ({TABLES[name].strip()})" for name in ORDER if name in needed]
    body = body.strip()
    if not parts:
        return body
    joint = ",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(parts) + joint


def _runs(keys: str, where: str = "") -> str:
    return (
        f"SELECT {keys}, count(*) AS points, min(distance) AS from_m, max(distance) AS to_m "
        f"FROM cut {where} GROUP BY {keys} HAVING count(*) > 1"
    )


_LAP_TYPES = [
    ("Year", "int"), ("GrandPrix", "string"), ("Driver", "string"), ("Team", "string"),
    ("LapNumber", "int"), ("Stint", "int"), ("Compound", "string"), ("TyreLife", "int"),
    ("LapTime", "double"), ("Sector1Time", "double"), ("Sector2Time", "double"),
    ("Sector3Time", "double"),
]
_MERGED = ", ".join(map(str, Q.MERGE_YEARS))
_METRICS = f"""SELECT count(*) AS rows, {mean('sqrt(avg((LapTime - hat) * (LapTime - hat)))', 6)} AS rmse,
 {mean('avg(abs(LapTime - hat))', 6)} AS mae,
 {mean('1e0 - avg((LapTime - hat) * (LapTime - hat)) / var_pop(LapTime)', 6)} AS r2,
 {mean('avg(abs(LapTime - hat) / abs(LapTime)) * 100e0', 6)} AS mape FROM predicted"""

BODIES = {
    "source_schema": "SELECT p AS position, c AS column, t AS type, (SELECT count(*) FROM laps) AS rows FROM (VALUES "
    + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_LAP_TYPES, 1))
    + ") v(p, c, t)",
    "pending_races": """SELECT DISTINCT Year, lower(replace(EventName, ' ', '_')) AS GrandPrix FROM calendar
 EXCEPT SELECT Year, GrandPrix FROM laps""",
    "predictions_merge": f"""SELECT * REPLACE ({up('costo_estimado_s + 1', 2)} AS costo_estimado_s) FROM predictions
 WHERE year NOT IN ({_MERGED}) UNION ALL SELECT * FROM predictions WHERE year IN ({_MERGED})""",
    "race_slug": "SELECT Year, EventName, lower(replace(EventName || ' Grand Prix', ' ', '_')) AS slug FROM calendar",
    "telemetry_lap_join": """SELECT f.Year, f.GrandPrix, f.Driver, w.LapNumber, event_id, Team, Compound, Speed
 FROM feed f JOIN lap_windows w ON w.Year = f.Year AND w.GrandPrix = f.GrandPrix AND w.Driver = f.Driver
 AND f.SessionTime >= LapStart AND f.SessionTime < LapEnd""",
    "lap_distance_ties": f"""SELECT {LAP}, SessionTime, Speed, {up('sum(step) OVER w', 1)} AS Distance FROM
 (SELECT *, coalesce(Speed / 36e-1 * (SessionTime - lag(SessionTime) OVER w), 0e0) AS step FROM
  (SELECT * REPLACE (floor(SessionTime / 2592e2) * 2592e2 AS SessionTime) FROM feed)
  WINDOW w AS (PARTITION BY {LAP} ORDER BY SessionTime, Speed)) WINDOW w AS (PARTITION BY {LAP} ORDER BY SessionTime, Speed ROWS UNBOUNDED PRECEDING)""",
    "sample_deltas_edges": f"""WITH e AS (SELECT {LAP},
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 250e0 ELSE Distance - 4e2 END AS Distance,
  CASE WHEN event_id % 3 = 0 THEN 7 ELSE X END AS X, CASE WHEN event_id % 3 = 0 THEN 9 ELSE Y END AS Y FROM feed),
 s AS (SELECT *, Distance - lag(Distance) OVER w AS arc, sqrt(CAST((X - lag(X) OVER w) * (X - lag(X) OVER w) + (Y - lag(Y) OVER w) * (Y - lag(Y) OVER w) AS DOUBLE)) / 1e1 AS chord
  FROM e WINDOW w AS (PARTITION BY {LAP} ORDER BY Distance NULLS FIRST, X, Y))
 SELECT {LAP}, Distance, {up('arc', 3)} AS arc, {up('chord', 3)} AS chord FROM s""",
    "silver_roundtrip": "SELECT * FROM timed",
    "silver_telemetry_roundtrip": "SELECT * FROM silver_feed",
    "partition_file_counts": f"SELECT {DRIVER}, 1 AS files FROM silver_feed GROUP BY ALL",
    "predictions_roundtrip": "SELECT * FROM predictions",
    "catalogue_roundtrip": """SELECT r.*, coalesce(p.pilotos, '') AS pilotos FROM cat_races r LEFT JOIN
 (SELECT year, slug, string_agg(code || ':' || team || ':' || name, ',' ORDER BY code, team, name) AS pilotos FROM cat_drivers GROUP BY 1, 2) p
 USING (year, slug)""",
    "lap_distance": f"""SELECT {LAP}, event_id, {up('sum(step) OVER w', 1)} AS Distance FROM
 (SELECT *, coalesce(Speed / 36e-1 * (SessionTime - lag(SessionTime) OVER w), 0e0) AS step FROM feed
  WINDOW w AS (PARTITION BY {LAP} ORDER BY SessionTime, Speed)) WINDOW w AS (PARTITION BY {LAP} ORDER BY SessionTime, Speed ROWS UNBOUNDED PRECEDING)""",
    "channels_normalised": """SELECT Year, GrandPrix, Driver, event_id, Team, CAST(LapNumber AS SMALLINT) AS LapNumber, Compound,
 CAST(coalesce(SessionTime, 0) AS FLOAT) AS SessionTime, CAST(Speed AS FLOAT) AS Speed,
 CAST(coalesce(RPM, 0) AS SMALLINT) AS RPM, CAST(coalesce(nGear, 0) AS TINYINT) AS nGear,
 CAST(coalesce(Throttle, 0) AS TINYINT) AS Throttle, CASE WHEN Brake THEN 1 ELSE 0 END AS Brake,
 CAST(0 AS TINYINT) AS DRS, coalesce(X, 0) AS X, coalesce(Y, 0) AS Y, coalesce(DriverAhead, '') AS DriverAhead,
 CAST(least(greatest(coalesce(DistanceToDriverAhead, 0), 0), 9999) AS FLOAT) AS DistanceToDriverAhead
 FROM bronze WHERE LapNumber IS NOT NULL""",
    "laps_durations": """SELECT Year, GrandPrix, Driver, Team, LapNumber, Stint, Compound, TyreLife, LapTime,
 CAST(Year AS STRING) || '-01-02' AS LapStartDate FROM laps""",
    "race_status": """SELECT l.*, c.race_status, c.Day AS status_since FROM
 (SELECT CAST(year(l_shipdate) AS INT) AS Year, lower(replace(n_name,' ','_')) AS GrandPrix, 'S' || lpad(CAST(l_suppkey AS STRING),4,'0') AS Driver,
   l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 <> 0 THEN CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) END AS Day
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey) l
 ASOF LEFT JOIN called c ON l.Year = c.Year AND l.GrandPrix = c.GrandPrix AND l.Day >= c.Day""",
    "live_laps": f"""SELECT {LAP}, count(*) AS samples, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, max(Speed) AS top_speed,
 {up('(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6', 3)} AS seconds,
 {up('CAST(sum(CAST(round(Speed * 10) AS BIGINT)) AS BIGINT) / count(*) / 10e0', 4)} AS mean_speed,
 {up('count(*) FILTER (Throttle >= 99) / count(*)', 4)} AS throttle_share, {up('count(*) FILTER (Brake > 0) / count(*)', 4)} AS braking_share,
 max(Distance) AS metres FROM (SELECT feed.*, ts FROM feed JOIN events USING (event_id)) GROUP BY ALL""",
    "events_clean": """SELECT Year, GrandPrix, Category, coalesce(Flag, '') AS Flag, o_orderkey,
 CAST(coalesce(try_cast(LapText AS SMALLINT), 0) AS SMALLINT) AS Lap,
 CASE WHEN o_orderkey%3=0 THEN 'DEPLOYED' ELSE '' END AS Status FROM race_events""",
    "events_flags": """SELECT Year, GrandPrix, count(*) AS messages, count(*) FILTER (Category = 'Flag') AS flags
 FROM race_events GROUP BY 1, 2""",
    "missing_drivers": f"""SELECT DISTINCT Year, GrandPrix, Abbreviation AS Driver FROM roster
 EXCEPT SELECT {DRIVER} FROM laps""",
    "ingest_report": f"""SELECT l.GrandPrix AS gp, l.Year AS year, count(DISTINCT l.Driver) AS pilotos,
 coalesce(any_value(m.names), '') AS faltantes FROM laps l LEFT JOIN
 (SELECT Year, GrandPrix, string_agg(Abbreviation, ',' ORDER BY Abbreviation) AS names FROM
  (SELECT DISTINCT Year, GrandPrix, Abbreviation FROM roster EXCEPT SELECT {DRIVER} FROM laps) GROUP BY 1, 2) m
 ON m.Year = l.Year AND m.GrandPrix = l.GrandPrix GROUP BY 1, 2""",
    "calendar_raced": f"SELECT * FROM calendar WHERE EventDate < DATE '{Q.AS_OF}'",
    "silver_laps": """SELECT * REPLACE (CASE WHEN LapNumber % 9 <> 0 THEN CAST(TyreLife AS INT) ELSE 0 END AS TyreLife)
 FROM laps WHERE LapTime IS NOT NULL""",
    "silver_telemetry": "SELECT * FROM silver_feed",
    "sample_deltas": f"SELECT {LAP}, Distance, {up('arc', 3)} AS arc, {up('chord', 3)} AS chord FROM deltas",
    "lap_position_quality": "SELECT * FROM lap_quality",
    "race_position_quality": "SELECT *, quality >= 0.75 AS position_ok FROM race_quality",
    "incoherent_samples": f"""SELECT {LAP}, count(*) AS samples, count(*) FILTER (arc > 0.5 AND chord > arc * 13e-1) AS incoherent
 FROM deltas GROUP BY {LAP}""",
    "sample_spacing": f"""SELECT {LAP}, {up('min(arc)', 3)} AS min_step, {up('max(arc)', 3)} AS max_step,
 {up('median(arc)', 3)} AS median_step FROM deltas WHERE arc IS NOT NULL GROUP BY {LAP}""",
    "sampling_density": f"""SELECT Year, GrandPrix, median(n) AS median_samples, min(n) AS min_samples, max(n) AS max_samples
 FROM (SELECT {LAP}, count(*) AS n FROM telemetry GROUP BY {LAP}) GROUP BY 1, 2""",
    "position_presence": """SELECT Year, GrandPrix, sum(abs(X)) > 0 AND sum(abs(Y)) > 0 AS has_position,
 min(X) AS min_x, max(X) AS max_x, min(Y) AS min_y, max(Y) AS max_y FROM telemetry GROUP BY 1, 2""",
    "distance_reset": f"""SELECT {LAP}, min(Distance) AS min_distance, max(Distance) AS max_distance
 FROM telemetry t SEMI JOIN (SELECT {DRIVER}, min(LapNumber) AS LapNumber FROM telemetry GROUP BY ALL) f
 USING ({LAP}) GROUP BY {LAP}""",
    "lake_profile": """SELECT count(*) AS rows, count(DISTINCT (Year, GrandPrix)) AS races, count(DISTINCT Driver) AS drivers,
 min(LapNumber) AS first_lap, max(LapNumber) AS last_lap FROM telemetry""",
    "telemetry_only_drivers": f"""SELECT DISTINCT {DRIVER} FROM telemetry
 EXCEPT SELECT {DRIVER} FROM tel_laps WHERE LapTime IS NOT NULL""",
    "missing_position": f"""SELECT {DRIVER}, count(*) AS samples, count(*) FILTER (X = 0 AND Y = 0) AS dropped
 FROM telemetry GROUP BY {DRIVER}""",
    "rule_107_circuit": f"SELECT {LAP}, LapTime FROM paced_circuit",
    "rule_107_race": f"SELECT {LAP}, LapTime FROM paced_race",
    "dry_laps": f"SELECT {LAP}, Compound FROM laps WHERE Compound IN {DRY}",
    "fuel_adjusted": f"SELECT {LAP}, {up('LapTimeFuelAdj', 3)} AS LapTimeFuelAdj FROM paced_race",
    "pace_delta": f"""SELECT {LAP}, {up('LapTimeFuelAdj', 3)} AS LapTimeFuelAdj, {up('LapTimeDelta', 3)} AS LapTimeDelta
 FROM paced_circuit""",
    "race_names": f"SELECT Year, GrandPrix, laps, {_name('GrandPrix')} AS nombre FROM named_races",
    "warehouse_laps": "SELECT * FROM warehouse",
    "warehouse_predictions": """SELECT p.*, coalesce(nombre, gp) AS Circuito, CAST(year AS STRING) AS Temporada,
 pit_window - pit_real AS DiferenciaVueltas FROM predictions p LEFT JOIN names ON slug = gp""",
    "warehouse_summary": """SELECT count(*) AS rows, count(DISTINCT Year) AS seasons, count(DISTINCT GrandPrix) AS circuits
 FROM warehouse""",
    "bi_lap_curve": f"""SELECT LapNumber, {mean('avg(LapTime)', 4)} AS mean_lap_time, count(*) AS laps FROM warehouse
 WHERE Compound IN {DRY} GROUP BY 1""",
    "bi_wear_curve": f"""SELECT TyreLife, {mean('avg(DeltaRitmo)', 4)} AS mean_delta, count(*) AS laps FROM warehouse
 WHERE Compound IN {DRY} GROUP BY 1""",
    "bi_cube": """SELECT axis, value, Compound, Temporada, Circuito,
 CAST(grouping(Compound) AS INT) AS all_Compound, CAST(grouping(Temporada) AS INT) AS all_Temporada,
 CAST(grouping(Circuito) AS INT) AS all_Circuito, count(*) AS laps, count(LapTime) AS timed,
 CAST(sum(CAST(round(LapTime * 1000) AS BIGINT)) AS BIGINT) AS time_ms, count(DeltaRitmo) AS paced,
 CAST(sum(CAST(round(DeltaRitmo * 1000) AS BIGINT)) AS BIGINT) AS delta_ms
FROM (SELECT *, unnest(['LapNumber', 'TyreLife']) AS axis, CAST(unnest([LapNumber, TyreLife]) AS BIGINT) AS value FROM warehouse)
GROUP BY axis, value, CUBE (Compound, Temporada, Circuito)""",
    "bi_wear_from_cube": f"""SELECT TyreLife, {mean('avg(DeltaRitmo)', 4)} AS mean_delta, count(*) AS laps FROM warehouse
 WHERE Compound IN {DRY} GROUP BY 1""",
    "bi_race_from_cube": f"""SELECT LapNumber, {mean('avg(LapTime)', 4)} AS mean_lap_time, count(*) AS laps FROM warehouse
 WHERE Temporada IN ('1996', '1999') AND Compound = 'SOFT' GROUP BY 1""",
    "season_statistics": f"""SELECT Year, count(*) AS laps, {mean('avg(LapTime)', 4)} AS mean_time, min(LapTime) AS fastest,
 max(LapTime) AS slowest, true AS p10_near, true AS median_near, true AS p90_near, true AS drivers_near FROM timed GROUP BY 1""",
    "bi_stop_error": f"""SELECT gp, count(*) AS stops, {up('avg(abs(pit_window - pit_real))', 4)} AS mean_error,
 {up('avg(pit_window - pit_real)', 4)} AS mean_bias, CAST(grouping(gp) AS INT) AS total FROM predictions
 WHERE pit_window IS NOT NULL AND pit_real IS NOT NULL GROUP BY ROLLUP (gp)""",
    "wear_points": f"SELECT TyreLife, LapTime, Compound FROM laps WHERE LapTime > 85 AND LapTime < 105 AND Compound IN {DRY}",
    "era_laps": f"SELECT {ERA} AS era, {LAP} FROM timed",
    "era_selected": f"""SELECT '{"-".join(map(str, Q.ERAS[1]))}' AS era, {LAP} FROM timed
 WHERE Year IN ({", ".join(map(str, Q.ERAS[1]))})""",
    "model_features": f"SELECT era, {LAP}, TyreLife, Stint, {_FLAGS}, {up('LapTimeDelta', 3)} AS LapTimeDelta FROM era",
    "holdout_circuit": "SELECT * FROM held_out",
    "holdout_split": f"SELECT era, {LAP}, validation FROM split",
    "random_holdout": f"""SELECT era, {LAP}, CAST('0x' || substr(md5(concat_ws('|', 42, {LAP})), 1, 8) AS BIGINT) % 10000 < 2000 AS validation
 FROM era""",
    "grid_shape": f"""SELECT era, compound, stint, count(*) AS cells, min(tyre) AS first_tyre, max(tyre) AS last_tyre,
 min(lap) AS first_lap, max(lap) AS last_lap FROM grid, (SELECT DISTINCT era FROM era) GROUP BY 1, 2, 3""",
    "baseline_mae": f"""SELECT era, {mean('avg(abs(LapTimeDelta - m)) FILTER (validation)', 4)} AS baseline,
 count(*) FILTER (validation) AS validation_laps, count(*) FILTER (NOT validation) AS training_laps
 FROM (SELECT *, avg(LapTimeDelta) FILTER (NOT validation) OVER (PARTITION BY era) AS m FROM split) GROUP BY era""",
    "wear_cells": "SELECT * FROM tree_cells",
    "wear_first_split": f"""SELECT era, 0 AS node, CAST(NULL AS STRING) AS feature, CAST(NULL AS INT) AS threshold, 0e0 AS gain,
 CAST(n AS BIGINT) AS rows, {up('mean', 6)} AS value FROM first_split
 UNION ALL SELECT era, 1, feature, threshold, {up('gain', 4)}, CAST(n AS BIGINT), 0e0 FROM first_split
 UNION ALL SELECT era, 2, NULL, NULL, 0e0, CAST(left_n AS BIGINT), {up('left_value', 6)} FROM first_split
 UNION ALL SELECT era, 3, NULL, NULL, 0e0, CAST(right_n AS BIGINT), {up('right_value', 6)} FROM first_split""",
    "regression_metrics": _METRICS,
    "metrics_dry": _METRICS + " WHERE Compound <> 'INTERMEDIATE'",
    "stop_requests": "SELECT * FROM requests",
    "stint_cost": f"""WITH q AS (SELECT {DRIVER}, first_compound AS compound, 1 AS stint, start_tyre, start_lap AS from_lap, total_laps AS to_lap
  FROM requests), w AS (SELECT *, CAST(unnest(generate_series(from_lap, to_lap)) AS INT) AS lap_no FROM q)
 SELECT {DRIVER}, w.compound, w.stint, start_tyre, from_lap, to_lap, {up(up('sum(pred)', 6), 3)} AS cost
 FROM w JOIN grid g ON g.compound = w.compound AND g.stint = w.stint
 AND g.tyre = least(start_tyre + lap_no - from_lap, 59) AND g.lap = least(lap_no, 79)
 GROUP BY Year, GrandPrix, Driver, w.compound, w.stint, start_tyre, from_lap, to_lap""",
    "best_stop": f"""SELECT {DRIVER}, pit_window, cost FROM requests LEFT JOIN solved
 USING (first_compound, second_compound, start_lap, start_tyre, total_laps, pit_loss)""",
    "pit_loss": f"SELECT Year, GrandPrix, {_loss('GrandPrix')} AS pit_loss FROM named_races",
    "wear_slope": f"""SELECT requests.Year, GrandPrix, requests.Driver, first_compound, start_lap, degradacion_s_vuelta AS wear_s_lap FROM requests
 JOIN predictions p ON p.year = requests.Year AND gp = GrandPrix AND p.driver = requests.Driver""",
    "stop_predictions": "SELECT * FROM predictions",
    "stop_summary": f"""SELECT count(*) AS predicciones_totales, count(error_vueltas) AS comparables,
 {up('avg(error_vueltas)', 2)} AS mae_vueltas, count(*) FILTER (error_vueltas <= 3) AS aciertos_3_vueltas,
 count(*) FILTER (error_vueltas <= 5) AS aciertos_5_vueltas FROM predictions""",
    "strategy_lookup": f"""SELECT year, gp, driver, pit_window, pit_real, (SELECT count(*) FROM predictions) AS predicciones_totales,
 (SELECT {up('avg(error_vueltas)', 2)} FROM predictions) AS mae_vueltas, '1995-1998' AS era,
 (SELECT {mean('avg(abs(LapTime - hat))', 3)} FROM predicted WHERE Year <= 1998) AS mae_segundos
 FROM predictions WHERE year = 1996 AND gp = 'nation_15' AND driver = 'S0000'""",
    "strategy_card": f"""SELECT year, gp, driver, pit_window - pit_real AS difference,
 CASE WHEN pit_window > pit_real THEN 'late' WHEN pit_window < pit_real THEN 'early' WHEN pit_window = pit_real THEN 'exact' END AS verdict,
 {up('least(greatest(pit_window / total_vueltas * 100e0, 0), 100)', 4)} AS window_pct,
 CASE WHEN pit_real IS NOT NULL THEN {up('least(greatest(pit_real / total_vueltas * 100e0, 0), 100)', 4)} END AS real_pct,
 degradacion_s_vuelta > 0.02 AS measurable FROM predictions""",
    "team_by_race": "SELECT * FROM swap_teams",
    "team_by_season": _season_teams("swap_teams"),
    "race_laps": "SELECT * FROM cat_laps",
    "driver_names": "SELECT * FROM full_names",
    "catalogue_races": "SELECT * FROM cat_races",
    "catalogue_drivers": "SELECT * FROM cat_drivers",
    "teams": "SELECT DISTINCT team FROM cat_drivers",
    "catalogue_summary": """SELECT year, count(*) AS races, count(*) FILTER (tiene_datos) AS with_data,
 arg_max(slug, ronda) FILTER (tiene_datos) AS last_slug FROM cat_races GROUP BY 1""",
    "default_race": "SELECT year, slug FROM cat_races WHERE tiene_datos ORDER BY year DESC, ronda DESC LIMIT 1",
    "drivers_by_team": r"""SELECT d.year, d.slug, strftime(CAST(fecha AS DATE), '%d/%m/%y') AS short_date, team, code,
 CASE WHEN regexp_matches(trim(name), '\s') THEN regexp_replace(trim(name), '^\S+\s+', '') ELSE name END AS surname
 FROM cat_drivers d JOIN cat_races r ON r.year = d.year AND r.slug = d.slug""",
    "laps_available": f"SELECT {LAP}, place FROM available",
    "middle_lap": "SELECT * FROM middle",
    "selected_lap": f"SELECT {LAP}, Distance, Speed, X, Y FROM placed SEMI JOIN middle USING ({LAP})",
    "unknown_lap": f"""SELECT {LAP} FROM available ANTI JOIN (SELECT {DRIVER} FROM available WHERE LapNumber = 4) k USING ({DRIVER})""",
    "lap_points": "SELECT * FROM points",
    "lap_bounds": f"""SELECT {LAP}, count(*) AS points, min(X) AS min_x, max(X) AS max_x, min(Y) AS min_y, max(Y) AS max_y
 FROM placed GROUP BY {LAP}""",
    "fastest_lap": f"""SELECT {LAP}, {up('LapTime', 3)} AS LapTime, Distance, Speed FROM telemetry JOIN
 (SELECT {DRIVER}, arg_min(LapNumber, (LapTime, LapNumber)) AS LapNumber, min(LapTime) AS LapTime
  FROM tel_laps WHERE LapTime IS NOT NULL GROUP BY {DRIVER}) f USING ({LAP})""",
    "head_to_head": f"""SELECT {LAP}, Distance, Speed, Throttle, Brake FROM telemetry SEMI JOIN
 (SELECT {DRIVER}, arg_min(LapNumber, (LapTime, LapNumber)) AS LapNumber FROM tel_laps
  WHERE LapTime IS NOT NULL AND Driver IN ('D0024', 'D0048') GROUP BY {DRIVER}) f USING ({LAP})""",
    "resampled_laps": f"""SELECT {LAP}, point, Distance, {up('Speed', 4)} AS Speed, {up('Throttle', 4)} AS Throttle, Brake
 FROM grid_25""",
    "head_to_head_aligned": f"""WITH f AS (SELECT {DRIVER}, arg_min(LapNumber, (LapTime, LapNumber)) AS LapNumber FROM tel_laps
  WHERE LapTime IS NOT NULL GROUP BY {DRIVER}),
 a AS (SELECT * FROM grid_10 SEMI JOIN f USING ({LAP}) WHERE Driver = 'D0024'),
 b AS (SELECT * FROM grid_10 SEMI JOIN f USING ({LAP}) WHERE Driver = 'D0048')
 SELECT Year, GrandPrix, point * 10e0 AS Distance, a.LapNumber AS lapnumber_a, {up('a.Speed', 4)} AS speed_a,
  {up('a.Throttle', 4)} AS throttle_a, a.Brake AS brake_a, b.LapNumber AS lapnumber_b, {up('b.Speed', 4)} AS speed_b,
  {up('b.Throttle', 4)} AS throttle_b, b.Brake AS brake_b, {up('a.Speed - b.Speed', 4)} AS speed_gap
 FROM a FULL JOIN b USING (Year, GrandPrix, point)""",
    "lap_progress": f"""SELECT {LAP}, distance,
 CASE WHEN n > 1 THEN {up('(place - 1) / (n - 1) * 100e0', 4)} ELSE 0e0 END AS progress_pct,
 CASE WHEN max(distance) OVER w = min(distance) OVER w THEN 0e0
  ELSE {up('(distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w)', 4)} END AS distance_ratio
 FROM ranked WINDOW w AS (PARTITION BY {LAP})""",
    "neighbours": f"""SELECT {LAP}, distance, b_dm AS before_dm, bx AS before_x, a_dm AS after_dm, ax AS after_x FROM near""",
    "lateral_g_raw": f"SELECT {LAP}, distance, {up('g_lat', 4)} AS g_lat FROM forces",
    "longitudinal_g_raw": f"SELECT {LAP}, distance, {up('g_lon', 4)} AS g_lon FROM forces",
    "g_smoothed": f"SELECT {LAP}, distance, {up('g_lat', 4)} AS g_lat, {up('g_lon', 4)} AS g_lon FROM smooth",
    "lap_enriched": f"SELECT {LAP}, distance, g_lat, g_lon FROM enriched",
    "g_diagnostic": f"""SELECT {LAP}, count(*) AS points, {up('quantile_cont(g_raw, 0.9)', 4)} AS p90_raw, {up('max(g_raw)', 4)} AS max_raw,
 {up('median(g)', 4)} AS median_g, {up('quantile_cont(g, 0.9)', 4)} AS p90_g, {up('max(g)', 4)} AS max_g,
 arg_max(speed, (speed, -place)) AS fastest_speed, {up('arg_max(g, (speed, -place))', 4)} AS fastest_g,
 {up('arg_max_null(radius_m, (speed, -place))', 2)} AS fastest_radius_m,
 arg_min(speed, (speed, place)) AS slowest_speed, {up('arg_min(g, (speed, place))', 4)} AS slowest_g,
 {up('arg_min_null(radius_m, (speed, place))', 2)} AS slowest_radius_m FROM checked GROUP BY {LAP}""",
    "g_top5": f"""SELECT {LAP}, CAST(row_number() OVER (PARTITION BY {LAP} ORDER BY g DESC, place) AS INT) AS rank, distance, speed,
 {up('g', 4)} AS g, {up('radius_m', 2)} AS radius_m FROM checked
 QUALIFY row_number() OVER (PARTITION BY {LAP} ORDER BY g DESC, place) <= 5""",
    "gauges": f"""SELECT {LAP}, distance, {up('abs(least(g_lon, 0e0))', 2)} AS deceleration_g, g_lat > 3 AS high_load, drs >= 10 AS drs_open,
 {up('least(greatest((rpm - 8000) / 4000e0, 0e0), 1e0)', 4)} AS rev_ratio,
 CAST(floor(least(greatest((rpm - 8000) / 4000e0, 0e0), 1e0) * 15 + 0.5e0) AS INT) AS lit_lights,
 {up('speed / 36e-1 / (pi() * 72e-2)', 3)} AS wheel_turns_s, {up('(speed / 300e0) * (speed / 300e0) * 100e0', 3)} AS aero_load_pct FROM enriched""",
    "track_projected": f"""SELECT {LAP}, distance, {up('map_x', 3)} AS map_x, {up('map_y', 3)} AS map_y,
 {up('units_per_metre', 4)} AS units_per_metre FROM drawn""",
    "track_segments": _runs(f"{LAP}, segment"),
    "braking_zones": _runs(f"{LAP}, segment, zone", "WHERE brake <> 0"),
    "nearest_sample": f"""SELECT {LAP}, query_id, arg_min(distance, (d2, distance)) AS distance, {up('sqrt(min(d2))', 3)} AS map_distance
 FROM (SELECT p.Year, p.GrandPrix, p.Driver, p.LapNumber, p.distance, CAST(round(q.distance * 10) AS BIGINT) AS query_id,
  (p.map_x - (q.map_x + 3)) * (p.map_x - (q.map_x + 3)) + (p.map_y - (q.map_y + 4)) * (p.map_y - (q.map_y + 4)) AS d2
  FROM drawn p JOIN drawn q USING ({LAP}))
 WHERE d2 < 140 GROUP BY {LAP}, query_id""",
    "gap_ahead": f"""WITH e AS (SELECT {LAP}, max(Distance) AS d FROM feed GROUP BY ALL),
 l AS (SELECT Year, GrandPrix, quantile_cont(d, 0.5) AS len FROM e GROUP BY 1, 2),
 s AS (SELECT feed.*, (LapNumber - 1) * len + Distance AS way FROM feed JOIN l USING (Year, GrandPrix)),
 p AS (SELECT *, lag(SessionTime) OVER w AS t0, lag(way) OVER w AS way0 FROM s
  WINDOW w AS (PARTITION BY {DRIVER} ORDER BY SessionTime, LapNumber, Distance)),
 i AS (SELECT *, unnest(range(CAST(ceil(t0 / {Q.GAP_BUCKET_S}e0) AS BIGINT),
  CAST(ceil(SessionTime / {Q.GAP_BUCKET_S}e0) AS BIGINT))) AS bucket FROM p WHERE t0 < SessionTime),
 c AS (SELECT {DRIVER}, bucket,
  way0 + (way - way0) * ((bucket * {Q.GAP_BUCKET_S}e0 - t0) / (SessionTime - t0)) AS covered FROM i)
 SELECT Year, GrandPrix, bucket, Driver, {up('covered', 1)} AS covered_m, lag(Driver) OVER w AS driver_ahead,
 {up('lag(covered) OVER w - covered', 1)} AS gap_m
 FROM c WINDOW w AS (PARTITION BY Year, GrandPrix, bucket ORDER BY covered DESC, Driver)""",
}

ORACLE = {name: sql(body) for name, body in BODIES.items()}

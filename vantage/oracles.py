"""DuckDB SQL for the sky queries, written apart from the DataFrame code."""

from __future__ import annotations

GAP = 86_400

_OBS = """
c AS (SELECT radians(43.4675e0) AS la, radians(-79.6877e0) AS lo, 6378137e0 AS a, (1/298.257223563e0)*(2-1/298.257223563e0) AS e2),
e0 AS (SELECT event_id AS obs_id, 'u' || user_id AS entity_id, ts, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS callsign, CAST(props->>'$.k' AS INT) AS k, event_id AS i, value FROM events),
e1 AS (SELECT obs_id, entity_id, ts, callsign, 43.4675e0+(k-50)*0.005e0+(i%7)*0.0003e0 AS lat, -79.6877e0+((i*37)%100-49.5e0)*0.006e0 AS lon, 300+value*20 AS alt_m, 40e0+(i*13)%200 AS speed_mps,
  ((k*36+(i%11)*10)%3600)/10e0 AS track_deg, ((i*7)%41-20)/2e0 AS vertical_rate_mps, -30e0+(i*3)%28 AS signal_dbfs FROM e0),
e2 AS (SELECT e1.*, radians(lat) AS pla, radians(lon) AS plo, a/sqrt(1-e2*sin(radians(lat))*sin(radians(lat))) AS n, a/sqrt(1-e2*sin(la)*sin(la)) AS n0, c.* FROM e1, c),
e3 AS (SELECT *, (n+alt_m)*cos(pla)*cos(plo)-(n0+100)*cos(la)*cos(lo) AS dx, (n+alt_m)*cos(pla)*sin(plo)-(n0+100)*cos(la)*sin(lo) AS dy, (n*(1-e2)+alt_m)*sin(pla)-(n0*(1-e2)+100)*sin(la) AS dz FROM e2),
e4 AS (SELECT *, -sin(lo)*dx+cos(lo)*dy AS east, -sin(la)*cos(lo)*dx-sin(la)*sin(lo)*dy+cos(la)*dz AS north, cos(la)*cos(lo)*dx+cos(la)*sin(lo)*dy+sin(la)*dz AS up FROM e3),
obs AS (SELECT obs_id, entity_id, ts, callsign, lat, lon, alt_m, speed_mps, track_deg, vertical_rate_mps, signal_dbfs, east, north, up, sqrt(east*east+north*north+up*up) AS range_m,
  fmod(degrees(atan2(east,north))+360,360) AS azimuth_deg, degrees(atan2(up,sqrt(east*east+north*north))) AS elevation_deg,
  fmod(degrees(atan2(sin(plo-lo)*cos(pla), cos(la)*sin(pla)-sin(la)*cos(pla)*cos(plo-lo)))+360,360) AS bearing_deg FROM e4)"""

_PTS = f"""{_OBS},
p0 AS (SELECT *, CASE WHEN date_sub('second', lag(ts) OVER w, ts) > {GAP} THEN 1 ELSE 0 END AS cut FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY ts, obs_id)),
p1 AS (SELECT *, sum(cut) OVER (PARTITION BY entity_id ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING) AS segment,
  first_value(nullif(callsign,'') IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING) AS known FROM p0),
pts AS (SELECT * EXCLUDE (callsign, known, cut, segment), CAST(segment AS INT) AS segment, coalesce(last_value(known) OVER (PARTITION BY entity_id, segment ORDER BY ts, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS callsign,
  'track-' || entity_id || '-' || CAST(segment AS INT) AS track_id FROM p1)"""


def _flat(la1: str, lo1: str, la2: str, lo2: str) -> str:
    return f"sqrt(power(({lo2}-{lo1})*111320e0*cos(radians(({la1}+{la2})/2)),2)+power(({la2}-{la1})*111132e0,2))"


def _bearing(la1: str, lo1: str, la2: str, lo2: str) -> str:
    return f"fmod(degrees(atan2(({lo2}-{lo1})*111320e0*cos(radians(({la1}+{la2})/2)), ({la2}-{la1})*111132e0))+360,360)"


_TRK = f"""{_PTS},
s0 AS (SELECT *, {_flat('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step_m, row_number() OVER (PARTITION BY track_id ORDER BY range_m, ts, obs_id) AS near_k, row_number() OVER w AS k, row_number() OVER (PARTITION BY track_id ORDER BY ts DESC, obs_id DESC) AS kz
  FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY ts, obs_id)),
t0 AS (SELECT track_id, any_value(entity_id) AS entity_id, any_value(segment) AS segment, any_value(callsign) AS callsign, count(*) AS n_points, min(ts) AS started, max(ts) AS ended, min(range_m) AS min_range_m, max(elevation_deg) AS max_elevation_deg,
  max(CASE WHEN near_k=1 THEN obs_id END) AS closest_obs, max(CASE WHEN near_k=1 THEN ts END) AS closest_approach, max(CASE WHEN k=1 THEN obs_id END) AS first_obs, max(CASE WHEN kz=1 THEN obs_id END) AS last_obs,
  avg(alt_m) AS mean_alt_m, stddev_pop(alt_m) AS std_alt_m, min(alt_m) AS min_alt_m, max(alt_m) AS max_alt_m, avg(speed_mps) AS mean_speed_mps, stddev_pop(speed_mps) AS std_speed_mps, avg(signal_dbfs) AS mean_signal_dbfs, avg(elevation_deg) AS mean_elevation_deg,
  avg(abs(vertical_rate_mps)) AS mean_abs_vrate_mps, avg(CASE WHEN vertical_rate_mps>2 THEN 1e0 ELSE 0 END) AS climb_ratio, avg(CASE WHEN vertical_rate_mps<-2 THEN 1e0 ELSE 0 END) AS descent_ratio,
  fmod(degrees(atan2(sum(sin(radians(track_deg))),sum(cos(radians(track_deg)))))+360,360) AS heading_deg, coalesce(sum(step_m),0) AS path_m,
  max(CASE WHEN k=1 THEN lat END) AS la1, max(CASE WHEN k=1 THEN lon END) AS lo1, max(CASE WHEN kz=1 THEN lat END) AS la2, max(CASE WHEN kz=1 THEN lon END) AS lo2, max(CASE WHEN k=1 THEN range_m END) AS start_range_m, max(CASE WHEN kz=1 THEN range_m END) AS end_range_m,
  {', '.join(f'avg(CASE WHEN floor(azimuth_deg/45)%8={b} THEN 1e0 ELSE 0 END) AS az_{b}' for b in range(8))} FROM s0 GROUP BY track_id),
trk AS (SELECT *, CASE WHEN path_m<1 THEN 1e0 ELSE least({_flat('la1', 'lo1', 'la2', 'lo2')}/path_m,1e0) END AS straightness, min_range_m<10000 AND max_elevation_deg>5 AS overhead, CAST(hour(started) AS INT) AS start_hour FROM t0)"""


def _c01(x: str) -> str:
    return f"least(greatest({x},0),1)"


_DIMS = [
    _c01("mean_alt_m/12000"), _c01("min_alt_m/12000"), _c01("max_alt_m/12000"), _c01("mean_speed_mps/300"), "(sin(radians(heading_deg))+1)/2", "(cos(radians(heading_deg))+1)/2",
    "0.5+0.25*sin((hour(started)+minute(started)/60e0)/24*2*pi())", "0.5+0.25*cos((hour(started)+minute(started)/60e0)/24*2*pi())", _c01("min_range_m/50000"), _c01("max_elevation_deg/90"), _c01("mean_elevation_deg/90"), _c01("(epoch_us(ended)-epoch_us(started))/1e6/1800"),
    "climb_ratio", "descent_ratio", "straightness", _c01("mean_abs_vrate_mps/15"), *[f"az_{b}" for b in range(8)], _c01("(mean_signal_dbfs+40)/40"), _c01("std_speed_mps/50"), _c01("std_alt_m/3000"), _c01("start_range_m/50000"), _c01("end_range_m/50000"), _c01("n_points/600"),
    "CASE WHEN overhead THEN 1e0 ELSE 0 END", "0e0",
]
_EMB = f"{_TRK}, emb AS (SELECT *, row_number() OVER (ORDER BY started, entity_id, segment)-1 AS seq, [{', '.join(f'CAST({x} AS FLOAT)' for x in _DIMS)}] AS v FROM trk)"
_WX = f"""{_OBS},
w0 AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n, avg(speed_mps) AS v, max(alt_m) AS z FROM obs GROUP BY 1),
wx AS (SELECT 'weather:' || strftime(start, '%Y-%m-%dT%H') AS window_id, start, start + INTERVAL 1 HOUR AS "end", ['clear','cloudy','fog','rain','snow','thunderstorm'][CAST(n%6+1 AS INT)] AS condition, v/20 AS wind_mps, z/1000 AS precip_mm_hr, CASE WHEN n%6>=3 THEN 'advisory' END AS alert FROM w0)"""
_WXT = _WX.replace(_OBS, _TRK)
_SEQ = f"{_TRK}, q AS (SELECT *, row_number() OVER (ORDER BY started, entity_id, segment)-1 AS seq FROM trk)"
_CIRC = "least(fmod(a.heading_deg-b.heading_deg+720,360),360-fmod(a.heading_deg-b.heading_deg+720,360))"
_BASE = f"""{_EMB},
base AS (SELECT a.track_id, count(b.track_id) AS n_prior, coalesce(avg(b.mean_alt_m),0) AS alt_mean, CASE WHEN count(b.track_id)>0 THEN greatest(stddev_pop(b.mean_alt_m),500) ELSE 0 END AS alt_std, coalesce(avg(b.mean_signal_dbfs),0) AS sig_mean,
  CASE WHEN count(b.track_id)>0 THEN greatest(stddev_pop(b.mean_signal_dbfs),1) ELSE 0 END AS sig_std, count(CASE WHEN least((a.start_hour-b.start_hour+48)%24,(b.start_hour-a.start_hour+48)%24)<=2 THEN 1 END) AS hours_near, min({_CIRC}) AS nearest_corridor
  FROM emb a LEFT JOIN emb b ON b.seq<a.seq GROUP BY a.track_id)"""
_NOV = f"""{_BASE},
d0 AS (SELECT a.track_id, sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda x: power(CAST(x[1] AS DOUBLE)-CAST(x[2] AS DOUBLE),2)))) AS d, b.track_id AS o FROM emb a JOIN emb b ON b.seq<a.seq),
d1 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY d, o) AS k FROM d0),
nov AS (SELECT t.track_id, CASE WHEN count(d)=0 THEN 0.5e0 ELSE least(avg(d)/1.2e0,1) END AS novelty FROM emb t LEFT JOIN d1 ON t.track_id=d1.track_id AND k<=3 GROUP BY t.track_id)"""
_SCORE = f"""{_NOV},
sc0 AS (SELECT t.track_id, t.seq, least(nearest_corridor/60,1) AS route_deviation, least(abs(mean_alt_m-alt_mean)/alt_std/2.5e0,1) AS altitude_deviation, greatest(1-hours_near/3e0,0) AS time_of_day_rarity, least(abs(mean_signal_dbfs-sig_mean)/sig_std/2.5e0,1) AS signal_unusualness, novelty AS novelty_score
  FROM emb t JOIN base USING (track_id) JOIN nov USING (track_id) WHERE n_prior>=5),
sc AS (SELECT *, 0.3e0*route_deviation+0.2e0*altitude_deviation+0.15e0*time_of_day_rarity+0.15e0*signal_unusualness+0.1e0*novelty_score AS score FROM sc0)"""
_NOW = "TIMESTAMP '2024-01-21 00:00:00'"
_SNAP = f"""{_OBS}, snap AS (SELECT * EXCLUDE (ts), {_NOW} - to_seconds((obs_id*7919)%1200) AS ts FROM obs)"""
_STEP = f"""{_SNAP}, st AS (SELECT *, {_flat('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d, {_bearing('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS b, date_sub('microsecond', lag(ts) OVER w, ts)/1e6 AS dt FROM snap WHERE ts >= {_NOW} - to_seconds(SPAN) WINDOW w AS (PARTITION BY entity_id ORDER BY ts, obs_id))"""
_JD = "e AS (SELECT event_id, epoch_us(ts)/1e6 AS t, epoch_us(ts)/1e6/86400-10957.5e0 AS d FROM events), g AS (SELECT *, fmod(280.46061837e0+360.98564736629e0*d,360) AS gmst FROM e)"
_SUN = f"""{_JD}, s0 AS (SELECT *, radians(fmod(357.528e0+0.9856003e0*d,360)) AS m, 280.460e0+0.9856474e0*d AS l, radians(23.439e0-0.0000004e0*d) AS eps FROM g),
s1 AS (SELECT *, radians(l+1.915e0*sin(m)+0.020e0*sin(2*m)) AS lam FROM s0), s2 AS (SELECT *, degrees(atan2(cos(eps)*sin(lam),cos(lam))) AS ra, asin(sin(eps)*sin(lam)) AS de FROM s1)"""
_MOON = f"""{_JD}, s0 AS (SELECT *, radians(218.316e0+13.176396e0*d)+radians(6.289e0)*sin(radians(134.963e0+13.064993e0*d)) AS lam, radians(5.128e0)*sin(radians(93.272e0+13.229350e0*d)) AS b, radians(23.439e0) AS eps FROM g),
s2 AS (SELECT *, degrees(atan2(sin(lam)*cos(eps)-tan(b)*sin(eps),cos(lam))) AS ra, asin(sin(b)*cos(eps)+cos(b)*sin(eps)*sin(lam)) AS de FROM s0)"""
_AZEL = """, s3 AS (SELECT *, radians(gmst-79.6877e0-ra) AS h, radians(43.4675e0) AS phi FROM s2)
SELECT event_id, fmod(round(fmod(degrees(atan2(-sin(h),tan(de)*cos(phi)-sin(phi)*cos(h)))+360,360),4),360) AS az, round(degrees(asin(sin(phi)*sin(de)+cos(phi)*cos(de)*cos(h))),4)+0.0 AS el FROM s3"""


_PLANT = f"""{_SNAP},
pics AS (SELECT obs_id, entity_id, ts, lat, lon, alt_m, speed_mps, track_deg FROM snap
  UNION ALL SELECT obs_id+1000000000, entity_id || 'w', ts, lat+0.002e0, lon, alt_m, speed_mps, track_deg FROM snap
  UNION ALL SELECT 2000000000+i*50+k, 'g' || user_id, {_NOW} - to_seconds((49-k)*10), user_id%1600*0.05e0-40+0.004e0*CASE WHEN user_id%3=0 THEN k ELSE k//10 END,
    CASE WHEN user_id%3=0 THEN -79e0 ELSE -79+0.003e0*CASE WHEN (k//10)%2=0 THEN k%10 ELSE 9-k%10 END END, 1000e0, 60e0, 0e0 FROM (SELECT user_id, min(event_id) AS i FROM events GROUP BY 1), range(50) r(k))"""
_PST = f"""{_PLANT}, st AS (SELECT *, {_flat('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d, {_bearing('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS b FROM pics WHERE ts >= {_NOW} - to_seconds(SPAN) WINDOW w AS (PARTITION BY entity_id ORDER BY ts, obs_id))"""
_DIFF = lambda a, b: f"least(fmod({a}-({b})+720,360),360-fmod({a}-({b})+720,360))"
_HELD = "SELECT entity_id FROM st GROUP BY 1 HAVING count(*)>=8 AND sum(d)>=4000 AND " + _flat("arg_min(lat,(ts,obs_id))", "arg_min(lon,(ts,obs_id))", "arg_max(lat,(ts,obs_id))", "arg_max(lon,(ts,obs_id))") + "/sum(d)<0.25"
_AROUND = "i AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, obs_id) AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM st), m AS (SELECT entity_id, min(alt_m) AS lo, arg_min(i,(alt_m,i)) AS mi FROM i GROUP BY 1) SELECT entity_id FROM i JOIN m USING (entity_id) GROUP BY entity_id, lo, mi, n HAVING n>=10 AND lo<=600 AND mi>1 AND mi-1<n-3 AND max(CASE WHEN i<mi THEN alt_m END)-lo>=150 AND max(CASE WHEN i>=mi THEN alt_m END)-lo>=200"
_FORM = f"""l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, obs_id DESC) AS k FROM fp), f AS (SELECT * FROM l WHERE k=1 AND date_sub('microsecond', ts, {_NOW})<30000000 AND speed_mps>30),
  o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, obs_id DESC) AS k2 FROM fp WHERE ts<={_NOW}-to_seconds(30)), h AS (SELECT f.*, o.lat AS qlat, o.lon AS qlon FROM f LEFT JOIN o ON f.entity_id=o.entity_id AND k2=1),
  fm AS (SELECT a.entity_id AS a, b.entity_id AS b FROM h a JOIN h b ON a.entity_id<b.entity_id WHERE {_DIFF('a.track_deg', 'b.track_deg')}<=15 AND abs(a.speed_mps-b.speed_mps)/greatest(a.speed_mps,b.speed_mps)<=0.15 AND abs(a.alt_m-b.alt_m)<=600
  AND {_flat('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=1000 AND NOT coalesce({_flat('a.qlat', 'a.qlon', 'b.qlat', 'b.qlon')}>1200, false))"""
#: Legs go on while a bearing stays within 25 degrees of their running mean: one step of each entity per round.
_LEGS = f"""es AS (SELECT entity_id, b, d, row_number() OVER (PARTITION BY entity_id ORDER BY ts, obs_id) AS k FROM st WHERE d>=15 AND entity_id IN (SELECT entity_id FROM st GROUP BY 1 HAVING count(*)>=24)),
  fold AS (SELECT entity_id, 1 AS k, sin(radians(b)) AS s, cos(radians(b)) AS c, 1 AS n, d AS len, CAST([] AS DOUBLE[]) AS legs FROM es WHERE k=1
    UNION ALL SELECT e.entity_id, e.k, CASE WHEN on_ THEN f.s ELSE 0 END+sin(radians(e.b)), CASE WHEN on_ THEN f.c ELSE 0 END+cos(radians(e.b)), CASE WHEN on_ THEN f.n ELSE 0 END+1, CASE WHEN on_ THEN f.len ELSE 0 END+e.d,
    CASE WHEN NOT on_ AND f.n>=4 AND f.len>=800 THEN list_append(f.legs, mean) ELSE f.legs END FROM (SELECT *, fmod(degrees(atan2(s,c))+360,360) AS mean FROM fold) f JOIN es e ON e.entity_id=f.entity_id AND e.k=f.k+1, LATERAL (SELECT {_DIFF('e.b', 'f.mean')}<25 AS on_) z),
  done AS (SELECT entity_id, CASE WHEN n>=4 AND len>=800 THEN list_append(legs, fmod(degrees(atan2(s,c))+360,360)) ELSE legs END AS legs FROM fold QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC)=1),
  gr AS (SELECT entity_id FROM done WHERE len(legs)>=4 AND len(list_filter(range(2, len(legs)+1), lambda x: {_DIFF('legs[x]', 'legs[x-1]')}>155))>=3)"""


def _with(ctes: str, sql: str) -> str:
    return f"WITH {ctes.strip()} {sql}"


def _hold(span: int) -> str:
    return _STEP.replace("SPAN", str(span))


ORACLES = {
    "project_frames": _with(_OBS, "SELECT obs_id, round(range_m,4)+0.0 AS range_m, fmod(round(azimuth_deg,6),360) AS azimuth_deg, round(elevation_deg,6)+0.0 AS elevation_deg, fmod(round(bearing_deg,6),360) AS bearing_deg FROM obs"),
    "ecef_enu": _with(_OBS, "SELECT obs_id, round(east,3)+0.0 AS east, round(north,3)+0.0 AS north, round(up,3)+0.0 AS up FROM obs"),
    "screen_xy": _with(_OBS, "SELECT obs_id, round(400+(90-elevation_deg)/90*300*sin(radians(azimuth_deg)),3)+0.0 AS x, round(300-(90-elevation_deg)/90*300*cos(radians(azimuth_deg)),3)+0.0 AS y, elevation_deg>=0 AS visible FROM obs"),
    "compass_counts": _with(_OBS, "SELECT ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(track_deg/45+0.5) AS INT)%8+1] AS sector, count(*) AS n FROM obs GROUP BY 1"),
    "band_counts": "WITH s AS (SELECT ((event_id*7)%101)/100e0 AS s FROM events), r AS (SELECT CASE WHEN s<=0.3 THEN 0 WHEN s<=0.55 THEN 1 WHEN s<=0.75 THEN 2 WHEN s<=0.9 THEN 3 ELSE 4 END AS rank FROM s) SELECT ['normal','mildly unusual','interesting','strong anomaly','rare'][rank+1] AS band, CAST(rank AS INT) AS rank, ['store','timeline marker','include in summary','local alert','preserve raw data + report'][rank+1] AS action, count(*) AS n FROM r GROUP BY rank",
    "dead_reckoning": _with(_OBS, "SELECT obs_id, CASE WHEN ok THEN round(lat+speed_mps*dt*cos(b)/111320e0,8) END AS lat, CASE WHEN ok THEN round(lon+speed_mps*dt*sin(b)/(111320e0*cos(radians(lat))),8) END AS lon, CASE WHEN ok THEN round(alt_m+vertical_rate_mps*dt,4) END AS alt_m FROM (SELECT *, CAST(obs_id%25 AS DOUBLE) AS dt, radians(track_deg) AS b, obs_id%25 BETWEEN 1 AND 20 AS ok FROM obs)"),
    "kp_levels": "WITH k AS (SELECT (event_id%91)/10e0 AS k FROM events) SELECT CASE WHEN k<4 THEN 'quiet' WHEN k<5 THEN 'active' WHEN k<6 THEN 'G1 minor storm' WHEN k<7 THEN 'G2 moderate storm' WHEN k<8 THEN 'G3 strong storm' WHEN k<9 THEN 'G4 severe storm' ELSE 'G5 extreme storm' END AS level, k>=7 AS aurora, count(*) AS n FROM k GROUP BY 1,2",
    "stitch_tracks": _with(_PTS, "SELECT track_id, count(*) AS n_points, min(ts) AS started, max(ts) AS ended FROM pts GROUP BY 1"),
    "callsign_fill": _with(_PTS, "SELECT obs_id, track_id, callsign FROM pts"),
    "track_rollup": _with(_TRK, "SELECT track_id, n_points, round(min_range_m,4)+0.0 AS min_range_m, closest_obs, first_obs, last_obs, round(max_elevation_deg,6)+0.0 AS max_elevation_deg, closest_approach, overhead, start_hour FROM trk"),
    "track_stats": _with(_TRK, "SELECT track_id, round(mean_alt_m,4)+0.0 AS mean_alt_m, round(std_alt_m,3)+0.0 AS std_alt_m, round(mean_speed_mps,4)+0.0 AS mean_speed_mps, round(mean_signal_dbfs,4)+0.0 AS mean_signal_dbfs, round(mean_elevation_deg,6)+0.0 AS mean_elevation_deg, round(mean_abs_vrate_mps,4)+0.0 AS mean_abs_vrate_mps, round(climb_ratio,6) AS climb_ratio, round(descent_ratio,6) AS descent_ratio FROM trk"),
    "circular_heading": _with(_TRK, "SELECT track_id, fmod(round(heading_deg,4),360) AS heading_deg FROM trk"),
    "heading_histogram": _with(_PTS, f"SELECT track_id, {', '.join(f'CAST(count(CASE WHEN floor(track_deg/45)%8={b} THEN 1 END) AS BIGINT) AS h{b}' for b in range(8))} FROM pts GROUP BY 1"),
    "azimuth_histogram": _with(_TRK, f"SELECT track_id, {', '.join(f'round(az_{b},6)+0.0 AS az_{b}' for b in range(8))} FROM trk"),
    "path_straightness": _with(_TRK, "SELECT track_id, round(path_m,2)+0.0 AS path_m, round(straightness,6)+0.0 AS straightness FROM trk"),
    "track_embedding": _with(_EMB, "SELECT track_id, CAST(dim AS INT) AS dim, round(CAST(v[dim+1] AS DOUBLE),4)+0.0 AS value FROM emb, range(32) r(dim)"),
    "weather_embedding": _with(_WX, "SELECT window_id, CAST(dim AS INT) AS dim, round(CAST(v[dim+1] AS DOUBLE),4)+0.0 AS value FROM (SELECT window_id, [CAST(x AS FLOAT) FOR x IN [CASE condition WHEN 'clear' THEN 0e0 WHEN 'cloudy' THEN 0.25 WHEN 'fog' THEN 0.5 WHEN 'rain' THEN 0.6 WHEN 'snow' THEN 0.7 ELSE 1 END, least(precip_mm_hr/5,1), least(wind_mps/20,1), CASE WHEN alert IS NULL THEN 0 ELSE 1 END, 0.5+0.25*sin(hour(start)/24e0*2*pi()), 0.5+0.25*cos(hour(start)/24e0*2*pi()), 0, 0]] AS v FROM wx), range(8) r(dim)"),
    "derived_motion": _with(_PTS, f""", m0 AS (SELECT track_id, obs_id, ts, row_number() OVER w AS n, date_sub('microsecond', lag(ts) OVER w, ts)/1e6 AS dt, {_flat('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d, {_bearing('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS b, alt_m-lag(alt_m) OVER w AS z FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY ts, obs_id)),
        m1 AS (SELECT *, coalesce(last_value(CASE WHEN dt>0 THEN d/dt END IGNORE NULLS) OVER u,0) AS v, coalesce(last_value(CASE WHEN dt>0 AND d>0 THEN b END IGNORE NULLS) OVER u,0) AS h, coalesce(last_value(CASE WHEN dt>0 THEN z/dt END IGNORE NULLS) OVER u,0) AS r FROM m0 WINDOW u AS (PARTITION BY track_id ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING)),
        m2 AS (SELECT obs_id, n, v, h, r, coalesce(lead(v) OVER w,0) AS v1, coalesce(lead(h) OVER w,0) AS h1, coalesce(lead(r) OVER w,0) AS r1 FROM m1 WINDOW w AS (PARTITION BY track_id ORDER BY ts, obs_id))
        SELECT obs_id, round(CASE WHEN n=1 THEN v1 ELSE v END,4)+0.0 AS derived_speed_mps, fmod(round(CASE WHEN n=1 THEN h1 ELSE h END,4),360) AS derived_track_deg, round(CASE WHEN n=1 THEN r1 ELSE r END,6)+0.0 AS derived_vrate_mps FROM m2"""),
    "overhead_candidates": _with(_TRK, "SELECT track_id, entity_id, round(min_range_m,4)+0.0 AS min_range_m, round(max_elevation_deg,6)+0.0 AS max_elevation_deg FROM trk WHERE overhead"),
    "window_activity": _with(_TRK, ", lo AS (SELECT min(started) + INTERVAL 10 DAY AS a FROM trk) SELECT entity_id, track_id FROM trk, lo WHERE floor(epoch_us(started)/1e6)<=floor(epoch_us(a)/1e6)+21600 AND floor(epoch_us(ended)/1e6)>=floor(epoch_us(a)/1e6)"),
    "hour_windows": _with(_TRK, "SELECT track_id, 'window:' || strftime(h, '%Y-%m-%dT%H') AS window_id FROM (SELECT track_id, unnest(generate_series(date_trunc('hour', started), ended, INTERVAL 1 HOUR)) AS h FROM trk)"),
    "weather_overlap": _with(_WXT, "SELECT track_id, window_id FROM trk JOIN wx ON wx.start<trk.ended AND wx.\"end\">trk.started"),
    "weather_islands": _with(_WX, ", r AS (SELECT *, sum(CASE WHEN condition IN ('clear','cloudy') THEN 1 ELSE 0 END) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM wx) SELECT arg_min(condition, start) AS condition, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n_windows FROM r WHERE condition NOT IN ('clear','cloudy') GROUP BY run"),
    "hourly_counts": _with(_OBS, "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT entity_id) AS entities FROM obs GROUP BY 1"),
    "session_windows": _with(_PTS, "SELECT entity_id, min(ts) AS started, count(*) AS n_points FROM pts GROUP BY entity_id, segment"),
    "prior_baseline": _with(_BASE, "SELECT track_id, n_prior, round(alt_mean,3)+0.0 AS alt_mean, round(alt_std,3)+0.0 AS alt_std, round(sig_mean,4)+0.0 AS sig_mean, round(sig_std,4)+0.0 AS sig_std, hours_near, round(nearest_corridor,4)+0.0 AS nearest_corridor FROM base"),
    "leave_one_out_baseline": _with(_SEQ, ", s AS (SELECT count(*) AS n, sum(mean_alt_m) AS a, sum(mean_alt_m*mean_alt_m) AS aa, sum(mean_signal_dbfs) AS g, sum(mean_signal_dbfs*mean_signal_dbfs) AS gg FROM q), o AS (SELECT a.track_id, count(CASE WHEN least((a.start_hour-b.start_hour+48)%24,(b.start_hour-a.start_hour+48)%24)<=2 THEN 1 END) AS hours_near, min(" + _CIRC + ") AS nearest_corridor FROM q a JOIN q b ON a.track_id<>b.track_id GROUP BY 1) SELECT q.track_id, n-1 AS n_prior, round((a-mean_alt_m)/(n-1),3)+0.0 AS alt_mean, round(greatest(sqrt(greatest((aa-mean_alt_m*mean_alt_m)/(n-1)-power((a-mean_alt_m)/(n-1),2),0)),500),2)+0.0 AS alt_std, round((g-mean_signal_dbfs)/(n-1),4)+0.0 AS sig_mean, round(greatest(sqrt(greatest((gg-mean_signal_dbfs*mean_signal_dbfs)/(n-1)-power((g-mean_signal_dbfs)/(n-1),2),0)),1),3)+0.0 AS sig_std, hours_near, round(nearest_corridor,4)+0.0 AS nearest_corridor FROM q, s, o WHERE o.track_id=q.track_id"),
    "anomaly_scores": _with(_SCORE, "SELECT track_id, round(route_deviation,3)+0.0 AS route_deviation, round(altitude_deviation,3)+0.0 AS altitude_deviation, round(time_of_day_rarity,4)+0.0 AS time_of_day_rarity, round(signal_unusualness,3)+0.0 AS signal_unusualness, round(novelty_score,3)+0.0 AS novelty_score, round(score,3)+0.0 AS score FROM sc"),
    "unusual_top1": _with(_SCORE, "SELECT track_id, round(score,3)+0.0 AS score FROM sc WHERE score>0.3 ORDER BY sc.score DESC, seq DESC LIMIT 1"),
    "track_novelty": _with(_NOV, "SELECT track_id, round(novelty,3)+0.0 AS novelty FROM nov"),
    "holding": _with(_hold(360), "SELECT entity_id FROM st GROUP BY 1 HAVING count(*)>=8 AND sum(d)>=4000 AND " + _flat("arg_min(lat,(ts,obs_id))", "arg_min(lon,(ts,obs_id))", "arg_max(lat,(ts,obs_id))", "arg_max(lon,(ts,obs_id))") + "/sum(d)<0.25"),
    "go_around": _with(_hold(600), ", i AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, obs_id) AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM st), m AS (SELECT entity_id, min(alt_m) AS lo, arg_min(i,(alt_m,i)) AS mi FROM i GROUP BY 1) SELECT entity_id FROM i JOIN m USING (entity_id) GROUP BY entity_id, lo, mi, n HAVING n>=10 AND lo<=600 AND mi>1 AND mi-1<n-3 AND max(CASE WHEN i<mi THEN alt_m END)-lo>=150 AND max(CASE WHEN i>=mi THEN alt_m END)-lo>=200"),
    "heading_rate": _with(_hold(90), ", a AS (SELECT *, lag(b) OVER (PARTITION BY entity_id ORDER BY ts, obs_id) AS pb FROM st WHERE d>30 AND dt>0), r AS (SELECT entity_id, avg((fmod(b-pb+540,360)-180)/dt) AS r FROM a GROUP BY 1) SELECT e.entity_id, round(coalesce(r,0),4)+0.0 AS rate_deg_s FROM (SELECT DISTINCT entity_id FROM snap) e LEFT JOIN r ON e.entity_id=r.entity_id"),
    "conflict_pairs": _with(_SNAP, f""", l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, obs_id DESC) AS k FROM snap), s AS (SELECT entity_id, east, north, up, speed_mps*sin(radians(track_deg)) AS ve, speed_mps*cos(radians(track_deg)) AS vn, vertical_rate_mps AS vu FROM l WHERE k=1 AND date_sub('microsecond', ts, {_NOW})<=30000000),
        p AS (SELECT a.entity_id AS a, b.entity_id AS b, b.east-a.east AS px, b.north-a.north AS py, b.up-a.up AS pz, b.ve-a.ve AS vx, b.vn-a.vn AS vy, b.vu-a.vu AS vz FROM s a JOIN s b ON a.entity_id<b.entity_id), q AS (SELECT *, vx*vx+vy*vy+vz*vz AS v2 FROM p), cc AS (SELECT *, CASE WHEN v2<1e-9 THEN 0 ELSE greatest(least(-(px*vx+py*vy+pz*vz)/v2,90),0) END AS t FROM q),
        d AS (SELECT a, b, t, sqrt(power(px+vx*t,2)+power(py+vy*t,2)) AS dh, abs(pz+vz*t) AS dv FROM cc) SELECT a, b, round(t,4)+0.0 AS t, round(dh,2)+0.0 AS dh, round(dv,2)+0.0 AS dv FROM d WHERE dh<1000 AND dv<300"""),
    "asof_lookup": _with(_OBS, ", l AS (SELECT * FROM obs WHERE callsign=''), r AS (SELECT entity_id, ts, max(obs_id) AS seen FROM obs WHERE callsign<>'' GROUP BY 1,2) SELECT l.obs_id, r.seen AS asof_seen FROM l ASOF LEFT JOIN r ON l.entity_id=r.entity_id AND l.ts>=r.ts"),
    "recent_window": f"SELECT 'u' || user_id AS entity_id, count(*) AS n FROM events WHERE ts>={_NOW} - INTERVAL 1 DAY GROUP BY 1",
    "trail_slice": f"SELECT entity_id, obs_id FROM (SELECT 'u' || user_id AS entity_id, event_id AS obs_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts<={_NOW}) WHERE k<=5",
    "novelty_cap": "SELECT event_id AS obs_id, 'u' || user_id AS entity_id FROM events ORDER BY ts DESC, event_id LIMIT 500",
    "knn_top3": "WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda x: power(CAST(x[1] AS DOUBLE)-CAST(x[2] AS DOUBLE),2)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d,9), neighbour) AS k FROM d) SELECT vec_id, neighbour, CAST(k AS INT) AS rank, round(d,5)+0.0 AS distance FROM k WHERE k<=3",
    "sun_position": _with(_SUN, _AZEL),
    "moon_position": _with(_MOON, _AZEL),
    "sat_sunlit": _with(_SUN, """, u AS (SELECT event_id, de, radians(ra-gmst) AS sl, radians(CAST(event_id%160-80 AS DOUBLE)) AS la, radians(CAST(event_id*7%360-180 AS DOUBLE)) AS lo, 6378.137e0 AS a, (1/298.257223563e0)*(2-1/298.257223563e0) AS e2 FROM s2),
        v AS (SELECT *, a/sqrt(1-e2*sin(la)*sin(la)) AS n, a/sqrt(1-e2*sin(de)*sin(de)) AS m FROM u), x AS (SELECT event_id, (n+550)*cos(la)*cos(lo) AS px, (n+550)*cos(la)*sin(lo) AS py, (n*(1-e2)+550)*sin(la) AS pz, m*cos(de)*cos(sl) AS sx, m*cos(de)*sin(sl) AS sy, m*(1-e2)*sin(de) AS sz FROM v),
        y AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS k FROM x), z AS (SELECT *, (px*sx+py*sy+pz*sz)/k AS dot FROM y) SELECT event_id, dot>0 OR sqrt(px*px+py*py+pz*pz-dot*dot)>6371 AS sunlit FROM z"""),
    "daily_brief": _with(_SCORE, f""", w0 AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM obs GROUP BY 1), wr AS (SELECT start, ['clear','cloudy','fog','rain','snow','thunderstorm'][CAST(n%6+1 AS INT)] AS kind, n%6 AS k, sum(CASE WHEN n%6<2 THEN 1 ELSE 0 END) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM w0),
        ev AS (SELECT min(start) AS a, max(start) + INTERVAL 1 HOUR AS z, arg_min(kind, start) AS kind FROM wr WHERE k>=2 GROUP BY run)
        SELECT 'oakville_node' AS observer, (SELECT CAST(min(started) AS DATE) FROM trk) AS date, (SELECT count(DISTINCT entity_id) FROM trk) AS aircraft_observed, (SELECT count(*) FROM trk WHERE overhead) AS overhead_candidates, (SELECT count(*) FROM sc WHERE score>0.55) AS unusual_tracks,
        (SELECT string_agg(kind || ' ' || strftime(a,'%H:%M') || '–' || strftime(z,'%H:%M') || ' UTC', '; ' ORDER BY a) FROM ev) AS weather, (SELECT round(max(score),3)+0.0 FROM sc WHERE score>0.3) AS confidence"""),
    "graph_nodes": _with(_SCORE, f""", w0 AS (SELECT date_trunc('hour', ts) AS h FROM obs GROUP BY 1), th AS (SELECT unnest(generate_series(date_trunc('hour', started), ended, INTERVAL 1 HOUR)) AS h FROM trk)
        SELECT 'observer:oakville_node' AS id, 'Observer' AS label UNION ALL SELECT 'weather:' || strftime(h,'%Y-%m-%dT%H'), 'WeatherCell' FROM w0 UNION ALL SELECT DISTINCT 'window:' || strftime(h,'%Y-%m-%dT%H'), 'TimeWindow' FROM (SELECT h FROM w0 UNION SELECT h FROM th)
        UNION ALL SELECT DISTINCT 'aircraft:' || entity_id, 'Aircraft' FROM trk UNION ALL SELECT track_id, 'Track' FROM trk UNION ALL SELECT 'obs:' || track_id || ':' || r, 'Observation' FROM trk, (VALUES ('first'),('closest_approach'),('last')) v(r) UNION ALL SELECT 'anomaly:' || track_id, 'Anomaly' FROM sc WHERE score>0.30"""),
}
ORACLES["formation_pairs"] = f"WITH {_PLANT.strip()}, fp AS (SELECT * FROM pics WHERE entity_id LIKE 'u%'), {_FORM} SELECT a, b FROM fm"
ORACLES["survey_grid"] = f"WITH RECURSIVE {_PST.replace('SPAN', '1200').strip()}, {_LEGS} SELECT entity_id FROM gr"
ORACLES["behavior_badges"] = f"""WITH RECURSIVE {_PST.replace('SPAN', '1200').strip()}, {_LEGS}, fp AS (SELECT * FROM pics), {_FORM},
  ho AS (WITH st AS (SELECT * REPLACE (CASE WHEN lag(ts) OVER w >= {_NOW}-to_seconds(360) THEN d END AS d) FROM st WINDOW w AS (PARTITION BY entity_id ORDER BY ts, obs_id) QUALIFY ts >= {_NOW}-to_seconds(360)) {_HELD}),
  ga AS (WITH st AS (SELECT * FROM (SELECT * FROM pics WHERE ts >= {_NOW}-to_seconds(600))), {_AROUND}),
  flags AS (SELECT entity_id, entity_id IN (SELECT entity_id FROM ho) AS holding, entity_id IN (SELECT entity_id FROM gr) AND entity_id NOT IN (SELECT entity_id FROM ho) AS grid, entity_id IN (SELECT entity_id FROM ga) AS goaround, entity_id IN (SELECT a FROM fm UNION SELECT b FROM fm) AS formation FROM (SELECT DISTINCT entity_id FROM pics))
  SELECT entity_id, concat_ws(',', CASE WHEN holding THEN 'holding' END, CASE WHEN grid THEN 'grid' END, CASE WHEN goaround THEN 'goaround' END, CASE WHEN formation THEN 'formation' END) AS behaviors,
  concat_ws('·', CASE WHEN holding THEN 'HOLD' END, CASE WHEN grid THEN 'GRID' END, CASE WHEN goaround THEN 'G/A' END, CASE WHEN formation THEN 'FORM' END) AS badges FROM flags"""
ORACLES["predicted_paths"] = _with(_OBS, """, k AS (SELECT obs_id, k, lat, lon, alt_m, speed_mps, vertical_rate_mps, radians(track_deg+0.5e0*5*(k+1)) AS h FROM obs, range(18) r(k)),
  la AS (SELECT *, lat+sum(speed_mps*5*cos(h)/111132e0) OVER w AS la FROM k WINDOW w AS (PARTITION BY obs_id ORDER BY k))
  SELECT obs_id, CAST(k AS INT) AS k, round(la,7)+0.0 AS lat, round(lon+sum(speed_mps*5*sin(h)/(111320e0*cos(radians(la)))) OVER w,7)+0.0 AS lon, round(alt_m+vertical_rate_mps*5*(k+1),3)+0.0 AS alt_m FROM la WINDOW w AS (PARTITION BY obs_id ORDER BY k)""")
ORACLES["greedy_keep"] = """WITH RECURSIVE o AS (SELECT 'u' || user_id AS entity_id, event_id AS obs_id, epoch_us(ts)/1e6/86400 AS t FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t, obs_id) AS k FROM o),
  f AS (SELECT entity_id, k, obs_id, t AS last, true AS kept FROM n WHERE k=1 UNION ALL SELECT n.entity_id, n.k, n.obs_id, CASE WHEN n.t>f.last+0.5 THEN n.t ELSE f.last END, n.t>f.last+0.5 FROM f JOIN n ON n.entity_id=f.entity_id AND n.k=f.k+1)
  SELECT entity_id, count(*) AS n_kept, max(obs_id) AS last_id FROM f WHERE kept GROUP BY 1"""
_EDGES = """, wh AS (SELECT window_id, strftime(start, '%Y-%m-%dT%H') AS h FROM wx), th AS (SELECT track_id, strftime(unnest(generate_series(date_trunc('hour', started), ended, INTERVAL 1 HOUR)), '%Y-%m-%dT%H') AS h FROM emb),
  odd AS (SELECT track_id FROM sc WHERE score>0.30), fd AS (SELECT a.track_id AS a, b.track_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda x: power(CAST(x[1] AS DOUBLE)-CAST(x[2] AS DOUBLE),2)))),9) AS d FROM emb a JOIN emb b ON a.track_id<>b.track_id),
  n1 AS (SELECT a, b, d FROM fd QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b)=1), pr AS (SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b, min(d) AS d FROM n1 GROUP BY 1,2 ORDER BY d, a, b LIMIT 5),
  e AS (SELECT window_id AS src, 'window' AS dst, 'during' AS type FROM wh UNION ALL SELECT 'obs:' || track_id || ':' || r, 'track', 'part_of_track' FROM emb, (VALUES ('first'),('closest_approach'),('last')) v(r) UNION ALL SELECT track_id, 'aircraft', 'part_of_track' FROM emb
  UNION ALL SELECT track_id, 'observer', 'observed_by' FROM emb UNION ALL SELECT track_id, 'observer', 'near' FROM emb WHERE min_range_m<10000 UNION ALL SELECT track_id, 'window', 'during' FROM th
  UNION ALL SELECT track_id, 'weather', 'correlated_with' FROM emb JOIN wx ON wx.start<emb.ended AND wx."end">emb.started UNION ALL SELECT a, 'track', 'similar_to' FROM pr UNION ALL SELECT track_id, 'anomaly', 'correlated_with' FROM odd
  UNION ALL SELECT 'anomaly:' || o.track_id, 'track', 'anomalous_relative_to' FROM odd o WHERE EXISTS (SELECT 1 FROM d1 WHERE d1.track_id=o.track_id AND k=1))"""
ORACLES["graph_edges"] = f"WITH {_SCORE.strip()}{_WX.replace(_OBS, '')}{_EDGES} SELECT type, dst AS \"to\", count(*) AS n, count(DISTINCT src) AS sources FROM e GROUP BY 1, 2"
ORACLES["novelty_vectors"] = "WITH k AS (" + ORACLES["knn_top3"].replace("round(d,5)+0.0 AS distance", "d AS distance") + ") SELECT vec_id, round(least(avg(distance)/1.2e0,1),5)+0.0 AS novelty FROM k GROUP BY 1"
ORACLES["similar_pairs"] = "WITH k AS (" + ORACLES["knn_top3"].replace("round(d,5)+0.0 AS distance", "d AS distance") + ") SELECT least(vec_id,neighbour) AS a, greatest(vec_id,neighbour) AS b, round(min(distance),5)+0.0 AS distance FROM k WHERE rank=1 GROUP BY 1,2"

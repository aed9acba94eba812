"""The registered queries in plain SQL, for checking results on the same tables."""

from __future__ import annotations

from tagtrack import constants as K

# --- derived inputs -----------------------------------------------------------
_MSG = """
src AS (SELECT *, CAST(event_id%4+1 AS VARCHAR) AS k, CAST((event_id+1)%4+1 AS VARCHAR) AS k2,
  CAST(CAST(floor(value*10) AS INTEGER) AS VARCHAR) AS v, CAST(event_id//3 AS VARCHAR) AS cb,
  CAST(event_id*100 AS VARCHAR) AS ms FROM events),
messages_v AS (SELECT event_id, user_id AS tag_id, ts, '10.0.0.'||k AS source_ip, 4210 AS source_port,
  CASE event_id%10
   WHEN 0 THEN 'A'||k||'='||v||';A'||k2||'='||v
   WHEN 1 THEN 'A'||k||' D1='||v
   WHEN 2 THEN 'anchor='||k||',d1='||v
   WHEN 3 THEN 'anchor='||k||',valid=0,dist='||v
   WHEN 4 THEN 'UWB,session=0x100'||k||',src=0x1111,dst=0x2222,cb='||cb||',status=0,lastDist='||v||',d1='||v||',ms='||ms
   WHEN 5 THEN 'UWB,session=0x100'||k||',src=0x1111,dst=0x2222,cb='||cb||',status=4,lastDist=65535,d1=-1,ms='||ms
   WHEN 6 THEN 'id='||k||' range='||v||',5 event=calib'
   WHEN 7 THEN 'dist'||k||': '||v||',5 type=probe'
   WHEN 8 THEN 'heartbeat'
   ELSE 'UWB,session=0x100'||k||',src=0x1111,cb='||cb END AS message FROM src)"""
_KV = _MSG + f""",
kv0 AS (SELECT event_id, unnest(regexp_extract_all(message, '{K.KEY_VALUE}', 1)) AS k,
  unnest(regexp_extract_all(message, '{K.KEY_VALUE}', 2)) AS v,
  unnest(range(len(regexp_extract_all(message, '{K.KEY_VALUE}', 1)))) AS pos FROM messages_v),
kv AS (SELECT event_id, lower(k) AS k, arg_max(v, pos) AS v FROM kv0 GROUP BY 1, 2),
fm AS (SELECT event_id, max(v) FILTER (k='anchor') AS anchor, max(v) FILTER (k='id') AS id, max(v) FILTER (k='a') AS a,
  max(v) FILTER (k='valid') AS valid, max(v) FILTER (k='d1') AS d1, max(v) FILTER (k='dist') AS dist,
  max(v) FILTER (k='distance') AS distance, max(v) FILTER (k='range') AS rng, max(v) FILTER (k='r') AS r,
  max(v) FILTER (k='event') AS event, max(v) FILTER (k='type') AS type FROM kv GROUP BY 1)"""


def _form(n: int, pattern: str) -> str:
    return f"""SELECT event_id, {n} AS form, unnest(range(len(regexp_extract_all(upper(message), '{pattern}', 1)))) AS pos,
  CAST(unnest(regexp_extract_all(upper(message), '{pattern}', 1)) AS BIGINT) AS anchor_id,
  CAST(replace(unnest(regexp_extract_all(upper(message), '{pattern}', 2)), ',', '.') AS DOUBLE) AS d FROM messages_v"""


_RNG = _KV + f""",
forms AS (
 SELECT event_id, 0 AS form, 0 AS pos, TRY_CAST(coalesce(anchor, id, a) AS BIGINT) AS anchor_id,
  coalesce(TRY_CAST(d1 AS DOUBLE), TRY_CAST(dist AS DOUBLE), TRY_CAST(distance AS DOUBLE), TRY_CAST(rng AS DOUBLE),
   TRY_CAST(r AS DOUBLE)) AS d
 FROM fm WHERE lower(coalesce(valid, '1')) NOT IN ('0','false','off','ko','invalid','none','nan')
 UNION ALL {_form(1, K.ANCHOR_D1)} UNION ALL {_form(2, K.ANCHOR_INDEXED)}
 UNION ALL {_form(3, K.D_INDEXED)} UNION ALL {_form(4, K.WORD_INDEXED)}),
parsed AS (SELECT event_id, anchor_id, arg_max(d, form*1000+pos) AS distance_cm FROM forms
 WHERE anchor_id IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2)"""
_TEL = _MSG + """,
tel AS (SELECT event_id, tag_id, ts, message, regexp_extract(message, ',session=([^,]*)', 1) AS session,
  regexp_extract(message, ',src=([^,]*)', 1) AS src, regexp_extract(message, ',dst=([^,]*)', 1) AS dst,
  TRY_CAST(regexp_extract(message, ',cb=([^,]*)', 1) AS BIGINT) AS cb,
  TRY_CAST(regexp_extract(message, ',status=([^,]*)', 1) AS INTEGER) AS status,
  TRY_CAST(regexp_extract(message, ',lastDist=([^,]*)', 1) AS INTEGER) AS last0,
  TRY_CAST(regexp_extract(message, ',d1=([^,]*)', 1) AS INTEGER) AS d0,
  TRY_CAST(regexp_extract(message, ',ms=([^,]*)', 1) AS BIGINT) AS ms FROM messages_v),
telemetry AS (SELECT *, nullif(last0, 65535) AS last_dist, CASE WHEN d0 >= 0 THEN d0 END AS d1 FROM tel
  WHERE starts_with(message, 'UWB,') AND session<>'' AND src<>'' AND dst<>'' AND cb IS NOT NULL AND status IS NOT NULL
   AND last0 IS NOT NULL AND d0 IS NOT NULL AND ms IS NOT NULL)"""
_TRUTH = """
seqd AS (SELECT event_id, user_id AS tag_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq,
  value FROM events),
truth_v AS (SELECT event_id, tag_id, seq, seq*0.05::DOUBLE AS t, 1250::DOUBLE+1300::DOUBLE*sin(0.05::DOUBLE*seq+tag_id) AS x,
  900::DOUBLE+650::DOUBLE*cos(0.031::DOUBLE*seq+tag_id) AS y,
  95::DOUBLE+CASE WHEN seq%20 IN (10,11,12) THEN 60::DOUBLE ELSE 0::DOUBLE END AS z FROM seqd)"""
_ANCHORS = """
anchors AS (SELECT * FROM (VALUES (1,-250::DOUBLE,-150::DOUBLE,600::DOUBLE),(2,2750::DOUBLE,-150::DOUBLE,600::DOUBLE),
  (3,2750::DOUBLE,1950::DOUBLE,600::DOUBLE),(4,-250::DOUBLE,1950::DOUBLE,600::DOUBLE)) AS v(anchor_id,ax,ay,az))"""
_RANGES = _TRUTH + "," + _ANCHORS + """,
ranges_v AS (SELECT event_id, tag_id, t, anchor_id, ax, ay, x AS tx, y AS ty,
  sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)) + ((event_id*7+anchor_id*13)%37-18) AS r,
  sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)) + ((event_id*7+anchor_id*13)%37-18) AS r3
  FROM truth_v CROSS JOIN anchors WHERE (event_id+anchor_id)%29 <> 0),
ticks AS (SELECT tag_id, t, max(r) FILTER (anchor_id=1) AS d1, max(r) FILTER (anchor_id=2) AS d2,
  max(r) FILTER (anchor_id=3) AS d3, max(r) FILTER (anchor_id=4) AS d4 FROM ranges_v GROUP BY 1, 2),
tickd AS (SELECT *, t - lag(t) OVER (PARTITION BY tag_id ORDER BY t) AS dt FROM ticks)"""


def _solve(name: str, source: str, x: str = "x", y: str = "y") -> str:
    """Normal-equation solution of (tag_id, t, anchor_id, r) rows, complete ticks only."""
    return f"""
{name}_r AS (SELECT s.tag_id, s.t, s.anchor_id, s.r, a.ax, a.ay, first_value(a.ax) OVER w AS rx, first_value(a.ay) OVER w AS ry,
  first_value(s.r) OVER w AS rr, count(*) OVER (PARTITION BY s.tag_id, s.t) AS n
  FROM {source} s JOIN anchors a USING (anchor_id) WHERE s.r IS NOT NULL
  WINDOW w AS (PARTITION BY s.tag_id, s.t ORDER BY s.anchor_id)),
{name}_l AS (SELECT *, 2*(ax-rx) AS a, 2*(ay-ry) AS b, rr*rr-r*r-rx*rx+ax*ax-ry*ry+ay*ay AS c FROM {name}_r WHERE n=4),
{name}_n AS (SELECT tag_id, t, sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*c) ac, sum(b*c) bc FROM {name}_l GROUP BY 1, 2),
{name} AS (SELECT tag_id, t, (ac*bb-bc*ab)/(aa*bb-ab*ab) AS {x}, (aa*bc-ab*ac)/(aa*bb-ab*ab) AS {y} FROM {name}_n
  WHERE abs(aa*bb-ab*ab) >= 1e-9)"""


_POS = _RANGES + "," + _solve("pos2d", "ranges_v")


def _ema(name: str, source: str, keys: str, value: str, alpha: float) -> str:
    """Closed-form smoothing of the non-NULL values of (keys, t, dt, value)."""
    lam = f"(-60*ln(1-{alpha}::DOUBLE))"
    return f"""
{name}_t AS (SELECT {keys}, t, dt, {value} AS v, row_number() OVER w AS rn, sum(coalesce(dt, 0)) OVER w AS tau
  FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
{name} AS (SELECT {keys}, t, exp(-{lam}*tau) * sum((CASE WHEN rn=1 THEN 1 ELSE 1-exp(-{lam}*dt) END)*v*exp({lam}*tau))
  OVER (PARTITION BY {keys} ORDER BY t) AS s FROM {name}_t)"""


def _ema_ticks(value: str = "r", source: str = "ranges_v", alpha: float = 0.12) -> str:
    """Smoothed distances per anchor, carried over every tick: sm(tag_id, t, dt, anchor_id, s)."""
    return (
        f"""
fed AS (SELECT g.tag_id, g.t, d.dt, g.anchor_id, g.{value} AS r FROM {source} g JOIN tickd d USING (tag_id, t)),"""
        + _ema("em", "fed", "tag_id, anchor_id", "r", alpha)
        + """,
sm AS (SELECT k.tag_id, k.t, k.dt, a.anchor_id, last_value(e.s IGNORE NULLS) OVER (PARTITION BY k.tag_id, a.anchor_id ORDER BY k.t
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM tickd k CROSS JOIN anchors a LEFT JOIN em e ON e.tag_id=k.tag_id AND e.t=k.t AND e.anchor_id=a.anchor_id)"""
    )


def _held(value: str = "r") -> str:
    """Arrivals held for at most two seconds on the arrival ticks: held(tag_id, t, anchor_id, r)."""
    return f"""
held0 AS (SELECT k.tag_id, k.t, a.anchor_id, last_value(g.{value} IGNORE NULLS) OVER w AS r,
  last_value(g.t IGNORE NULLS) OVER w AS got_t FROM tickd k CROSS JOIN anchors a
  LEFT JOIN ranges_v g ON g.tag_id=k.tag_id AND g.t=k.t AND g.anchor_id=a.anchor_id
  WINDOW w AS (PARTITION BY k.tag_id, a.anchor_id ORDER BY k.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
held AS (SELECT tag_id, t, anchor_id, r FROM held0 WHERE t - got_t <= 2.0)"""


def _located(value: str) -> str:
    """Raw and doubly smoothed planar solution on every arrival tick: loc(...)."""
    return (
        _held(value)
        + ","
        + _solve("raw", "held", "x_raw", "y_raw")
        + ","
        + _ema_ticks(value)
        + ","
        + _solve("fine", "sm", "xs", "ys")
        + """,
aim AS (SELECT k.tag_id, k.t, k.dt, f.xs, f.ys FROM tickd k LEFT JOIN fine f USING (tag_id, t)),"""
        + _ema("ex", "aim", "tag_id", "xs", 0.10)
        + ","
        + _ema("ey", "aim", "tag_id", "ys", 0.10)
        + """,
loc AS (SELECT k.tag_id, k.t, raw.x_raw, raw.y_raw,
  last_value(ex.s IGNORE NULLS) OVER w AS x, last_value(ey.s IGNORE NULLS) OVER w AS y FROM tickd k
  LEFT JOIN raw USING (tag_id, t) LEFT JOIN ex USING (tag_id, t) LEFT JOIN ey USING (tag_id, t)
  WINDOW w AS (PARTITION BY k.tag_id ORDER BY k.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    )


_FRAMES = _RANGES + """,
span AS (SELECT tag_id, CAST(ceil(min(t)*8) AS BIGINT) AS i, CAST(floor((max(t)+2.0)*8) AS BIGINT) AS j FROM ranges_v GROUP BY 1),
frames AS (SELECT tag_id, unnest(range(i, j+1)) AS tick FROM span),
frame_anchor AS (SELECT tag_id, tick, tick/8::DOUBLE AS t, anchor_id FROM frames CROSS JOIN anchors),
near AS (SELECT f.tag_id, f.tick, f.t, f.anchor_id, g.r, f.t - g.t AS age FROM frame_anchor f
  ASOF LEFT JOIN ranges_v g ON f.tag_id=g.tag_id AND f.anchor_id=g.anchor_id AND f.t >= g.t)"""
_SEG = """
seg AS (SELECT tag_id, t, x, y, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)) AS step_cm
  FROM {src} WINDOW w AS (PARTITION BY tag_id ORDER BY t))"""
_HEAT = _POS + """,
cells AS (SELECT tag_id, t, least(greatest(CAST(floor((y-150::DOUBLE)/1500::DOUBLE*60) AS INTEGER),0),59) AS "row",
  least(greatest(CAST(floor((x+150::DOUBLE)/2800::DOUBLE*112) AS INTEGER),0),111) AS col FROM pos2d
  WHERE x BETWEEN -150 AND 2650 AND y BETWEEN 150 AND 1650),
heat AS (SELECT tag_id, "row", col, count(*) AS hits FROM cells GROUP BY 1, 2, 3),
offs AS (SELECT dy, dx, 1::DOUBLE/(1+dx*dx+dy*dy) AS w FROM range(-3,4) a(dy) CROSS JOIN range(-3,4) b(dx)),
grid AS (SELECT r."row", c.col FROM range(0,60) r("row") CROSS JOIN range(0,112) c(col)),
weights AS (SELECT g."row", g.col, sum(o.w) AS ws FROM grid g CROSS JOIN offs o
  WHERE g."row"+o.dy BETWEEN 0 AND 59 AND g.col+o.dx BETWEEN 0 AND 111 GROUP BY 1, 2),
kern AS (SELECT h.tag_id, h."row"+o.dy AS "row", h.col+o.dx AS col, sum(h.hits*o.w) AS weighted FROM heat h CROSS JOIN offs o
  WHERE h."row"+o.dy BETWEEN 0 AND 59 AND h.col+o.dx BETWEEN 0 AND 111 GROUP BY 1, 2, 3),
allk AS (SELECT "row", col, sum(weighted) AS weighted FROM kern GROUP BY 1, 2)"""


def _r(expr: str, n: int, name: str) -> str:
    return f"round({expr}, {n}) + 0 AS {name}"


_T = "round(t, 4) + 0 AS t"
_RAMP = f"""CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col,
 CASE WHEN ratio <= 0.5 THEN CAST(trunc(40+215*(ratio*2)) AS INTEGER) ELSE 255 END AS r,
 CASE WHEN ratio <= 0.5 THEN CAST(trunc(170+55*(1-ratio*2)) AS INTEGER) ELSE CAST(trunc(170*(1-(ratio-0.5)*2)) AS INTEGER) END AS g,
 {_r('CASE WHEN ratio <= 0.5 THEN 30.0::DOUBLE ELSE 30*(1-(ratio-0.5)*2) END', 3, 'b')},
 CAST(56+trunc(110*ratio) AS INTEGER) AS a FROM q"""
_HOPS = _TRUTH + ", hops AS (SELECT tag_id, t, x, y, greatest(0, z-95) AS jump FROM truth_v)," + _SEG.format(src="hops")
_RISE = """, rise AS (SELECT *, jump >= 12 AND NOT coalesce(lag(jump >= 12) OVER (PARTITION BY tag_id ORDER BY t), false) AS up FROM hops)"""
_SCORED = (
    _POS
    + ", p AS (SELECT tag_id, t, 0.05::DOUBLE AS dt, x, y FROM pos2d),"
    + _ema("ex", "p", "tag_id", "x", 0.10) + "," + _ema("ey", "p", "tag_id", "y", 0.10)
    + """, sc0 AS (SELECT p.tag_id, p.t, sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)) AS raw_err,
  sqrt((v.x-ex.s)*(v.x-ex.s)+(v.y-ey.s)*(v.y-ey.s)) AS smooth_err FROM p JOIN truth_v v USING (tag_id, t)
  JOIN ex USING (tag_id, t) JOIN ey USING (tag_id, t)),
sc AS (SELECT *, least(greatest(100*(1-raw_err/100),0),100) AS raw_precision,
  least(greatest(100*(1-smooth_err/100),0),100) AS smooth_precision FROM sc0)"""
)
_AVG3 = (
    "err3d", "errxy", "errz", "precision", "delay_total_s", "measured_delay", "traj_err_3d", "traj_err_xy", "traj_err_z", "traj_precision",
)
_AVG2 = ("raw_err", "smooth_err", "raw_precision", "smooth_precision")


def _card(src: str, jumps: str, extra: str = "") -> str:
    return f"""SELECT tag_id, count(*) AS samples, {_r('max(t)', 4, 'time_s')}, {_r('coalesce(sum(step_cm),0)/100', 4, 'distance_m')},
  {_r('coalesce(sum(step_cm),0)/max(t)*0.036', 4, 'avg_speed_kmh')},
  {_r('coalesce(max(step_cm/0.05),0)*0.036', 4, 'max_speed_kmh')}{extra}, {jumps} FROM {src} GROUP BY 1"""


def _at(delay: str, history: int) -> str:
    """True position `delay` before each complete tick: past(tag_id, t, at_x, at_y, at_z)."""
    ax = ", ".join(
        f"CASE WHEN c.tau < c.ot THEN c.o{a} WHEN b.nt > b.t THEN b.{a} + (b.n{a}-b.{a})*((c.tau-b.t)/(b.nt-b.t)) ELSE b.{a} END AS at_{a}"
        for a in "xyz"
    )
    return f"""
brk AS (SELECT tag_id, t, x, y, z, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz,
  first_value(t) OVER h AS ot, first_value(x) OVER h AS ox, first_value(y) OVER h AS oy, first_value(z) OVER h AS oz
  FROM truth_v WINDOW w AS (PARTITION BY tag_id ORDER BY t),
  h AS (PARTITION BY tag_id ORDER BY t ROWS BETWEEN {history - 1} PRECEDING AND CURRENT ROW)),
aims AS (SELECT p.tag_id, p.t, p.t - {delay} AS tau, k.ot, k.ox, k.oy, k.oz FROM {{src}} p JOIN brk k USING (tag_id, t)),
past AS (SELECT c.tag_id, c.t, {ax} FROM aims c ASOF LEFT JOIN brk b ON c.tag_id=b.tag_id AND c.tau >= b.t)"""


_BEST = """
est AS (SELECT k.tag_id, k.t, p.x, p.y, 95::DOUBLE AS z FROM ticks k LEFT JOIN pos2d p USING (tag_id, t)),
hist AS (SELECT tag_id, t, x, y, z, row_number() OVER (PARTITION BY tag_id ORDER BY t) AS idx FROM est),
seen AS (SELECT h.tag_id, h.t, v.t AS st, h.t - v.t AS delay,
  sqrt((v.x-h.x)*(v.x-h.x)+(v.y-h.y)*(v.y-h.y)+(v.z-h.z)*(v.z-h.z)) AS err
  FROM hist h JOIN truth_v v ON v.tag_id=h.tag_id AND v.t <= h.t AND h.t - v.t <= 1.2 WHERE h.x IS NOT NULL AND h.idx >= 2),
best AS (SELECT tag_id, t, arg_min(delay, (err, -st)) AS measured_delay, min(err) AS delay_err FROM seen GROUP BY 1, 2)"""
_WIDE3 = """
wide3 AS (SELECT tag_id, t, max(r3) FILTER (anchor_id=1) AS d1, max(r3) FILTER (anchor_id=2) AS d2,
  max(r3) FILTER (anchor_id=3) AS d3, max(r3) FILTER (anchor_id=4) AS d4 FROM ranges_v GROUP BY 1, 2 HAVING count(*)=4)"""
_FLAT = """
flat AS (SELECT tag_id, t, anchor_id, sqrt(greatest(0, r3*r3-505::DOUBLE*505)) AS r FROM ranges_v)"""


def _newton(src: str) -> str:
    """One damped step of every row of ``src``: adds the clipped point nx, ny, nz, the step s* and the starting error e."""
    return f"""(
  SELECT *, least(greatest(x+sx,-450),2950) AS nx, least(greatest(y+sy,-350),2150) AS ny, least(greatest(z+sz,0),580) AS nz FROM (
  SELECT *, (v0*(m11*m22-m12*m12)-m01*(v1*m22-m12*v2)+m02*(v1*m12-m11*v2))/det AS sx,
   (m00*(v1*m22-m12*v2)-v0*(m01*m22-m12*m02)+m02*(m01*v2-v1*m02))/det AS sy,
   (m00*(m11*v2-v1*m12)-m01*(m01*v2-v1*m02)+v0*(m01*m12-m11*m02))/det AS sz FROM (
  SELECT *, m00*(m11*m22-m12*m12)-m01*(m01*m22-m12*m02)+m02*(m01*m12-m11*m02) AS det FROM (
  SELECT *, (abs(p1-d1)+abs(p2-d2)+abs(p3-d3)+abs(p4-d4))/4 AS e,
   35+x1*x1+x2*x2+x3*x3+x4*x4 AS m00, x1*y1+x2*y2+x3*y3+x4*y4 AS m01, x1*z1+x2*z2+x3*z3+x4*z4 AS m02,
   35+y1*y1+y2*y2+y3*y3+y4*y4 AS m11, y1*z1+y2*z2+y3*z3+y4*z4 AS m12, 35+z1*z1+z2*z2+z3*z3+z4*z4 AS m22,
   -(x1*(p1-d1)+x2*(p2-d2)+x3*(p3-d3)+x4*(p4-d4)) AS v0, -(y1*(p1-d1)+y2*(p2-d2)+y3*(p3-d3)+y4*(p4-d4)) AS v1,
   -(z1*(p1-d1)+z2*(p2-d2)+z3*(p3-d3)+z4*(p4-d4)) AS v2 FROM (
  SELECT *, (x+250)/p1 AS x1, (x-2750)/p2 AS x2, (x-2750)/p3 AS x3, (x+250)/p4 AS x4, (y+150)/p1 AS y1, (y+150)/p2 AS y2,
   (y-1950)/p3 AS y3, (y-1950)/p4 AS y4, (z-600)/p1 AS z1, (z-600)/p2 AS z2, (z-600)/p3 AS z3, (z-600)/p4 AS z4 FROM (
  SELECT *, sqrt((x+250)*(x+250)+(y+150)*(y+150)+(z-600)*(z-600)) AS p1, sqrt((x-2750)*(x-2750)+(y+150)*(y+150)+(z-600)*(z-600)) AS p2,
   sqrt((x-2750)*(x-2750)+(y-1950)*(y-1950)+(z-600)*(z-600)) AS p3, sqrt((x+250)*(x+250)+(y-1950)*(y-1950)+(z-600)*(z-600)) AS p4
  FROM {src}))))))"""


# independent solves of wide3 from seed(tag_id, t, x, y, z)
_STEP = f"""
it(k, tag_id, t, d1, d2, d3, d4, x, y, z, qx, qy, qz, qe, live) AS (
 SELECT 0, w.tag_id, w.t, d1, d2, d3, d4, s.x, s.y, s.z, s.x, s.y, s.z, 1e300::DOUBLE, true
 FROM wide3 w JOIN seed s USING (tag_id, t)
 UNION ALL
 SELECT k+1, tag_id, t, d1, d2, d3, d4, nx, ny, nz, CASE WHEN e < qe THEN nx ELSE qx END, CASE WHEN e < qe THEN ny ELSE qy END,
  CASE WHEN e < qe THEN nz ELSE qz END, least(e, qe), sqrt(sx*sx+sy*sy+sz*sz) >= 0.01
 FROM {_newton('it WHERE live AND k < 18')}),
solved AS (SELECT tag_id, t, qx, qy, qz FROM it QUALIFY row_number() OVER (PARTITION BY tag_id, t ORDER BY k DESC) = 1)"""
_MIX = "CASE WHEN NOT full4 THEN h{a} WHEN h{a} IS NULL THEN q{a} ELSE 0.08*q{a}+(1-0.08::DOUBLE)*h{a} END"
# the smoothed track: a row either takes a step or, when done, moves to the next tick of its tag
_TRACK = (
    """
fed3 AS (SELECT tag_id, t, anchor_id, 1/60::DOUBLE AS dt, r3 AS r FROM ranges_v),"""
    + _ema("em3", "fed3", "tag_id, anchor_id", "r", 0.12)
    + f""",
sm3 AS (SELECT k.tag_id, k.t, a.anchor_id, last_value(e.s IGNORE NULLS) OVER (PARTITION BY k.tag_id, a.anchor_id ORDER BY k.t
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM tickd k CROSS JOIN anchors a LEFT JOIN em3 e ON e.tag_id=k.tag_id AND e.t=k.t AND e.anchor_id=a.anchor_id),
sw AS MATERIALIZED (SELECT tag_id, t, row_number() OVER (PARTITION BY tag_id ORDER BY t) AS idx, max(r) FILTER (anchor_id=1) AS d1,
  max(r) FILTER (anchor_id=2) AS d2, max(r) FILTER (anchor_id=3) AS d3, max(r) FILTER (anchor_id=4) AS d4,
  count(r)=4 AS full4 FROM sm3 GROUP BY 1, 2),
trk(tag_id, idx, k, d1, d2, d3, d4, full4, x, y, z, qx, qy, qz, qe, live, hx, hy, hz) AS (
 SELECT tag_id, idx, 0, d1, d2, d3, d4, full4, 1250::DOUBLE, 900::DOUBLE, 95::DOUBLE, 1250::DOUBLE, 900::DOUBLE, 95::DOUBLE, 1e300::DOUBLE,
  full4, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM sw WHERE idx = 1
 UNION ALL
 SELECT n.tag_id, CASE WHEN step THEN n.idx ELSE s.idx END, CASE WHEN step THEN k+1 ELSE 0 END,
  CASE WHEN step THEN n.d1 ELSE s.d1 END, CASE WHEN step THEN n.d2 ELSE s.d2 END, CASE WHEN step THEN n.d3 ELSE s.d3 END,
  CASE WHEN step THEN n.d4 ELSE s.d4 END, CASE WHEN step THEN n.full4 ELSE s.full4 END,
  CASE WHEN step THEN nx ELSE coalesce(gx, 1250) END, CASE WHEN step THEN ny ELSE coalesce(gy, 900) END,
  CASE WHEN step THEN nz ELSE coalesce(gz, 95) END,
  CASE WHEN NOT step THEN coalesce(gx, 1250) WHEN e < qe THEN nx ELSE qx END, CASE WHEN NOT step THEN coalesce(gy, 900) WHEN e < qe THEN ny ELSE qy END,
  CASE WHEN NOT step THEN coalesce(gz, 95) WHEN e < qe THEN nz ELSE qz END, CASE WHEN NOT step THEN 1e300::DOUBLE ELSE least(e, qe) END,
  CASE WHEN step THEN sqrt(sx*sx+sy*sy+sz*sz) >= 0.01 ELSE s.full4 END,
  CASE WHEN step THEN hx ELSE gx END, CASE WHEN step THEN hy ELSE gy END, CASE WHEN step THEN hz ELSE gz END
 FROM (SELECT *, live AND k < 18 AS step, {_MIX.format(a='x')} AS gx, {_MIX.format(a='y')} AS gy, {_MIX.format(a='z')} AS gz
  FROM {_newton('trk')}) n LEFT JOIN sw s ON s.tag_id=n.tag_id AND s.idx=n.idx+1 WHERE step OR s.idx IS NOT NULL),
fin AS (SELECT w.tag_id, w.t, hx, hy, hz, {_MIX.format(a='x').replace('full4', 'w.full4')} AS x, {_MIX.format(a='y').replace('full4', 'w.full4')} AS y,
  {_MIX.format(a='z').replace('full4', 'w.full4')} AS z FROM trk JOIN sw w USING (tag_id, idx) WHERE NOT (live AND k < 18)),
seed AS (SELECT tag_id, t, coalesce(hx, 1250) AS x, coalesce(hy, 900) AS y, coalesce(hz, 95) AS z FROM fin)"""
)
_ZONE = """CASE WHEN NOT (x BETWEEN -150 AND 2650 AND y BETWEEN 150 AND 1650) THEN 'out' WHEN hoop <= 125 THEN 'restricted'
  WHEN fe <= 580 AND side <= 245 THEN 'paint' WHEN sqrt((fe-580)*(fe-580)+side*side) <= 180 AND fe > 580 THEN 'free_throw'
  WHEN sqrt((x-1250)*(x-1250)+(y-900)*(y-900)) <= 180 THEN 'centre_circle'
  WHEN (fe <= 157.5 AND side <= 660) OR (fe > 157.5 AND hoop <= 675) THEN 'two_point' ELSE 'three_point' END"""
_HOOP = """
hp AS (SELECT *, least(sqrt((x-7.5)*(x-7.5)+(y-900)*(y-900)), sqrt((x-2492.5)*(x-2492.5)+(y-900)*(y-900))) AS hoop,
  least(x+150, 2650-x) AS fe, abs(y-900) AS side FROM pos2d)"""
_LAYOUT_ROWS = ",".join(
    f"({n}, '{name}', {a}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)"
    for n, (name, anchors) in K.LAYOUTS_3D.items()
    for a, (x, y, z) in anchors.items()
)


def _sweep_part(alpha: float, tol: float, shift: str, x1: float) -> str:
    return f"""SELECT {alpha}::DOUBLE AS alpha, {tol}::DOUBLE AS tolerance_cm, '{shift}' AS anchor_shift, count(*) AS n,
  {_r('avg(err)', 3, 'avg_err')}, {_r(f'avg(least(greatest(100*(1-err/{tol}),0),100))', 3, 'avg_precision')}
  FROM (SELECT sqrt((v.x-f.x)*(v.x-f.x)+(v.y-f.y)*(v.y-f.y)) AS err FROM f_{str(alpha)[2:]}_{int(x1)} f JOIN truth_v v USING (tag_id, t))"""


def _sweep() -> str:
    ctes = [_RANGES]
    for alpha in (0.12, 0.5):
        tag = str(alpha)[2:]
        body = _ema_ticks(alpha=alpha)
        for cte in ("fed", "em_t", "em", "sm"):
            body = body.replace(f"\n{cte} AS", f"\n{cte}{tag} AS").replace(f"FROM {cte}\n", f"FROM {cte}{tag}\n")
        body = body.replace("FROM em_t)", f"FROM em_t{tag})").replace("JOIN em e", f"JOIN em{tag} e").replace(
            "FROM fed WHERE", f"FROM fed{tag} WHERE"
        )
        ctes.append(body)
        for shift, name in ((0, "0"), (50, "50")):
            moved = _solve(f"f_{tag}_{name}", f"sm{tag}").replace("JOIN anchors a", f"JOIN anchors{name} a")
            ctes.append(moved)
    moved_anchors = "".join(
        f", anchors{s} AS (SELECT anchor_id, CASE WHEN anchor_id=1 THEN ax+{s} ELSE ax END AS ax, ay FROM anchors)" for s in (0, 50)
    )
    head = ctes[0] + moved_anchors
    parts = [
        _sweep_part(al, tol, shift, x1)
        for al in (0.12, 0.5) for tol in (100.0, 200.0) for shift, x1 in (("none", 0), ("a1_x+50", 50))
    ]
    return "WITH " + head + "," + ",".join(ctes[1:]) + " " + " UNION ALL ".join(parts)


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


_RUN2 = ", ".join(_r(f"avg({c}) OVER w", 3, f"avg_{c}") for c in _AVG2)
_FIN2 = ", ".join(_r(f"avg({c})", 3, f"avg_{c}") for c in _AVG2)
_SET = """
doc AS (SELECT event_id, event_id%3 AS ver, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, round(value/50, 4) AS a,
  event_type='error' AS bad FROM events)"""

ORACLES: dict[str, str] = {
    "parse_fields": _with(_KV, "SELECT event_id, k, v FROM kv"),
    "parse_ranges": _with(_RNG, "SELECT event_id, anchor_id, distance_cm FROM parsed"),
    "parse_ranges_session": _with(
        _RNG + "," + _TEL.replace(_MSG + ",", ""),
        """SELECT event_id, anchor_id, distance_cm FROM parsed WHERE event_id NOT IN (SELECT event_id FROM telemetry)
 UNION ALL SELECT event_id, CAST(right(session, 1) AS INTEGER), CAST(d1 AS DOUBLE) FROM telemetry
 WHERE session IN ('0x1001','0x1002','0x1003','0x1004') AND d1 IS NOT NULL""",
    ),
    "event_label": _with(
        _KV, "SELECT m.event_id, upper(coalesce(fm.event, fm.type, 'DISTANCE')) AS event FROM messages_v m LEFT JOIN fm USING (event_id)"
    ),
    "fields_json": _with(
        _KV,
        """SELECT m.event_id, '{' || coalesce(string_agg('"'||k||'":"'||v||'"', ',' ORDER BY k), '') || '}' AS fields_json
 FROM messages_v m LEFT JOIN kv USING (event_id) GROUP BY 1""",
    ),
    "ranges_log": _with(
        _RNG,
        """, js AS (SELECT event_id, '{' || string_agg('"'||k||'":"'||v||'"', ',' ORDER BY k) || '}' AS fields_json FROM kv GROUP BY 1)
 SELECT strftime(m.ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(m.ts)//1000)%1000 AS VARCHAR), 3, '0') AS timestamp_iso,
  epoch_us(m.ts)/1e6 AS timestamp_s, m.source_ip, m.source_port, upper(coalesce(fm.event, fm.type, 'DISTANCE')) AS event,
  p.anchor_id, p.distance_cm, m.message AS raw_message, js.fields_json
 FROM parsed p JOIN messages_v m USING (event_id) LEFT JOIN fm USING (event_id) LEFT JOIN js USING (event_id)""",
    ),
    "rows_written": _with(_RNG, 'SELECT m.source_ip, count(*) AS "rows" FROM parsed p JOIN messages_v m USING (event_id) GROUP BY 1'),
    "bounded_capture": _with(
        _RNG,
        """SELECT p.anchor_id, count(*) AS n, min(p.event_id) AS first_event, max(p.event_id) AS last_event FROM parsed p
 JOIN messages_v m USING (event_id) WHERE m.ts >= TIMESTAMP '2024-01-03' AND m.ts < TIMESTAMP '2024-01-08' GROUP BY 1""",
    ),
    "message_counts": _with(_MSG, "SELECT tag_id, count(*) AS packet_count, arg_max(message, event_id) AS last_message FROM messages_v GROUP BY 1"),
    "telemetry_valid": _with(_TEL, "SELECT event_id, session, src, dst, cb, status, last_dist, d1, ms FROM telemetry"),
    "telemetry_rejects": _with(_TEL, "SELECT event_id, message FROM messages_v WHERE event_id NOT IN (SELECT event_id FROM telemetry)"),
    "sentinel_clean": _with(
        _TEL,
        """SELECT status=0 AND last_dist IS NOT NULL AS measured, count(*) AS n, count(d1) AS n_d1,
 CAST(sum(last_dist) AS BIGINT) AS sum_last_dist FROM telemetry GROUP BY 1""",
    ),
    "failed_share": _with(
        _TEL,
        f"""SELECT session, count(*) AS lines,
 {_r('avg(CASE WHEN status=0 AND last_dist IS NOT NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)', 6, 'failed_share')} FROM telemetry GROUP BY 1""",
    ),
    "session_anchor_map": _with(
        _TEL,
        """SELECT event_id, session, CASE session WHEN '0x1001' THEN 1 WHEN '0x1002' THEN 2 WHEN '0x1003' THEN 3 WHEN '0x1004' THEN 4 END
 AS anchor_id, CASE session WHEN '0x1001' THEN '0x1111' WHEN '0x1002' THEN '0x3333' WHEN '0x1003' THEN '0x4444'
 WHEN '0x1004' THEN '0x5555' END AS address FROM telemetry""",
    ),
    "response_rate": _with(
        _TEL,
        f""", steps AS (SELECT *, cb - lag(cb) OVER (PARTITION BY tag_id, session, src ORDER BY ms) AS step FROM telemetry)
 SELECT tag_id, session, src, ms//60000*60000 AS window_ms, count(*) AS lines, count(*) FILTER (step < 0) AS restarts,
 {_r('sum(CASE WHEN step < 0 THEN cb ELSE step END)/600.0::DOUBLE', 6, 'rate')} FROM steps GROUP BY 1, 2, 3, 4""",
    ),
    "stale_anchors": _with(
        _TEL,
        f"""SELECT tag_id, {_r("(epoch_us(TIMESTAMP '2024-01-30 23:00:00')-epoch_us(max(ts)))/1000.0::DOUBLE", 3, 'age_ms')},
 (epoch_us(TIMESTAMP '2024-01-30 23:00:00')-epoch_us(max(ts)))/1000.0::DOUBLE > 1500 AS stale FROM telemetry GROUP BY 1""",
    ),
    "repeat_suppress": _with(
        _TEL,
        """, c AS (SELECT src, cb % 20 AS cb, ms, status, d1 FROM telemetry),
 g AS (SELECT *, CASE WHEN cb = lag(cb) OVER (PARTITION BY src ORDER BY ms) THEN 0 ELSE 1 END AS fresh FROM c),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY ms) AS part FROM g)
 SELECT src, cb, min(ms) AS ms, arg_min(status, ms) AS status, first(d1 ORDER BY ms) AS d1, count(*) AS copies FROM s GROUP BY src, cb, part""",
    ),
    "session_gaps": """WITH d AS (SELECT user_id AS tag_id, event_id*100 AS ms FROM events),
 g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY tag_id ORDER BY ms) <= 1500 THEN 0 ELSE 1 END AS fresh FROM d),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY tag_id ORDER BY ms) AS sid FROM g)
 SELECT tag_id, min(ms) AS start_ms, max(ms)+1500 AS end_ms, count(*) AS n FROM s GROUP BY tag_id, sid""",
    "calibration_bias": _with(
        _RANGES,
        f""", c AS (SELECT anchor_id, r, r - sqrt((tx-ax)*(tx-ax)+(ty-ay)*(ty-ay)) AS e FROM ranges_v)
 SELECT anchor_id, count(*) AS n, {_r('avg(r)', 3, 'mean_cm')}, {_r('stddev_samp(r)', 3, 'stddev_cm')},
 {_r('quantile_disc(e, 0.5)', 3, 'median_residual_cm')}, {_r('avg(e)', 3, 'bias_cm')},
 {_r('stddev_samp(e)', 3, 'residual_stddev_cm')} FROM c GROUP BY 1""",
    ),
    "latest_per_anchor": _with(
        _RANGES,
        f"""SELECT tag_id, anchor_id, {_r('max(t)', 4, 't')}, {_r('arg_max(r, (t, event_id))', 3, 'distance_cm')}, count(*) AS n
 FROM ranges_v GROUP BY 1, 2""",
    ),
    "live_ranges": _with(
        _RANGES,
        f""", l AS (SELECT tag_id, anchor_id, max(t) AS t, arg_max(r, (t, event_id)) AS r FROM ranges_v GROUP BY 1, 2),
 a AS (SELECT *, max(t) OVER (PARTITION BY tag_id) - t AS age FROM l)
 SELECT tag_id, anchor_id, {_r('r', 3, 'distance_cm')}, {_r('age', 4, 'age_s')} FROM a WHERE age <= 2.0""",
    ),
    "asof_hold": _with(
        _FRAMES,
        f"SELECT tag_id, tick, anchor_id, {_r('r', 3, 'distance_cm')}, {_r('age', 4, 'age_s')} FROM near WHERE age <= 2.0",
    ),
    "anchor_status": _with(
        _FRAMES,
        """SELECT tag_id, tick, count(*) FILTER (age <= 0.06) = 4 AS valid, 'udp 0.0.0.0:4210 - ' ||
 coalesce('ancres recues: ' || string_agg(CAST(anchor_id AS VARCHAR), ', ' ORDER BY anchor_id) FILTER (age <= 0.06),
 'aucune distance recente') AS status FROM near GROUP BY 1, 2""",
    ),
    "packet_rows": _with(
        _RANGES,
        f"""SELECT tag_id, {_T}, CAST(count(*) AS INTEGER) AS n_raw, count(*)=4 AS valid, 'log' AS source,
 {_r('max(r) FILTER (anchor_id=1)', 3, 'd1')} FROM ranges_v GROUP BY tag_id, ranges_v.t""",
    ),
    "complete_ticks": _with(
        _RANGES,
        f"SELECT tag_id, {_T}, CAST(count(DISTINCT anchor_id) AS INTEGER) AS n_anchors, count(DISTINCT anchor_id)=4 AS complete FROM ranges_v GROUP BY tag_id, ranges_v.t",
    ),
    "tick_delta": _with(_RANGES, f"SELECT tag_id, {_T}, {_r('dt', 6, 'dt')} FROM tickd"),
    "tick_window_100ms": _with(
        _RANGES,
        f"""SELECT tag_id, anchor_id, CAST(round(t*1e6) AS BIGINT)//100000*100 AS window_ms, {_r('arg_max(r, event_id)', 3, 'distance_cm')},
 count(*) AS n FROM ranges_v GROUP BY 1, 2, 3""",
    ),
    "run_segments": """SELECT user_id AS tag_id, event_id, CAST(sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run_id FROM events""",
    "active_layout": _with(
        _RANGES + f", lay(layout_id, layout_name, anchor_id, lx, ly, lz) AS (VALUES {_LAYOUT_ROWS})",
        f"""SELECT l.layout_id, l.layout_name, l.anchor_id, lx AS ax, ly AS ay, lz AS az, count(*) AS n, {_r('avg(r)', 3, 'mean_cm')}
 FROM ranges_v g JOIN lay l ON l.layout_id = g.tag_id%5+2 AND l.anchor_id = g.anchor_id GROUP BY ALL""",
    ),
    "ema_distance": _with(
        _RANGES + "," + _ema_ticks(),
        f"SELECT tag_id, {_T}, " + ", ".join(_r(f"max(r) FILTER (anchor_id={a})", 3, f"s{a}") for a in (1, 2, 3, 4)) + " FROM sm GROUP BY tag_id, sm.t",
    ),
    "ema_position": _with(
        _POS
        + ", aim AS (SELECT k.tag_id, k.t, 0.05::DOUBLE AS dt, p.x, p.y FROM ticks k LEFT JOIN pos2d p USING (tag_id, t)),"
        + _ema("ex", "aim", "tag_id", "x", 0.10) + "," + _ema("ey", "aim", "tag_id", "y", 0.10)
        + """, o AS (SELECT a.tag_id, a.t, last_value(ex.s IGNORE NULLS) OVER w AS xs, last_value(ey.s IGNORE NULLS) OVER w AS ys
 FROM aim a LEFT JOIN ex USING (tag_id, t) LEFT JOIN ey USING (tag_id, t)
 WINDOW w AS (PARTITION BY a.tag_id ORDER BY a.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"SELECT tag_id, {_T}, {_r('xs', 3, 'xs')}, {_r('ys', 3, 'ys')} FROM o",
    ),
    "project_ground": _with(
        _RANGES,
        f"""SELECT tag_id, {_T}, anchor_id, {_r('r3', 3, 'slant_cm')},
 {_r('sqrt(greatest(0, r3*r3-505::DOUBLE*505))', 3, 'distance_cm')} FROM ranges_v""",
    ),
    "locate_2d": _with(_POS, f"SELECT tag_id, {_T}, {_r('x', 3, 'x')}, {_r('y', 3, 'y')} FROM pos2d"),
    "locate_2d_full": _with(
        _RANGES + "," + _located("r")
        + """, er AS (SELECT l.*, CASE WHEN l.x_raw IS NOT NULL AND l.x IS NOT NULL THEN sqrt((v.x-l.x_raw)*(v.x-l.x_raw)+(v.y-l.y_raw)*(v.y-l.y_raw)) END AS raw_err,
 CASE WHEN l.x_raw IS NOT NULL AND l.x IS NOT NULL THEN sqrt((v.x-l.x)*(v.x-l.x)+(v.y-l.y)*(v.y-l.y)) END AS smooth_err
 FROM loc l LEFT JOIN truth_v v USING (tag_id, t))""",
        f"""SELECT tag_id, {_T}, x_raw IS NOT NULL AS valid, {_r('x_raw', 3, 'x_raw')}, {_r('y_raw', 3, 'y_raw')}, {_r('x', 3, 'x')},
 {_r('y', 3, 'y')}, {_r('raw_err', 3, 'raw_err')}, {_r('smooth_err', 3, 'smooth_err')},
 {_r('CASE WHEN smooth_err IS NOT NULL THEN avg(smooth_err) OVER (PARTITION BY tag_id ORDER BY er.t) END', 3, 'avg_smooth_err')} FROM er""",
    ),
    "locate_3d_to_2d": _with(
        _RANGES + "," + _located("rg").replace("g.rg", "CASE WHEN g.r3 IS NOT NULL THEN sqrt(greatest(0, g.r3*g.r3-505::DOUBLE*505)) END")
        + """, h3 AS (SELECT k.tag_id, k.t, last_value(g.r3 IGNORE NULLS) OVER w AS s1, last_value(g.t IGNORE NULLS) OVER w AS st FROM tickd k
 LEFT JOIN ranges_v g ON g.tag_id=k.tag_id AND g.t=k.t AND g.anchor_id=1
 WINDOW w AS (PARTITION BY k.tag_id ORDER BY k.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""SELECT l.tag_id, {_r('l.t', 4, 't')}, {_r('x_raw', 3, 'x_raw')}, {_r('y_raw', 3, 'y_raw')}, {_r('x', 3, 'x')}, {_r('y', 3, 'y')},
 {_r('CASE WHEN l.t - h3.st <= 2.0 THEN h3.s1 END', 3, 'slant_1')} FROM loc l JOIN h3 USING (tag_id, t)""",
    ),
    "circle_pairs": _with(
        _RANGES
        + """, c AS (SELECT tag_id, t, d1 AS r0, d3 AS r1, sqrt(3000::DOUBLE*3000+2100::DOUBLE*2100) AS d FROM ticks WHERE d1 IS NOT NULL AND d3 IS NOT NULL),
 h AS (SELECT *, (r0*r0-r1*r1+d*d)/(2*d) AS a FROM c WHERE d <= r0+r1 AND d >= abs(r0-r1)),
 p AS (SELECT tag_id, t, -250+a*3000/d AS xm, -150+a*2100/d AS ym, sqrt(greatest(0, r0*r0-a*a)) AS hh, d FROM h)""",
        f"""SELECT tag_id, {_T}, {_r('xm-2100*hh/d', 3, 'x1')}, {_r('ym+3000*hh/d', 3, 'y1')}, {_r('xm+2100*hh/d', 3, 'x2')},
 {_r('ym-3000*hh/d', 3, 'y2')} FROM p""",
    ),
    "locate_3d_point": _with(
        _RANGES + "," + _WIDE3 + "," + _FLAT + "," + _solve("ground", "flat")
        + ", seed AS (SELECT tag_id, t, x, y, 95::DOUBLE AS z FROM ground)," + _STEP,
        f"SELECT tag_id, {_T}, {_r('qx', 3, 'x')}, {_r('qy', 3, 'y')}, {_r('qz', 3, 'z')} FROM solved",
        recursive=True,
    ),
    "locate_3d_track": _with(
        _RANGES + "," + _WIDE3 + "," + _TRACK + "," + _STEP,
        f"""SELECT f.tag_id, {_r('f.t', 4, 't')}, {_r('qx', 3, 'x_raw')}, {_r('qy', 3, 'y_raw')}, {_r('qz', 3, 'z_raw')}, {_r('f.x', 3, 'x')},
 {_r('f.y', 3, 'y')}, {_r('f.z', 3, 'z')}, {_r('coalesce(-dt/ln(1-0.12::DOUBLE) - dt/ln(1-0.08::DOUBLE), 0)', 3, 'delay_total_s')}
 FROM fin f JOIN tickd USING (tag_id, t) LEFT JOIN solved USING (tag_id, t)""",
        recursive=True,
    ),
    "segment_speed": _with(
        _POS + "," + _SEG.format(src="pos2d"), f"SELECT tag_id, {_T}, {_r('step_cm', 2, 'step_cm')}, {_r('step_cm/0.05', 2, 'speed_cm_s')} FROM seg"
    ),
    "player_card": _with(
        _POS + "," + _SEG.format(src="pos2d"), _card("seg", "CAST(NULL AS BIGINT) AS jump_count, CAST(NULL AS DOUBLE) AS max_jump_cm")
    ),
    "player_card_3d": _with(
        _HOPS + _RISE + ", j AS (SELECT s.*, rise.up, rise.jump FROM seg s JOIN rise USING (tag_id, t))",
        _card(
            "j", f"CAST(count(*) FILTER (up) AS BIGINT) AS jump_count, {_r('max(jump)', 4, 'max_jump_cm')}",
            f", {_r('coalesce(sum(step_cm/0.05),0)', 2, 'speed_sum_cm_s')}",
        ),
    ),
    "jumps": _with(_HOPS + _RISE, f"SELECT tag_id, {_T}, {_r('jump', 4, 'jump')} FROM rise WHERE up"),
    "running_max": _with(
        _HOPS + ", j AS (SELECT s.*, hops.jump FROM seg s JOIN hops USING (tag_id, t))",
        f"""SELECT tag_id, {_T}, {_r('max(j.t) OVER w', 4, 'max_time_s')}, {_r('max(coalesce(step_cm/0.05,0)) OVER w', 2, 'max_speed_so_far')},
 {_r('max(jump) OVER w', 4, 'max_jump_so_far')} FROM j WINDOW w AS (PARTITION BY tag_id ORDER BY j.t)""",
    ),
    "trail_220": _with(
        _POS,
        f"""SELECT * FROM (SELECT tag_id, CAST(row_number() OVER (PARTITION BY tag_id ORDER BY pos2d.t DESC) AS INTEGER) AS rank, {_T},
 {_r('x', 3, 'x')}, {_r('y', 3, 'y')} FROM pos2d) WHERE rank <= 220""",
    ),
    "trail_lines": """WITH p AS (SELECT l_suppkey, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)*100000000
 + l_orderkey*10 + l_linenumber AS pos FROM lineitem), r AS (SELECT l_suppkey,
 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY pos DESC) AS INTEGER) AS rank, pos FROM p) SELECT * FROM r WHERE rank <= 220""",
    "running_total_lines": """SELECT l_suppkey, l_orderkey, l_linenumber, max(l_quantity) OVER w AS peak, count(*) OVER w AS n,
 sum(l_quantity) OVER w AS total FROM lineitem
 WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "heat_cells": _with(_HEAT, 'SELECT tag_id, "row", col, hits FROM heat'),
    "heatmap_max": _with(_HEAT, "SELECT tag_id, CAST(sum(hits) AS BIGINT) AS version, max(hits) AS max_hits, count(*) AS cells FROM heat GROUP BY 1"),
    "heatmap_kernel": _with(_HEAT, f'SELECT tag_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, {_r("weighted", 6, "weighted")} FROM kern'),
    "heatmap_smooth": _with(
        _HEAT,
        f'SELECT tag_id, CAST(k."row" AS INTEGER) AS "row", CAST(k.col AS INTEGER) AS col, {_r("weighted/ws", 6, "value")} FROM kern k JOIN weights USING ("row", col)',
    ),
    "heatmap_dense": _with(
        _HEAT,
        f"""SELECT CAST(w."row" AS INTEGER) AS "row", CAST(w.col AS INTEGER) AS col, {_r('coalesce(weighted,0)/ws', 6, 'value')}
 FROM weights w LEFT JOIN allk USING ("row", col)""",
    ),
    "heatmap_snapshot": _with(_HEAT, 'SELECT tag_id, "row", col, count(*) AS hits FROM cells WHERE t <= 2.0 GROUP BY 1, 2, 3'),
    "heat_snapshots": _with(
        _HEAT + """, snaps AS (SELECT i AS snapshot_id, 0.517::DOUBLE + 0.05::DOUBLE*i AS upto FROM range(0, 100) s(i)),
 shot AS (SELECT tag_id, snapshot_id, "row", col, count(*) AS hits FROM cells JOIN snaps ON t <= upto GROUP BY 1, 2, 3, 4)""",
        """SELECT tag_id, CAST(snapshot_id AS INTEGER) AS snapshot_id, CAST(sum(hits) OVER (PARTITION BY tag_id, snapshot_id) AS BIGINT) AS heat_version,
 "row", col, hits FROM shot""",
    ),
    "heat_snapshots_rgba": _with(
        _HEAT
        + """, snaps AS (SELECT * FROM (VALUES (0, 1::DOUBLE), (1, 2::DOUBLE), (2, 4::DOUBLE)) s(snapshot_id, upto)),
 shot AS (SELECT snapshot_id, "row", col, count(*) AS hits FROM cells JOIN snaps ON t <= upto GROUP BY 1, 2, 3),
 versions AS (SELECT snapshot_id, CAST(sum(hits) AS BIGINT) AS heat_version FROM shot GROUP BY 1),
 shotk AS (SELECT snapshot_id, h."row"+o.dy AS "row", h.col+o.dx AS col, sum(h.hits*o.w) AS weighted FROM shot h CROSS JOIN offs o
  WHERE h."row"+o.dy BETWEEN 0 AND 59 AND h.col+o.dx BETWEEN 0 AND 111 GROUP BY 1, 2, 3),
 v AS (SELECT snapshot_id, heat_version, "row", col, round(weighted/ws, 6) AS value FROM shotk JOIN weights USING ("row", col) JOIN versions USING (snapshot_id)),
 q AS (SELECT *, least(greatest(value/max(value) OVER (PARTITION BY snapshot_id), 0), 1) AS ratio FROM v)""",
        f"SELECT snapshot_id, heat_version, {_RAMP}",
    ),
    "heat_rgba": _with(
        _HEAT
        + """, v AS (SELECT "row", col, round(weighted/ws, 6) AS value FROM allk JOIN weights USING ("row", col)),
 q AS (SELECT *, least(greatest(value/max(value) OVER (), 0), 1) AS ratio FROM v)""",
        f"SELECT {_RAMP}",
    ),
    "zone_time": _with(
        _POS + "," + _HOOP, f"SELECT tag_id, {_ZONE} AS zone, count(*) AS samples, {_r('count(*)*0.05::DOUBLE', 4, 'seconds')} FROM hp GROUP BY 1, 2"
    ),
    "hoop_distance": _with(_POS + "," + _HOOP, f"SELECT tag_id, {_T}, {_r('hoop', 3, 'hoop_cm')} FROM hp"),
    "error_final_2d": _with(
        _SCORED,
        f"SELECT tag_id, count(*) AS n, {_FIN2}, {_r('max(raw_err)', 3, 'max_raw_err')}, {_r('max(smooth_err)', 3, 'max_smooth_err')} FROM sc GROUP BY 1",
    ),
    "error_running_2d": _with(
        _SCORED,
        f"""SELECT tag_id, {_T}, {_RUN2}, {_r('max(raw_err) OVER w', 3, 'max_raw_err')}, {_r('max(smooth_err) OVER w', 3, 'max_smooth_err')}
 FROM sc WINDOW w AS (PARTITION BY tag_id ORDER BY sc.t)""",
    ),
    "precision": _with(
        _POS + ", e AS (SELECT tag_id, t, sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)) AS err FROM pos2d p JOIN truth_v v USING (tag_id, t))",
        f"SELECT tag_id, {_T}, {_r('err', 3, 'err')}, {_r('least(greatest(100*(1-err/100),0),100)', 3, 'precision')} FROM e",
    ),
    "filter_delay": _with(
        _RANGES,
        f"""SELECT tag_id, {_T}, {_r('(-dt/ln(1-0.12::DOUBLE) - dt/ln(1-0.08::DOUBLE))*1000', 3, 'delay_ms')},
 {_r('1-pow(1-0.12::DOUBLE, dt*60)', 6, 'alpha')} FROM tickd WHERE dt IS NOT NULL""",
    ),
    "truth_at_delay": _with(
        _POS + "," + _at("0.3301::DOUBLE", 40).replace("{src}", "pos2d"),
        f"SELECT tag_id, {_T}, {_r('at_x', 3, 'at_x')}, {_r('at_y', 3, 'at_y')}, {_r('at_z', 3, 'at_z')} FROM past",
    ),
    "truth_between_samples": _with(
        _POS + """,
brk AS (SELECT tag_id, t, x, y, z, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz,
  first_value(t) OVER h AS ot, first_value(x) OVER h AS ox, first_value(y) OVER h AS oy, first_value(z) OVER h AS oz
  FROM truth_v WINDOW w AS (PARTITION BY tag_id ORDER BY t), h AS (PARTITION BY tag_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
aims AS (SELECT tag_id, t + 0.0213::DOUBLE AS t, t - 0.2301::DOUBLE AS tau FROM pos2d),
now AS (SELECT a.tag_id, a.t, a.tau, k.ot, k.ox, k.oy, k.oz FROM aims a ASOF LEFT JOIN brk k ON a.tag_id=k.tag_id AND a.t >= k.t),
past AS (SELECT c.tag_id, c.t, """ + ", ".join(
            f"CASE WHEN b.t IS NULL OR c.tau < c.ot THEN c.o{a} WHEN b.nt > b.t AND b.nt <= c.t THEN b.{a} + (b.n{a}-b.{a})*((c.tau-b.t)/(b.nt-b.t)) ELSE b.{a} END AS at_{a}"
            for a in "xyz"
        ) + " FROM now c ASOF LEFT JOIN brk b ON c.tag_id=b.tag_id AND c.tau >= b.t)",
        f"SELECT tag_id, {_T}, {_r('at_x', 3, 'at_x')}, {_r('at_y', 3, 'at_y')}, {_r('at_z', 3, 'at_z')} FROM past",
    ),
    "best_delay": _with(
        _POS + "," + _BEST,
        f"SELECT e.tag_id, {_r('e.t', 4, 't')}, {_r('measured_delay', 4, 'measured_delay')}, {_r('delay_err', 3, 'delay_err')} FROM est e LEFT JOIN best USING (tag_id, t)",
    ),
    "error_3d": _with(
        _POS + "," + _BEST + "," + _at("0.3301::DOUBLE", K.TRUTH_HISTORY).replace("{src}", "est")
        + """, e3 AS (SELECT e.tag_id, e.t, CASE WHEN e.x IS NOT NULL THEN sqrt((v.x-e.x)**2+(v.y-e.y)**2+(v.z-e.z)**2) END AS err3d,
 CASE WHEN e.x IS NOT NULL THEN sqrt((v.x-e.x)**2+(v.y-e.y)**2) END AS errxy, CASE WHEN e.x IS NOT NULL THEN abs(v.z-e.z) END AS errz,
 CASE WHEN e.x IS NOT NULL THEN sqrt((p.at_x-e.x)**2+(p.at_y-e.y)**2+(p.at_z-e.z)**2) END AS traj_err_3d,
 CASE WHEN e.x IS NOT NULL THEN sqrt((p.at_x-e.x)**2+(p.at_y-e.y)**2) END AS traj_err_xy,
 CASE WHEN e.x IS NOT NULL THEN abs(p.at_z-e.z) END AS traj_err_z,
 CASE WHEN e.x IS NOT NULL THEN 0.3301::DOUBLE END AS delay_total_s,
 CASE WHEN e.x IS NOT NULL THEN coalesce(b.measured_delay, 0) END AS measured_delay
 FROM est e JOIN truth_v v USING (tag_id, t) JOIN past p USING (tag_id, t) LEFT JOIN best b USING (tag_id, t)),
 p3 AS (SELECT *, CASE WHEN err3d IS NOT NULL THEN least(greatest(100*(1-err3d/90),0),100) END AS precision,
 CASE WHEN err3d IS NOT NULL THEN least(greatest(100*(1-traj_err_3d/90),0),100) END AS traj_precision FROM e3),
 w3 AS (SELECT *, """ + ", ".join(f"avg({c}) OVER w AS a_{c}" for c in _AVG3) + """, max(measured_delay) OVER w AS mx FROM p3
 WINDOW w AS (PARTITION BY tag_id ORDER BY t))""",
        f"""SELECT tag_id, {_T}, {', '.join(_r(c, 6 if c == 'traj_err_z' else 3, c) for c in _AVG3 if c not in ('delay_total_s', 'measured_delay'))},
 {', '.join(_r(f'CASE WHEN err3d IS NOT NULL THEN a_{c} END', 6 if c == 'traj_err_z' else 3, f'avg_{c}') for c in _AVG3)},
 {_r('CASE WHEN err3d IS NOT NULL THEN mx END', 3, 'max_measured_delay')},
 {_r('CASE WHEN err3d IS NOT NULL THEN a_err3d/nullif(a_traj_err_3d,0) END', 3, 'path_ratio')} FROM w3""",
    ),
    "settings_sanitize": _with(
        _SET,
        f"""SELECT event_id, CASE WHEN bad THEN 4 ELSE CAST(greatest(least(trunc(k),6),2) AS INTEGER) END AS active_anchor_count,
 {_r('CASE WHEN bad THEN 0.12::DOUBLE ELSE greatest(least(a,0.95::DOUBLE),0.01::DOUBLE) END', 4, 'alpha_dist')}, 0.1::DOUBLE AS alpha_pos,
 {_r('CASE WHEN bad THEN 100::DOUBLE ELSE greatest(least(k,2000),1) END', 4, 'precision_tolerance_cm')}, ver=2 AND NOT bad AS layouts_apply FROM doc""",
    ),
    "alpha_sweep": _sweep(),
}
ORACLES["stream_ranges_log"] = ORACLES["ranges_log"].replace(
    "SELECT strftime", "SELECT raw_message, event, anchor_id, distance_cm, fields_json FROM (SELECT strftime"
) + ")"
ORACLES["stream_latest"] = _with(
    _RNG,
    """SELECT m.tag_id, p.anchor_id, max(epoch_us(m.ts)) AS last_us, arg_max(p.distance_cm, m.ts) AS distance_cm, count(*) AS n
 FROM parsed p JOIN messages_v m USING (event_id) GROUP BY 1, 2""",
)
ORACLES["stream_tick_window"] = _with(
    _RNG,
    """SELECT m.tag_id, p.anchor_id, epoch_us(m.ts)//100000*100 AS tick_ms, arg_max(p.distance_cm, m.ts) AS distance_cm, count(*) AS n
 FROM parsed p JOIN messages_v m USING (event_id) GROUP BY 1, 2, 3""",
)
ORACLES["stream_sessions"] = ORACLES["session_gaps"]
_BOARDS = """seqd AS (SELECT event_id, user_id AS tag_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
lines AS (SELECT tag_id, event_id AS arrival, seq // 30 AS boot, seq % 30 AS cb, seq * 10000000 + 1000000000000 AS sent_us,
  seq * 10000000 + 1000000000000 + event_id * 7919 % 1800 * 1000 AS us,
  CAST(floor(((seq % 30) * 10000 + 3000) * (1 + (tag_id % 5 - 2) * 40e-6::DOUBLE)) AS BIGINT) AS ms FROM seqd)"""
_CLOCK = _BOARDS + """,
pts AS (SELECT tag_id, boot, ms::DOUBLE AS x, us / 1000::DOUBLE - ms AS y FROM lines
  QUALIFY row_number() OVER (PARTITION BY tag_id, boot, ms // 60000 ORDER BY us / 1000::DOUBLE - ms, ms) = 1),
mid AS (SELECT tag_id, boot, avg(x) AS m FROM pts GROUP BY 1, 2),
edges AS (SELECT a.tag_id, a.boot, (b.y - a.y) / (b.x - a.x) AS s, b.x - a.x AS wide
  FROM pts a JOIN pts b ON a.tag_id = b.tag_id AND a.boot = b.boot AND a.x < b.x JOIN mid ON mid.tag_id = a.tag_id AND mid.boot = a.boot
  WHERE a.x < m AND m <= b.x AND NOT EXISTS (SELECT 1 FROM pts c WHERE c.tag_id = a.tag_id AND c.boot = a.boot
    AND c.y < a.y + (b.y - a.y) / (b.x - a.x) * (c.x - a.x) - 1e-6)),
slopes AS (SELECT tag_id, boot, greatest(-500e-6, least(500e-6, arg_max(s, wide)))::DOUBLE AS drift FROM edges GROUP BY 1, 2),
fitted AS (SELECT p.tag_id, p.boot, coalesce(any_value(drift), 0) AS drift, min(y - coalesce(drift, 0) * x) AS height
  FROM pts p LEFT JOIN slopes s ON s.tag_id = p.tag_id AND s.boot = p.boot GROUP BY 1, 2),
ended AS (SELECT f.tag_id, f.boot, drift, height, max(round((ms * (1 + drift) + height) * 1000)) AS e
  FROM fitted f JOIN lines l ON l.tag_id = f.tag_id AND l.boot = f.boot GROUP BY ALL),
placed AS (SELECT *, max(e) OVER (PARTITION BY tag_id ORDER BY boot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor_us FROM ended),
timed AS (SELECT l.*, greatest(round((ms * (1 + drift) + height) * 1000), coalesce(floor_us, 0)) / 1e6::DOUBLE AS t
  FROM lines l JOIN placed p ON l.tag_id = p.tag_id AND l.boot = p.boot)"""
ORACLES["device_clock"] = _with(_CLOCK, f"SELECT tag_id, arrival, boot, {_r('t', 3, 't')} FROM timed")
ORACLES["ranges_device_clock"] = _with(_CLOCK, f"SELECT tag_id, arrival, {_r('t', 3, 't')}, 1 AS anchor_id, cb::DOUBLE AS distance_cm FROM timed")
ORACLES["stream_device_clock"] = _with(
    _BOARDS, "SELECT tag_id, boot, count(*) AS lines, max(cb) AS last_cb, true AS within_delay FROM lines GROUP BY 1, 2"
)
ORACLES["stream_repeat_suppress"] = _with(
    _TEL,
    """, c AS (SELECT tag_id, session, src, cb % 20 AS cb, ms FROM telemetry)
 SELECT tag_id, session, src, cb, ms FROM c
 QUALIFY cb IS DISTINCT FROM lag(cb) OVER (PARTITION BY tag_id, session, src ORDER BY ms)""",
)
ORACLES["stream_repeat_shuffled"] = ORACLES["stream_repeat_suppress"]
ORACLES["stream_track"] = _with(
    _RANGES + "," + _located("r"),
    f"SELECT tag_id, {_T}, {_r('x_raw', 3, 'x_raw')}, {_r('y_raw', 3, 'y_raw')}, {_r('x', 3, 'x')}, {_r('y', 3, 'y')} FROM loc",
)
_FRAME60 = _RANGES.replace("tickd AS (", "stampd AS (") + """,
span AS (SELECT tag_id, CAST(ceil(min(t)*60) AS BIGINT) AS i, CAST(floor((max(t)+2.0)*60) AS BIGINT) AS j FROM ranges_v GROUP BY 1),
frames AS (SELECT tag_id, unnest(range(i, j+1)) AS tick FROM span),
tickd AS (SELECT tag_id, tick/60::DOUBLE AS t, 1/60::DOUBLE AS dt FROM frames),
near AS (SELECT f.tag_id, f.t, f.anchor_id, g.r, f.t - g.t AS age FROM (SELECT * FROM tickd CROSS JOIN anchors) f
  ASOF LEFT JOIN ranges_v g ON f.tag_id=g.tag_id AND f.anchor_id=g.anchor_id AND f.t >= g.t),
heldf AS (SELECT tag_id, t, anchor_id, r FROM near WHERE age <= 2.0)"""
ORACLES["locate_2d_frame"] = _with(
    _FRAME60 + "," + _solve("raw", "heldf", "x_raw", "y_raw") + "," + _ema_ticks("r", "heldf") + "," + _solve("fine", "sm", "xs", "ys")
    + """,
aim AS (SELECT k.tag_id, k.t, k.dt, f.xs, f.ys FROM tickd k LEFT JOIN fine f USING (tag_id, t)),"""
    + _ema("ex", "aim", "tag_id", "xs", 0.10) + "," + _ema("ey", "aim", "tag_id", "ys", 0.10)
    + """,
loc AS (SELECT k.tag_id, k.t, raw.x_raw, raw.y_raw,
  last_value(ex.s IGNORE NULLS) OVER w AS x, last_value(ey.s IGNORE NULLS) OVER w AS y FROM tickd k
  LEFT JOIN raw USING (tag_id, t) LEFT JOIN ex USING (tag_id, t) LEFT JOIN ey USING (tag_id, t)
  WINDOW w AS (PARTITION BY k.tag_id ORDER BY k.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    f"""SELECT tag_id, {_T}, x_raw IS NOT NULL AS valid, {_r('x_raw', 3, 'x_raw')}, {_r('y_raw', 3, 'y_raw')}, {_r('x', 3, 'x')},
 {_r('y', 3, 'y')} FROM loc""",
)
_EST3 = """
est AS (SELECT f.tag_id, f.t, f.x, f.y, f.z, o.qx AS xr, coalesce(-dt/ln(1-0.12::DOUBLE) - dt/ln(1-0.08::DOUBLE), 0) AS dl
  FROM fin f JOIN tickd USING (tag_id, t) LEFT JOIN solved o USING (tag_id, t)),
hist AS"""
ORACLES["score_3d_track"] = _with(
    _RANGES + "," + _WIDE3 + "," + _TRACK + "," + _STEP + "," + _EST3 + _BEST.split("hist AS", 1)[1] + ","
    + _at("p.dl", K.TRUTH_HISTORY).replace("{src}", "est")
    + """, e3 AS (SELECT e.tag_id, e.t, e.x, e.y, e.z, CASE WHEN ok THEN sqrt((v.x-e.x)**2+(v.y-e.y)**2+(v.z-e.z)**2) END AS err3d,
 CASE WHEN ok THEN sqrt((p.at_x-e.x)**2+(p.at_y-e.y)**2+(p.at_z-e.z)**2) END AS traj_err_3d,
 CASE WHEN ok THEN coalesce(b.measured_delay, 0) END AS md
 FROM (SELECT *, x IS NOT NULL AND xr IS NOT NULL AS ok FROM est) e JOIN truth_v v USING (tag_id, t) JOIN past p USING (tag_id, t)
 LEFT JOIN best b USING (tag_id, t)),
w3 AS (SELECT *, avg(err3d) OVER w AS a1, avg(traj_err_3d) OVER w AS a3,
 avg(CASE WHEN err3d IS NOT NULL THEN least(greatest(100*(1-err3d/90),0),100) END) OVER w AS a4 FROM e3
 WINDOW w AS (PARTITION BY tag_id ORDER BY t))""",
    f"""SELECT tag_id, {_T}, {_r('x', 3, 'x')}, {_r('y', 3, 'y')}, {_r('z', 3, 'z')}, {_r('err3d', 3, 'err3d')},
 {_r('traj_err_3d', 3, 'traj_err_3d')}, {_r('md', 3, 'measured_delay')}, {_r('CASE WHEN err3d IS NOT NULL THEN a1 END', 3, 'avg_err3d')},
 {_r('CASE WHEN err3d IS NOT NULL THEN a4 END', 3, 'avg_precision')},
 {_r('CASE WHEN err3d IS NOT NULL THEN a1/nullif(a3,0) END', 3, 'path_ratio')} FROM w3""",
    recursive=True,
)

_SENT = _RANGES + "," + _located("rg").replace("g.rg", "round(g.r, 2)")
ORACLES["messages_to_positions"] = _with(
    _SENT,
    f"SELECT tag_id, {_T}, x_raw IS NOT NULL AS valid, {_r('x_raw', 3, 'x_raw')}, {_r('y_raw', 3, 'y_raw')}, {_r('x', 3, 'x')}, {_r('y', 3, 'y')} FROM loc",
)
ORACLES["stream_messages_to_positions"] = _with(
    _SENT, f"SELECT tag_id, {_T}, {_r('x_raw', 3, 'x_raw')}, {_r('y_raw', 3, 'y_raw')}, {_r('x', 3, 'x')}, {_r('y', 3, 'y')} FROM loc"
)
_ESTIMATE = _RANGES + "," + _located("r") + ", pos2d AS (SELECT tag_id, t, x, y FROM loc WHERE x IS NOT NULL)"
ORACLES["card_from_locate_2d"] = ORACLES["player_card"].replace(_POS, _ESTIMATE)
ORACLES["heat_from_locate_2d"] = ORACLES["heat_rgba"].replace(_POS, _ESTIMATE)
_ASYNC = (
    _RANGES.replace("ticks AS (", "ticks0 AS (").replace("tickd AS (", "tickd0 AS (").replace("FROM ticks)", "FROM ticks0)")
    + """,
thin AS (SELECT * FROM ranges_v WHERE anchor_id = CAST(round(t/0.05) AS INTEGER)%4+1),
tickd AS (SELECT tag_id, t, t - lag(t) OVER (PARTITION BY tag_id ORDER BY t) AS dt FROM (SELECT DISTINCT tag_id, t FROM thin)),"""
    + _held("r3").replace("ranges_v", "thin")
    + """,
thin4 AS (SELECT tag_id, t, anchor_id, r AS r3 FROM held),"""
)
ORACLES["locate_3d_async"] = _with(
    _ASYNC + (_WIDE3 + "," + _TRACK + "," + _STEP).replace("ranges_v", "thin4"),
    f"""SELECT f.tag_id, {_r('f.t', 4, 't')}, {_r('qx', 3, 'x_raw')}, {_r('qy', 3, 'y_raw')}, {_r('qz', 3, 'z_raw')}, {_r('f.x', 3, 'x')},
 {_r('f.y', 3, 'y')}, {_r('f.z', 3, 'z')} FROM fin f JOIN tickd USING (tag_id, t) LEFT JOIN solved USING (tag_id, t)""",
    recursive=True,
)
ORACLES["stream_fresh"] = _with(
    _RNG,
    """, l AS (SELECT m.tag_id, p.anchor_id, max(m.ts) AS last_ts, arg_max(p.distance_cm, m.ts) AS distance_cm
 FROM parsed p JOIN messages_v m USING (event_id) GROUP BY 1, 2)
 SELECT tag_id, anchor_id, distance_cm FROM l WHERE epoch_us(TIMESTAMP '2024-01-25') - epoch_us(last_ts) <= 86400000000""",
)
ORACLES["stream_heat"] = ORACLES["heat_cells"]
ORACLES["log_files"] = ORACLES["ranges_log"]
ORACLES["message_files"] = _with(_MSG, """SELECT event_id, tag_id, message || ' note="a,b"' AS message FROM messages_v""")
ORACLES["ranges_device_time"] = _with(
    _TEL,
    f"""SELECT tag_id, {_r('ms/1000::DOUBLE', 4, 't')}, CAST(right(session, 1) AS BIGINT) AS anchor_id, CAST(d1 AS DOUBLE) AS distance_cm
 FROM telemetry WHERE session IN ('0x1001','0x1002','0x1003','0x1004') AND d1 IS NOT NULL""",
)
ORACLES["truth_file"] = _with(_TRUTH, f"SELECT tag_id, {_T}, {_r('x', 4, 'x')}, {_r('y', 4, 'y')}, {_r('z', 4, 'z')} FROM truth_v")
ORACLES["stream_track_3d"] = _with(
    _RANGES + "," + _WIDE3 + "," + _TRACK + "," + _STEP,
    f"""SELECT f.tag_id, {_r('f.t', 4, 't')}, {_r('qx', 3, 'x_raw')}, {_r('qy', 3, 'y_raw')}, {_r('qz', 3, 'z_raw')}, {_r('f.x', 3, 'x')},
 {_r('f.y', 3, 'y')}, {_r('f.z', 3, 'z')} FROM fin f LEFT JOIN solved USING (tag_id, t)""",
    recursive=True,
)
_QUICK_TRACK = _TRACK.replace("0.08", "0.6").replace("0.12", "0.7")
ORACLES["card_from_locate_3d"] = ORACLES["stream_card_3d"] = _with(
    _RANGES + "," + _WIDE3 + "," + _QUICK_TRACK + ", hops AS (SELECT tag_id, t, x, y, greatest(0, z-95) AS jump FROM fin WHERE x IS NOT NULL),"
    + _SEG.format(src="hops") + _RISE + ", j AS (SELECT s.*, rise.up, rise.jump FROM seg s JOIN rise USING (tag_id, t))",
    _card("j", f"CAST(count(*) FILTER (up) AS BIGINT) AS jump_count, {_r('max(jump)', 3, 'max_jump_cm')}").replace(", 4) + 0", ", 3) + 0"),
    recursive=True,
)

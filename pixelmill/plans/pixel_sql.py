"""DuckDB SQL for the queries over derived strips, written apart from the Spark plans."""

PIX = """
s AS (SELECT s_suppkey AS image_id, cast(2 + s_suppkey % 3 AS int) AS expected FROM supplier),
g AS (SELECT image_id, expected, 96 // expected AS slot, x::int AS x, y::int AS y FROM s, range(96) t(x), range(32) u(y)),
h AS (SELECT *, least(expected - 1, x // slot) AS pose, slot // 4 AS q FROM g),
k AS (SELECT *, x - pose * slot AS lx, 40 + (image_id * 37) % 160 AS fr, 60 + (image_id * 53 + pose * 4) % 160 AS fg, 30 + (image_id * 29) % 90 AS fb FROM h),
z AS (SELECT *, CASE WHEN (lx >= q AND lx < slot - q AND y >= 6 + pose AND y < 28) OR (image_id % 5 = 0 AND y >= 16 AND y < 19 AND x >= q AND x < 96 - q) THEN 2
  WHEN lx >= q - 2 AND lx < slot - q + 2 AND y >= 4 + pose AND y < 30 THEN 1 ELSE 0 END AS zone FROM k),
pix AS (SELECT image_id, expected, slot::int AS slot, pose::int AS pose, lx::int AS lx, x, y, (CASE zone WHEN 2 THEN fr WHEN 1 THEN (fr + 765) // 4 ELSE 255 END)::int AS r,
  (CASE zone WHEN 2 THEN fg WHEN 1 THEN fg // 4 ELSE 0 END)::int AS g, (CASE zone WHEN 2 THEN fb WHEN 1 THEN (fb + 765) // 4 ELSE 255 END)::int AS b, 255 AS a FROM z)"""
YCC = """
y0 AS (SELECT *, 0.299::double * r + 0.587::double * g + 0.114::double * b AS yy FROM pix),
yc AS (SELECT *, (b - yy) * 0.564::double + 128 AS cb, (r - yy) * 0.713::double + 128 AS cr FROM y0),
kk AS (SELECT 0.299::double * 255 + 0.587::double * 0 + 0.114::double * 255 AS ky),
kc AS (SELECT (255 - ky) * 0.564::double + 128 AS kb, (255 - ky) * 0.713::double + 128 AS kr FROM kk),
yd AS (SELECT yc.*, kb - 128 AS kb, kr - 128 AS kr, sqrt((kb - 128) ** 2 + (kr - 128) ** 2) AS kl, sqrt((cb - kb) ** 2 + (cr - kr) ** 2) AS d FROM yc, kc)"""
MAT = """
m0 AS (SELECT *, least(1.0::double, greatest(0.0::double, (d - 24) / 48.0::double)) AS t, ((cb - 128) * kb + (cr - 128) * kr) / kl AS pr, least(1.0::double, greatest(0.0::double, ((100 - d) / 100.0::double) / 1.0::double)) AS u FROM yd),
m1 AS (SELECT *, floor(255.0::double * (t * t * (3.0::double - 2.0::double * t)))::int AS al, t * t * (3.0::double - 2.0::double * t) > 0 AS seen, d < 100 AND pr > 0 AS spilt, u * u * (3.0::double - 2.0::double * u) * 0.92::double AS wg FROM m0),
m2 AS (SELECT *, 128 + ((cb - 128) - kb / kl * pr * wg) AS nb, 128 + ((cr - 128) - kr / kl * pr * wg) AS nr FROM m1),
m3 AS (SELECT *, floor(least(255.0::double, greatest(0.0::double, yy + 1.402::double * (nr - 128))) + 0.5::double)::int AS r2, floor(least(255.0::double, greatest(0.0::double, yy - 0.344136::double * (nb - 128) - 0.714136::double * (nr - 128))) + 0.5::double)::int AS g2,
  floor(least(255.0::double, greatest(0.0::double, yy + 1.772::double * (nb - 128))) + 0.5::double)::int AS b2 FROM m2),
mat AS (SELECT image_id, expected, slot, pose, lx, x, y, CASE WHEN NOT seen THEN 0 WHEN spilt THEN r2 ELSE r END AS r, CASE WHEN NOT seen THEN 0 WHEN spilt THEN g2 ELSE g END AS g,
  CASE WHEN NOT seen THEN 0 WHEN spilt THEN b2 ELSE b END AS b, al AS a FROM m3)"""
FRM = "fr AS MATERIALIZED (SELECT image_id, pose AS frame, lx AS x, y, r, g, b, a, slot AS w, 32 AS h FROM mat)"
PRO = "pro AS (SELECT image_id, x AS pos, sum(a)::double AS mass FROM mat GROUP BY ALL)"
OPQ = "pro AS (SELECT image_id, x AS pos, count(*) FILTER (a > 10)::double AS mass FROM mat GROUP BY ALL)"
SMO = "smo AS MATERIALIZED (SELECT image_id, pos, avg(mass) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mass FROM pro)"


def _runs(source: str, out: str, drop: bool = True) -> str:
    keep = "mass >= most * 0.20::double" if drop else "true"
    return f"""
{out}_t AS (SELECT *, max(mass) OVER (PARTITION BY image_id) AS top FROM {source}),
{out}_i AS (SELECT *, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS island FROM {out}_t WHERE top > 0 AND mass > 0.045::double * top),
{out}_g AS (SELECT image_id, min(pos) AS x0, max(pos) + 1 AS x1, sum(mass) AS mass, max(mass) AS peak, any_value(top) AS top FROM {out}_i GROUP BY image_id, island),
{out}_k AS (SELECT *, max(mass) OVER (PARTITION BY image_id) AS most FROM {out}_g WHERE x1 - x0 >= 4 AND peak >= 0.18::double * top),
{out} AS (SELECT image_id, x0, x1, mass, peak FROM {out}_k WHERE {keep})"""


BASE = f"{PIX},{YCC}"
M = f"{BASE},{MAT}"
F_ = f"{M},{FRM}"
P_ = f"{M},{PRO},{SMO}"
R_ = f"{P_},{_runs('smo', 'run')}"
PK = """
pin AS (SELECT smo.image_id, x0, x1, pos, smo.mass FROM smo JOIN run ON smo.image_id = run.image_id AND pos >= x0 AND pos < x1),
pla AS (SELECT *, lag(mass) OVER (PARTITION BY image_id, x0 ORDER BY pos) AS bf, lead(mass) OVER (PARTITION BY image_id, x0 ORDER BY pos) AS af, max(mass) OVER (PARTITION BY image_id, x0) AS most FROM pin),
cand AS (SELECT image_id, x0, x1, pos, mass FROM pla WHERE bf IS NOT NULL AND af IS NOT NULL AND mass >= bf AND mass > af AND mass >= 0.45::double * most),
shal AS (SELECT DISTINCT c.image_id, c.x0, c.pos FROM cand c JOIN cand o ON c.image_id = o.image_id AND c.x0 = o.x0 AND c.pos <> o.pos AND o.mass >= c.mass
  WHERE (SELECT min(mass) FROM pin WHERE pin.image_id = c.image_id AND pin.x0 = c.x0 AND pin.pos BETWEEN least(c.pos, o.pos) AND greatest(c.pos, o.pos)) > 0.62::double * c.mass),
kept AS (SELECT image_id, x0, pos FROM cand WHERE (image_id, x0, pos) NOT IN (SELECT (image_id, x0, pos) FROM shal)),
pk AS (SELECT * FROM kept UNION ALL SELECT image_id, x0, min(pos) FROM cand WHERE (image_id, x0) NOT IN (SELECT (image_id, x0) FROM kept) GROUP BY ALL
  UNION ALL SELECT image_id, x0, (x0 + x1) // 2 FROM run WHERE (image_id, x0) NOT IN (SELECT (image_id, x0) FROM cand))"""
HST = """
hb AS (SELECT image_id, frame, ((r >> 6) << 4) + ((g >> 6) << 2) + (b >> 6) AS bin, count(*) AS n FROM fr WHERE a > 10 GROUP BY ALL),
hs AS (SELECT image_id, frame, bin, n::double / sum(n) OVER (PARTITION BY image_id, frame) AS share FROM hb)"""
LOO = """
nf AS (SELECT image_id, count(DISTINCT frame) AS n FROM fr GROUP BY ALL),
ids AS (SELECT DISTINCT image_id, frame FROM fr),
lo AS (SELECT frame, image_id, sum(least(share, rest / (n - 1))) AS similarity FROM (SELECT hs.*, n, sum(share) OVER (PARTITION BY image_id, bin) - share AS rest FROM hs JOIN nf USING (image_id) WHERE n > 1) GROUP BY ALL),
loo AS (SELECT image_id, frame, coalesce(similarity, 0) AS similarity FROM ids LEFT JOIN lo USING (image_id, frame))"""
REP = """
rep AS (SELECT image_id, frame, max(w)::int AS width, max(h)::int AS height, count(*) FILTER (a > 10) AS content, count(*) FILTER (a > 10 AND (x < 2 OR x >= w - 2 OR y < 2 OR y >= h - 2)) AS edge,
  count(*) FILTER (a > 10 AND sqrt((r - 255) ** 2 + g ** 2 + (b - 255) ** 2) <= 70 AND r > 150 AND g < 110 AND b > 150) AS residue FROM fr GROUP BY ALL)"""
ADJ = """
aj AS (SELECT *, lag(r) OVER o AS pr, lag(g) OVER o AS pg, lag(b) OVER o AS pb, lag(a) OVER o AS pa FROM fr WINDOW o AS (PARTITION BY image_id, x, y ORDER BY frame)),
ad AS (SELECT * FROM aj WHERE pa IS NOT NULL AND (a > 10 OR pa > 10))"""
MOT = "mo AS (SELECT image_id, avg(m) AS motion FROM (SELECT image_id, frame, sum(abs(r - pr) + abs(g - pg) + abs(b - pb) + abs(a - pa))::double / 1020 / count(*) AS m FROM ad GROUP BY ALL) GROUP BY ALL)"
IDN = """idn AS (SELECT image_id, avg(i) AS identity FROM (SELECT image_id, frame, 1 - avg(least((sqrt(0.299::double * (r - pr) ** 2 + 0.587::double * (g - pg) ** 2 + 0.114::double * (b - pb) ** 2) + 0.5::double * abs(a - pa)) / 382.5::double, 1)) AS i FROM ad GROUP BY ALL) GROUP BY ALL)"""
CON = """
ty AS (SELECT image_id, frame, min(y) FILTER (a > 10) AS top, max(y) FILTER (a > 10) AS bottom FROM fr GROUP BY ALL),
tz AS (SELECT image_id, abs(top - avg(top) OVER (PARTITION BY image_id)) AS dt, abs(bottom - avg(bottom) OVER (PARTITION BY image_id)) AS db FROM ty),
con AS (SELECT image_id, 0.75::double * (1 - least(avg(db) / 3.2::double, 1)) + 0.25::double * (1 - least(avg(dt) / 8.96::double, 1)) AS contact FROM tz GROUP BY ALL)"""
CUT = """
sp AS (SELECT image_id, expected AS n, 96::double / expected AS ideal, greatest(2, floor(96::double / expected * 0.45::double)::int) AS mw FROM s),
k1 AS (SELECT image_id, n, ideal, mw, pos AS last, 0.0::double + mass + 0.0015::double * (pos - ideal) * (pos - ideal) AS cost, [pos] AS cuts FROM sp JOIN smo USING (image_id) WHERE pos >= mw AND pos <= 96 - (n - 1) * mw),
k2 AS (SELECT * FROM (SELECT k1.image_id, n, ideal, mw, pos AS last, cost + mass + 0.0015::double * (pos - last - ideal) * (pos - last - ideal) AS cost, list_append(cuts, pos) AS cuts,
  row_number() OVER (PARTITION BY k1.image_id, pos ORDER BY cost + mass + 0.0015::double * (pos - last - ideal) * (pos - last - ideal), last) AS rn FROM k1 JOIN smo USING (image_id) WHERE n > 2 AND pos >= last + mw AND pos >= 2 * mw AND pos <= 96 - (n - 2) * mw) WHERE rn = 1),
k3 AS (SELECT * FROM (SELECT k2.image_id, n, ideal, mw, pos AS last, cost + mass + 0.0015::double * (pos - last - ideal) * (pos - last - ideal) AS cost, list_append(cuts, pos) AS cuts,
  row_number() OVER (PARTITION BY k2.image_id, pos ORDER BY cost + mass + 0.0015::double * (pos - last - ideal) * (pos - last - ideal), last) AS rn FROM k2 JOIN smo USING (image_id) WHERE n > 3 AND pos >= last + mw AND pos >= 3 * mw AND pos <= 96 - (n - 3) * mw) WHERE rn = 1),
ends AS (SELECT image_id, ideal, last, cost, cuts FROM k1 WHERE n = 2 UNION ALL SELECT image_id, ideal, last, cost, cuts FROM k2 WHERE n = 3 UNION ALL SELECT image_id, ideal, last, cost, cuts FROM k3 WHERE n = 4),
cut AS (SELECT image_id, cuts FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cost + 0.0015::double * (96 - last - ideal) * (96 - last - ideal), last) AS rn FROM ends) WHERE rn = 1)"""
CMP = """
on_ AS (SELECT image_id, x, y, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS isl FROM mat WHERE a > 10),
rn AS MATERIALIZED (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y * 96 + min(x) AS id FROM on_ GROUP BY image_id, y, isl),
ed AS MATERIALIZED (SELECT a.image_id, a.id AS u, b.id AS v FROM rn a JOIN rn b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
rc(image_id, u, v) AS (SELECT image_id, id, id FROM rn UNION SELECT rc.image_id, rc.u, ed.v FROM rc JOIN ed ON rc.image_id = ed.image_id AND rc.v = ed.u),
rt AS (SELECT image_id, u AS id, min(v) AS root FROM rc GROUP BY ALL),
lb AS (SELECT rn.image_id, x0, x1, y, dense_rank() OVER (PARTITION BY rn.image_id ORDER BY root) - 1 AS label FROM rn JOIN rt ON rn.image_id = rt.image_id AND rn.id = rt.id)"""
GIF = """
gb AS (SELECT image_id, ((r >> 3) << 10) + ((g >> 3) << 5) + (b >> 3) AS bucket, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM mat WHERE a >= 128 GROUP BY ALL),
gif AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bucket) AS rank, (r // n)::int AS r, (g // n)::int AS g, (b // n)::int AS b, n FROM gb)"""
NEA = """
dc AS (SELECT DISTINCT image_id, r, g, b FROM mat WHERE a >= 128),
nea AS (SELECT dc.image_id, dc.r, dc.g, dc.b, p.r AS pr, p.g AS pg, p.b AS pb FROM dc JOIN gif p USING (image_id) WHERE rank <= 8
  QUALIFY row_number() OVER (PARTITION BY dc.image_id, dc.r, dc.g, dc.b ORDER BY 2 * (dc.r - p.r) ** 2 + 4 * (dc.g - p.g) ** 2 + 3 * (dc.b - p.b) ** 2, rank) = 1)"""
BOX = """
bx AS (SELECT image_id, frame, min(x) FILTER (a > 10) AS x0, max(x) FILTER (a > 10) AS x1, min(y) FILTER (a > 10) AS y0, max(y) FILTER (a > 10) AS y1 FROM fr GROUP BY ALL),
box AS (SELECT image_id, frame, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 - x0 + 1, 0) AS w, coalesce(y1 - y0 + 1, 0) AS h FROM bx)"""
ATL = """
st AS (SELECT image_id, image_id // 4 AS sheet, (image_id % 4)::int AS row, (4 + image_id % 3 * 4)::int AS fps FROM s),
cel AS (SELECT sheet, image_id, row, frame, (frame * 64)::int AS x, row * 32 AS y, box.x AS trim_x, box.y AS trim_y, box.w AS trim_w, box.h AS trim_h, 32 AS pivot_x,
  max(box.y + box.h) OVER (PARTITION BY image_id) AS ground, 1000 // fps AS duration FROM box JOIN st USING (image_id)),
atl AS (SELECT * EXCLUDE (ground), least(CASE WHEN ground < 16 THEN 32 ELSE ground END, 32) AS pivot_y FROM cel)"""


def _lengths(line: str, along: str, name: str) -> str:
    return f"""
{name}_l AS (SELECT image_id, {line} AS ln, {along} AS p, a, abs(r - lag(r) OVER o) <= 12 AND abs(g - lag(g) OVER o) <= 12 AND abs(b - lag(b) OVER o) <= 12 AS near, lag(a) OVER o AS pa FROM mat WINDOW o AS (PARTITION BY image_id, {line} ORDER BY {along})),
{name}_n AS (SELECT *, sum(CASE WHEN (a <= 10 AND pa <= 10) OR (a > 10 AND pa > 10 AND near) THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, ln ORDER BY p) AS isl FROM {name}_l),
{name} AS (SELECT image_id, length FROM (SELECT image_id, ln, isl, count(*) AS length, max(isl) OVER (PARTITION BY image_id, ln) AS last FROM {name}_n GROUP BY image_id, ln, isl) WHERE isl < last AND length BETWEEN 2 AND 4)"""


LEN = f"{_lengths('y', 'x', 'la')},{_lengths('x', 'y', 'lc')}, len_ AS (SELECT image_id, length, count(*) AS n FROM (SELECT * FROM la UNION ALL SELECT * FROM lc) GROUP BY ALL)"


def _extent(source: str, out: str, keys: str = "image_id") -> str:
    return f"""
{out}_c AS (SELECT *, sum(mass) OVER (PARTITION BY {keys} ORDER BY pos) AS upto, sum(mass) OVER (PARTITION BY {keys}) AS al FROM {source}),
{out} AS (SELECT {keys}, coalesce(min(j.pos - i.pos + 1) FILTER (j.upto - (i.upto - i.mass) >= i.al * 0.8::double AND i.al > 0), 0)::int AS span FROM {out}_c i JOIN {out}_c j USING ({keys}) WHERE j.pos >= i.pos GROUP BY {keys})"""


def _step(before: str, out: str, k: int, name: str) -> str:
    """The k-th cut of parts (image_id, x0, x1, n, ideal, mw, last, cost, cuts)."""
    price = "cost + mass + 0.0015::double * (pos - last - ideal) * (pos - last - ideal)"
    return f"""
{out} AS (SELECT * FROM (SELECT b.image_id, x0, x1, n, ideal, mw, pos AS last, {price} AS cost, list_append(cuts, pos) AS cuts, row_number() OVER (PARTITION BY b.image_id, x0, pos ORDER BY {price}, last) AS rn
  FROM (SELECT * FROM {before} WHERE n > {k}) b JOIN smo ON smo.image_id = b.image_id AND pos >= last + mw AND pos >= x0 + {k} * mw AND pos <= x1 - (n - {k}) * mw) WHERE rn = 1)"""


def _parted(parts: str, p: str) -> str:
    """Spans of parts (image_id, x0, x1, n) cut into n: as {p}_sp."""
    cols = "image_id, x0, x1, n, ideal, mw, last, cost, cuts"
    return f"""
{p}_0 AS (SELECT image_id, x0, x1, n, (x1 - x0)::double / n AS ideal, greatest(2, floor((x1 - x0)::double / n * 0.45::double)::int) AS mw, x0 AS last, 0::double AS cost, []::bigint[] AS cuts FROM {parts} WHERE n > 1 AND x1 - x0 >= n),
{_step(p + '_0', p + '_1', 1, p)},{_step(p + '_1', p + '_2', 2, p)},{_step(p + '_2', p + '_3', 3, p)},
{p}_e AS (SELECT {cols} FROM {p}_1 WHERE n = 2 UNION ALL SELECT {cols} FROM {p}_2 WHERE n = 3 UNION ALL SELECT {cols} FROM {p}_3 WHERE n = 4),
{p}_c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x0 ORDER BY cost + 0.0015::double * (x1 - last - ideal) * (x1 - last - ideal), last) AS rn FROM {p}_e) WHERE rn = 1),
{p}_b AS (SELECT z.image_id, z.x0 AS s0, list_concat([z.x0::bigint], coalesce({p}_c.cuts, list_transform(range(1, z.n), lambda i: z.x0 + (z.x1 - z.x0) * i // z.n)), [z.x1::bigint]) AS e FROM {p}_0 z LEFT JOIN {p}_c ON {p}_c.image_id = z.image_id AND {p}_c.x0 = z.x0),
{p}_sp AS (SELECT image_id, unnest(list_transform(range(1, len(e)), lambda i: e[i])) AS x0, unnest(list_transform(range(1, len(e)), lambda i: e[i + 1])) AS x1 FROM {p}_b
  UNION ALL SELECT image_id, x0, x1 FROM {parts} WHERE n <= 1 OR x1 - x0 < n)"""


CNT = """me AS (SELECT image_id, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS med, count(*) AS nr FROM run GROUP BY ALL), pn AS (SELECT image_id, x0, count(*) AS n FROM pk GROUP BY ALL),
cap AS (SELECT run.image_id, run.x0, x1, nr, med, CASE WHEN nr > 1 THEN least(n, greatest(1, floor((x1 - run.x0)::double / med + 0.5::double)::int)) ELSE n END AS n FROM run JOIN pn ON run.image_id = pn.image_id AND run.x0 = pn.x0 JOIN me ON run.image_id = me.image_id),
cnt AS (SELECT image_id, x0, x1, (CASE WHEN nr > 1 AND n = 1 AND x1 - x0 > med * 1.45::double THEN 2 ELSE n END)::int AS n FROM cap)"""
SEG = f"""{CNT},{_parted('cnt', 'pa')},
tot AS (SELECT image_id, count(*) AS nf FROM pa_sp GROUP BY ALL), wid AS (SELECT image_id, sum(x1 - x0) AS content FROM run GROUP BY ALL),
frc AS (SELECT image_id, 0 AS x0, 96 AS x1, expected AS n FROM tot JOIN wid USING (image_id) JOIN s USING (image_id) WHERE nf <> expected AND content::double / expected >= 16 AND 96 // expected >= 16),
{_parted('frc', 'pf')},
segs AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY x0) - 1)::int AS seg, x0::int AS x0, x1::int AS x1 FROM (SELECT * FROM pa_sp WHERE image_id NOT IN (SELECT image_id FROM frc) UNION ALL SELECT * FROM pf_sp))"""

ORACLES = {
    "pixel_derive": f"WITH {PIX} SELECT image_id, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b, sum((r * 31 + g * 17 + b) * (x + 1) * (y + 1))::bigint AS mark FROM pix GROUP BY ALL",
    "ycbcr_project": f"WITH {BASE} SELECT image_id, round(avg(yy), 6) AS y, round(avg(cb), 6) AS cb, round(avg(cr), 6) AS cr FROM yc GROUP BY ALL",
    "ycc_round_trip": f"""WITH {BASE} SELECT image_id, max(abs(floor(least(255, greatest(0, yy + 1.402::double * (cr - 128))) + 0.5)::int - r) + abs(floor(least(255, greatest(0, yy - 0.344136::double * (cb - 128) - 0.714136::double * (cr - 128))) + 0.5)::int - g)
      + abs(floor(least(255, greatest(0, yy + 1.772::double * (cb - 128))) + 0.5)::int - b)) AS worst FROM yc GROUP BY ALL""",
    "matte_alpha": f"WITH {M} SELECT image_id, a, count(*) AS n FROM mat GROUP BY ALL",
    "despill": f"WITH {M} SELECT image_id, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b FROM mat GROUP BY ALL",
    "bg_key_mode": f"""WITH {BASE}, bag AS (SELECT *, (x < 19 AND y < 6)::int + (x >= 77 AND y < 6)::int + (x < 19 AND y >= 26)::int + (x >= 77 AND y >= 26)::int + (y = 0)::int + (y = 31)::int + (x = 0)::int + (x = 95)::int AS n, r > 150 AND b > 150 AND g < 120 AS mg,
      (trunc(cb)::int >> 3 << 6) + (trunc(cr)::int >> 3) AS bin FROM yc),
      bins AS (SELECT image_id, bin, sum(n) AS n, sum(r * n) AS r, sum(g * n) AS g, sum(b * n) AS b FROM bag WHERE n > 0 GROUP BY ALL),
      mg AS (SELECT image_id, sum(n) AS total, sum(n) FILTER (mg) AS mn, sum(r * n) FILTER (mg) AS r, sum(g * n) FILTER (mg) AS g, sum(b * n) FILTER (mg) AS b FROM bag WHERE n > 0 GROUP BY ALL),
      top AS (SELECT * FROM bins QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) = 1)
      SELECT image_id, (CASE WHEN mn > 0 AND mn >= total * 12 // 100 THEN mg.r // mn ELSE top.r // top.n END)::int AS r, (CASE WHEN mn > 0 AND mn >= total * 12 // 100 THEN mg.g // mn ELSE top.g // top.n END)::int AS g,
      (CASE WHEN mn > 0 AND mn >= total * 12 // 100 THEN mg.b // mn ELSE top.b // top.n END)::int AS b FROM top JOIN mg USING (image_id)""",
    "magenta_residue": f"WITH {BASE} SELECT image_id, round(avg((d < 55)::int), 6) AS share FROM yd GROUP BY ALL",
    "column_projection": f"WITH {M},{PRO} SELECT * FROM pro",
    "profile_smooth": f"WITH {P_} SELECT image_id, pos, round(mass, 6) AS mass FROM smo",
    "content_runs": f"WITH {P_},{_runs('smo', 'run', False)} SELECT image_id, x0, x1, round(mass, 6) AS mass, round(peak, 6) AS peak FROM run",
    "drop_minor_runs": f"WITH {R_} SELECT image_id, x0, x1 FROM run",
    "upper_median_width": f"WITH {R_} SELECT image_id, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS width FROM run GROUP BY ALL",
    "pose_peaks": f"WITH {R_},{PK} SELECT image_id, x0, pos FROM pk",
    "pose_counts": f"""WITH {R_},{PK}, me AS (SELECT image_id, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS med, count(*) AS nr FROM run GROUP BY ALL), pn AS (SELECT image_id, x0, count(*) AS n FROM pk GROUP BY ALL),
      cap AS (SELECT run.image_id, run.x0, x1, nr, med, CASE WHEN nr > 1 THEN least(n, greatest(1, floor((x1 - run.x0)::double / med + 0.5::double)::int)) ELSE n END AS n FROM run JOIN pn ON run.image_id = pn.image_id AND run.x0 = pn.x0 JOIN me ON run.image_id = me.image_id)
      SELECT image_id, x0, x1, (CASE WHEN nr > 1 AND n = 1 AND x1 - x0 > med * 1.45::double THEN 2 ELSE n END)::int AS n FROM cap""",
    "dp_cut": f"WITH {P_},{CUT} SELECT image_id, array_to_string(cuts, ',') AS cuts FROM cut",
    "pose_count_accuracy": f"""WITH {R_},{PK},{SEG}, n AS (SELECT image_id, count(*) AS found FROM segs GROUP BY ALL), j AS (SELECT expected, coalesce(found, 0) AS found FROM s LEFT JOIN n USING (image_id))
      SELECT expected, count(*) AS strips, count(*) FILTER (found = expected) AS exact, sum(found)::bigint AS found, round(avg((found = expected)::int), 6) AS accuracy, avg((found = expected)::int) >= 0.85 AS passed FROM j GROUP BY ROLLUP (expected)""",
    "row_bands": f"""WITH {M}, pro AS (SELECT image_id, y AS pos, sum(a)::double AS mass FROM mat GROUP BY ALL),{SMO},{_runs('smo', 'run', False)} SELECT image_id, x0 AS y0, x1 AS y1 FROM run""",
    "bbox": f"WITH {F_},{BOX} SELECT * FROM box",
    "weighted_centroid": f"WITH {F_} SELECT image_id, frame, round(sum(x * a)::double / sum(a), 6) AS cx, round(sum(y * a)::double / sum(a), 6) AS cy, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM fr WHERE a > 10 GROUP BY ALL",
    "body_extent": f"WITH {M},{PRO}, pry AS (SELECT image_id, y AS pos, sum(a)::double AS mass FROM mat GROUP BY ALL),{_extent('pro', 'ex')},{_extent('pry', 'ey')} SELECT image_id, greatest(ex.span, 1) AS body_w, greatest(ey.span, 1) AS body_h FROM ex JOIN ey USING (image_id)",
    "components": f"WITH RECURSIVE {M},{CMP} SELECT image_id, label::int AS label, sum(x1 - x0 + 1)::bigint AS n, min(x0) AS min_x, min(y) AS min_y, max(x1) AS max_x, max(y) AS max_y FROM lb GROUP BY ALL",
    "label_owner_rangejoin": f"""WITH RECURSIVE {M},{CMP}, px AS (SELECT image_id, label, unnest(range(x0, x1 + 1)) AS x FROM lb), sg AS (SELECT image_id, x // (96 // expected) AS seg, label, count(*) AS n FROM px JOIN s USING (image_id) GROUP BY ALL)
      SELECT image_id, label::int AS label, seg::int AS owner FROM sg QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY n DESC, seg) = 1""",
    "flood_clear": f"""WITH RECURSIVE {BASE}, ky AS MATERIALIZED (SELECT image_id, x, y FROM yd WHERE d <= 88),
      fl(image_id, x, y) AS (SELECT image_id, x, y FROM ky WHERE x IN (0, 95) OR y IN (0, 31) UNION SELECT ky.image_id, ky.x, ky.y FROM fl, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy), ky WHERE ky.image_id = fl.image_id AND ky.x = fl.x + dx AND ky.y = fl.y + dy)
      SELECT image_id, count(*) AS n, sum(y * 96 + x)::bigint AS mark FROM fl GROUP BY ALL""",
    "alpha_cleanup": f"""WITH {M}, nb AS (SELECT m.image_id, m.x + dx AS x, m.y + dy AS y, count(*) AS n FROM mat m, range(-1, 2) p(dx), range(-1, 2) q(dy) WHERE m.a > 10 AND (dx <> 0 OR dy <> 0) GROUP BY ALL),
      ca AS (SELECT mat.image_id, CASE WHEN a > 10 AND coalesce(n, 0) = 0 THEN 0 WHEN a <= 10 AND coalesce(n, 0) >= 7 THEN 255 ELSE a END AS a FROM mat LEFT JOIN nb ON mat.image_id = nb.image_id AND mat.x = nb.x AND mat.y = nb.y)
      SELECT image_id, sum(a)::bigint AS alpha, count(*) FILTER (a > 10) AS opaque FROM ca GROUP BY ALL""",
    "hist64": f"WITH {F_},{HST} SELECT image_id, frame, bin, round(share, 6) AS share FROM hs",
    "loo_palette_similarity": f"WITH {F_},{HST},{LOO} SELECT image_id, frame, round(similarity, 6) AS similarity FROM loo",
    "base_similarity": f"""WITH {F_},{HST}, sh AS (SELECT image_id FROM fr WHERE frame = 0 GROUP BY ALL HAVING avg((a <= 10)::int) >= 0.05), b AS (SELECT image_id, bin, share AS ref FROM hs WHERE frame = 0),
      sm AS (SELECT image_id, frame, sum(least(share, ref)) AS v FROM hs JOIN b USING (image_id, bin) WHERE frame > 0 GROUP BY ALL), ids AS (SELECT DISTINCT image_id, frame FROM fr JOIN sh USING (image_id) WHERE frame > 0)
      SELECT image_id, round(avg(coalesce(v, 0)), 6) AS similarity FROM ids LEFT JOIN sm USING (image_id, frame) GROUP BY ALL""",
    "frame_reports": f"WITH {F_},{REP} SELECT * FROM rep",
    "inspect_rules": f"""WITH {F_},{HST},{LOO},{REP}, pe AS (SELECT image_id, list_sort(list(content))[count(*) // 2 + 1] AS med, count(*) AS n, sum(width * height) // count(*) AS area FROM rep GROUP BY ALL),
      j AS (SELECT rep.*, similarity, med, n, floor(area * 0.25::double)::int AS co, CASE WHEN n >= 3 AND med > 0 THEN content::double / med END AS ratio FROM rep JOIN pe USING (image_id) LEFT JOIN loo USING (image_id, frame))
      SELECT image_id, frame, content, edge, residue, round(similarity, 6) AS similarity,
      concat_ws(',', CASE WHEN content < greatest(400, width * height // 100) THEN 'empty' END, CASE WHEN residue > 120 THEN 'residue' END, CASE WHEN similarity < 0.45 THEN 'drift' END) AS errors,
      concat_ws(',', CASE WHEN edge > 24 THEN 'edge' END, CASE WHEN co > 0 AND content < co THEN 'less_content' END, CASE WHEN ratio < 0.35 THEN 'too_small' END, CASE WHEN ratio > 2.75 THEN 'too_large' END, CASE WHEN similarity >= 0.45 AND similarity < 0.65 THEN 'drift' END) AS warnings FROM j""",
    "motion_presence": f"WITH {F_},{ADJ},{MOT} SELECT image_id, round(motion, 6) AS motion FROM mo",
    "pairwise_identity": f"WITH {F_},{ADJ},{IDN} SELECT image_id, round(identity, 6) AS identity FROM idn",
    "contact_score": f"WITH {F_},{CON} SELECT image_id, round(contact, 6) AS contact FROM con",
    "score_overall": f"WITH {F_},{ADJ},{MOT},{IDN},{CON} SELECT image_id, round(0.5::double * identity + 0.3::double * motion + 0.2::double * contact, 6) AS overall FROM mo JOIN idn USING (image_id) JOIN con USING (image_id)",
    "jitter_report": f"""WITH {F_}, c AS (SELECT image_id, frame, sum(x * a)::double / sum(a) AS cx, sum(y * a)::double / sum(a) AS cy, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM fr WHERE a > 10 GROUP BY ALL)
      SELECT image_id, round(max(cx) - min(cx), 6) AS cx, round(max(cy) - min(cy), 6) AS cy, max(w) - min(w) AS w, max(h) - min(h) AS h FROM c GROUP BY ALL""",
    "distinct_colors": f"WITH {M} SELECT image_id, count(DISTINCT (r, g, b)) AS colours, count(*) AS pixels FROM mat WHERE a > 10 GROUP BY ALL",
    "gif_top255": f"WITH {M},{GIF} SELECT * FROM gif WHERE rank <= 24",
    "systematic_sample": f"""WITH {F_}, st AS (SELECT image_id, greatest(1, count(*) // 256) AS step FROM fr GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY frame, y, x) - 1 AS i FROM fr WHERE a > 10)
      SELECT image_id, count(*) AS n, sum(r + g * 256 + b * 65536)::bigint AS mark FROM o JOIN st USING (image_id) WHERE i % step = 0 GROUP BY ALL""",
    "nearest_palette": f"WITH {M},{GIF},{NEA} SELECT * FROM nea",
    "apply_palette": f"""WITH {M},{GIF},{NEA} SELECT image_id, sum(coalesce(pr, 0))::bigint AS sum_r, sum(coalesce(pg, 0))::bigint AS sum_g, sum(coalesce(pb, 0))::bigint AS sum_b, sum(CASE WHEN a >= 128 THEN 255 ELSE 0 END)::bigint AS sum_a
      FROM (SELECT mat.image_id, a, CASE WHEN a >= 128 THEN pr END AS pr, CASE WHEN a >= 128 THEN pg END AS pg, CASE WHEN a >= 128 THEN pb END AS pb FROM mat LEFT JOIN nea ON mat.image_id = nea.image_id AND mat.r = nea.r AND mat.g = nea.g AND mat.b = nea.b) GROUP BY ALL""",
    "pixel_scale_runs": f"WITH {M},{LEN} SELECT * FROM len_",
    "pixel_scale": f"WITH {M},{LEN}, be AS (SELECT image_id, length FROM len_ QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n * length DESC, length) = 1) SELECT image_id, coalesce(length, 1)::int AS scale FROM s LEFT JOIN be USING (image_id)",
    "block_mode": f"""WITH {M}, c AS (SELECT image_id, x // 4 AS bx, y // 4 AS "by", r, g, b, count(*) AS n FROM mat WHERE a > 10 GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY image_id, bx, "by") AS al FROM c)
      SELECT image_id, bx, "by", r, g, b FROM t WHERE al * 2 >= 16 QUALIFY row_number() OVER (PARTITION BY image_id, bx, "by" ORDER BY n DESC, r, g, b) = 1""",
    "mirror": f"WITH {F_} SELECT image_id, frame, sum((w - 1 - x) * a)::bigint AS mark FROM fr GROUP BY ALL",
    "direction_set_union": f"""WITH {F_}, g0 AS (SELECT *, ['south', 'east', 'north', 'south-east', 'north-east'][image_id % 5 + 1] AS direction FROM fr WHERE frame = 0), mi(direction, goal) AS (VALUES ('east', 'west'), ('south-east', 'south-west'), ('north-east', 'north-west')),
      al AS (SELECT direction, false AS mirrored, image_id, x, a FROM g0 UNION ALL SELECT goal, true, image_id, w - 1 - x, a FROM g0 JOIN mi USING (direction)) SELECT direction, mirrored, count(DISTINCT image_id) AS images, sum(x * a)::bigint AS mark FROM al GROUP BY ALL""",
    "atlas_rects": f"WITH {F_},{BOX},{ATL} SELECT * FROM atl",
    "sheet_json": f"""WITH {F_},{BOX},{ATL}, ix AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row, image_id, frame) - 1 AS i FROM atl), tg AS (SELECT sheet, row, image_id, min(i) AS f, max(i) AS t FROM ix GROUP BY ALL),
      tl AS (SELECT sheet, string_agg(image_id || '-' || f || '-' || t || CASE WHEN image_id % 3 = 0 THEN '-1' ELSE '' END, ',' ORDER BY row) AS tags FROM tg GROUP BY ALL)
      SELECT sheet, count(*) AS n_frames, any_value(tags) AS tags, sum(duration)::int AS ms, (max(x) + 64)::int AS width, (max(y) + 32)::int AS height FROM ix JOIN tl USING (sheet) GROUP BY ALL""",
    "strip_concat": f"WITH {F_} SELECT image_id, max(frame * w + x) + 1 AS width, sum((frame * w + x) * a)::bigint AS mark FROM fr GROUP BY ALL",
    "cell_placement": f"""WITH {F_},{BOX}, px AS (SELECT image_id, frame, x AS pos, sum(a)::double AS mass FROM fr GROUP BY ALL), py AS (SELECT image_id, frame, y AS pos, sum(a)::double AS mass FROM fr GROUP BY ALL),{_extent('px', 'ex', 'image_id, frame')},{_extent('py', 'ey', 'image_id, frame')},
      ce AS (SELECT image_id, frame, sum(x * a)::double / sum(a) AS cx FROM fr WHERE a > 10 GROUP BY ALL),
      j AS (SELECT box.*, cx, ex.span AS bw, ey.span AS bh, y + h - 1 AS bottom FROM box JOIN ce USING (image_id, frame) JOIN ex USING (image_id, frame) JOIN ey USING (image_id, frame) WHERE w > 0),
      k1 AS (SELECT *, least(least(1, 24::double / max(bw) OVER p, 24::double / max(bh) OVER p), 24::double / w, 24::double / h) AS sc, max(bottom) OVER p AS base FROM j WINDOW p AS (PARTITION BY image_id)),
      k2 AS (SELECT *, greatest(1, trunc(w * sc + 0.5::double)::int) AS sw, greatest(1, trunc(h * sc + 0.5::double)::int) AS sh, greatest(0, trunc(16::double - (cx - x) * sc + 0.5::double)::int) AS lf FROM k1)
      SELECT image_id, frame AS seg, round(sc, 6) AS scale, sw, sh, CASE WHEN lf + sw > 32 THEN 32 - sw ELSE lf END AS "left", greatest(0, 28 - trunc((base - bottom) * sc + 0.5::double)::int - sh) AS top FROM k2""",
    "equal_split_crossings": f"""WITH {M},{OPQ}, li AS (SELECT image_id, unnest(range(1, expected)) AS kk2, expected FROM s), tp AS (SELECT image_id, max(mass) AS top FROM pro GROUP BY ALL)
      SELECT image_id, count(*) FILTER (mass > 0.06::double * top) AS crossed FROM li JOIN tp USING (image_id) JOIN pro ON pro.image_id = li.image_id AND pro.pos = kk2 * 96 // expected GROUP BY ALL""",
    "frame_balance": f"WITH {F_}, n AS (SELECT image_id, frame, count(*) FILTER (a > 10) AS n FROM fr GROUP BY ALL) SELECT image_id, min(n) AS least, max(n) AS most, round(CASE WHEN min(n) > 0 THEN max(n)::double / min(n) ELSE 999 END, 6) AS ratio FROM n GROUP BY ALL",
    "centroid_spread": f"WITH {F_}, c AS (SELECT image_id, frame, coalesce(avg(x) FILTER (a > 10), max(w) / 2) AS c FROM fr GROUP BY ALL) SELECT image_id, round(stddev_pop(c), 6) AS spread FROM c GROUP BY ALL",
    "body_heights": f"WITH {F_}, c AS (SELECT image_id, frame, x, max(y) FILTER (a > 10) - min(y) FILTER (a > 10) + 1 AS h FROM fr GROUP BY ALL) SELECT image_id, frame, coalesce(max(h), 0) AS height FROM c GROUP BY ALL",
    "frame_metrics": f"""WITH {F_} SELECT image_id, frame, count(*) FILTER (a > 10 AND r > 150 AND b > 150 AND g < 130) AS residue, count(*) FILTER (a > 10 AND r - g > 40 AND b - g > 40 AND NOT (r > 200 AND b > 200 AND g < 80)) AS halo,
      count(*) FILTER (a > 10 AND (x < 2 OR x >= w - 2)) AS edge, round(coalesce(avg(x) FILTER (a > 10 AND b > 140 AND b - r > 40 AND g < 180), 0), 6) AS torso FROM fr GROUP BY ALL""",
    "onion_skin": f"""WITH RECURSIVE {F_}, on_(image_id, x, y, f, r, g, b) AS (SELECT DISTINCT image_id, x, y, -1, 0, 0, 0 FROM fr UNION ALL SELECT o.image_id, o.x, o.y, fr.frame, CASE WHEN fr.a > 10 THEN (o.r * 165 + fr.r * 90) // 255 ELSE o.r END,
      CASE WHEN fr.a > 10 THEN (o.g * 165 + fr.g * 90) // 255 ELSE o.g END, CASE WHEN fr.a > 10 THEN (o.b * 165 + fr.b * 90) // 255 ELSE o.b END FROM on_ o JOIN fr ON fr.image_id = o.image_id AND fr.x = o.x AND fr.y = o.y AND fr.frame = o.f + 1)
      SELECT image_id, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b FROM (SELECT * FROM on_ QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY f DESC) = 1) GROUP BY ALL""",
    "segment_strip": f"WITH {R_},{PK},{SEG} SELECT * FROM segs",
    "extract_contents": f"""WITH RECURSIVE {R_},{PK},{SEG},{CMP}, px AS (SELECT lb.image_id, label, y, unnest(range(lb.x0, lb.x1 + 1)) AS x FROM lb),
      ow AS (SELECT px.image_id, label, seg, count(*) AS n FROM px JOIN segs ON segs.image_id = px.image_id AND px.x >= segs.x0 AND px.x < segs.x1 GROUP BY ALL), own AS (SELECT * FROM ow QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY n DESC, seg) = 1)
      SELECT px.image_id, seg, min(px.x)::int AS min_x, min(px.y)::int AS min_y, max(px.x)::int AS max_x, max(px.y)::int AS max_y, round(sum(px.x * a)::double / sum(a), 6) AS cx FROM px JOIN own ON own.image_id = px.image_id AND own.label = px.label JOIN mat ON mat.image_id = px.image_id AND mat.x = px.x AND mat.y = px.y GROUP BY px.image_id, seg""",
    "tight_crop": f"WITH {F_},{BOX} SELECT fr.image_id, fr.frame, max(fr.x - box.x) AS max_x, max(fr.y - box.y) AS max_y, sum((fr.x - box.x) * a)::bigint AS mark FROM fr JOIN box ON fr.image_id = box.image_id AND fr.frame = box.frame WHERE box.w > 0 AND fr.x >= box.x AND fr.x < box.x + box.w AND fr.y >= box.y AND fr.y < box.y + box.h GROUP BY ALL",
    "rescale_round_trip": f"WITH {M} SELECT m.image_id, count(*) AS n, sum((m.x + 1) * (m.y + 1) * o.a)::bigint AS mark FROM mat m JOIN mat o ON o.image_id = m.image_id AND o.x = m.x // 2 * 2 AND o.y = m.y // 2 * 2 GROUP BY ALL",
    "draw_rects": f"""WITH {F_},{BOX}, t AS (SELECT image_id, frame, w, h, CASE WHEN image_id % 4 = 0 THEN 1 ELSE (image_id % 9)::double / 4 END AS sc, CASE WHEN image_id % 4 = 0 THEN 0 ELSE frame END AS d FROM box WHERE w > 0),
      u AS (SELECT *, least(1.5, greatest(0.5, sc))::double AS s FROM t) SELECT image_id, frame, round(32 - w * s / 2 + d + 6, 6)::double AS draw_x, round(64 - h * s - d + 6, 6)::double AS draw_y, round(w * s, 6)::double AS draw_w, round(h * s, 6)::double AS draw_h, sc = 1 AND d = 0 AS plain FROM u""",
    "remove_background": f"""WITH RECURSIVE {M}, ky AS MATERIALIZED (SELECT image_id, x, y FROM yd WHERE d <= 88),
      fl(image_id, x, y) AS (SELECT image_id, x, y FROM ky WHERE x IN (0, 95) OR y IN (0, 31) UNION SELECT ky.image_id, ky.x, ky.y FROM fl, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy), ky WHERE ky.image_id = fl.image_id AND ky.x = fl.x + dx AND ky.y = fl.y + dy),
      fm AS MATERIALIZED (SELECT mat.image_id, mat.x, mat.y, r, g, b, CASE WHEN fl.x IS NULL THEN a ELSE 0 END AS a FROM mat LEFT JOIN fl ON fl.image_id = mat.image_id AND fl.x = mat.x AND fl.y = mat.y),
      nb AS (SELECT m.image_id, m.x + dx AS x, m.y + dy AS y, count(*) AS n FROM fm m, range(-1, 2) p(dx), range(-1, 2) q(dy) WHERE m.a > 10 AND (dx <> 0 OR dy <> 0) GROUP BY ALL),
      ca AS (SELECT fm.image_id, r, g, b, CASE WHEN a > 10 AND coalesce(n, 0) = 0 THEN 0 WHEN a <= 10 AND coalesce(n, 0) >= 7 THEN 255 ELSE a END AS a FROM fm LEFT JOIN nb ON fm.image_id = nb.image_id AND fm.x = nb.x AND fm.y = nb.y)
      SELECT image_id, sum(r) FILTER (a > 0)::bigint AS sum_r, sum(g) FILTER (a > 0)::bigint AS sum_g, sum(b) FILTER (a > 0)::bigint AS sum_b, sum(a)::bigint AS sum_a FROM ca GROUP BY ALL""",
    "grid_bands": f"""WITH {M}, pro AS (SELECT image_id // 2 AS image_id, y + 32 * (image_id % 2) AS pos, sum(a)::double AS mass FROM mat GROUP BY ALL),{SMO},{_runs('smo', 'run')},
      b AS (SELECT image_id, row_number() OVER o - 1 AS band, coalesce((lag(x1) OVER o + x0) // 2, 0) AS y0, count(*) OVER (PARTITION BY image_id) AS n FROM run WINDOW o AS (PARTITION BY image_id ORDER BY x0))
      SELECT image_id, band::int AS band, y0::int AS y0, coalesce(lead(y0) OVER (PARTITION BY image_id ORDER BY band), 64)::int AS y1 FROM b WHERE n = 2""",
}

_PLACED = """k2 AS (SELECT *, greatest(1, trunc(w * sc + 0.5::double)::int) AS sw, greatest(1, trunc(h * sc + 0.5::double)::int) AS sh, greatest(0, trunc(16::double - (cx - x) * sc + 0.5::double)::int) AS lf FROM k1)"""
_GAPS = f"""{M}, gc AS (SELECT DISTINCT image_id, x AS pos FROM mat WHERE a > 10), gn AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY image_id ORDER BY pos) <= 6 THEN 0 ELSE 1 END AS new FROM gc),
gr AS (SELECT image_id, run, min(pos) AS x0, max(pos) AS x1 FROM (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY pos) AS run FROM gn) GROUP BY ALL),
gx AS (SELECT gr.image_id, (row_number() OVER (PARTITION BY gr.image_id ORDER BY x0) - 1)::int AS seg, x0, x1 FROM gr),
gap AS (SELECT gx.image_id, seg, min(x)::int AS min_x, min(y)::int AS min_y, max(x)::int AS max_x, max(y)::int AS max_y FROM gx JOIN mat ON mat.image_id = gx.image_id AND mat.a > 10 AND mat.x BETWEEN gx.x0 AND gx.x1 GROUP BY ALL)"""
_RULES = "rules(o, rule, hint) AS (VALUES (1, 'empty', 'fill every column'), (2, 'edge', 'keep clear of the edges'), (3, 'residue', 'avoid the key colour'), (4, 'less_content', 'keep one size'), (5, 'too_small', 'keep one scale'), (6, 'too_large', 'keep figures apart'), (7, 'drift', 'keep the character''s colours'), (8, 'other_character', 'copy the reference'))"


def _frame_lengths(line: str, along: str, name: str) -> str:
    return f"""
{name}_l AS (SELECT image_id, frame, least(32, least(w, h) // 8) AS lim, {line} AS ln, {along} AS p, a, abs(r - lag(r) OVER o) <= 12 AND abs(g - lag(g) OVER o) <= 12 AND abs(b - lag(b) OVER o) <= 12 AS near, lag(a) OVER o AS pa FROM pp WHERE least(w, h) >= 32 WINDOW o AS (PARTITION BY image_id, frame, {line} ORDER BY {along})),
{name}_n AS (SELECT *, sum(CASE WHEN (a <= 10 AND pa <= 10) OR (a > 10 AND pa > 10 AND near) THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, frame, ln ORDER BY p) AS isl FROM {name}_l),
{name} AS (SELECT image_id, frame, length FROM (SELECT image_id, frame, ln, isl, max(lim) AS lim, count(*) AS length, max(isl) OVER (PARTITION BY image_id, frame, ln) AS last FROM {name}_n GROUP BY image_id, frame, ln, isl) WHERE isl < last AND length BETWEEN 2 AND lim)"""


ORACLES |= {
    "opaque_columns": f"WITH {M},{OPQ} SELECT * FROM pro",
    "gap_run_boxes": f"WITH {_GAPS} SELECT * FROM gap",
    "shared_box_placement": f"""WITH {_GAPS}, w1 AS (SELECT *, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h, max(max_y) OVER (PARTITION BY image_id) AS base FROM gap),
      w2 AS (SELECT *, least(1.0::double, 24::double / max(w) OVER p, 24::double / max(h + base - max_y) OVER p) AS sc FROM w1 WINDOW p AS (PARTITION BY image_id)), w3 AS (SELECT *, trunc(w * sc + 0.5::double)::int AS sw, trunc(h * sc + 0.5::double)::int AS sh FROM w2)
      SELECT image_id, seg, round(sc, 6) AS scale, sw, sh, trunc((32 - sw)::double / 2)::int AS "left", greatest(0, 28 - trunc((base - max_y) * sc + 0.5::double)::int - sh) AS top FROM w3""",
    "equal_split_placement": f"""WITH {M}, e AS (SELECT image_id, (((x + 1) * expected - 1) // 96)::int AS seg, x, y FROM mat WHERE a > 10), w1 AS (SELECT image_id, seg, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM e GROUP BY ALL),
      w2 AS (SELECT *, least(1.0::double, 24::double / h) AS sc FROM w1), w3 AS (SELECT *, trunc(w * sc + 0.5::double)::int AS sw, trunc(h * sc + 0.5::double)::int AS sh FROM w2) SELECT image_id, seg, round(sc, 6) AS scale, sw, sh, trunc((32 - sw)::double / 2)::int AS "left", 28 - sh AS top FROM w3""",
    "mean_body_height": f"""WITH {F_}, c AS (SELECT image_id, frame, x, max(y) FILTER (a > 10) - min(y) FILTER (a > 10) + 1 AS h FROM fr GROUP BY ALL), d AS (SELECT image_id, frame, coalesce(max(h), 0) AS h FROM c GROUP BY ALL)
      SELECT image_id, round(coalesce(avg(h) FILTER (frame <> 0), 0), 6) AS height FROM d GROUP BY ALL""",
    "torso_spread": f"WITH {F_}, t AS (SELECT image_id, frame, coalesce(avg(x) FILTER (a > 10 AND b > 140 AND b - r > 40 AND g < 180), 0) AS t FROM fr GROUP BY ALL) SELECT image_id, round(stddev_pop(t), 6) AS spread FROM t GROUP BY ALL",
    "plain_cut": f"""WITH {PIX}, c AS (SELECT *, CASE WHEN (r - 255) ** 2 + g ** 2 + (b - 255) ** 2 <= 22500 THEN 0 ELSE a END AS al FROM pix)
      SELECT image_id, count(*) FILTER (al > 10) AS opaque, sum(r) FILTER (al > 0)::bigint AS sum_r, sum(g) FILTER (al > 0)::bigint AS sum_g, sum(b) FILTER (al > 0)::bigint AS sum_b FROM c GROUP BY ALL""",
    "shade_gradient": f"""WITH {PIX}, f AS (SELECT *, 0.6::double + 0.4::double * (x + y)::double / 128 AS f, r > 200 AND b > 200 AND g < 80 AS k FROM pix),
      o AS (SELECT image_id, CASE WHEN k THEN r ELSE least(255, floor(r * f + 0.5::double)::int) END AS r, CASE WHEN k THEN g ELSE least(255, floor(g * f + 0.5::double)::int) END AS g, CASE WHEN k THEN b ELSE least(255, floor(b * f + 0.5::double)::int) END AS b FROM f)
      SELECT image_id, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b, count(DISTINCT (r, g, b)) AS colours FROM o GROUP BY ALL""",
    "over_ground": f"""WITH {M}, o AS (SELECT image_id, floor((r * a * 255 + 200 * 255 * (255 - a))::double / 65025 + 0.5)::int AS r, floor((g * a * 255 + 204 * 255 * (255 - a))::double / 65025 + 0.5)::int AS g, floor((b * a * 255 + 210 * 255 * (255 - a))::double / 65025 + 0.5)::int AS b FROM mat)
      SELECT image_id, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b, (count(*) * 255)::bigint AS sum_a FROM o GROUP BY ALL""",
    "silhouette_outline": f"""WITH {F_}, so AS (SELECT image_id, frame, x, y FROM fr WHERE a > 0), nr AS (SELECT DISTINCT so.image_id, so.frame, x + dx AS x, y + dy AS y FROM so, range(-1, 2) p(dx), range(-1, 2) q(dy)),
      rg AS (SELECT fr.image_id, fr.frame, count(*) AS ring, sum(fr.y * 100 + fr.x)::bigint AS mark FROM fr JOIN nr ON nr.image_id = fr.image_id AND nr.frame = fr.frame AND nr.x = fr.x AND nr.y = fr.y WHERE fr.a = 0 GROUP BY ALL)
      SELECT fr.image_id, fr.frame, (count(*) FILTER (a > 0) * 400)::bigint AS tint, any_value(ring) AS ring, any_value(mark) AS mark FROM fr LEFT JOIN rg ON rg.image_id = fr.image_id AND rg.frame = fr.frame GROUP BY fr.image_id, fr.frame""",
    "baked_frames": f"""WITH {F_}, t AS (SELECT *, CASE WHEN image_id % 4 = 0 THEN 1 ELSE 0.5::double + (image_id % 3) / 2::double END AS s, CASE WHEN image_id % 4 = 0 THEN 0 ELSE frame * 1.5::double END AS dx, CASE WHEN image_id % 4 = 0 THEN 0 ELSE -1 END AS dy FROM fr),
      u AS (SELECT *, 24 - w * s / 2 + dx AS px, 44 - h * s + dy AS py FROM t), v AS (SELECT image_id, frame, a, tx, ty FROM u, range(48) p(tx), range(48) q(ty) WHERE tx + 0.5 >= px + x * s AND tx + 0.5 < px + (x + 1) * s AND ty + 0.5 >= py + y * s AND ty + 0.5 < py + (y + 1) * s)
      SELECT image_id, frame, count(*) AS n, sum((tx + 1) * (ty + 3) * a)::bigint AS mark FROM v GROUP BY ALL""",
    "stacked_panels": f"WITH {F_} SELECT image_id, sum((x + frame * (w + 3)) * a)::bigint AS mark_x, max(x + frame * (w + 3)) + 1 AS size_x, sum((y + frame * 35) * a)::bigint AS mark_y, max(y + frame * 35) + 1 AS size_y FROM fr GROUP BY ALL",
    "crop_window": f"WITH {M} SELECT image_id, count(*) AS n, sum((x - 7) * (y - 3) * a)::bigint AS mark FROM mat WHERE x >= 8 AND x < 48 AND y >= 4 AND y < 24 GROUP BY ALL",
    "sheet_raster": f"WITH {F_} SELECT image_id // 4 AS sheet, count(*) AS n, sum((frame * 40 + x + 1) * (image_id % 4 * 30 + y + 1) * a)::bigint AS mark FROM fr WHERE x < 40 AND y < 30 GROUP BY ALL",
    "file_round_trip": f"WITH {PIX} SELECT image_id, 96 AS w, 32 AS h, NULL::varchar AS error, sum(r * (x + 1))::bigint AS mark_r, sum(g * (x + 1))::bigint AS mark_g, sum(b * (x + 1))::bigint AS mark_b, sum(a * (x + 1))::bigint AS mark_a FROM pix GROUP BY ALL",
    "retry_hints": f"""WITH ins AS ({ORACLES["inspect_rules"]}), {_RULES}, hit AS (SELECT DISTINCT image_id, o, hint FROM ins JOIN rules ON contains(',' || errors || ',' || warnings || ',', ',' || rule || ','))
      SELECT i.image_id, coalesce(string_agg(hint, '; ' ORDER BY o), '') AS hints FROM (SELECT DISTINCT image_id FROM ins) i LEFT JOIN hit ON hit.image_id = i.image_id GROUP BY i.image_id""",
    "base_rules": f"""WITH {M}, fa AS MATERIALIZED (SELECT image_id, pose AS frame, lx AS x, y, r, g, b, a, slot AS w, 32 AS h FROM mat), fr AS MATERIALIZED (SELECT * FROM fa WHERE frame > 0),{HST},{LOO},{REP},
      sh AS (SELECT image_id FROM fa WHERE frame = 0 GROUP BY ALL HAVING avg((a <= 10)::int) >= 0.05), bb AS (SELECT image_id, ((r >> 6) << 4) + ((g >> 6) << 2) + (b >> 6) AS bin, count(*) AS n FROM fa WHERE frame = 0 AND a > 10 GROUP BY ALL),
      bs AS (SELECT image_id, bin, n::double / sum(n) OVER (PARTITION BY image_id) AS ref FROM bb), sm AS (SELECT image_id, frame, sum(least(share, ref)) AS v FROM hs JOIN bs USING (image_id, bin) GROUP BY ALL),
      bq AS (SELECT image_id, avg(coalesce(v, 0)) AS base FROM ids JOIN sh USING (image_id) LEFT JOIN sm USING (image_id, frame) GROUP BY ALL),
      pe AS (SELECT image_id, list_sort(list(content))[count(*) // 2 + 1] AS med, count(*) AS n, sum(width * height) // count(*) AS area FROM rep GROUP BY ALL),
      j AS (SELECT rep.*, CASE WHEN n > 1 THEN similarity END AS similarity, base, med, n, floor(area * 0.25::double)::int AS co, CASE WHEN n >= 3 AND med > 0 THEN content::double / med END AS ratio FROM rep JOIN pe USING (image_id) LEFT JOIN loo USING (image_id, frame) LEFT JOIN bq USING (image_id))
      SELECT image_id, frame, concat_ws(',', CASE WHEN content < greatest(400, width * height // 100) THEN 'empty' END, CASE WHEN residue > 120 THEN 'residue' END, CASE WHEN similarity < 0.45 THEN 'drift' END, CASE WHEN base < 0.4 THEN 'other_character' END) AS errors,
      concat_ws(',', CASE WHEN edge > 24 THEN 'edge' END, CASE WHEN co > 0 AND content < co THEN 'less_content' END, CASE WHEN ratio < 0.35 THEN 'too_small' END, CASE WHEN ratio > 2.75 THEN 'too_large' END, CASE WHEN similarity >= 0.45 AND similarity < 0.65 THEN 'drift' END,
        CASE WHEN base >= 0.4 AND base < 0.6 THEN 'near_character' END) AS warnings FROM j""",
    "post_process": f"""WITH {F_},{GIF},{NEA}, sz AS (SELECT image_id, 96 // expected AS sw FROM s),
      pp AS MATERIALIZED (SELECT fr.image_id, fr.frame, fr.x, fr.y, sz.sw AS w, 32 AS h, CASE WHEN a >= 128 THEN pr ELSE 0 END AS r, CASE WHEN a >= 128 THEN pg ELSE 0 END AS g, CASE WHEN a >= 128 THEN pb ELSE 0 END AS b, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a
        FROM fr JOIN sz USING (image_id) LEFT JOIN nea ON nea.image_id = fr.image_id AND nea.r = fr.r AND nea.g = fr.g AND nea.b = fr.b),{_frame_lengths("y", "x", "fa_")},{_frame_lengths("x", "y", "fb_")},
      ln AS (SELECT image_id, frame, length, count(*) AS n FROM (SELECT * FROM fa_ UNION ALL SELECT * FROM fb_) GROUP BY ALL), be AS (SELECT * FROM ln QUALIFY row_number() OVER (PARTITION BY image_id, frame ORDER BY n * length DESC, length) = 1),
      fs AS (SELECT i.image_id, i.frame, coalesce(length, 1) AS sc FROM (SELECT DISTINCT image_id, frame FROM fr) i LEFT JOIN be ON be.image_id = i.image_id AND be.frame = i.frame), me AS (SELECT image_id, list_sort(list(sc))[count(*) // 2 + 1] AS sc FROM fs GROUP BY ALL),
      bl AS (SELECT pp.*, sc, x // sc AS bx, y // sc AS bq FROM pp JOIN me USING (image_id)), bc AS (SELECT image_id, frame, bx, bq, r, g, b, count(*) AS n, any_value(least(sc, w - bx * sc) * least(sc, h - bq * sc)) AS area FROM bl WHERE a > 10 GROUP BY ALL),
      bt AS (SELECT *, sum(n) OVER (PARTITION BY image_id, frame, bx, bq) AS al FROM bc QUALIFY row_number() OVER (PARTITION BY image_id, frame, bx, bq ORDER BY n DESC, r, g, b) = 1), bk AS (SELECT * FROM bt WHERE 2 * al >= area),
      fin AS (SELECT bl.image_id, bl.frame, CASE WHEN sc < 2 THEN bl.r ELSE coalesce(bk.r, 0) END AS r, CASE WHEN sc < 2 THEN bl.g ELSE coalesce(bk.g, 0) END AS g, CASE WHEN sc < 2 THEN bl.b ELSE coalesce(bk.b, 0) END AS b, CASE WHEN sc < 2 THEN bl.a WHEN bk.r IS NULL THEN 0 ELSE 255 END AS a
        FROM bl LEFT JOIN bk ON bk.image_id = bl.image_id AND bk.frame = bl.frame AND bk.bx = bl.bx AND bk.bq = bl.bq)
      SELECT image_id, frame, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b, sum(a)::bigint AS sum_a FROM fin GROUP BY ALL""",
    "extract_frames": f"""WITH RECURSIVE {R_},{PK},{SEG},{CMP}, px AS (SELECT lb.image_id, label, y, unnest(range(lb.x0, lb.x1 + 1)) AS x FROM lb),
      ow AS (SELECT px.image_id, label, seg, count(*) AS n FROM px JOIN segs ON segs.image_id = px.image_id AND px.x >= segs.x0 AND px.x < segs.x1 GROUP BY ALL), own AS (SELECT * FROM ow QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY n DESC, seg) = 1),
      hl AS (SELECT segs.image_id, count(DISTINCT own.seg) < count(DISTINCT segs.seg) AS clipped FROM segs LEFT JOIN own ON own.image_id = segs.image_id AND own.seg = segs.seg GROUP BY segs.image_id),
      op AS (SELECT px.image_id, px.x, px.y, own.seg FROM px JOIN hl ON hl.image_id = px.image_id AND NOT clipped JOIN own ON own.image_id = px.image_id AND own.label = px.label
        UNION ALL SELECT px.image_id, px.x, px.y, segs.seg FROM px JOIN hl ON hl.image_id = px.image_id AND clipped JOIN segs ON segs.image_id = px.image_id AND px.x >= segs.x0 AND px.x < segs.x1),
      oa AS MATERIALIZED (SELECT op.image_id, op.seg, op.x, op.y, a FROM op JOIN mat ON mat.image_id = op.image_id AND mat.x = op.x AND mat.y = op.y),
      qx AS (SELECT image_id, seg, x AS pos, sum(a)::double AS mass FROM oa GROUP BY ALL), qy AS (SELECT image_id, seg, y AS pos, sum(a)::double AS mass FROM oa GROUP BY ALL),{_extent('qx', 'ex', 'image_id, seg')},{_extent('qy', 'ey', 'image_id, seg')},
      bb AS (SELECT image_id, seg, min(x) AS x, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, max(y) AS bottom, sum(x * a)::double / sum(a) AS cx FROM oa GROUP BY ALL),
      k1 AS (SELECT *, least(least(1, 24::double / max(bw) OVER p, 24::double / max(bh) OVER p), 24::double / w, 24::double / h) AS sc, max(bottom) OVER p AS base FROM (SELECT bb.*, ex.span AS bw, ey.span AS bh FROM bb JOIN ex USING (image_id, seg) JOIN ey USING (image_id, seg)) WINDOW p AS (PARTITION BY image_id)),{_PLACED}
      SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY seg) - 1)::int AS seg, count(*) OVER (PARTITION BY image_id) AS found, round(sc, 6) AS scale, sw, sh, CASE WHEN lf + sw > 32 THEN 32 - sw ELSE lf END AS "left", greatest(0, 28 - trunc((base - bottom) * sc + 0.5::double)::int - sh) AS top FROM k2""",
}
ORACLES["body_extent_ratio"] = f"""WITH a AS ({ORACLES["shared_box_placement"]}), b AS ({ORACLES["cell_placement"]}), pa AS (SELECT image_id, avg(sh) AS plain, count(*) AS n FROM a GROUP BY ALL), pb AS (SELECT image_id, avg(sh) AS own FROM b GROUP BY ALL)
      SELECT image_id, round(plain / own, 6) AS ratio FROM pa JOIN pb USING (image_id) WHERE n >= 2 AND own > 0 ORDER BY ratio, image_id LIMIT 12"""
# cells of 128 hold every strip's figures at their own size, so that their pixels are the strip's
_CELLS = ORACLES["extract_frames"].replace("24::double", "120::double").replace("trunc(16::double", "trunc(64::double").rsplit("SELECT image_id, (row_number()", 1)[0]
ORACLES["extract_cells"] = f"""{_CELLS.rstrip()}, k3 AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY seg) - 1)::int AS frame, CASE WHEN lf + sw > 128 THEN 128 - sw ELSE lf END AS cl, greatest(0, 124 - trunc((base - bottom) * sc + 0.5::double)::int - sh) AS ct FROM k2),
      kp AS (SELECT k3.image_id, frame, cl + oa.x - k3.x AS px, ct + oa.y - (k3.bottom - k3.h + 1) AS py, mat.r, mat.g, mat.b, mat.a FROM k3 JOIN oa ON oa.image_id = k3.image_id AND oa.seg = k3.seg JOIN mat ON mat.image_id = oa.image_id AND mat.x = oa.x AND mat.y = oa.y)
      SELECT image_id, frame, count(*) AS n, sum((px + 1) * (py + 1) * a)::bigint AS mark, sum(r)::bigint AS sum_r, sum(g)::bigint AS sum_g, sum(b)::bigint AS sum_b, sum(a)::bigint AS sum_a FROM kp GROUP BY ALL"""
_STRIPS = "SELECT s_suppkey AS image_id, 2 + s_suppkey % 3 AS expected FROM supplier"
# a project holds a sheet, two descriptions, every frame, and two animations a state; all but the descriptions are images
ORACLES["bundle_round_trip"] = f"""WITH {F_}, n AS (SELECT image_id // 4 AS bundle, sum(expected + 2)::bigint AS n FROM ({_STRIPS}) GROUP BY ALL),
      m AS (SELECT image_id // 4 AS bundle, sum((frame * 48 + x + 1) * (image_id % 4 * 32 + y + 1) * a)::bigint AS mark, sum(r + g + b)::bigint AS colour FROM fr GROUP BY ALL)
      SELECT bundle, n + 3 AS n_files, n + 1 AS n_images, mark, colour FROM n JOIN m USING (bundle)"""
ORACLES["project_manifest"] = f"""WITH a AS ({ORACLES["atlas_rects"].replace("frame * 64", "frame * 48")}), f AS (SELECT image_id, 4 + image_id % 3 * 4 AS fps, image_id % 3 <> 0 AS loop FROM ({_STRIPS}))
      SELECT sheet, max(max(x)) OVER (PARTITION BY sheet)::int + 48 AS width, (max("row") OVER (PARTITION BY sheet) + 1)::int * 32 AS height, image_id, "row", count(*)::int AS frames, any_value(fps)::int AS fps, any_value(loop) AS loop, any_value(duration)::int AS "durationMs",
        24 AS pivot_x, any_value(pivot_y)::int AS pivot_y, max(x)::int AS last_x, max(y)::int AS last_y, sum(trim_w * trim_h)::int AS area FROM a JOIN f USING (image_id) GROUP BY sheet, image_id, "row" """
ORACLES["frame_file_counts"] = f"SELECT image_id // 4 AS sheet, image_id, expected::bigint AS n FROM ({_STRIPS})"
ORACLES["first_files"] = f"SELECT sheet, name FROM (SELECT image_id // 4 AS sheet, image_id || '.png' AS name FROM ({_STRIPS})) QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY name) <= 2"
ORACLES["animations_read"] = f"""WITH {F_},{GIF},{NEA}
      SELECT image_id, 'png' AS kind, frame, count(*) FILTER (a >= 128) AS n, sum(CASE WHEN a >= 128 THEN r * (x + 1) ELSE 0 END)::bigint AS mark_r, sum(CASE WHEN a >= 128 THEN g * (x + 1) ELSE 0 END)::bigint AS mark_g, sum(CASE WHEN a >= 128 THEN b * (x + 1) ELSE 0 END)::bigint AS mark_b FROM fr GROUP BY ALL
      UNION ALL SELECT fr.image_id, 'gif', frame, count(*) FILTER (a >= 128), sum(CASE WHEN a >= 128 THEN pr * (x + 1) ELSE 0 END)::bigint, sum(CASE WHEN a >= 128 THEN pg * (x + 1) ELSE 0 END)::bigint, sum(CASE WHEN a >= 128 THEN pb * (x + 1) ELSE 0 END)::bigint
      FROM fr LEFT JOIN nea ON nea.image_id = fr.image_id AND nea.r = fr.r AND nea.g = fr.g AND nea.b = fr.b GROUP BY fr.image_id, frame"""
ORACLES["raw_strip_list"] = f"SELECT image_id, expected::int AS frames, image_id || '-raw.png' AS path, 96 AS w, 32 AS h FROM ({_STRIPS})"
ORACLES["thumbnails_read"] = f"SELECT image_id, 48 AS w, 16 AS h, true AS same FROM ({_STRIPS})"
_KEPT = ORACLES["extract_cells"].rsplit("SELECT image_id, frame, count(*) AS n", 1)[0].rstrip()


def _scan(rows: str, width: str, tail: str) -> str:
    """Balance and spread of frames, as b_ and c_ with the tail."""
    return f"""n_{tail} AS (SELECT image_id, frame, count(*) FILTER (a > 10) AS n, coalesce(avg(x) FILTER (a > 10), max({width}) / 2) AS c FROM {rows} GROUP BY ALL),
      b_{tail} AS (SELECT image_id, CASE WHEN min(n) > 0 THEN max(n)::double / min(n) ELSE 999 END AS ratio, stddev_pop(c) AS spread FROM n_{tail} GROUP BY ALL)"""


ORACLES["sample_scan"] = f"""{_KEPT}, cf AS (SELECT image_id, frame, px AS x, a FROM kp), ef AS (SELECT image_id, pose AS frame, lx AS x, a, slot AS w FROM mat),{_scan("cf", "128", "cut")},{_scan("ef", "w", "even")}, ec AS ({ORACLES["equal_split_crossings"]}),
      al AS (SELECT e.image_id, crossed::double AS crossed, round(CASE WHEN c.ratio > 0 THEN e.ratio / c.ratio ELSE e.ratio END, 6) AS segment_gain, round(e.ratio, 6) AS balance, round(e.spread - c.spread, 6) AS centre_gain FROM b_even e LEFT JOIN b_cut c USING (image_id) LEFT JOIN ec USING (image_id)),
      ls AS (SELECT image_id, 'crossed' AS list, 8 AS most, crossed AS value FROM al UNION ALL SELECT image_id, 'segments', 6, segment_gain FROM al UNION ALL SELECT image_id, 'balance', 8, balance FROM al UNION ALL SELECT image_id, 'centres', 6, centre_gain FROM al)
      SELECT list, rank::int AS rank, image_id, value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, image_id) AS rank FROM ls WHERE value IS NOT NULL) WHERE rank <= most"""
ORACLES["tiled_components"] = f"""WITH RECURSIVE {M},{CMP} SELECT image_id, min(y * 96 + x0)::bigint // 96 AS first_y, min(y * 96 + x0)::bigint % 96 AS first_x, sum(x1 - x0 + 1)::bigint AS n, min(x0)::bigint AS min_x, min(y)::bigint AS min_y, max(x1)::bigint AS max_x, max(y)::bigint AS max_y FROM lb GROUP BY image_id, label"""
ORACLES["tiled_flood"] = f"SELECT image_id, n FROM ({ORACLES['flood_clear']})"


def _median_cut(size: int) -> str:
    """Splits one after the other: of each image the box with the widest channel, at half of its pixels, which may part one colour's."""
    out = "c0 AS (SELECT image_id, 0 AS box, r, g, b, count(*)::bigint AS n FROM mat WHERE a > 10 GROUP BY ALL)"
    for k in range(1, size):
        out += f""",
      s{k} AS (SELECT image_id, box, sum(n) AS total, max(r) - min(r) AS wr, max(g) - min(g) AS wg, max(b) - min(b) AS wb FROM c{k - 1} GROUP BY image_id, box),
      w{k} AS (SELECT image_id, box AS wide, total // 2 AS half, CASE WHEN wr >= wg AND wr >= wb THEN 0 WHEN wg >= wb THEN 1 ELSE 2 END AS ch FROM s{k} WHERE greatest(wr, wg, wb) > 0 AND total > 1 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY greatest(wr, wg, wb) DESC, box) = 1),
      o{k} AS (SELECT c.*, wide, half, sum(n) OVER (PARTITION BY c.image_id, box ORDER BY CASE ch WHEN 0 THEN r WHEN 1 THEN g ELSE b END, r, g, b ROWS UNBOUNDED PRECEDING)::bigint - n AS before FROM c{k - 1} c LEFT JOIN w{k} w ON w.image_id = c.image_id AND w.wide = c.box),
      c{k} AS MATERIALIZED (SELECT image_id, box, r, g, b, CASE WHEN wide IS NULL THEN n ELSE greatest(0, least(n, half - before)) END AS n FROM o{k} WHERE wide IS NULL OR half > before
        UNION ALL SELECT image_id, {k}, r, g, b, n - greatest(0, least(n, half - before)) FROM o{k} WHERE wide IS NOT NULL AND n > half - before)"""
    return out


_D = "2 * (e.r - m.r) * (e.r - m.r) + 4 * (e.g - m.g) * (e.g - m.g) + 3 * (e.b - m.b) * (e.b - m.b)"
# near colours are taken up one after the other, the largest first, by the first that is near
ORACLES["median_cut"] = f"""WITH {M},{_median_cut(8)},
      e AS (SELECT image_id, box, sum(n)::bigint AS n, (sum(r * n) // sum(n))::bigint AS r, (sum(g * n) // sum(n))::bigint AS g, (sum(b * n) // sum(n))::bigint AS b FROM c7 GROUP BY image_id, box),
      l AS (SELECT image_id, list({{'n': n, 'r': r, 'g': g, 'b': b}} ORDER BY n DESC, box) AS es FROM e GROUP BY image_id),
      f AS (SELECT image_id, list_reduce(es, lambda done, e: CASE WHEN len(list_filter(done, lambda m: {_D} < 600)) = 0 THEN list_append(done, e) ELSE
          list_transform(done, lambda m, i: CASE WHEN i = list_position(list_transform(done, lambda m: {_D} < 600), true) THEN {{'n': m.n + e.n, 'r': (m.r * m.n + e.r * e.n) // (m.n + e.n), 'g': (m.g * m.n + e.g * e.n) // (m.n + e.n), 'b': (m.b * m.n + e.b * e.n) // (m.n + e.n)}} ELSE m END) END, [es[1]][:0]) AS ms FROM l),
      p AS (SELECT image_id, CASE WHEN len(ms) < 2 THEN list_append(ms, {{'n': 1::bigint, 'r': 255::bigint, 'g': 255::bigint, 'b': 255::bigint}}) ELSE ms END AS ms FROM f),
      q AS (SELECT image_id, ms, unnest(range(len(ms))) AS ord FROM p)
      SELECT image_id, ord::int AS ord, ms[ord + 1].r::int AS r, ms[ord + 1].g::int AS g, ms[ord + 1].b::int AS b FROM q"""
ORACLES["gallery_strips"] = f"""WITH {F_}, f AS (SELECT image_id, max(frame * w + x)::int + 1 AS w, sum((frame * w + x) * a)::bigint AS mark FROM fr GROUP BY ALL)
      SELECT 'state-' || image_id || '-' || strftime(to_timestamp(1700000000 + image_id * 61) AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S') || '-' || lpad((image_id % 1000)::varchar, 3, '0') || '.png' AS name, w, 32 AS h, mark FROM f"""

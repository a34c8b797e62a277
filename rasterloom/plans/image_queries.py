"""Registered queries that run image by image: stencils, palettes, merging, contours, outlines and whole pipelines."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import ORD, ORD_SQL, PART, PART_SQL, r_ord, r_part
from ..functions import color as C
from ..functions import random
from ..operators import borders, grid, marks, smoothing, turning
from ..operators import palette as P
from ..operators import regions as R
from ..operators.merge import RegionGraph, merge_regions
from ..operators.state import build_plan
from ..shipping import cut, light, shared_folder, stored
from ..sources import raster_source, rasters
from ..streaming import gestures
from ..streaming.progress import stream_fills
from . import segment
from .catalog_queries import TAP_SQL
from .pixel_queries import LAB_SQL, blurred, box_sql, lab_pixels, sobel, thinned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def lab_rows(s, d):
    """Lab as plain columns l, a, b."""
    return lab_pixels(s, d).select("img", "i", "x", "y", "conf", "lab.*")


def pass_sql(source: str, name: str, sigma: float) -> str:
    """CTE ``name``: ``source`` (img, i, x, y, l, a, bb) after one bilateral pass."""
    return f"""{name}_s as materialized (select img, i, x, y, l::double l, a::double a, bb::double bb from {source}),
{name}_m as materialized (select s.*, cast(x + dx as int) nx, cast(y + dy as int) ny, cast(exp(-(dx * dx + dy * dy) / (2 * (4 / 1.5) ** 2)) as float)::double k from {name}_s s, range(-4, 5) u(dx), range(-4, 5) v(dy)),
{name}_t as (select p.img, p.i, p.x, p.y, q.l ql, q.a qa, q.bb qb, k * exp(-((q.l - p.l) ** 2 + (q.a - p.a) ** 2 + (q.bb - p.bb) ** 2) / (2 * {sigma} * {sigma})) w
 from {name}_m p join {name}_s q on q.img = p.img and q.x = p.nx and q.y = p.ny),
{name} as (select img, i, x, y, cast(sum(w * ql) / sum(w) as float) l, cast(sum(w * qa) / sum(w) as float) a, cast(sum(w * qb) / sum(w) as float) bb from {name}_t group by img, i, x, y)"""


LAB_ROUND = "select img, i, round(l::double, 2) l, round(a::double, 2) a, round(bb::double, 2) b"


def rounded(df):
    return df.select("img", "i", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in "lab"))


@query("w1_bilateral_pass", f"with {ORD_SQL}, {LAB_SQL}, {pass_sql('lab', 'p1', 14)} {LAB_ROUND} from p1")
def w1(s, d):
    return rounded(smoothing.bilateral(lab_rows(s, d), list("lab"), 14.0))


@query("w2_smooth", f"with {ORD_SQL}, {LAB_SQL}, {pass_sql('lab', 'p1', 11)}, {pass_sql('p1', 'p2', 11)} {LAB_ROUND} from p2")
def w2(s, d):
    """Two passes; these images are below the size from which smoothing goes by way of a smaller copy (w4 has that step)."""
    once = smoothing.bilateral(lab_rows(s, d), list("lab"), 11.0)
    return rounded(smoothing.bilateral(once, list("lab"), 11.0))


@query("w3_downscale", f"""with {ORD_SQL}, t as (select img, h, cast(ox as int) ox, cast(oy as int) oy from (select img, max(y) + 1 h from ord group by img), range(50) a(ox), range(16) b(oy))
select t.img, cast(t.oy * 50 + t.ox as bigint) i, round(avg(o.r), 3) v from t join ord o on o.img = t.img and o.x >= floor(t.ox * 125 / 50.0) and o.x < ceil((t.ox + 1) * 125 / 50.0) and o.y >= floor(t.oy * h / 16.0) and o.y < ceil((t.oy + 1) * h / 16.0) group by t.img, t.ox, t.oy""")
def w3(s, d):
    low = marks.box_means(r_ord(s, d), ["r"], ORD[0], (50, 16))
    return low.select("img", (F.col("oy") * 50 + F.col("ox")).cast("bigint").alias("i"), F.round("r", 3).alias("v"))


@query("w4_guided_upsample", f"""with {ORD_SQL}, {LAB_SQL}, hs as (select img, max(y) + 1 h from ord group by img),
bx as (select img, h, cast(ox as int) ox, cast(oy as int) oy from hs, range(50) a(ox), range(16) b(oy)),
lo as (select t.img, t.ox, t.oy, cast(avg(l::double) as float)::double l, cast(avg(a::double) as float)::double a, cast(avg(bb::double) as float)::double bb
 from bx t join lab o on o.img = t.img and o.x >= floor(t.ox * 125 / 50.0) and o.x < ceil((t.ox + 1) * 125 / 50.0) and o.y >= floor(t.oy * h / 16.0) and o.y < ceil((t.oy + 1) * h / 16.0) group by all),
gd as (select img, i, l::double l, a::double a, bb::double bb, (x + 0.5::double) * (50 / 125.0::double) - 0.5 cx, (y + 0.5::double) * (16 / h::double) - 0.5 cy from lab join hs using (img)),
gb as (select *, cast(least(49, greatest(0, floor(cx + 0.5))) as int) px, cast(least(15, greatest(0, floor(cy + 0.5))) as int) py from gd),
tp as (select g.img, g.i, lo.l, lo.a, lo.bb, lo.ox = g.px and lo.oy = g.py own, exp(-((lo.oy - cy) ** 2 + (lo.ox - cx) ** 2) / (2 * (2 / 1.5) ** 2)) * exp(-((lo.l - g.l) ** 2 + (lo.a - g.a) ** 2 + (lo.bb - g.bb) ** 2) / (2 * 11 * 11)) w
 from gb g, range(-2, 3) u(dx), range(-2, 3) v(dy), lo where lo.img = g.img and lo.ox = g.px + u.dx and lo.oy = g.py + v.dy)
select img, i, round(cast(case when sum(w) > 1e-12 then sum(w * l) / sum(w) else max(l) filter (own) end as float)::double, 2) l, round(cast(case when sum(w) > 1e-12 then sum(w * a) / sum(w) else max(a) filter (own) end as float)::double, 2) a, round(cast(case when sum(w) > 1e-12 then sum(w * bb) / sum(w) else max(bb) filter (own) end as float)::double, 2) b from tp group by img, i""")
def w4(s, d):
    px = lab_rows(s, d)
    frames = light(stored(R.frames(px), "frames"))
    return rounded(smoothing.guided_upsample(marks.box_means(px, list("lab"), ORD[0], (50, 16), frames), px, list("lab"), ORD, (50, 16), 11.0, frames=frames))


SMALL_SIZE = (48, max(1, int(np.floor(ORD[1] * 48 / ORD[0] + 0.5))))


@query("s12_thumbnail", f"""with {ORD_SQL}, {LAB_SQL}, hs as (select img, max(y) + 1 h from ord group by img),
bx as (select img, h, cast(ox as int) ox, cast(oy as int) oy from hs, range({SMALL_SIZE[0]}) a(ox), range({SMALL_SIZE[1]}) b(oy))
select t.img, cast(t.oy * {SMALL_SIZE[0]} + t.ox as bigint) i, round(cast(avg(l::double) as float)::double, 2) l, round(cast(avg(a::double) as float)::double, 2) a, round(cast(avg(bb::double) as float)::double, 2) b
from bx t join lab o on o.img = t.img and o.x >= floor(t.ox * 125 / {SMALL_SIZE[0]}.0) and o.x < ceil((t.ox + 1) * 125 / {SMALL_SIZE[0]}.0) and o.y >= floor(t.oy * h / {SMALL_SIZE[1]}.0) and o.y < ceil((t.oy + 1) * h / {SMALL_SIZE[1]}.0) group by t.img, t.ox, t.oy""")
def s12(s, d):
    low = marks.box_means(lab_rows(s, d), list("lab"), ORD[0], SMALL_SIZE)
    return low.select("img", (F.col("oy") * SMALL_SIZE[0] + F.col("ox")).cast("bigint").alias("i"), *(F.round(F.col(c).cast("float").cast("double"), 2).alias(c) for c in "lab"))


CHAIN_SQL = """c as (select img, i, x, y, i root from px union select q.img, q.i, q.x, q.y, c.root from c join px q on q.img = c.img and abs(q.x - c.x) <= 1 and abs(q.y - c.y) <= 1 and c.root < q.i),
m as (select img, i, x, y, min(root) root from c group by all),
k as (select img, root, count(*) n, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) box from m group by all)"""


LINES_SQL = """kt as (select * from (values (-2, 0.06136::double), (-1, 0.24477::double), (0, 0.38774::double), (1, 0.24477::double), (2, 0.06136::double)) k(t, w)),
hs as (select img, max(y) my from ord group by img),
b0 as materialized (select img, i, x, y, l::double v, my from lab join hs using (img)),
b1 as materialized (select p.img, p.i, p.x, p.y, p.my, cast(sum(w * q.v) as float)::double v from (select b0.*, w, least(124, greatest(0, x + t)) nx from b0, kt) p join b0 q on q.img = p.img and q.y = p.y and q.x = p.nx group by p.img, p.i, p.x, p.y, p.my),
b2 as materialized (select p.img, p.i, p.x, p.y, p.my, cast(sum(w * q.v) as float)::double v from (select b1.*, w, least(my, greatest(0, y + t)) ny from b1, kt) p join b1 q on q.img = p.img and q.x = p.x and q.y = p.ny group by p.img, p.i, p.x, p.y, p.my),
nb as (select b2.*, dx, dy, cast(x + dx as int) nx, cast(y + dy as int) ny from b2, range(-1, 2) u(dx), range(-1, 2) v(dy) where x between 1 and 123 and y between 1 and my - 1),
sb as (select p.img, p.i, p.x, p.y, sum(dx * (2 - abs(dy)) * q.v) gx, sum(dy * (2 - abs(dx)) * q.v) gy from nb p join b2 q on q.img = p.img and q.x = p.nx and q.y = p.ny group by p.img, p.i, p.x, p.y),
mg as materialized (select b2.img, b2.i, b2.x, b2.y, coalesce(cast(sqrt(gx * gx + gy * gy) as float)::double, 0) mag, case when gx is null or (gx = 0 and gy = 0) then 0 else ((cast(floor(atan2(gy, gx) / pi() * 4 + 0.5) as int) % 4) + 4) % 4 end dir from b2 left join sb using (img, i)),
sd as (select *, case dir when 2 then 0 else 1 end sx, case dir when 0 then 0 when 1 then -1 else 1 end sy from mg where mag > 0),
th as materialized (select c.img, c.i, c.x, c.y, c.mag from sd c join mg a on a.img = c.img and a.x = c.x - sx and a.y = c.y - sy join mg b on b.img = c.img and b.x = c.x + sx and b.y = c.y + sy where c.mag >= a.mag and c.mag >= b.mag),
rk as (select img, mag, row_number() over (partition by img order by mag) - 1 k, count(*) over (partition by img) n from th),
lim as (select img, max(mag) filter (k = least(n - 1, cast(floor(n * 0.95::double) as bigint))) hi, max(mag) filter (k = least(n - 1, cast(floor(n * 0.85::double) as bigint))) lo from rk group by img),
wk as materialized (select th.*, hi from th join lim using (img) where mag >= lo),
hy as (select img, i, x, y from wk where mag >= hi union select q.img, q.i, q.x, q.y from hy join wk q on q.img = hy.img and abs(q.x - hy.x) <= 1 and abs(q.y - hy.y) <= 1),
px as (select * from hy)"""


@query("c3_feature_lines", f"with recursive {ORD_SQL}, {LAB_SQL}, {LINES_SQL}, {CHAIN_SQL} select img, i, x, y from m join k using (img, root) where n >= 3")
def c3(s, d):
    return feature_lines(lab_rows(s, d).select("img", "i", "x", "y", "l"), "l", least=3)


def feature_lines(px: DataFrame, col: str, strong: float = 0.95, weak: float = 0.85, least: int = 20) -> DataFrame:
    """(img, i, x, y) of the thin edges of ``col`` that hang together with a strong one, in chains of at least ``least`` pixels. Strong and
    weak are ranks among the image's thin edges."""
    blur = blurred(px, col).withColumn("v", F.col("v").cast("double"))
    t = cut(thinned(sobel(blur, "v").withColumn("mag", F.sqrt("m2").cast("float").cast("double")), "mag"))
    w = Window.partitionBy("img")
    ranked = t.select("img", "mag", (F.row_number().over(w.orderBy("mag")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))), F.col("mag")))
    limits = ranked.groupBy("img").agg(at(strong).alias("hi"), at(weak).alias("lo"))
    return marks.long_chains(marks.hysteresis(t.join(limits, "img"), F.col("mag") >= F.col("lo"), F.col("mag") >= F.col("hi")), least)


@query("g2_hysteresis", f"with recursive {ORD_SQL}, px as (select * from ord where r > 120), c as (select img, i, x, y from px where r > 250 union select q.img, q.i, q.x, q.y from c join px q on q.img = c.img and abs(q.x - c.x) <= 1 and abs(q.y - c.y) <= 1) select * from c")
def g2(s, d):
    return marks.hysteresis(r_ord(s, d), F.col("r") > 120, F.col("r") > 250)


@query("g3_long_chains", f"with recursive {ORD_SQL}, px as (select * from ord where r > 180), {CHAIN_SQL} select img, i, x, y from m join k using (img, root) where n >= 6")
def g3(s, d):
    return marks.long_chains(r_ord(s, d).where("r > 180"), 6)


@query("g4_compact_components", f"with recursive {ORD_SQL}, px as (select * from ord where r > 180), {CHAIN_SQL} select img, i, x, y from m join k using (img, root) where n between 4 and 200 and n / box::double >= 0.3")
def g4(s, d):
    return marks.compact(r_ord(s, d).where("r > 180"), 4, 200)


@query("w6_g4_dark_marks", f"with recursive {ORD_SQL}, {LAB_SQL}, {box_sql('lab', 'l')}, px as (select * from bm where l::double < m - 13), {CHAIN_SQL}, sz as (select img, 0.004::double * 125 * (max(y) + 1) most from ord group by img) select img, i, x, y from m join k using (img, root) join sz using (img) where n >= 3 and n <= most and n / box::double >= 0.3")
def dark(s, d):
    px = lab_rows(s, d).withColumn("l", F.col("l").cast("double"))
    most = R.frames(px).select("img", (F.lit(0.004) * ORD[0] * (F.col("bottom") + 1)).alias("most"))
    return marks.compact(R.with_local_mean(px, "l", 24).where(F.col("l") < F.col("mean") - 13), 3, most)


@query("g1_components_by_image", """with recursive px as (select p_partkey // 500 img, p_partkey % 500 i, p_partkey % 50 x, p_partkey % 500 // 50 y, floor(p_size / 13.0) idx from part),
c as (select img, i, x, y, idx, i root from px union select q.img, q.i, q.x, q.y, q.idx, c.root from c join px q on q.img = c.img and q.idx = c.idx and abs(q.x - c.x) + abs(q.y - c.y) = 1 and c.root < q.i),
m as (select img, i, min(root) root from c group by all)
select img, i, dense_rank() over (partition by img order by root) - 1 label, count(*) over (partition by img, root) area from m""")
def g1b(s, d):
    def f(g):
        label = grid.components(g["idx"], g["valid"])
        return {k: v for k, v in grid.rows_of({"label": grid.dense_rank(label), "area": grid.area_of(label)}, g["valid"]).items() if k not in "xy"}

    return grid.per_image(r_part(s, d), PART, ["idx"], f, "img bigint, i bigint, label bigint, area bigint")


@query("p19_random_numbers", f"""with {ORD_SQL}, sd as (select img, sum(r)::bigint seed from ord group by img),
a as (select img, cast(k as int) k, (seed + (k + 1) * {random.STEP}) % 4294967296 a from sd, range(8) u(k)),
b as (select img, k, cast((xor(a, a >> 15)::hugeint * (a | 1)) % 4294967296 as bigint) t from a),
c as (select img, k, t, cast((xor(t, t >> 7)::hugeint * (t | 61)) % 4294967296 as bigint) m from b),
e as (select img, k, xor(t, (t + m) % 4294967296) t from c) select img, k, xor(t, t >> 14) / 4294967296::double u from e""")
def p19(s, d):
    seeds = r_ord(s, d).groupBy("img").agg(F.sum("r").alias("seed"))
    draws = seeds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return draws.select("img", "k", random.random32(F.col("seed"), F.col("k")).alias("u"))


def start_sql(k: int, seed: int = P.SEED) -> str:
    """CTEs of the seeded start over x (img, j, l, a, b): s0, s1, ... hold (img, l, a, b) of each starting point, d1, d2, ... the weights."""
    draw = lambda i: f"(select (xor(t, t >> 14) / 4294967296::double) from (select xor(t, (t + cast((xor(t, t >> 7)::hugeint * (t | 61)) % 4294967296 as bigint)) % 4294967296) t from (select cast((xor(a, a >> 15)::hugeint * (a | 1)) % 4294967296 as bigint) t from (select ({seed} + {i + 1}::bigint * {random.STEP}) % 4294967296 a))))"
    far = lambda c: f"(x.l - {c}.l) ** 2 + (x.a - {c}.a) ** 2 + (x.b - {c}.b) ** 2"
    steps = [f"s0 as materialized (select x.img, l, a, b from x join (select img, count(*) n from x group by img) using (img) where j = greatest(0, cast(ceil({draw(0)} * n) as bigint) - 1))"]
    for i in range(1, k):
        least = f"least(d.w, cast({far(f's{i - 1}')} as float))" if i > 1 else f"cast({far('s0')} as float)"
        steps.append(f"""d{i} as materialized (select x.*, {least} w from x join s{i - 1} on s{i - 1}.img = x.img {f'join d{i - 1} d on d.img = x.img and d.j = x.j' if i > 1 else ''}),
r{i} as (select *, sum(w::double) over (partition by img order by j) upto, sum(w::double) over (partition by img) total, max(j) over (partition by img) top from d{i}),
s{i} as materialized (select r.img, case when r.total = 0 then s0.l else r.l end l, case when r.total = 0 then s0.a else r.a end a, case when r.total = 0 then s0.b else r.b end b from r{i} r join s0 using (img)
 join (select img, coalesce(min(j) filter (upto >= {draw(i)} * total), max(top)) j from r{i} group by img) h on h.img = r.img and h.j = r.j)""")
    return ",\n".join(steps)


START_SQL = f"{ORD_SQL}, {LAB_SQL}, x as materialized (select img, row_number() over (partition by img order by i) - 1 j, l::double l, a::double a, bb::double b from lab), {start_sql(8)}"


def colors_of(df: DataFrame) -> DataFrame:
    return df.select("img", F.col("idx").cast("int").alias("idx"), *(F.round(F.col(c).cast("double"), 3).alias(c) for c in "lab"))


@query("g10_spread_start", f"with {START_SQL} select img, idx, round(l, 3) l, round(a, 3) a, round(b, 3) b from ({' union all '.join(f'select img, {i} idx, l, a, b from s{i}' for i in range(8))})")
def g10(s, d):
    start = P.spread_start(stored(P.samples(lab_rows(s, d))), 8)
    return colors_of(start.select("img", "idx", "lab.*"))


@query("g11_distinct_colors", f"""with recursive {ORD_SQL}, {LAB_SQL}, c as (select img, list({{'idx': i, 'l': l::double, 'a': a::double, 'b': bb::double}} order by i) p from lab where i % 25 = 0 group by img),
f as (select img, p, 1 k, cast([] as struct(idx bigint, l double, a double, b double)[]) kept from c
 union all select img, p, k + 1, case when len(list_filter(kept, lambda o: (o.l - p[k].l) ** 2 + (o.a - p[k].a) ** 2 + (o.b - p[k].b) ** 2 < 144)) = 0 then list_append(kept, p[k]) else kept end from f where k <= len(p))
select img, c.idx i from (select img, unnest(kept) c from f where k = len(p) + 1)""")
def g11(s, d):
    """Of every 25th pixel's colour, those that are farther than 12 from all kept before them."""
    every = lab_rows(s, d).where("i % 25 = 0").groupBy("img").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("idx"), *"lab", F.lit(1).cast("bigint").alias("n")))).alias("p"))
    return every.select("img", F.explode(P.distinct_colors(F.col("p"), 12.0)).alias("c")).select("img", F.col("c.idx").alias("i"))


@query("g10_g11_g12_palette", f"""with recursive {START_SQL},
b0 as materialized ({' union all '.join(f'select img, {i} idx, l, a, b from s{i}' for i in range(8))}),
it as (select img, 0 t, false done, list({{'idx': idx, 'l': l, 'a': a, 'b': b, 'n': 0::bigint}} order by idx) p from b0 group by img
 union all select img, t + 1, max(moved) < {P.CONVERGED_SQ}, list({{'idx': idx, 'l': l, 'a': a, 'b': b, 'n': n}} order by idx) from (
  select it.img, t, c.idx, coalesce(n, 0) n, cast(coalesce(ml, c.l) as float)::double l, cast(coalesce(ma, c.a) as float)::double a, cast(coalesce(mb, c.b) as float)::double b, (coalesce(ml, c.l) - c.l) ** 2 + (coalesce(ma, c.a) - c.a) ** 2 + (coalesce(mb, c.b) - c.b) ** 2 moved
  from (select img, t, unnest(p) c from it where not done) it left join (
   select img, idx, count(*) n, avg(l) ml, avg(a) ma, avg(b) mb from (select x.img, x.l, x.a, x.b, list_min(list_transform(p, lambda c: {{'d': (x.l - c.l) ** 2 + (x.a - c.a) ** 2 + (x.b - c.b) ** 2, 'idx': c.idx}})).idx idx from it join x on x.img = it.img where not done) group by img, idx) m on m.img = it.img and m.idx = c.idx) where t < {P.MAX_ITERATIONS} group by img, t),
z as (select img, p from it where done or t = {P.MAX_ITERATIONS}),
f as (select img, p, 1 k, cast([] as struct(idx int, l double, a double, b double, n bigint)[]) kept from z
 union all select img, p, k + 1, case when p[k].n > 0 and len(list_filter(kept, lambda o: (o.l - p[k].l) ** 2 + (o.a - p[k].a) ** 2 + (o.b - p[k].b) ** 2 < {P.DUPLICATE**2})) = 0 then list_append(kept, p[k]) else kept end from f where k <= len(p)),
e as (select img, case when len(kept) > 0 then kept else p[1:1] end kept from f where k = len(p) + 1)
select img, cast(idx as int) idx, round(c.l, 3) l, round(c.a, 3) a, round(c.b, 3) b from (select img, unnest(range(len(kept))) idx, unnest(kept) c from e)""")
def g12(s, d):
    return colors_of(P.kmeans(lab_rows(s, d), 8))


MERGE_PALETTE = [[20, 0, 0], [40, 10, 0], [60, 0, 10], [80, 5, 5]]


@query("g5_g6_g7_g8_g9_merge_regions")
def g9(s, d):
    """Region of each pixel after merging. These maps are small, so each is merged in one task; ``contraction.merged`` does the same as a relation."""
    palette = np.array(MERGE_PALETTE, np.float32)

    def f(g):
        label = grid.dense_rank(grid.components(g["idx"], np.ones(g["idx"].shape, bool)))
        conf = np.full(label.max() + 1, 0.2)
        roots = merge_regions(RegionGraph.of(label, g["idx"]), 12, 30, conf, palette, 15)
        return {k: v for k, v in grid.rows_of({"root": roots[label]}, g["valid"]).items() if k not in "xy"}

    return grid.per_image(r_part(s, d), PART, ["idx"], f, "img bigint, i bigint, root bigint")


def loops_sql(raster: str, set_if: str, width: int, least: int) -> str:
    """CTEs of the borders of a mask: m (pixels with roots), ln (chosen loops), bd (img, loop, k, x, y)."""
    return f"""fm as (select img, max(y) + 1 h from {raster} group by img),
fx as (select img, h, unnest(range(h)) y from fm),
fl as (select img, h, y, unnest(range({width})) x from fx),
px as materialized (select fl.img, cast(fl.y * {width} + fl.x as bigint) i, fl.x, fl.y, fl.h, coalesce(cast({set_if} as int), 0) v from fl left join {raster} q on q.img = fl.img and q.x = fl.x and q.y = fl.y),
cc as (select img, i, x, y, v, i root from px union select q.img, q.i, q.x, q.y, q.v, cc.root from cc join px q on q.img = cc.img and q.v = cc.v and abs(q.x - cc.x) + abs(q.y - cc.y) = 1 and cc.root < q.i),
m as materialized (select img, i, x, y, v, min(root) root from cc group by all),
lp as (select m.img, root, v, count(*) area, bool_or(x = 0 or y = 0 or x = {width - 1} or y = h - 1) edge from m join fm using (img) group by all),
ln as materialized (select img, row_number() over (partition by img order by root) - 1 loop, root, area, v = 0 hole from lp where area >= {least} and (v = 1 or not edge)),
tn(d, dx, dy, behind) as (values {", ".join(str((d, *borders.AROUND[d], borders.BEHIND[d])) for d in range(8))}),
cd as materialized (select p.img, p.root, p.i, p.x, p.y, coalesce(sum(1 << d) filter (q.i is not null), 0) code from (select m.*, d, m.x + dx nx, m.y + dy ny from m semi join ln using (img, root), tn) p left join m q on q.img = p.img and q.root = p.root and q.x = p.nx and q.y = p.ny group by all),
wk as (select ln.img, loop, ln.root, cd.i, cd.x, cd.y, 0 back, 0 k from ln join cd on cd.img = ln.img and cd.i = ln.root
 union all select s.img, loop, s.root, q.i, q.x, q.y, behind, k + 1 from (select wk.*, list_filter(list_transform(range(1, 9), lambda t: (back + t) % 8), lambda d: (code >> d) & 1 = 1)[1] d from wk join cd using (img, i)) s join tn on tn.d = s.d join cd q on q.img = s.img and q.x = s.x + dx and q.y = s.y + dy and q.root = s.root where q.i <> s.root),
bd as materialized (select img, loop, k, x, y from wk)"""


def simplify_sql(epsilon: float) -> str:
    """CTE sm (img, loop, k, x, y): what Douglas-Peucker keeps of bd."""
    return f"""nn as (select b.img, b.loop, count(*) n, max({{'d': (b.x - f.x) ** 2 + (b.y - f.y) ** 2, 'k': -b.k}}) m from bd b join bd f on f.img = b.img and f.loop = b.loop and f.k = 0 group by all),
ds as materialized (select img, loop, k, x, y, n from bd join nn using (img, loop) union all select img, loop, n, x, y, n from bd join nn using (img, loop) where k = 0),
ar as (select img, loop, n, unnest([0, -m.k]) a, unnest([-m.k, n]) b from nn where n > 4 and m.k < 0
 union all select img, loop, n, unnest([a, -m.k]), unnest([-m.k, b]) from (select ar.img, ar.loop, ar.n, a, b, max({{'d': case when (t.x - s.x) ** 2 + (t.y - s.y) ** 2 = 0 then (p.x - s.x) ** 2 + (p.y - s.y) ** 2 else ((p.x - s.x) * (t.y - s.y) - (p.y - s.y) * (t.x - s.x)) ** 2 / ((t.x - s.x) ** 2 + (t.y - s.y) ** 2)::double end, 'k': -p.k}}) m
 from ar join ds s on s.img = ar.img and s.loop = ar.loop and s.k = a join ds t on t.img = ar.img and t.loop = ar.loop and t.k = b join ds p on p.img = ar.img and p.loop = ar.loop and p.k > a and p.k < b group by all) where m.d > {epsilon}::double * {epsilon}::double),
sm as materialized (select img, loop, k, x::double x, y::double y from bd join nn using (img, loop) where n <= 4 or m.k = 0 or (img, loop, k) in (select (img, loop, a) from ar))"""


def corners_sql(rounds: int) -> str:
    """CTEs c0, c1, ...: sm after each round of corner cutting."""
    steps = ["c0 as (select img, loop, row_number() over (partition by img, loop order by k) - 1 k, x, y from sm)"]
    for r in range(rounds):
        w = "over (partition by img, loop order by k)"
        steps.append(f"""t{r} as (select *, count(*) over (partition by img, loop) n, coalesce(lag(x) {w}, last_value(x) over (partition by img, loop order by k rows between unbounded preceding and unbounded following)) px, coalesce(lag(y) {w}, last_value(y) over (partition by img, loop order by k rows between unbounded preceding and unbounded following)) py,
 coalesce(lead(x) {w}, first_value(x) {w}) nx, coalesce(lead(y) {w}, first_value(y) {w}) ny from c{r}),
u{r} as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) s, (x - px) * (nx - x) + (y - py) * (ny - y) dot from t{r}),
q{r} as (select img, loop, k, unnest(case when n < 3 or (s > 0 and dot / s < cos(radians({borders.SHARP}))) then [{{'s': 0, 'x': x, 'y': y}}] else [{{'s': 0, 'x': x + 0.25::double * (px - x), 'y': y + 0.25::double * (py - y)}}, {{'s': 1, 'x': x + 0.25::double * (nx - x), 'y': y + 0.25::double * (ny - y)}}] end) q from u{r}),
c{r + 1} as (select img, loop, row_number() over (partition by img, loop order by k, q.s) - 1 k, q.x x, q.y y from q{r})""")
    return ",\n".join(steps)


PART_LOOPS = f"{PART_SQL}, {loops_sql('prt', 'idx >= 2', PART[0], 6)}"


def part_mask(s, d):
    return borders.full_frame(r_part(s, d).withColumn("v", (F.col("idx") >= 2).cast("int")), "v", PART[0])


def part_borders(s, d):
    return borders.outlines(part_mask(s, d), "v", 6)


def as_loops(df: DataFrame) -> DataFrame:
    return df.select("img", F.col("loop").cast("int").alias("loop"), F.col("k").cast("int").alias("k"), *(F.round(F.col(c).cast("double"), 6).alias(f"p{c}") for c in "xy"))


LOOPS_OUT = "select img, cast(loop as int) loop, cast(k as int) k, round(x::double, 6) px, round(y::double, 6) py from"


@query("k6_k7_contours", f"with recursive {PART_LOOPS} {LOOPS_OUT} bd")
def k6(s, d):
    return as_loops(part_borders(s, d))


@query("k7_loops", f"with recursive {PART_LOOPS} select ln.img, cast(loop as int) loop, ln.root, area, hole, case when hole then m.root end inside from ln left join m on m.img = ln.img and m.i = ln.root - {PART[0]}")
def k7(s, d):
    px = borders.components(part_mask(s, d), "v")
    return borders.loops(px, "v", 6).withColumn("loop", F.col("loop").cast("int"))


@query("k8_simplified_contours", f"with recursive {PART_LOOPS}, {simplify_sql(1.2)}, {corners_sql(0)} {LOOPS_OUT} c0")
def k8(s, d):
    kept = borders.simplified(part_borders(s, d), 1.2)
    return as_loops(borders.corners_cut(kept, 0))


@query("k9_smoothed_contours", f"with recursive {PART_LOOPS}, {simplify_sql(1.2)}, {corners_sql(2)} {LOOPS_OUT} c2")
def k9(s, d):
    return as_loops(borders.corners_cut(borders.simplified(part_borders(s, d), 1.2), 2))


@query("k10_k11_silhouette", f"""with recursive {ORD_SQL}, {loops_sql('ord', 'conf > 128', ORD[0], 20)}, {simplify_sql(2.2)}, {corners_sql(2)},
e as (select img, x, y, coalesce(lead(x) over w, first_value(x) over w) - x dx, coalesce(lead(y) over w, first_value(y) over w) - y dy from c2 window w as (partition by img, loop order by k)),
sn as (select *, greatest(1, cast(ceil(sqrt(dx * dx + dy * dy)) as int)) n from e),
st as (select *, unnest(range(n + 1)) k from sn),
sp as (select distinct img, cast(floor(x + dx * (k / n::double) + 0.5) as int) x, cast(floor(y + dy * (k / n::double) + 0.5) as int) y from st),
br as (select distinct img, cast(sp.x + u.o - 3 as int) x, cast(sp.y + v.o - 3 as int) y from sp, range(7) u(o), range(7) v(o) where (u.o - 3) ** 2 + (v.o - 3) ** 2 <= 9)
select ord.img, i, x, y from ord semi join br using (img, x, y)""")
def k11(s, d):
    return segment.silhouette(r_ord(s, d), ORD[0], least=20)


@query("k13_paint_strokes", f"""with {ORD_SQL}, hs as (select img, max(y) bottom, max(x) "right" from ord group by img),
p as (select img, i, x, y from ord where r > 253 union all select img, 0, 0, 0 from ord group by img having max(r) <= 253),
e as (select img, x, y, coalesce(lead(x) over w, first_value(x) over w) - x dx, coalesce(lead(y) over w, first_value(y) over w) - y dy from p window w as (partition by img order by i)),
n as (select *, greatest(1, cast(ceil(sqrt((dx * dx + dy * dy)::double)) as int)) n from e),
t as (select *, unnest(range(n + 1)) k from n),
q as (select distinct img, cast(floor(x + dx * (k / n::double) + 0.5) as int) x, cast(floor(y + dy * (k / n::double) + 0.5) as int) y from t),
b as (select distinct img, cast(q.x + u.o - 2 as int) x, cast(q.y + v.o - 2 as int) y from q, range(5) u(o), range(5) v(o) where (u.o - 2) ** 2 + (v.o - 2) ** 2 <= 4)
select b.img, cast(b.y * 125 + b.x as bigint) i, b.x, b.y from b join hs using (img) where b.x between 0 and "right" and b.y between 0 and bottom""")
def k13(s, d):
    px = r_ord(s, d)
    points = px.where("r > 253").select("img", "i", "x", "y")
    none = px.groupBy("img").agg(F.max("r").alias("m")).where("m <= 253").select("img", F.lit(0).cast("bigint"), F.lit(0), F.lit(0))
    out = marks.strokes(points.union(none), 2, R.frames(px))
    return out.select("img", (F.col("y") * ORD[0] + F.col("x")).cast("bigint").alias("i"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


SMALL = {"min_area": (0.004, 20), "background_area": (0.012, 60)}


def labels_of(s, d):
    return segment.segment_labels(r_ord(s, d), ORD, "easy", **SMALL)


@query("c1_segment_image")
def c1(s, d):
    """Regions of every image: number, colour, area, label point and hexadecimal colour."""
    px = labels_of(s, d)
    base = px.groupBy("img", "region_id", F.col("color_idx").alias("color")).agg(F.count(F.lit(1)).alias("area"), F.first(C.lab_hex(*(F.col(c).cast("double") for c in "lab"), boost=segment.BOOST)).alias("hex"))
    numbered = base.join(R.color_numbers(base), ["img", "color"]).join(R.label_points(px, "region_id"), ["img", "region_id"])
    return numbered.select("img", "region_id", "color_no", "label_x", "label_y", F.col("area").alias("area_px"), "hex")


@query("c1_label_runs")
def c1_runs(s, d):
    return R.encode_runs(labels_of(s, d), "region_id")


@query("c2_outline")
def c2(s, d):
    return segment.outline_pixels(r_ord(s, d), ORD)


@query("c2_outline_from_line_art", f"with {ORD_SQL} select img, i, x, y, 31 ink, conf alpha from ord where conf > 0")
def c2_model(s, d):
    return segment.outline_pixels(r_ord(s, d).withColumn("alpha", F.col("conf")), ORD, line_art=True)


ALPHA_SQL = "v as (select *, 1 - b / 255.0::double dk from ord), k as (select img, dk, row_number() over (partition by img order by dk) - 1 k, count(*) over (partition by img) n from v where dk > 0.08), sc as (select img, 1 / greatest(coalesce(max(dk) filter (k = least(n - 1, cast(floor(n * 0.95) as bigint))), 1), 0.35) s from k group by img), al as (select v.img, i, case when x < 8 or y < 8 or x >= 117 or y >= 32 then 0 else cast(floor(least(1.0::double, greatest(0.0::double, (dk * coalesce(s, 1) - 0.45) / 0.3)) * 255 + 0.5) as int) end alpha from v left join sc using (img))"


@query("c4_line_art_alpha", f"with {ORD_SQL}, {ALPHA_SQL} select img, i, alpha from al")
def c4(s, d):
    """The drawing is an outside input (1 = paper, 0 = ink); here the blue channel stands for it."""
    w = Window.partitionBy("img")
    v = r_ord(s, d).withColumn("dk", 1 - F.col("b") / 255.0)
    k = v.where("dk > 0.08").select("img", "dk", (F.row_number().over(w.orderBy("dk")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    p95 = F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), F.col("dk")))
    scale = k.groupBy("img").agg((1 / F.greatest(F.coalesce(p95, F.lit(1.0)), F.lit(0.35))).alias("s"))
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("dk") * F.coalesce("s", F.lit(1.0)) - 0.45) / 0.3))
    frame = (F.col("x") < 8) | (F.col("y") < 8) | (F.col("x") >= ORD[0] - 8) | (F.col("y") >= ORD[1] - 8)
    return v.join(scale, "img", "left").select("img", "i", F.when(frame, 0).otherwise(C.round_half_up(ramp * 255).cast("int")).alias("alpha"))


@query("c7_outline_asset", f"""with {ORD_SQL}, {ALPHA_SQL},
px as (select ord.img, x, y, case when alpha > 0 then '1f1f1f' || lower(printf('%02x', alpha)) else '00000000' end h from ord join al on al.img = ord.img and al.i = ord.i),
im as (select img, cast(max(x) + 1 as int) width, cast(max(y) + 1 as int) height, string_agg(h, '' order by y, x) h from px group by img),
f as (select *, encode('P7' || chr(10) || 'WIDTH ' || width || chr(10) || 'HEIGHT ' || height || chr(10) || 'DEPTH 4' || chr(10) || 'MAXVAL 255' || chr(10) || 'TUPLTYPE RGB_ALPHA' || chr(10) || 'ENDHDR' || chr(10)) || unhex(h) c from im)
select img, width, height, cast(octet_length(c) as int) bytes, sha1(c) sha from f""")
def c7(s, d):
    """An outline file of each image, from its line art: alpha curve, ink, and the encoded picture."""
    px = r_ord(s, d)
    ink = segment.outline_pixels(px.select("img", "i", "x", "y").join(c4(s, d), ["img", "i"]), ORD, line_art=True)
    full = px.select("img", "i", "x", "y").join(ink.select("img", "i", "ink", "alpha"), ["img", "i"], "left")
    rgba = full.select("img", "x", "y", *(F.coalesce("ink", F.lit(0)).alias(c) for c in "rgb"), F.coalesce("alpha", F.lit(0)).alias("a"))
    return rasters.encode_pam(rgba).select("img", "width", "height", F.length("content").alias("bytes"), F.sha1("content").alias("sha"))


@query("s2_s11_raster_files", f"with {ORD_SQL} select img, i, x, y, r, g, b from ord")
def s11(s, d):
    """Every image written as a file to the shared folder, and read again."""
    raster_source.register(s)
    path = f"{shared_folder(s)}/rasters-{uuid.uuid4().hex}"
    pixels = r_ord(s, d)
    raster_source.in_file_order(pixels.withColumn("slug", F.col("img").cast("string"))).write.format("raster").mode("append").save(path)
    back = s.read.format("raster").load(path).select(F.col("slug").cast("bigint").alias("img"), "i", "x", "y", "r", "g", "b")
    return back.join(pixels.select("img", "i"), ["img", "i"], "left_semi")  # a file also holds what is missing of its frame


TURN_SQL = f"""with {ORD_SQL}, f as (select img, max(x) mx, max(y) my from ord group by img),
t as (select img, k, r, g, b, case k when 2 then mx - x when 3 then mx - x when 5 then y when 6 then my - y when 7 then my - y when 8 then y else x end x,
 case k when 3 then my - y when 4 then my - y when 5 then x when 6 then x when 7 then mx - x when 8 then mx - x else y end y from ord join f using (img), range(1, 9) o(k))"""


@query("s2_turned_rasters", f"{TURN_SQL} select img, k orientation, x, y, r, g, b from t")
def s2_turned(s, d):
    """Every image turned upright from each of the eight orientations."""
    each = r_ord(s, d).select("img", "x", "y", "r", "g", "b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))).alias("orientation"))
    return turning.turned(each, F.col("orientation"))[["img", "orientation", "x", "y", "r", "g", "b"]]


@query("s2_fit_inside", f"""{TURN_SQL}, z as (select img, k, max(x) + 1 w, max(y) + 1 h from t group by all),
s as (select *, greatest(1, cast(floor(w * least(1.0::double, 40.0::double / greatest(w, h)) + 0.5) as int)) tw, greatest(1, cast(floor(h * least(1.0::double, 40.0::double / greatest(w, h)) + 0.5) as int)) th from z),
bx as (select img, k, w, h, tw, th, ox, unnest(range(th)) oy from (select *, unnest(range(tw)) ox from s))
select bx.img, bx.k orientation, cast(ox as int) x, cast(oy as int) y, round(avg(r::double), 3) r, round(avg(g::double), 3) g, round(avg(b::double), 3) b from bx join t on t.img = bx.img and t.k = bx.k
 and t.x >= floor(ox * w / tw::double) and t.x < ceil((ox + 1) * w / tw::double) and t.y >= floor(oy * h / th::double) and t.y < ceil((oy + 1) * h / th::double) group by bx.img, bx.k, ox, oy""")
def s2_fit(s, d):
    """The turned images shrunk to at most 40 pixels a side."""
    small = turning.fit_inside(s2_turned(s, d), 40, list("rgb"), ("img", "orientation"))
    return small.select("img", "orientation", "x", "y", *(F.round(c, 3).alias(c) for c in "rgb"))


@query("c5_c6_c8_incremental_build")
def c8(s, d):
    """Catalog of all images: those whose hash is in the cache are taken over, the others are segmented."""
    px = r_ord(s, d)
    now = px.groupBy("img").agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b"))), lambda p: F.concat_ws(",", p["r"], p["g"], p["b"])), ";").cast("binary")).alias("sha1")).select(F.col("img").cast("string").alias("slug"), "sha1")
    cache = now.where("slug % 2 = 0")
    plan = build_plan(now, cache, now.select("slug", F.lit(3).alias("entries")), now.select("slug"))
    pending = px.join(plan.where("status = 'pending'").select(F.col("slug").cast("bigint").alias("img")), "img", "left_semi")
    made = segment.segment_labels(pending, ORD, "easy", **SMALL).groupBy("img").agg(F.countDistinct("region_id").alias("regions"), F.countDistinct("color_idx").alias("colors"))
    return plan.join(now, "slug").withColumn("img", F.col("slug").cast("bigint")).join(made, "img", "left").select("img", "sha1", "status", "regions", "colors")


@query("t4_stream_fills", f"with {TAP_SQL} select puzzle, region, arg_max(fill, struct_pack(ts := ts, e := event_id)) fill from ok group by all")
def t4_stream(s, d):
    return stream_fills(s, d).select("puzzle", "region", "fill")


IDLE_MS, FAR_TAP, LONG_TAP_MS = 4 * 86_400_000, 60.0, 86_400_000


def _gestures_sql() -> str:
    """One session's events gone through in order by recursion, with the machine's state in columns."""
    kinds = " ".join(f"when '{t}' then '{k}'" for t, k in gestures.KINDS.items())
    fresh = lambda c, v: f"case when idle then {v} else {c} end {c}"
    return f"""with recursive e as materialized (select user_id session, row_number() over (partition by user_id order by epoch_ms(ts), event_id) n, event_id ev, epoch_ms(ts) ms, case event_type {kinds} end kind, event_id % 3 id,
 cast(json_extract_string(props, '$.k') as double) x, value y from events where user_id is not null and event_id is not null and ts is not null and event_type in ({", ".join(repr(t) for t in gestures.KINDS)}) and json_extract_string(props, '$.k') is not null and value is not null),
g as (select session, 0::bigint n, 0::bigint ev, null::bigint ms, cast([] as struct(id bigint, x double, y double)[]) p, null::struct(x double, y double, t bigint, ev bigint) tap, null::struct(x double, y double) pan, null::struct(d double, mx double, my double) pin,
 1::double s, 0::double tx, 0::double ty, null::bigint dp, null::bigint sev, false pinching, cast([] as struct(what varchar, began bigint)[]) told from (select distinct session from e)
 union all
 select session, n, ev, ms, p, tap1, pan1, pin1, s1, tx1, ty1, dp1, sev1, pinching1, told1 from (
  select *, case when kind = 'down' then case when m = 1 then {{'x': x, 'y': y, 't': ms, 'ev': ev}} end when kind = 'move' then tap when m = 1 then tap end tap1,
   case when kind = 'down' then case when m = 1 then {{'x': x, 'y': y}} end when kind = 'move' then case when pans then {{'x': x, 'y': y}} else pan end when m = 1 then {{'x': p[1].x, 'y': p[1].y}} end pan1,
   case when kind = 'down' then case when m = 1 then pin when m = 2 then now end when kind = 'move' then case when pinches then now else pin end end pin1,
   case when moves then z else s end s1,
   case when moves then now.mx - (now.mx - tx) * (z / s) + (now.mx - pin.mx) when pans then tx + x - pan.x else tx end tx1,
   case when moves then now.my - (now.my - ty) * (z / s) + (now.my - pin.my) when pans then ty + y - pan.y else ty end ty1,
   case when kind = 'down' then case when starts then id when m = 2 then null else dp end when ends then null else dp end dp1,
   case when kind = 'down' then case when starts then ev when m = 2 then null else sev end when ends then null else sev end sev1,
   case when kind = 'down' then pinching or (m = 2 and not starts) when kind = 'move' then pinching when ends then pinching else pinching and m >= 2 end pinching1,
   list_filter([case when kind = 'up' and m <> 1 and tap is not null and sqrt((x - tap.x) ** 2 + (y - tap.y) ** 2) <= {FAR_TAP} and ms - tap.t <= {LONG_TAP_MS} then {{'what': 'tap', 'began': tap.ev}} end,
    case when (kind = 'down' and m = 2 and sev is not null) or ends then {{'what': 'stroke', 'began': sev}} end, case when moves then {{'what': 'pinch', 'began': null}} end, case when pans then {{'what': 'pan', 'began': null}} end], lambda o: o is not null) told1
  from (select *, kind = 'down' and dp is null and not pinching and m = 1 starts, kind in ('up', 'cancel') and dp is not null and dp = id ends,
    pinches and pin.d > 0 and now.d > 0 moves, case when pinches and pin.d > 0 and now.d > 0 then least(8.0::double, greatest(1.0::double, s * (now.d / pin.d))) end z, kind = 'move' and known and m = 1 and s > 1 and pan is not null pans
   from (select *, kind = 'move' and known and m = 2 and pin is not null pinches from (
    select *, len(p) m, case when len(p) = 2 then {{'d': sqrt((p[1].x - p[2].x) ** 2 + (p[1].y - p[2].y) ** 2), 'mx': (p[1].x + p[2].x) / 2, 'my': (p[1].y + p[2].y) / 2}} end now from (
     select * replace (case when kind in ('up', 'cancel') then list_filter(p, lambda q: q.id <> r_id) when known then list_transform(p, lambda q: case when q.id = r_id then {{'id': r_id, 'x': r_x, 'y': r_y}} else q end) when kind = 'down' then list_append(p, {{'id': r_id, 'x': r_x, 'y': r_y}}) else p end as p) from (
      select *, len(list_filter(p, lambda q: q.id = r_id)) > 0 known from (
       select session, n, ev, ms, kind, id, x, y, id r_id, x r_x, y r_y, {fresh("p", "[]")}, {fresh("tap", "null")}, {fresh("pan", "null")}, {fresh("pin", "null")}, {fresh("s", "1")}, {fresh("tx", "0")}, {fresh("ty", "0")}, {fresh("dp", "null")}, {fresh("sev", "null")}, {fresh("pinching", "false")} from (
        select e.*, g.p, g.tap, g.pan, g.pin, g.s, g.tx, g.ty, g.dp, g.sev, g.pinching, coalesce(e.ms - g.ms > {IDLE_MS}, false) idle from g join e on e.session = g.session and e.n = g.n + 1)))))))))
select session, ev event_id, t.what what, t.began began, round(s, 4) scale, round(tx, 4) tx, round(ty, 4) ty from (select session, ev, s, tx, ty, unnest(told) t from g where len(told) > 0)"""


@query("t9_t11_t12_gestures", _gestures_sql())
def t9(s, d):
    """Taps, strokes, pinches and pans of every user's events, as a stream with keyed state. Events are minutes apart here, so a tap may last a day."""
    told = gestures.stream_gestures(s, d, idle_ms=IDLE_MS, tap_pixels=FAR_TAP, tap_ms=LONG_TAP_MS)
    return told.select("session", "event_id", "what", "began", *(F.round(c, 4).alias(c) for c in ("scale", "tx", "ty")))

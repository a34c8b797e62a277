"""Registered queries over pixel and region relations, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import EMB_SQL, ORD, ORD_SQL, PART, PART_SQL, load, r_emb, r_ord, r_part
from ..functions import color as C
from ..operators import regions as R
from ..operators.palette import assign, lloyd_step

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r4(c, n: int = 3):
    return F.round(c.cast("double"), n)


# --- colour algebra -------------------------------------------------------------------------------------------------------
LIN = lambda c: f"cast(case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) end as float)"
FWD = lambda t: f"(case when {t} > 0.008856 then cbrt({t}) else 7.787 * {t} + 16 / 116.0::double end)"
INV = lambda t: f"(case when {t} * {t} * {t} > 0.008856 then {t} * {t} * {t} else ({t} - 16 / 116.0::double) / 7.787 end)"
BYTE = lambda c: f"cast(least(255, greatest(0, floor((case when {c} <= 0.0031308 then {c} * 12.92 else 1.055 * pow(greatest({c}, 0), 1 / 2.4::double) - 0.055 end) * 255 + 0.5))) as int)"
LAB_SQL = f"""
lin as (select *, {LIN('r')}::double lr, {LIN('g')}::double lg, {LIN('b')}::double lb from ord),
xyz as (select *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 tx, (0.2126729 * lr + 0.7151522 * lg + 0.072175 * lb) ty, (0.0193339 * lr + 0.119192 * lg + 0.9503041 * lb) / 1.08883 tz from lin),
ff as (select *, {FWD('tx')} fx, {FWD('ty')} fy, {FWD('tz')} fz from xyz),
lab as (select *, cast(116 * fy - 16 as float) l, cast(500 * (fx - fy) as float) a, cast(200 * (fy - fz) as float) bb from ff)"""
RGB_SQL = f"""
g1 as (select *, (l::double + 16) / 116 gy, (l::double + 16) / 116 + a::double / 500 gx, (l::double + 16) / 116 - bb::double / 200 gz from lab),
g2 as (select *, {INV('gx')} * 0.95047 ux, {INV('gy')} uy, {INV('gz')} * 1.08883 uz from g1),
g3 as (select *, 3.2404542 * ux - 1.5371385 * uy - 0.4985314 * uz cr, -0.969266 * ux + 1.8760108 * uy + 0.041556 * uz cg, 0.0556434 * ux - 0.2040259 * uy + 1.0572252 * uz cb from g2),
rgb as (select *, {BYTE('cr')} r2, {BYTE('cg')} g2b, {BYTE('cb')} b2 from g3)"""


def lab_pixels(s: SparkSession, d: str) -> DataFrame:
    return r_ord(s, d).withColumn("lab", C.lab(F.col("r"), F.col("g"), F.col("b")))


@query("p1_linear_light", f"with {ORD_SQL} select img, i, round({LIN('r')}::double, 5) lin from ord")
def p1(s, d):
    return r_ord(s, d).select("img", "i", r4(C.linear(F.col("r")), 5).alias("lin"))


@query("p2_forward_curve", f"with {ORD_SQL} select img, i, round({FWD('(g / 255.0::double)')}, 5) f from ord")
def p2(s, d):
    return r_ord(s, d).select("img", "i", r4(C.cube_root_or_line(F.col("g") / 255.0), 5).alias("f"))


@query("p3_rgb_to_lab", f"with {ORD_SQL}, {LAB_SQL} select img, i, round(l::double, 3) l, round(a::double, 3) a, round(bb::double, 3) b from lab")
def p3(s, d):
    return lab_pixels(s, d).select("img", "i", *(r4(F.col(f"lab.{c}")).alias(c) for c in "lab"))


@query("p4_inverse_curve", f"with {ORD_SQL} select img, i, round({INV('(g / 255.0::double)')}, 5) f from ord")
def p4(s, d):
    return r_ord(s, d).select("img", "i", r4(C.cube_or_line(F.col("g") / 255.0), 5).alias("f"))


@query("p5_srgb_byte", f"with {ORD_SQL} select img, i, {BYTE('(g / 200.0::double - 0.1)')} byte from ord")
def p5(s, d):
    return r_ord(s, d).select("img", "i", C.srgb_byte(F.col("g") / 200.0 - 0.1).alias("byte"))


@query("p6_lab_to_rgb", f"with {ORD_SQL}, {LAB_SQL}, {RGB_SQL} select img, i, r2 as r, g2b as g, b2 as b from rgb")
def p6(s, d):
    return lab_pixels(s, d).withColumn("c", C.rgb(*(F.col(f"lab.{k}").cast("double") for k in "lab"))).select("img", "i", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("rgb")))


@query("p7_lab_to_hex", f"with {ORD_SQL}, {LAB_SQL.replace('cast(500 * (fx - fy) as float) a', 'cast(500 * (fx - fy) as float)::double * 1.12 a').replace('cast(200 * (fy - fz) as float) bb', 'cast(200 * (fy - fz) as float)::double * 1.12 bb')}, {RGB_SQL} select img, i, printf('#%02x%02x%02x', r2, g2b, b2) hex from rgb")
def p7(s, d):
    return lab_pixels(s, d).select("img", "i", C.lab_hex(*(F.col(f"lab.{k}").cast("double") for k in "lab"), boost=1.12).alias("hex"))


@query("p8_hex_to_lab", f"with {ORD_SQL}, {LAB_SQL} select img, i, round(l::double, 3) l, round(a::double, 3) a, round(bb::double, 3) b from lab")
def p8(s, d):
    return r_ord(s, d).withColumn("h", C.hex_of(F.array("r", "g", "b"))).withColumn("lab", C.hex_lab(F.col("h"))).select("img", "i", *(r4(F.col(f"lab.{c}")).alias(c) for c in "lab"))


@query("p9_color_distance", f"with {ORD_SQL}, {LAB_SQL} select p.img, p.i, round((p.l::double - q.l::double) ** 2 + (p.a::double - q.a::double) ** 2 + (p.bb::double - q.bb::double) ** 2, 1) d from lab p join lab q on p.img = q.img and q.i = p.i + 1 and p.y = q.y")
def p9(s, d):
    nxt = F.lead("lab").over(R.row_window())
    return lab_pixels(s, d).withColumn("n", nxt).where("n is not null").select("img", "i", r4(C.distance_sq(F.col("lab"), F.col("n")), 1).alias("d"))


@query("p10_hex_to_rgb", f"with {ORD_SQL} select img, i, r, g, b from ord")
def p10(s, d):
    c = C.hex_rgb(C.hex_of(F.array("r", "g", "b")))
    return r_ord(s, d).withColumn("c", c).select("img", "i", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("rgb")))


@query("p11_min_area", "select p_partkey, greatest(p_size * 40 * 0.004::double, 150.0::double) area from part")
def p11(s, d):
    return load(s, d, "part").select("p_partkey", F.greatest(F.col("p_size") * 40 * 0.004, F.lit(150.0)).alias("area"))


@query("p12_confidence_min_area", "select p_partkey, round(400 + (1 - coalesce(case when p_size % 5 = 0 then null else p_size / 50.0 end, 0)) * (3000 - 400), 3) area from part")
def p12(s, d):
    conf = F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0)
    return load(s, d, "part").select("p_partkey", F.round(400 + (1 - F.coalesce(conf, F.lit(0.0))) * (3000 - 400), 3).alias("area"))


@query("p20_spatial_kernel", "select p_partkey, x - 4 dx, y - 4 dy, round(cast(exp(-((x - 4) ** 2 + (y - 4) ** 2) / (2 * (4 / 1.5) ** 2)) as float)::double, 5) w from part, range(9) a(x), range(9) b(y)")
def p20(s, d):
    o = F.sequence(F.lit(-4), F.lit(4)).cast("array<bigint>")
    k = load(s, d, "part").select("p_partkey", F.explode(o).alias("dx")).select("*", F.explode(o).alias("dy"))
    return k.withColumn("w", r4(F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * (4 / 1.5) ** 2)).cast("float"), 5))


@query("p21_line_distance", f"with {ORD_SQL} select img, i, case when r = g and g = b then cast((x - r) ** 2 + (y - g) ** 2 as double) else round(((x - r) * (b - g) - (y - g) * (g - r)) ** 2 / cast((g - r) ** 2 + (b - g) ** 2 as double), 3) end d from ord")
def p21(s, d):
    ux, uy, vx, vy = F.col("g") - F.col("r"), F.col("b") - F.col("g"), F.col("x") - F.col("r"), F.col("y") - F.col("g")
    cross = (vx * uy - vy * ux).cast("double")
    flat = (ux == 0) & (uy == 0)
    return r_ord(s, d).select("img", "i", F.when(flat, (vx * vx + vy * vy).cast("double")).otherwise(F.round(cross * cross / (ux * ux + uy * uy), 3)).alias("d"))


@query("p22_direction", f"with {ORD_SQL} select img, i, case when r < g then (case when g < b then 1 when g > b then 7 else 0 end) when r > g then (case when g < b then 3 when g > b then 5 else 4 end) else (case when g < b then 2 when g > b then 6 else 0 end) end dir from ord")
def p22(s, d):
    sx, sy = F.signum(F.col("r") - F.col("g")), F.signum(F.col("g") - F.col("b"))
    names = F.create_map(*(F.lit(v) for k, (a, b) in enumerate([(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]) for v in (f"{a},{b}", k)))
    return r_ord(s, d).select("img", "i", F.coalesce(names[F.concat_ws(",", sx.cast("int").cast("string"), sy.cast("int").cast("string"))], F.lit(0)).alias("dir"))


@query("p24_canvas_point", f"with {ORD_SQL} select img, i, round((r - 10) * 125 / 250.0, 3) px, round((g - 20) * 40 / 200.0, 3) py, cast(floor((r - 10) * 125 / 250.0) as bigint) ix from ord")
def p24(s, d):
    px, py = (F.col("r") - 10) * 125 / 250.0, (F.col("g") - 20) * 40 / 200.0
    return r_ord(s, d).select("img", "i", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"), F.floor(px).alias("ix"))


@query("p25_zoom_pan", f"with {ORD_SQL}, z as (select *, least(8.0, greatest(1.0, r / 30.0)) z0 from ord), y as (select *, case when z0 < 1.05 then 1.0 else z0 end z1 from z) select img, i, round(z1, 4) zoom, round(least(0.0, greatest(125 - 125 * z1, g - 128)), 3) pan from y")
def p25(s, d):
    z0 = F.least(F.lit(8.0), F.greatest(F.lit(1.0), F.col("r") / 30.0))
    z = F.when(z0 < 1.05, 1.0).otherwise(z0)
    return r_ord(s, d).select("img", "i", F.round(z, 4).alias("zoom"), F.round(F.least(F.lit(0.0), F.greatest(125 - 125 * z, (F.col("g") - 128).cast("double"))), 3).alias("pan"))


@query("p28_planar_tensor", f"with {ORD_SQL}, c as (select * from ord where x < 124 and y < 40) select img, list(round(r / 255.0::double, 4) order by i) r, list(round(g / 255.0::double, 4) order by i) g, list(round(b / 255.0::double, 4) order by i) b from c group by img")
def p28(s, d):
    crop = r_ord(s, d).where(f"x < {ORD[0] - ORD[0] % 4} and y < {ORD[1] - ORD[1] % 4}")
    plane = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda t: F.round(t[c] / 255.0, 4)).alias(c)
    return crop.groupBy("img").agg(plane("r"), plane("g"), plane("b"))


@query("p29_presets", "select c_custkey, list_extract(['#e6194b','#f58231','#ffe119','#bfef45','#3cb44b','#42d4f4','#4363d8','#911eb4','#f032e6','#a9a9a9','#000000','#ffffff'], cast(c_custkey % 12 as int) + 1) color from customer")
def p29(s, d):
    return load(s, d, "customer").select("c_custkey", F.get(F.array(*map(F.lit, C.PRESETS)), (F.col("c_custkey") % 12).cast("int")).alias("color"))


# --- masks and filters ------------------------------------------------------------------------------------------------------
@query("f1_usable_mask", f"with {ORD_SQL}, u as (select img, avg(case when conf > 128 then 1.0 else 0.0 end) share from ord group by img) select o.img, o.i, case when share < 0.02 or share > 0.98 then null else conf > 128 end fg from ord o join u using (img)")
def f1(s, d):
    px = r_ord(s, d)
    share = px.groupBy("img").agg(F.avg((F.col("conf") > 128).cast("double")).alias("share"))
    return px.join(share, "img").select("img", "i", F.when(F.col("share").between(0.02, 0.98), F.col("conf") > 128).alias("fg"))


@query("f2_masked_pixels", f"with {ORD_SQL} select img, i, r from ord where conf > 128")
def f2(s, d):
    return r_ord(s, d).where("conf > 128").select("img", "i", "r")


@query("f3_focus_pixels", f"with {ORD_SQL} select img, i, r from ord where r > 0 and conf > 128")
def f3(s, d):
    return r_ord(s, d).where("r > 0 and conf > 128").select("img", "i", "r")


@query("f5_background_region", f"with {ORD_SQL} select img, r % 7 region, avg(conf) / 255 < 0.5 background from ord group by all")
def f5(s, d):
    return r_ord(s, d).groupBy("img", (F.col("r") % 7).alias("region")).agg((F.avg("conf") / 255 < 0.5).alias("background"))


@query("f6_subject_region", f"with {ORD_SQL} select img, r % 7 region, avg(conf) > 127 subject from ord group by all")
def f6(s, d):
    return r_ord(s, d).groupBy("img", (F.col("r") % 7).alias("region")).agg((F.avg("conf") > 127).alias("subject"))


@query("f7_inside", f"with {PART_SQL} select p.img, p.i, coalesce(q.idx = p.idx, false) inside from prt p left join prt q on p.img = q.img and q.x = p.x + 1 and q.y = p.y - 1")
def f7(s, d):
    px = r_part(s, d)
    q = px.select("img", (F.col("x") - 1).alias("x"), (F.col("y") + 1).alias("y"), F.col("idx").alias("q"))
    return px.join(q, ["img", "x", "y"], "left").select("img", "i", F.coalesce(F.col("q") == F.col("idx"), F.lit(False)).alias("inside"))


@query("f9_region_at_point", f"with {PART_SQL}, t as (select event_id, user_id % 4 img, cast(user_id % 60 as int) x, cast(event_id % 12 as int) y from events) select event_id, idx region from t left join prt using (img, x, y)")
def f9(s, d):
    t = load(s, d, "events").select("event_id", (F.col("user_id") % 4).alias("img"), (F.col("user_id") % 60).cast("int").alias("x"), (F.col("event_id") % 12).cast("int").alias("y"))
    return t.join(r_part(s, d), ["img", "x", "y"], "left").select("event_id", F.col("idx").alias("region"))


# --- joins over pixels ------------------------------------------------------------------------------------------------------
@query("j1_adjacency", f"with {PART_SQL}, e as (select p.img, p.idx a, q.idx b from prt p join prt q on p.img = q.img and ((q.x = p.x + 1 and q.y = p.y) or (q.x = p.x and q.y = p.y + 1)) where p.idx <> q.idx) select img, a, b, count(*) border from (select * from e union all select img, b, a from e) group by all")
def j1(s, d):
    return R.adjacency(r_part(s, d), "idx").select("img", "a", "b", F.col("border").cast("bigint").alias("border"))


@query("j2_color_by_region", f"with {PART_SQL} select p.img, p.i, case p.idx when 0 then '#e6194b' when 1 then '#f58231' when 2 then '#ffe119' else '#ff00ff' end color, coalesce(e.idx <> p.idx, false) or coalesce(b.idx <> p.idx, false) edge from prt p left join prt e on e.img = p.img and e.y = p.y and e.x = p.x + 1 left join prt b on b.img = p.img and b.x = p.x and b.y = p.y + 1")
def j2(s, d):
    px = R.neighbours(r_part(s, d), "idx")
    colors = s.createDataFrame([(k, C.PRESETS[k]) for k in range(3)], "idx int, color string")
    return px.join(F.broadcast(colors), "idx", "left").select("img", "i", F.coalesce("color", F.lit("#ff00ff")).alias("color"), R.boundary(px, "idx", False).alias("edge"))


@query("j3_paint_buffer", f"with {PART_SQL} select p.img, p.i, case when coalesce(e.idx <> p.idx, false) or coalesce(w.idx <> p.idx, false) or coalesce(b.idx <> p.idx, false) or coalesce(n.idx <> p.idx, false) then '#2b2b2b' when p.idx = 1 then '#f58231' else '#ffffff' end color from prt p left join prt e on e.img = p.img and e.y = p.y and e.x = p.x + 1 left join prt w on w.img = p.img and w.y = p.y and w.x = p.x - 1 left join prt b on b.img = p.img and b.x = p.x and b.y = p.y + 1 left join prt n on n.img = p.img and n.x = p.x and n.y = p.y - 1")
def j3(s, d):
    px = R.neighbours(r_part(s, d), "idx")
    fills = s.createDataFrame([(1, C.PRESETS[1])], "idx int, fill string")
    return px.join(F.broadcast(fills), "idx", "left").select("img", "i", F.when(R.boundary(px, "idx"), "#2b2b2b").otherwise(F.coalesce("fill", F.lit("#ffffff"))).alias("color"))


#: Palettes of a query: the colours of every 1250th pixel of an image.
CENTS_SQL = "cents as (select img, cast(i // 1250 as int) idx, l, a, bb from lab where i % 1250 = 0)"


def cents(px: DataFrame) -> DataFrame:
    return px.where("i % 1250 = 0").select("img", F.floor(F.col("i") / 1250).cast("int").alias("idx"), F.col("lab.l").alias("l"), F.col("lab.a").alias("a"), F.col("lab.b").alias("b"))


NEAR = "(p.l::double - c.l::double) * (p.l::double - c.l::double) + (p.a::double - c.a::double) * (p.a::double - c.a::double) + (p.bb::double - c.bb::double) * (p.bb::double - c.bb::double)"


@query("j4_j5_nearest_centroid", f"with {ORD_SQL}, {LAB_SQL}, {CENTS_SQL} select img, i, idx from (select p.img, p.i, c.idx, row_number() over (partition by p.img, p.i order by round({NEAR}, 6), c.idx) k from lab p join cents c on p.img = c.img) where k = 1")
def j5(s, d):
    px = lab_pixels(s, d)
    return assign(px, cents(px)).select("img", "i", "idx")


@query("j6_partitioned_assignment", f"with {ORD_SQL}, {LAB_SQL}, {CENTS_SQL} select img, i, idx from (select p.img, p.i, c.idx, row_number() over (partition by p.img, p.i order by round({NEAR}, 6), c.idx) k from lab p join cents c on p.img = c.img and (p.conf > 128) = (c.idx < 2)) where k = 1")
def j6(s, d):
    px = lab_pixels(s, d).withColumn("fg", F.col("conf") > 128)
    return assign(px, cents(px).withColumn("fg", F.col("idx") < 2), "fg").select("img", "i", "idx")


@query("a16_lloyd_step", f"with {ORD_SQL}, {LAB_SQL}, {CENTS_SQL}, n as (select p.*, c.idx, row_number() over (partition by p.img, p.i order by round({NEAR}, 6), c.idx) k from lab p join cents c on p.img = c.img) select img, idx, round(avg(l::double), 2) l, round(avg(a::double), 2) a, round(avg(bb::double), 2) b, count(*) n from n where k = 1 group by img, idx")
def a16(s, d):
    px = lab_pixels(s, d)
    return lloyd_step(assign(px, cents(px))).select("img", "idx", *(F.round(c, 2).alias(c) for c in "lab"), "n")


@query("j7_mask_resize", f"with {ORD_SQL}, t as (select img, w, h, cast(x as int) x, cast(y as int) y from (select img, max(x) + 1 w, max(y) + 1 h from ord group by img), range(200) a(x), range(64) b(y)) select t.img, t.x, t.y, coalesce(conf, 0) conf from t left join ord o on o.img = t.img and o.x = least(w - 1, cast(floor(t.x / 200.0 * w) as int)) and o.y = least(h - 1, cast(floor(t.y / 64.0 * h) as int))")
def j7(s, d):
    """The mask at 200 x 64: every target pixel of every image takes the nearest source pixel of the image's own frame; where the source lacks one, 0."""
    px = r_ord(s, d)
    rows = R.frames(px).select("img", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("ty"), (F.col("right") + 1).alias("w"), (F.col("bottom") + 1).alias("h"))
    target = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("tx"))
    at = lambda t, n, size: F.least(F.col(size) - 1, F.floor(F.col(t) / F.lit(float(n)) * F.col(size))).cast("int")
    src = target.withColumns({"x": at("tx", 200, "w"), "y": at("ty", 64, "h")})
    return src.join(px, ["img", "x", "y"], "left").select("img", F.col("tx").alias("x"), F.col("ty").alias("y"), F.coalesce("conf", F.lit(0)).alias("conf"))


@query("j12_final_labels", f"with {PART_SQL} select img, i, idx // 2 root from prt")
def j12(s, d):
    px = r_part(s, d)
    roots = px.select("img", "idx").distinct().withColumn("root", F.floor(F.col("idx") / 2).cast("int"))
    return px.join(roots, ["img", "idx"]).select("img", "i", "root")


@query("j13_region_lines", f"with {PART_SQL}, c as (select *, case idx when 0 then 10.0 when 1 then 25.0 when 2 then 60.0 else 70.0 end l from prt), e as (select p.img, p.i i, q.i j from c p join c q on p.img = q.img and ((q.x = p.x + 1 and q.y = p.y) or (q.x = p.x and q.y = p.y + 1)) where p.idx <> q.idx and (p.l - q.l) ** 2 >= 18 * 18) select distinct img, i from (select img, i from e union all select img, j from e)")
def j13(s, d):
    colors = s.createDataFrame([(0, 10.0), (1, 25.0), (2, 60.0), (3, 70.0)], "idx int, l double")
    px = R.neighbours(r_part(s, d).join(F.broadcast(colors), "idx"), "l")
    far = [F.coalesce((F.col(c) - F.col("l")) * (F.col(c) - F.col("l")) >= 18 * 18, F.lit(False)) for c in ("_e", "_w", "_s", "_n")]
    return px.where(F.greatest(*far)).select("img", "i")


# --- aggregates, numbering ----------------------------------------------------------------------------------------------------
@query("a1_foreground_share", f"with {ORD_SQL} select img, count(*) filter (conf > 128) n, round(avg(case when conf > 128 then 1.0 else 0.0 end), 6) share from ord group by img")
def a1(s, d):
    return r_ord(s, d).groupBy("img").agg(F.count_if(F.col("conf") > 128).alias("n"), F.round(F.avg((F.col("conf") > 128).cast("double")), 6).alias("share"))


@query("a2_region_confidence", f"with {ORD_SQL} select img, r % 9 region, round(sum(conf) / count(*)::double / 255, 5) c from ord group by all")
def a2(s, d):
    return r_ord(s, d).groupBy("img", (F.col("r") % 9).alias("region")).agg(F.round(F.sum("conf") / F.count(F.lit(1)) / 255, 5).alias("c"))


@query("a3_region_area", f"with {PART_SQL} select img, idx region, count(*) area from prt group by all")
def a3(s, d):
    return r_part(s, d).groupBy("img", F.col("idx").alias("region")).agg(F.count(F.lit(1)).alias("area"))


@query("a4_centroid_sums", f"with {PART_SQL} select img, idx region, sum(x)::bigint sx, sum(y)::bigint sy from prt group by all")
def a4(s, d):
    return r_part(s, d).groupBy("img", F.col("idx").alias("region")).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))


REG_SQL = "reg as (select img, r % 9 region_id, (r % 9) % 4 color, count(*) area from ord group by all)"


def reg(s, d):
    k = F.col("r") % 9
    return r_ord(s, d).groupBy("img", k.alias("region_id"), (k % 4).alias("color")).agg(F.count(F.lit(1)).alias("area"))


@query("a5_area_by_color", f"with {ORD_SQL}, {REG_SQL} select img, color, sum(area)::bigint area from reg group by all")
def a5(s, d):
    return reg(s, d).groupBy("img", "color").agg(F.sum("area").alias("area"))


@query("a6_o1_palette_by_area", f"with {ORD_SQL}, {REG_SQL} select img, color, row_number() over (partition by img order by sum(area) desc, min(region_id)) color_no from reg group by img, color")
def a6(s, d):
    return R.color_numbers(reg(s, d)).select("img", "color", F.col("color_no").cast("bigint").alias("color_no"))


@query("a7_percentile_index", f"with {ORD_SQL}, v as (select img, r, row_number() over (partition by img order by r) - 1 k, count(*) over (partition by img) n from ord where r > 0 and conf > 128) select img, max(r) filter (k = least(n - 1, cast(floor(n * 0.95) as bigint))) hi, max(r) filter (k = least(n - 1, cast(floor(n * 0.85) as bigint))) lo from v group by img")
def a7(s, d):
    w = Window.partitionBy("img")
    v = r_ord(s, d).where("r > 0 and conf > 128").select("img", "r", (F.row_number().over(w.orderBy("r")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("r")))
    return v.groupBy("img").agg(at(0.95).alias("hi"), at(0.85).alias("lo"))


@query("a8_darkness_scale", f"with {ORD_SQL}, v as (select img, 1 - b / 255.0::double dk from ord), k as (select img, dk, row_number() over (partition by img order by dk) - 1 k, count(*) over (partition by img) n from v where dk > 0.08) select img, round(1 / greatest(coalesce(max(dk) filter (k = least(n - 1, cast(floor(n * 0.95) as bigint))), 1), 0.35), 5) scale from k group by img")
def a8(s, d):
    w = Window.partitionBy("img")
    v = r_ord(s, d).select("img", (1 - F.col("b") / 255.0).alias("dk")).where("dk > 0.08").select("img", "dk", (F.row_number().over(w.orderBy("dk")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    p95 = F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), F.col("dk")))
    return v.groupBy("img").agg(F.round(1 / F.greatest(F.coalesce(p95, F.lit(1.0)), F.lit(0.35)), 5).alias("scale"))


@query("a9_bounding_boxes", f"with {PART_SQL} select img, idx region, count(*) area, min(x) x0, max(x) x1, min(y) y0, max(y) y1, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::double, 5) fill from prt group by img, idx having count(*) between 24 and 400 and count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::double >= 0.05")
def a9(s, d):
    box = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    g = r_part(s, d).groupBy("img", F.col("idx").alias("region")).agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.count(F.lit(1)) / box).alias("f"))
    return g.where("area between 24 and 400 and f >= 0.05").withColumn("fill", F.round("f", 5)).drop("f")


@query("a12_max_region", f"with {PART_SQL} select img, max(idx) most from prt group by img")
def a12(s, d):
    return r_part(s, d).groupBy("img").agg(F.max("idx").alias("most"))


BOUND_SQL = "bd as (select p.*, coalesce(e.idx <> p.idx, false) or coalesce(w.idx <> p.idx, false) or coalesce(b.idx <> p.idx, false) or coalesce(n.idx <> p.idx, false) edge from prt p left join prt e on e.img = p.img and e.y = p.y and e.x = p.x + 1 left join prt w on w.img = p.img and w.y = p.y and w.x = p.x - 1 left join prt b on b.img = p.img and b.x = p.x and b.y = p.y + 1 left join prt n on n.img = p.img and n.x = p.x and n.y = p.y - 1)"


def bounded(s, d):
    px = R.neighbours(r_part(s, d), "idx")
    return px.withColumn("edge", R.boundary(px, "idx")).drop("_e", "_w", "_s", "_n")


@query("a13_fillable_pixels", f"with {PART_SQL}, {BOUND_SQL} select img, idx region, count(*) filter (not edge) n from bd group by img, idx")
def a13(s, d):
    return bounded(s, d).groupBy("img", F.col("idx").alias("region")).agg(F.count_if(~F.col("edge")).alias("n"))


@query("w10_base_outline", f"with {PART_SQL}, {BOUND_SQL} select img, i, edge from bd")
def w10(s, d):
    return bounded(s, d).select("img", "i", "edge")


@query("w11_dilate", f"with {PART_SQL}, m as (select * from prt where idx = 3) select p.img, p.i, exists (select 1 from m where m.img = p.img and abs(m.x - p.x) + abs(m.y - p.y) <= 1) ink from prt p")
def w11(s, d):
    px = R.neighbours(r_part(s, d).withColumn("m", F.col("idx") == 3), "m")
    return px.select("img", "i", F.greatest("m", *(F.coalesce(c, F.lit(False)) for c in ("_e", "_w", "_s", "_n"))).alias("ink"))


@query("w12_dilate_disc", f"with {PART_SQL}, m as (select * from prt where idx = 3) select distinct p.img, p.x, p.y from prt p join m on m.img = p.img and (m.x - p.x) ** 2 + (m.y - p.y) ** 2 <= 4")
def w12(s, d):
    return R.dilate(r_part(s, d).where("idx = 3"), 2, R.frames(r_part(s, d)))


@query("w13_erode_disc", f"with {PART_SQL} select p.img, p.i, case when exists (select 1 from prt m where m.idx = 3 and m.img = p.img and (m.x - p.x) ** 2 + (m.y - p.y) ** 2 <= 4) then 0 else 255 end conf from prt p")
def w13(s, d):
    px = r_part(s, d)
    gone = R.dilate(px.where("idx = 3"), 2, R.frames(px)).withColumn("g", F.lit(0))
    return px.join(gone, ["img", "x", "y"], "left").select("img", "i", F.coalesce("g", F.lit(255)).alias("conf"))


@query("w14_ink_alpha", f"with {ORD_SQL} select img, i, case when x < 8 or y < 8 or x >= 117 or y >= 32 then 0 else cast(floor(least(1.0, greatest(0.0, ((1 - r / 255.0::double) * 1.2 - 0.45) / 0.3)) * 255 + 0.5) as int) end alpha from ord")
def w14(s, d):
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((1 - F.col("r") / 255.0) * 1.2 - 0.45) / 0.3))
    frame = (F.col("x") < 8) | (F.col("y") < 8) | (F.col("x") >= ORD[0] - 8) | (F.col("y") >= ORD[1] - 8)
    return r_ord(s, d).select("img", "i", F.when(frame, 0).otherwise(C.round_half_up(ramp * 255).cast("int")).alias("alpha"))


# --- stencils -------------------------------------------------------------------------------------------------------------------
@query("w5_mode_filter", f"with {PART_SQL}, v as (select p.img, p.i, q.idx v, count(*) c, max(case when q.i = p.i then 1 else 0 end) own from prt p join prt q on p.img = q.img and abs(p.x - q.x) <= 2 and abs(p.y - q.y) <= 2 group by all) select img, i, v as value from (select *, row_number() over (partition by img, i order by c desc, own desc, v) k from v) where k = 1")
def w5(s, d):
    return R.vote(r_part(s, d), "idx", 2).select("img", (F.col("y") * PART[0] + F.col("x")).cast("bigint").alias("i"), "value")


def box_sql(source: str, col: str, radius: int = 24) -> str:
    """CTE bm: the rows of ``source`` with m, the mean over a box, by running sums over rows and then columns."""
    over = f"rows between {radius} preceding and {radius} following"
    return f"""br as (select *, sum({col}::double) over (partition by img, y order by x {over}) s, count(*) over (partition by img, y order by x {over}) k from {source}),
bm as (select *, sum(s) over (partition by img, x order by y {over}) / sum(k) over (partition by img, x order by y {over}) m from br)"""


@query("w6_local_mean_dark", f"with {ORD_SQL}, {box_sql('ord', 'r')} select img, i, round(m, 4) mean, r < m - 13 dark from bm")
def w6(s, d):
    m = R.with_local_mean(r_ord(s, d), "r", 24)
    return m.select("img", "i", F.round("mean", 4).alias("mean"), (F.col("r") < F.col("mean") - 13).alias("dark"))


BLUR_SQL = """bx as (select p.img, p.i, p.x, p.y, cast(sum(k.w * q.r) as float) v from ord p, (values (-2, 0.06136), (-1, 0.24477), (0, 0.38774), (1, 0.24477), (2, 0.06136)) k(t, w), ord q where q.img = p.img and q.y = p.y and q.x = least(124, greatest(0, p.x + k.t)) group by all),
bl as (select p.img, p.i, p.x, p.y, cast(sum(k.w * q.v::double) as float) v from bx p, (values (-2, 0.06136), (-1, 0.24477), (0, 0.38774), (1, 0.24477), (2, 0.06136)) k(t, w), bx q, (select img, max(y) my from ord group by img) h where h.img = p.img and q.img = p.img and q.x = p.x and q.y = least(my, greatest(0, p.y + k.t)) group by all)"""


def blurred(px: DataFrame, col: str) -> DataFrame:
    """Adds v, the separable five-tap blur of ``col``; borders are repeated."""
    taps = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)
    for w, src in ((R.row_window(), col), (R.col_window(), "v")):
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(src).over(full), F.last(src).over(full)
        near = [F.coalesce(F.lag(src, 2).over(w), first), F.coalesce(F.lag(src, 1).over(w), first), F.col(src), F.coalesce(F.lead(src, 1).over(w), last), F.coalesce(F.lead(src, 2).over(w), last)]
        px = px.withColumn("v", sum(F.lit(k) * n.cast("double") for k, n in zip(taps, near, strict=True)).cast("float"))
    return px


@query("w7_gaussian_blur", f"with {ORD_SQL}, {BLUR_SQL} select img, i, round(v::double, 2) v from bl")
def w7(s, d):
    return blurred(r_ord(s, d), "r").select("img", "i", r4(F.col("v"), 2).alias("v"))


SOBEL_SQL = """sb as (select c.img, c.i, c.x, c.y,
 case when c.x in (0, 124) or c.y in (0, my) then 0 else sum(case when n.x - c.x <> 0 then (n.x - c.x) * (case when n.y = c.y then 2 else 1 end) * n.r else 0 end) end gx,
 case when c.x in (0, 124) or c.y in (0, my) then 0 else sum(case when n.y - c.y <> 0 then (n.y - c.y) * (case when n.x = c.x then 2 else 1 end) * n.r else 0 end) end gy
 from ord c join (select img, max(y) my from ord group by img) h on h.img = c.img join ord n on n.img = c.img and abs(n.x - c.x) <= 1 and abs(n.y - c.y) <= 1 group by c.img, c.i, c.x, c.y, my),
mg as (select *, gx * gx + gy * gy m2, case when gx = 0 and gy = 0 then 0 else ((cast(floor(atan2(gy, gx) / pi() * 4 + 0.5) as int) % 4) + 4) % 4 end dir from sb)"""


def sobel(px: DataFrame, col: str = "r") -> DataFrame:
    """Adds gx, gy (integers for integer input), m2 = gx^2 + gy^2 and dir 0-3; 0 on the border of the image."""
    px = px.withColumns({"_l": F.lag(col).over(R.row_window()), "_r": F.lead(col).over(R.row_window())})
    px = px.withColumns({f"_{n}{k}": f(c).over(R.col_window()) for n, f in (("u", F.lag), ("d", F.lead)) for k, c in (("l", "_l"), ("c", col), ("r", "_r"))})
    inner = F.col("x").between(1, ORD[0] - 2) & F.col("_uc").isNotNull() & F.col("_dc").isNotNull()
    c = lambda n: F.col(n)
    gx = -c("_ul") + c("_ur") - 2 * c("_l") + 2 * c("_r") - c("_dl") + c("_dr")
    gy = -c("_ul") - 2 * c("_uc") - c("_ur") + c("_dl") + 2 * c("_dc") + c("_dr")
    px = px.withColumns({"gx": F.when(inner, gx).otherwise(0), "gy": F.when(inner, gy).otherwise(0)})
    octant = F.floor(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double")) / F.pi() * 4 + 0.5)
    way = F.when((F.col("gx") == 0) & (F.col("gy") == 0), 0).otherwise(F.pmod(octant, F.lit(4)).cast("int"))
    return px.withColumns({"m2": F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"), "dir": way})


@query("w8_sobel", f"with {ORD_SQL}, {SOBEL_SQL} select img, i, cast(gx as bigint) gx, cast(gy as bigint) gy, round(sqrt(m2::double), 3) mag, dir from mg")
def w8(s, d):
    return sobel(r_ord(s, d)).select("img", "i", F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"), F.round(F.sqrt(F.col("m2").cast("double")), 3).alias("mag"), "dir")


@query("w9_thin_edges", f"with {ORD_SQL}, {SOBEL_SQL} select c.img, c.i from mg c join mg a on a.img = c.img and a.x = c.x - (case c.dir when 2 then 0 else 1 end) and a.y = c.y - (case c.dir when 0 then 0 when 1 then -1 else 1 end) join mg b on b.img = c.img and b.x = c.x + (case c.dir when 2 then 0 else 1 end) and b.y = c.y + (case c.dir when 0 then 0 when 1 then -1 else 1 end) where c.m2 > 0 and c.m2 >= a.m2 and c.m2 >= b.m2")
def w9(s, d):
    return thinned(sobel(r_ord(s, d)), "m2").select("img", "i")


def thinned(m: DataFrame, strength: str) -> DataFrame:
    """(img, i, x, y, strength) of the pixels no weaker than both neighbours along the gradient's direction ``dir``."""
    dx, dy = F.when(F.col("dir") == 2, 0).otherwise(1), F.when(F.col("dir") == 0, 0).when(F.col("dir") == 1, -1).otherwise(1)
    own = F.struct("i", "x", "y", strength).alias("own")
    sides = m.where(F.col(strength) > 0).select("img", own, F.explode(F.array(F.lit(-1), F.lit(1))).alias("k"), "x", "y", dx.alias("dx"), dy.alias("dy"))
    at = sides.select("img", "own", (F.col("x") + F.col("k") * F.col("dx")).alias("x"), (F.col("y") + F.col("k") * F.col("dy")).alias("y"))
    both = at.join(m.select("img", "x", "y", F.col(strength).alias("near")), ["img", "x", "y"]).groupBy("img", "own").agg(F.max("near").alias("most"))
    return both.where(F.col(f"own.{strength}") >= F.col("most")).select("img", "own.*")


# --- numbering, runs, labels ------------------------------------------------------------------------------------------------------
@query("k1_run_lengths", f"with {EMB_SQL}, s as (select *, case when lag(idx) over w is distinct from idx and i > 0 then 1 else 0 end b from emb window w as (partition by img order by i)), n as (select *, sum(b) over (partition by img order by i) run_no from s) select img, run_no::bigint run_no, max(idx) as value, min(i) start_i, count(*) len from n group by img, run_no")
def k1(s, d):
    return R.runs(r_emb(s, d), "idx").select("img", F.col("run_no").cast("bigint").alias("run_no"), "value", "start_i", "len")


@query("k2_j16_decode_runs", f"with {EMB_SQL} select img, i, cast(idx as bigint) as value from emb")
def k2(s, d):
    return R.decode_runs(R.encode_runs(r_emb(s, d), "idx"))


@query("k3_region_index", f"with {PART_SQL}, {BOUND_SQL}, n as (select img, idx region, count(*) filter (not edge) n, list(i order by i) filter (not edge) pixels from bd group by img, idx) select img, region, n, (sum(n) over (partition by img order by region))::bigint - n offset_, coalesce(pixels, []) pixels from n")
def k3(s, d):
    g = bounded(s, d).groupBy("img", F.col("idx").alias("region")).agg(F.count_if(~F.col("edge")).alias("n"), F.array_sort(F.collect_list(F.when(~F.col("edge"), F.col("i")))).alias("pixels"))
    return g.withColumn("offset_", F.sum("n").over(Window.partitionBy("img").orderBy("region")) - F.col("n"))


@query("k4_fill_region", f"with {PART_SQL}, {BOUND_SQL} select img, i, case when idx = 2 and not edge then '#3cb44b' else '#ffffff' end color from bd")
def k4(s, d):
    return bounded(s, d).select("img", "i", F.when((F.col("idx") == 2) & ~F.col("edge"), C.PRESETS[4]).otherwise("#ffffff").alias("color"))


@query("k5_o7_label_points", f"with {PART_SQL}, c as (select img, idx, floor(avg(x) + 0.5) cx, floor(avg(y) + 0.5) cy from prt group by all) select img, region_id, label_x, label_y from (select p.img, p.idx region_id, p.x label_x, p.y label_y, row_number() over (partition by p.img, p.idx order by greatest(abs(p.x - cx), abs(p.y - cy)), p.y, p.x) k from prt p join c on p.img = c.img and p.idx = c.idx) where k = 1")
def k5(s, d):
    return R.label_points(r_part(s, d), "idx")


@query("k12_composite", f"with {ORD_SQL} select img, i, cast(floor(31 * conf / 255.0::double + r * (1 - conf / 255.0::double) + 0.5) as int) red from ord")
def k12(s, d):
    a = F.col("conf") / 255.0
    return r_ord(s, d).select("img", "i", C.round_half_up(31 * a + F.col("r") * (1 - a)).cast("int").alias("red"))


@query("o2_regions_by_id", f"with {PART_SQL} select img, list(idx order by idx) ids from (select distinct img, idx from prt) group by img")
def o2(s, d):
    return r_part(s, d).groupBy("img").agg(F.array_sort(F.collect_set("idx")).alias("ids"))


@query("o8_best_neighbour", f"with {PART_SQL}, e as (select p.img, p.idx a, q.idx b from prt p join prt q on p.img = q.img and abs(p.x - q.x) + abs(p.y - q.y) = 1 where p.idx <> q.idx), g as (select img, a, b, count(*) border from e group by all), ar as (select img, idx b, count(*) area from prt group by all) select img, a, b from (select img, a, b, row_number() over (partition by img, a order by floor(abs(a - b) * 3 / 2.5), border * 1000000 + area * 10 - b desc) k from g join ar using (img, b)) where k = 1")
def o8(s, d):
    px = r_part(s, d)
    area = px.groupBy("img", F.col("idx").alias("b")).agg(F.count(F.lit(1)).alias("area"))
    rank = F.struct(F.floor(F.abs(F.col("a") - F.col("b")) * 3 / 2.5), -(F.col("border") * 1000000 + F.col("area") * 10 - F.col("b")))
    return R.adjacency(px, "idx").join(area, ["img", "b"]).groupBy("img", "a").agg(F.min_by("b", rank).alias("b"))


@query("o9_farthest_vertex", f"with {PART_SQL}, p as (select img, i - min(i) over (partition by img) k, x - first(x) over w dx, y - first(y) over w dy from prt where idx = 1 window w as (partition by img order by i)) select img, i as k from (select img, k i, row_number() over (partition by img order by dx * dx + dy * dy desc, k) r from p) where r = 1")
def o9(s, d):
    px = r_part(s, d).where("idx = 1")
    first = px.groupBy("img").agg(F.min(F.struct("i", "x", "y")).alias("f"))
    v = px.join(first, "img").withColumns({"k": F.col("i") - F.col("f.i"), "d": (F.col("x") - F.col("f.x")) * (F.col("x") - F.col("f.x")) + (F.col("y") - F.col("f.y")) * (F.col("y") - F.col("f.y"))})
    return v.groupBy("img").agg(F.max_by("k", F.struct("d", -F.col("k"))).alias("k"))


@query("n1_final_numbering", f"with {PART_SQL} select img, idx old, row_number() over (partition by img order by min(i)) id from prt group by img, idx")
def n1(s, d):
    return R.renumber(r_part(s, d), "idx").select("img", "old", F.col("id").cast("bigint").alias("id"))


# --- set operations on masks -------------------------------------------------------------------------------------------------------
@query("u3_union_of_masks", f"with {ORD_SQL} select img, i from ord where r > 200 or g > 200 or b > 240 or conf > 250")
def u3(s, d):
    px = r_ord(s, d)
    parts = [px.where(c).select("img", "i") for c in ("r > 200", "g > 200", "b > 240", "conf > 250")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


@query("u4_mask_intersection", f"with {ORD_SQL} select img, i from ord where conf > 128 and r % 3 = 0")
def u4(s, d):
    px = r_ord(s, d)
    return px.where("conf > 128").select("img", "i").intersect(px.where("r % 3 = 0").select("img", "i"))


# --- components ---------------------------------------------------------------------------------------------------------------------
CC_SQL = "c as (select img, i, x, y, idx, i root from prt union select q.img, q.i, q.x, q.y, q.idx, c.root from c join prt q on q.img = c.img and q.idx = c.idx and abs(q.x - c.x) + abs(q.y - c.y) = 1 and c.root < q.i)"


@query("g1_components", f"with recursive {PART_SQL}, {CC_SQL}, m as (select img, i, min(root) root from c group by all) select img, i, dense_rank() over (partition by img order by root) - 1 label from m")
def g1(s, d):
    roots = R.grow(r_part(s, d), "idx")
    return roots.select("img", "i", (F.dense_rank().over(Window.partitionBy("img").orderBy("root")) - 1).cast("bigint").alias("label"))

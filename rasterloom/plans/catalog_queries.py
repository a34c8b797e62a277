"""Registered queries over catalogs, names, progress state and events, with the same results in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import ORD_SQL, load, r_ord
from ..functions import text as T
from ..operators import state as S
from ..shipping import shared_folder
from ..sources import rasters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SLUG = lambda c: f"regexp_replace(regexp_replace(lower(regexp_replace({c}, '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
FILE = "(p_name || '_' || p_brand || '.JPG')"
CAT_SQL = f"cat as (select p_partkey ord, {SLUG(FILE)} || '-' || (case p_size % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end) id, p_name as name, p_size size, p_brand brand from part)"


def files(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").withColumn("file", F.concat(F.col("p_name"), F.lit("_"), F.col("p_brand"), F.lit(".JPG")))


def catalog(s: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("p_size") % 3 == 0, "easy").when(F.col("p_size") % 3 == 1, "medium").otherwise("hard")
    return files(s, d).select(F.col("p_partkey").alias("ord"), F.concat_ws("-", T.slugify(F.col("file")), tier).alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


@query("p13_slugify", f"select p_partkey, {SLUG(FILE)} slug from part")
def p13(s, d):
    return files(s, d).select("p_partkey", T.slugify(F.col("file")).alias("slug"))


@query("p14_humanize", f"with a as (select p_partkey, {SLUG(FILE)} slug from part) select p_partkey, list_aggregate(list_transform(string_split(slug, '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') title from a")
def p14(s, d):
    return files(s, d).select("p_partkey", T.humanize(T.slugify(F.col("file"))).alias("title"))


@query("p15_default_name", "with a as (select p_partkey, trim(regexp_replace(regexp_replace(p_name || '_' || p_brand || '.JPG', '\\.[^.]*$', ''), '[-_]+', ' ', 'g'), ' ') t from part) select p_partkey, coalesce(nullif(list_aggregate(list_transform(string_split(regexp_replace(t, ' +', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' '), ''), 'My Picture') title from a")
def p15(s, d):
    return files(s, d).select("p_partkey", T.default_name(F.col("file")).alias("title"))


@query("p16_capitalize", "select c_custkey, upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) word from customer")
def p16(s, d):
    return load(s, d, "customer").select("c_custkey", T.capitalize(F.lower("c_mktsegment")).alias("word"))


@query("p17_group_key", f"with {CAT_SQL} select ord, regexp_replace(id, '-(easy|medium|hard)$', '') key from cat")
def p17(s, d):
    return catalog(s, d).select("ord", T.group_key(F.col("id")).alias("key"))


@query("p18_content_hash", "select page_id, sha1(html) sha from pages")
def p18(s, d):
    return load(s, d, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))


@query("p23_match_fill", "select event_id, case when sel = rc then list_extract(['#e6194b','#f58231','#ffe119','#bfef45','#3cb44b'], rc) end fill from (select event_id, cast(json_extract(props, '$.k') as int) % 5 + 1 rc, case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end sel from events)")
def p23(s, d):
    return S.taps(load(s, d, "events")).select("event_id", S.matched_fill().alias("fill"))


@query("p26_composite_key", "select event_id, user_id || ':' || event_type || ':' || (epoch_us(ts) // 1000) as key from events")
def p26(s, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(s, d, "events").select("event_id", T.composite_key(F.col("user_id").cast("string"), F.col("event_type"), ms).alias("key"))


@query("p27_completed_date", "select event_id, strftime(ts, '%d.%m.%Y') as day from events")
def p27(s, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(s, d, "events").select("event_id", F.date_format(F.timestamp_millis(ms), "dd.MM.yyyy").alias("day"))


@query("p30_effective_palette", "select c_custkey, case when c_nationkey % 3 = 0 then c_mktsegment else 'default' end palette from customer")
def p30(s, d):
    custom = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment"))
    return load(s, d, "customer").select("c_custkey", F.coalesce(custom, F.lit("default")).alias("palette"))


@query("s1_image_files", "select page_id, url from (select page_id, url || (case page_id % 4 when 0 then '.JPG' when 1 then '.png' when 2 then '.txt' else '.webp' end) url from pages) where regexp_matches(lower(url), '\\.(jpg|jpeg|png|webp)$')")
def s1(s, d):
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".txt", ".webp"))), (F.col("page_id") % 4 + 1).cast("int"))
    return load(s, d, "pages").select("page_id", F.concat("url", ext).alias("url")).where(F.lower("url").rlike(r"\.(jpg|jpeg|png|webp)$"))


@query("s3_target_size", "select p_partkey, cast(floor(p_size * 40 * least(1.0::double, 1024.0::double / greatest(p_size * 40, 900)) + 0.5) as bigint) w, cast(floor(900 * least(1.0::double, 1024.0::double / greatest(p_size * 40, 900)) + 0.5) as bigint) h from part")
def s3(s, d):
    k = F.least(F.lit(1.0), 1024.0 / F.greatest(F.col("p_size") * 40, F.lit(900)))
    return load(s, d, "part").select("p_partkey", F.floor(F.col("p_size") * 40 * k + 0.5).alias("w"), F.floor(900 * k + 0.5).alias("h"))


@query("s13_data_url", "select page_id, 'data:image/png;base64,' || base64(encode(url)) url from pages")
def s13(s, d):
    return load(s, d, "pages").select("page_id", F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("url", "utf-8")), r"\s", "")).alias("url"))


@query("s8_s10_manifest", f"with {CAT_SQL} select id, name, size width from cat")
def s10(s, d):
    """The catalog written as a manifest, and read again."""
    path = f"{shared_folder(s)}/manifest-{uuid.uuid4().hex}"
    rasters.write_manifest(catalog(s, d).select("id", "name", F.col("size").alias("width")), path)
    return rasters.read_manifest(s, path).select("id", "name", "width")


@query("s9_load_json", "with t as (select event_id, case when event_id % 5 = 0 then left(props, -1) else props end p from events) select event_id, case when json_valid(p) then cast(json_extract(p, '$.k') as int) end k from t")
def s9(s, d):
    """Every fifth text has lost its end."""
    cropped = F.expr("case when event_id % 5 = 0 then left(props, length(props) - 1) else props end")
    return load(s, d, "events").select("event_id", rasters.json_value(cropped, "$.k", "int").alias("k"))


@query("s14_contact_sheet", "select p_partkey, p_partkey % 8 % 4 * 480 as left_, cast(floor(p_partkey % 8 / 4.0) as bigint) * 320 as top_ from part")
def s14(s, d):
    i = F.col("p_partkey") % 8
    return load(s, d, "part").select("p_partkey", (i % 4 * 480).alias("left_"), (F.floor(i / 4) * 320).alias("top_"))


@query("s15_summary", f"with {CAT_SQL} select regexp_replace(id, '-(easy|medium|hard)$', '') key, row_number() over (partition by regexp_replace(id, '-(easy|medium|hard)$', '') order by ord) as place, size || ' regions / ' || length(brand) || ' colors' line from cat")
def s15(s, d):
    """The lines of each image's summary, in their order; one row each, so that no image has to fit a row."""
    line = F.concat(F.col("size").cast("string"), F.lit(" regions / "), F.length("brand").cast("string"), F.lit(" colors"))
    lines = catalog(s, d).select(T.group_key(F.col("id")).alias("key"), "ord", line.alias("line"))
    return S.place_within(lines, ["key"], ["ord"], "place").select("key", "place", "line")


@query("s18_cell_layout", "select p_partkey, cast(floor(p_size * 20 * k + 0.5) as bigint) w, cast(floor((480 - p_size * 20 * k) / 2) as bigint) pad from (select *, least(480.0::double / (p_size * 20), 320.0::double / 400) k from part where p_size > 0)")
def s18(s, d):
    k = F.least(480.0 / (F.col("p_size") * 20), F.lit(320.0 / 400))
    return load(s, d, "part").where("p_size > 0").select("p_partkey", F.floor(F.col("p_size") * 20 * k + 0.5).alias("w"), F.floor((480 - F.col("p_size") * 20 * k) / 2).alias("pad"))


@query("f4_available_tiers", f"with {CAT_SQL} select regexp_replace(id, '-(easy|medium|hard)$', '') key, bool_or(id like '%-easy') easy, bool_or(id like '%-medium') medium, bool_or(id like '%-hard') hard from cat group by 1")
def f4(s, d):
    return catalog(s, d).groupBy(T.group_key(F.col("id")).alias("key")).agg(*(F.bool_or(F.col("id").endswith(f"-{t}")).alias(t) for t in T.DIFFICULTIES))


@query("f8_taps", "select a.event_id from events a join events b on b.event_id = a.event_id + 1 where abs(b.value - a.value) <= 10 and abs(epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000) <= 500000")
def f8(s, d):
    e = load(s, d, "events").select("event_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    up = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("v2"), F.col("ms").alias("m2"))
    return e.join(up, "event_id").where((F.abs(F.col("v2") - F.col("value")) <= 10) & (F.abs(F.col("m2") - F.col("ms")) <= 500_000)).select("event_id")


@query("f10_assets_exist", "select d.doc_id from documents d where d.doc_id in (select doc_id from labels)")
def f10(s, d):
    return load(s, d, "documents").join(load(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id")


HASH_SQL = "f as (select doc_id, sha1(case when doc_id % 10 = 0 then text || '!' else text end) sha from documents), c as (select doc_id, sha1(text) sha from documents where doc_id % 7 <> 0), m as (select doc_id, case when doc_id % 11 = 0 then 2 else 3 end entries from documents)"


@query("j8_cache_plan", f"with {HASH_SQL} select f.doc_id, case when c.sha = f.sha and m.entries = 3 and l.doc_id is not null then 'reuse' else 'pending' end status from f left join c using (doc_id) left join m using (doc_id) left join (select distinct doc_id from labels) l using (doc_id)")
def j8(s, d):
    docs = load(s, d, "documents")
    body = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = docs.select(F.col("doc_id").alias("slug"), F.sha1(body.cast("binary")).alias("sha1"))
    cache = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("slug"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    known = docs.select(F.col("doc_id").alias("slug"), F.when(F.col("doc_id") % 11 == 0, 2).otherwise(3).alias("entries"))
    assets = load(s, d, "labels").select(F.col("doc_id").alias("slug")).distinct()
    return S.build_plan(now, cache, known, assets).withColumnRenamed("slug", "doc_id")


@query("j9_u5_orphans", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem)")
def j9(s, d):
    return load(s, d, "part").join(load(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("j10_cascade_delete", "select 'progress' tbl, count(*) n from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3) union all select 'puzzles', count(*) from customer where c_nationkey <> 3 union all select 'finished', count(*) from events")
def j10(s, d):
    gone = load(s, d, "customer").where("c_nationkey = 3").select("c_custkey")
    left = load(s, d, "orders").join(gone.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_anti")
    keep = load(s, d, "customer").join(gone, "c_custkey", "left_anti")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n")
    return count(left, "progress").union(count(keep, "puzzles")).union(count(load(s, d, "events"), "finished"))


TAP_SQL = "t as (select event_id, ts, user_id puzzle, cast(json_extract(props, '$.k') as int) region, cast(json_extract(props, '$.k') as int) % 5 + 1 rc, case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end sel from events), ok as (select *, list_extract(['#e6194b','#f58231','#ffe119','#bfef45','#3cb44b'], rc) fill from t where sel = rc)"


@query("j11_fill_diff", f"with {TAP_SQL}, a as (select distinct puzzle, region from ok where event_id % 2 = 0), b as (select distinct puzzle, region from ok where event_id % 3 = 0) select puzzle, region, 'removed' change from a where not exists (select 1 from b where b.puzzle = a.puzzle and b.region = a.region) union all select puzzle, region, 'added' from b where not exists (select 1 from a where b.puzzle = a.puzzle and b.region = a.region)")
def j11(s, d):
    ok = S.accepted(S.taps(load(s, d, "events")))
    a, b = (ok.where(c).select("puzzle", "region").distinct() for c in ("event_id % 2 = 0", "event_id % 3 = 0"))
    return a.join(b, ["puzzle", "region"], "left_anti").withColumn("change", F.lit("removed")).union(b.join(a, ["puzzle", "region"], "left_anti").withColumn("change", F.lit("added")))


@query("j14_progress_lookup", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderpriority like '1%'")
def j14(s, d):
    return load(s, d, "orders").where(F.col("o_orderpriority").startswith("1")).join(load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j15_find_or_gallery", "select event_id, coalesce(c_name, 'gallery') target from events left join customer on c_custkey = user_id * 3")
def j15(s, d):
    e = load(s, d, "events").select("event_id", (F.col("user_id") * 3).alias("k"))
    return e.join(load(s, d, "customer"), F.col("k") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_name", F.lit("gallery")).alias("target"))


@query("a10_group_by_image", f"with {CAT_SQL}, g as (select *, regexp_replace(id, '-(easy|medium|hard)$', '') key, regexp_extract(id, '-(easy|medium|hard)$', 1) tier from cat) select key, arg_min(name, ord) as name, max(ord) filter (tier = 'easy') easy, max(ord) filter (tier = 'medium') medium, max(ord) filter (tier = 'hard') hard, coalesce(arg_max(size, ord) filter (tier = 'medium'), arg_min(size, ord)) thumb from g group by key")
def a10(s, d):
    g = catalog(s, d).withColumn("key", T.group_key(F.col("id"))).withColumn("tier", F.regexp_extract("id", "-(easy|medium|hard)$", 1))
    last = [F.max(F.when(F.col("tier") == t, F.col("ord"))).alias(t) for t in T.DIFFICULTIES]
    medium = F.max_by("size", F.when(F.col("tier") == "medium", F.col("ord")))
    return g.groupBy("key").agg(F.min_by("name", "ord").alias("name"), *last, F.coalesce(medium, F.min_by("size", "ord")).alias("thumb"))


@query("a11_manifest_by_slug", f"with {CAT_SQL} select regexp_replace(id, '-(easy|medium|hard)$', '') key, row_number() over (partition by regexp_replace(id, '-(easy|medium|hard)$', '') order by ord) as place, id from cat")
def a11(s, d):
    """Entries by slug, in the manifest's order; one row each."""
    entries = catalog(s, d).select(T.group_key(F.col("id")).alias("key"), "ord", "id")
    return S.place_within(entries, ["key"], ["ord"], "place").select("key", "place", "id")


@query("a14_color_count", f"with {ORD_SQL} select img, r % 9 region, count(distinct g % 24) colors from ord group by all")
def a14(s, d):
    g = r_ord(s, d).groupBy("img", (F.col("r") % 9).alias("region")).agg(F.collect_set(F.col("g") % 24).alias("palette"))
    return g.select("img", "region", F.size("palette").cast("bigint").alias("colors"))


@query("a15_completion", f"with {TAP_SQL} select puzzle, count(distinct region) filled, count(distinct region) >= 10 complete from ok group by puzzle")
def a15(s, d):
    return S.completion(S.accepted(S.taps(load(s, d, "events"))), 10)


@query("o3_manifest_order", f"with {CAT_SQL} select ord, row_number() over (order by id, ord) as place from cat")
def o3(s, d):
    c = catalog(s, d)
    return S.global_rank(c.select("ord", "id"), ["id", "ord"], "place").select("ord", "place")


def in_locale_order(names, col: str):
    """Adds place: distinct names in the order of the root locale, by a collated column dealt out by range; names that the collation holds for equal go by code point."""
    return S.global_rank(names.withColumn("_c", F.collate(F.col(col), "UNICODE")), ["_c", col], "place").drop("_c")


@query("o4_groups_by_name", f"with {CAT_SQL}, g as (select distinct name from cat) select name, row_number() over (order by icu_sort_key(name, 'en'), name) as place from g")
def o4(s, d):
    return in_locale_order(catalog(s, d).select("name").distinct(), "name").select("name", "place")


@query("o3_o4_locale_order", r"with t as (select distinct regexp_extract(text, '^\S+ \S+') title from documents where text is not null) select title, row_number() over (order by icu_sort_key(title, 'en'), title) as place from t where title <> ''")
def o3_4(s, d):
    """Titles with accents and mixed case: the first two words of every text."""
    titles = load(s, d, "documents").where("text is not null").select(F.regexp_extract("text", r"^\S+ \S+", 0).alias("title")).where("title <> ''").distinct()
    return in_locale_order(titles, "title")


@query("o5_newest_first", "select event_id, row_number() over (partition by user_id order by ts desc, event_id) as place from events where event_type = 'purchase'")
def o5(s, d):
    bought = load(s, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return S.place_within(bought, ["user_id"], [F.desc("ts"), "event_id"], "place").select("event_id", "place")


@query("o6_palette_entries", "select user_id, list(k || '=' || n order by k) entries from (select user_id, event_type k, count(*) n from events group by all) group by user_id")
def o6(s, d):
    g = load(s, d, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select("user_id", F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("entries"))


@query("u1_u2_catalog_union", "select c_custkey id, c_name as name, 0 src from customer union all select s_suppkey, s_name, 1 from supplier")
def u1(s, d):
    a = load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("src"))
    return a.unionByName(load(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("src")))


@query("t1_upsert", "select user_id, arg_max(value, struct_pack(ts := ts, e := event_id)) as value from events group by user_id")
def t1(s, d):
    e = load(s, d, "events").withColumn("ord", F.struct("ts", "event_id"))
    return S.upsert(None, e.select("user_id", "value", "ord"), ["user_id"], "ord").select("user_id", "value")


@query("t2_t13_delete", "select event_id from events where user_id not in (select c_custkey from customer where c_nationkey = 5)")
def t2(s, d):
    gone = load(s, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("user_id"))
    return S.delete(load(s, d, "events"), gone, ["user_id"]).select("event_id")


@query("t3_key_order_scan", "select user_id, event_id, row_number() over (order by user_id, event_id) as place from events")
def t3(s, d):
    """All rows in the order of their keys."""
    return S.global_rank(load(s, d, "events").select("user_id", "event_id"), ["user_id", "event_id"], "place")


@query("t4_fill_fold", f"with {TAP_SQL} select puzzle, region, arg_max(fill, struct_pack(ts := ts, e := event_id)) fill from ok group by all")
def t4(s, d):
    return S.fills(S.accepted(S.taps(load(s, d, "events"))))


@query("t5_finish", f"with {TAP_SQL}, n as (select *, row_number() over (partition by puzzle, region order by ts, event_id) k from ok), c as (select puzzle, ts, event_id, sum(case when k = 1 then 1 else 0 end) over (partition by puzzle order by ts, event_id) filled from n) select puzzle, arg_min(event_id, struct_pack(ts := ts, e := event_id)) finishing_event from c where filled >= 10 group by puzzle")
def t5(s, d):
    return S.finishing_events(S.accepted(S.taps(load(s, d, "events"))), 10)


@query("t6_t14_clear", f"with {TAP_SQL}, cl as (select puzzle, max(struct_pack(ts := ts, e := event_id)) cleared from t where event_id % 50 = 0 group by puzzle) select ok.puzzle, region, arg_max(fill, struct_pack(ts := ts, e := event_id)) fill from ok left join cl on cl.puzzle = ok.puzzle where cleared is null or struct_pack(ts := ts, e := event_id) > cleared group by all")
def t6(s, d):
    taps = S.taps(load(s, d, "events"))
    clears = taps.where("event_id % 50 = 0").groupBy("puzzle").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    left = S.accepted(taps).join(clears, "puzzle", "left").where("at is null or struct(ts, event_id) > at")
    return S.fills(left)


@query("t7_set_color", "select user_id, list(k || '=' || (case when k = 'click' then -1 else n end) order by k) entries from (select user_id, event_type k, count(*) n from events group by all) group by user_id having count(*) filter (k = 'click') = 1")
def t7(s, d):
    g = load(s, d, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")).where("map_contains_key(m, 'click')")
    new = S.map_set(F.col("m"), F.lit("click"), F.lit(-1).cast("bigint"))
    return m.select("user_id", F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("entries"))


@query("t8_stroke_snapshots", "select user_id, max(event_id) last_, count(*) strokes from events where event_type in ('click', 'view') group by user_id")
def t8(s, d):
    return load(s, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.max("event_id").alias("last_"), F.count(F.lit(1)).alias("strokes"))

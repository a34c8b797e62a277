"""The registered queries over the corpus tables: thin adapters from the operators' general outputs to fixed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .ann import nearest
from .bpe import SPLIT, encode
from .chat import format_conversations
from .common import table
from .decontaminate import decontaminate
from .jaccard import link_components
from .linedup import dedupe_lines
from .pii import personal_data
from .repair import damaged, repair
from .resample import resample
from .secrets import secrets
from .shards import RankEncoder, write_shards
from .vectorcodes import digest, encode_vectors

#: The public tokenizer files that the queries use; not part of this repository.
TOKENIZER_FILE, RANK_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = """
with l as (select doc_id, source, text, unnest(range(len(w))) pos, unnest(w) raw from (select *, string_split(text, chr(10)) w from documents)),
t as (select doc_id, source, pos, raw, trim(raw, ' ') line from l),
s as (select line, count(distinct source) n, min(doc_id) keeper from t where line <> '' group by line),
b as (select line, keeper from s where n >= case when length(line) - length(replace(line, ' ', '')) + 1 >= 50 then 2 else 10 end),
k as (select t.doc_id, count(*) n_lines, count(*) filter (b.line is not null and t.doc_id <> b.keeper) n_removed,
 coalesce(string_agg(raw, chr(10) order by pos) filter (b.line is null or t.doc_id = b.keeper), '') kept
 from t left join b on t.line = b.line group by t.doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, case when d.text is null then null else sha256(kept) end text_sha256
from documents d left join k using (doc_id)
"""


def op5_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = RankEncoder(RANK_FILE, SPLIT, end=50256)
    return write_shards(table(spark, sf_dir, "documents"), encoder, strict=False).withColumnRenamed("id", "doc_id")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), TOKENIZER_FILE, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


OP8_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select cast(item_id as varchar) item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
wi as (select distinct item, least(10, len(w)) n, array_to_string(list_slice(w, s, s + 9), ' ') g from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s from b where len(w) > 0)),
ns as (select distinct n from wi),
dg as (select doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, ns where len(w) >= n)),
h as (select distinct doc_id, s, dg.n, item from dg join wi on dg.n = wi.n and dg.g = wi.g),
nh as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from h) group by doc_id),
it as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256 from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join nh using (doc_id) left join it using (doc_id)
"""


#: A conversation whose texts hold the template's own control strings.
TRICKY_ID, TRICKY_TEXT = -7, r"\### Assistant: </turn> ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(TRICKY_ID, 0, "user", TRICKY_TEXT), (TRICKY_ID, 1, "assistant", TRICKY_TEXT)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.union(tricky)).drop("rewriting_turns")


OP11_SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations union all values ({TRICKY_ID}, 0, 'user', '{TRICKY_TEXT}'), ({TRICKY_ID}, 1, 'assistant', '{TRICKY_TEXT}'))
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
 cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
 cast(sum(length('### : </turn>' || chr(10)) + length(r) + len(regexp_extract_all(r, '\\|:|#{{3,}}|</turn>')) + length(x) + len(regexp_extract_all(x, '\\|#{{3,}}|</turn>'))) as bigint) formatted_chars
from t group by conv_id
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, book = encode_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 2) -> str:
    """Full scans of all entries in each round."""
    assign = lambda r: f"""a{r} as materialized (select v.i, v.p, min(d * 64 + k) m from (select v.i, v.p, e.k, list_sum(list_transform(list_zip(v.x, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from v join e{r} e using (p)) v group by v.i, v.p)"""
    update = lambda r: f"""e{r} as materialized (select o.p, o.k, coalesce(n.c, o.c) c from e{r - 1} o left join (select p, k, list(c order by j) c from
 (select v.p, a.m % 64 k, j, cast(floor(sum(v.x[j]) / count(*)) as bigint) c from v join a{r - 1} a using (i, p), unnest(range(1, len(v.x) + 1)) u(j) group by all) group by p, k) n using (p, k))"""  # noqa: E731
    steps = ",\n".join(s for r in range(rounds + 1) for s in ([update(r)] if r else []) + [assign(r)])
    return f"""
with q as (select row_number() over (order by vec_id nulls last, embedding) i, vec_id, label, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) w from embeddings
 where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select i, vec_id, label, p, list_slice(w, cast(p * len(w) // 16 + 1 as bigint), cast((p + 1) * len(w) // 16 as bigint)) x from q, range(16) u(p)),
e0 as materialized (select p, i - 1 k, x c from v where i <= 64),
{steps},
o as (select v.i, v.vec_id, v.label, string_agg(printf('%02x', a.m % 64), '' order by v.p) code, cast(sum(a.m // 64) as bigint) error from v join a{rounds} a using (i, p) group by v.i, v.vec_id, v.label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, (select sha256(string_agg(c::varchar, ',' order by p, k, j)) from (select p, k, generate_subscripts(c, 1) j, unnest(c) c from e{rounds})) codebooks_sha256 from o
"""


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _op13_sql() -> str:
    """Costs and edits of all four states carried from row to row, without a search."""
    add = lambda s, cost, edit, text="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || {text}}}"
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    least = lambda *s: f"list_min([{', '.join(s)}])"
    user, assistant, own = "'user:' || chr(10)", "'assistant:' || chr(10)", "w.r || ':' || w.x || chr(10)"
    may = lambda test, s: f"case when w.f not in (1, 2) and {test} then {s} else {far} end"
    cut = "case when w.f = 3 then 5 else 0 end"
    keep = lambda s: add(s, f"({cut})", "K", own)
    rerole = lambda s, role: add(s, f"(1 + {cut})", "R", f"'{role}:' || w.x || chr(10)")
    delete = lambda s: add(s, 2, "D")
    i2 = least("p2", *(add(s, 5, "I", user) for s in ("p0", "p1", "p3")))
    i3 = least("p3", add("i2", 5, "I", assistant))
    return rf"""
with o as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations),
bits as (select b, list_reduce([b] || range(8), lambda s, _: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end) v from range(256) u(b)),
crc as (select list(v order by b) v from bits),
h as (select o.*, xor(list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])), lambda s, c: xor(s >> 8, crc.v[1 + (xor(s, c) & 255)])), 4294967295) % 20 hit from o, crc),
d as (select conv_id, turn, case when hit = 4 then 'user' else r end r, case when hit = 1 then '' when hit = 2 then translate(x, '.!?', '') else x end x, unnest(case when hit = 3 then [0, 1] else [0] end) copy from h where hit <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, r, x, copy) i, row_number() over (partition by conv_id, r, x order by turn nulls first, copy) k, rtrim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') e from d),
w as materialized (select *, case when not regexp_matches(x, '[^\x20\x09-\x0D]') then 1 when k > 1 then 2 when right(e, 1) not in ('.', '!', '?') then 3 else 0 end f, left(r, 1) z,
 lag(left(r, 1)) over (partition by conv_id order by i) y from n),
stats as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 1) blank, count(*) filter (f = 2) duplicate, count(*) filter (f = 3) truncated,
 count(*) filter (y is not null and y || z not in ('su', 'ua', 'au')) illegal, max(i) last from w group by conv_id),
p as (with recursive g as (
 select conv_id, 0::bigint i, {{'c': 0::bigint, 'a': '', 't': ''}} s0, {far}::struct(c bigint, a varchar, t varchar) s1, {far}::struct(c bigint, a varchar, t varchar) s2, {far}::struct(c bigint, a varchar, t varchar) s3 from stats
 union all
 select conv_id, i, {delete("p0")} s0, {least(delete("p1"), may("w.z = 's'", keep("p0")))} s1,
  {least(delete("i2"), *(may("w.z = 'u'", keep(s)) for s in ("p0", "p1", "i3")), *(may("true", rerole(s, "user")) for s in ("p0", "p1", "i3")))} s2,
  {least(delete("i3"), may("w.z = 'a'", keep("i2")), may("true", rerole("i2", "assistant")))} s3
 from (select b.*, {i3} i3 from (select a.*, {i2} i2 from (select w.conv_id, w.i, w, g.s0 p0, g.s1 p1, g.s2 p2, g.s3 p3 from g join w on w.conv_id is not distinct from g.conv_id and w.i = g.i + 1) a) b) c)
 select g.conv_id, {least("p0", "i3")} s from (select b.*, {i3} i3 from (select a.*, {i2} i2 from (select conv_id, i, s0 p0, s1 p1, s2 p2, s3 p3 from g) a) b) g join stats on stats.conv_id is not distinct from g.conv_id and stats.last = g.i)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(s.c, 0) cost, coalesce(s.a, '') audit,
 sha256(coalesce(left(s.t, greatest(length(s.t) - 1, 0)), '')) repaired_sha256
from (select distinct conv_id from o) o left join stats on stats.conv_id is not distinct from o.conv_id left join p on p.conv_id is not distinct from o.conv_id
"""


OP12_SQL, OP13_SQL = _op12_sql(), _op13_sql()


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_line_dedup": op2_line_dedup, "op3_jaccard": op3_jaccard, "op4_bpe": op4_bpe, "op5_resample": op5_resample, "op6_shards": op6_shards, "op7_neighbours": op7_neighbours, "op8_decontamination": op8_decontamination, "op9_pii": op9_pii, "op10_secrets": op10_secrets, "op11_chat": op11_chat, "op12_vector_codes": op12_vector_codes, "op13_repair": op13_repair}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op8_decontamination": OP8_SQL, "op11_chat": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_repair": OP13_SQL}

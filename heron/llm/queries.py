"""One thin query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.llm import audit, centroids, chat, pii, quality, repeats, simhash, toxicity, warc
from heron.llm.bpe import digests
from heron.llm.common import stored, table
from heron.llm.decontaminate import contamination
from heron.llm.exact_dedup import exact_dedup
from heron.llm.minhash import near_dedup


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(stored(chat.windows(turns), "chats"))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the stored archive of all pages against a stored replica in which one byte of some records is wrong."""
    archive = warc.read(spark, warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    records = archive.records
    end, page = ">" + warc.LAST, F.regexp_extract("record", r"<urn:page:(-?\d*)>", 1).try_cast("long")
    wrong = (page % 97 == 13) & F.col("record").endswith(end)
    replica = warc.copy(records.withColumn("record", F.when(wrong, F.concat(F.expr(f"substring(record, 1, length(record) - {len(end)})"), F.lit("?" + warc.LAST))).otherwise(F.col("record"))))
    ours, theirs = (warc.tree(x.leaves) for x in (archive, warc.read(spark, replica)))
    found = warc.audit(ours, theirs).filter("kind <> 'moved' and ours is not null").select("file", F.col("ours").alias("node"), F.lit(False).alias("intact"))
    roots = ours[-1].select("file", F.col("hash").alias("root_sha256"))
    rows = ours[0].join(found, ["file", "node"], "left").join(roots, "file")
    return rows.select("page_id", "file", F.col("start").alias("record_offset"), (F.col("end") - F.col("start")).alias("n_bytes"), F.col("hash").alias("record_sha256"), "root_sha256", F.coalesce("intact", F.lit(True)).alias("intact"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(pii.KINDS) for x in (kind, k)))

    def joined(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def clustering_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, dims: int = centroids.DIMS, scale: int = centroids.SCALE) -> str:
    """Each round as a query of the one before: all distances, the nearest by distance and number, means rounded down."""
    apart = "list_sum(list_transform(range(1, {d} + 1), lambda k: (p.x[k] - c.x[k]) * (p.x[k] - c.x[k])))".format(d=dims)
    nearest = "select p.rid, min(struct_pack(distance := cast({a} as bigint), cluster := c.cluster)) as m from p, c{k} c group by p.rid"
    out = [
        f"e as (select row_number() over () as rid, vec_id, embedding from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {dims})",
        f"p as (select rid, vec_id, list_transform(embedding, lambda v: cast(floor({scale} * cast(v as double)) as bigint)) as x from e)",
        f"c0 as (select row_number() over (order by h, x) - 1 as cluster, x from (select sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h, x from p) order by h, x limit {clusters})",
    ]
    for k in range(rounds):
        out.append(f"a{k} as ({nearest.format(a=apart, k=k)})")
        out.append(f"s{k} as (select a{k}.m.cluster as cluster, k, cast(floor(sum(p.x[k])::double / count(*)) as bigint) as v from a{k} join p using (rid), unnest(range(1, {dims} + 1)) t(k) group by all)")
        out.append(f"c{k + 1} as (select c{k}.cluster, coalesce(n.x, c{k}.x) as x from c{k} left join (select cluster, list(v order by k) as x from s{k} group by cluster) n using (cluster))")
    out.append(f"a as ({nearest.format(a=apart, k=rounds)})")
    return f"""
with {(","+chr(10)).join(out)},
t as (select p.vec_id, cast(a.m.cluster as integer) as cluster, a.m.distance as distance from a join p using (rid))
select t.*, cast(sum(distance) over (partition by t.cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from t join c{rounds} c using (cluster)"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_chat_formatting, op4_bpe, op5_warc_fixity, op6_repeats, op7_pii, op8_decontamination, op9_minhash_near_dedup, op10_quality, op11_simhash_near_dedup, op12_centroid_clustering, op13_filter_audit)}

ORACLES = {
    "op1_exact_dedup": """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g using (t)""",
    "op8_decontamination": r"""
with d as (select doc_id, row_number() over () as rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-`{-\x7F]+'), lambda w: w <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-`{-\x7F]+'), lambda w: w <> '') as w from benchmark),
bw as (select distinct item_id, len(list_slice(w, s, s + 9)) as n, array_to_string(list_slice(w, s, s + 9), ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select rid, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
m as (select rid, s, bw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from m) group by rid),
i as (select rid, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct rid, cast(item_id as varchar) as i from m) group by rid)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join i using (rid)""",
    "op3_chat_formatting": r"""
with recursive t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c as (select *, len(regexp_extract_all(text, '\S+')) + 4 as tokens, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
p as (select *, cast(sum(tokens) over (partition by conv_id order by pos) - tokens as bigint) as ofs from c),
g as (select conv_id, pos, 0 as win, tokens as used from p where pos = 1
  union all select p.conv_id, p.pos, case when used + p.tokens <= 384 then win else win + 1 end, case when used + p.tokens <= 384 then used + p.tokens else p.tokens end from g join p on p.conv_id is not distinct from g.conv_id and p.pos = g.pos + 1),
q as (select p.*, g.win from p join g on p.conv_id is not distinct from g.conv_id and p.pos = g.pos),
b as (select conv_id, win, min(pos) as pos, min(ofs) as ofs from q group by all),
h as (select conv_id, min(pos) as pos, arg_min(text, pos) as text, arg_min(tokens, pos) as tokens from p where role = 'system' group by conv_id),
m as (select conv_id, win, pos, role, text from q
  union select q.conv_id, b.win, q.pos, q.role, q.text from q join b on q.conv_id is not distinct from b.conv_id and b.ofs > q.ofs left join h on q.conv_id is not distinct from h.conv_id where b.ofs - q.ofs <= 128 - coalesce(h.tokens, 0)
  union select b.conv_id, b.win, h.pos, 'system', h.text from b join h on b.conv_id is not distinct from h.conv_id and h.pos < b.pos),
f as (select conv_id, sum(len(role || text) + len(regexp_replace(role || text, '[^~<\[\]]', '', 'g')) + 10) as formatted_chars from m group by conv_id),
d as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by pos) as turns, coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '') as loss from p group by conv_id)
select d.conv_id, n_turns, sha256(turns) as turns_sha256, len(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from d join f on d.conv_id is not distinct from f.conv_id""",
    "op5_warc_fixity": r"""
with r as (select page_id, coalesce(cast(floor(page_id / 1000) as bigint), -1) as file, coalesce(html, '') like '%>' as shut,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as body from pages),
h as (select page_id, file, shut, strlen(body) as n_bytes, sha256(body) as hash from r),
l as (select *, row_number() over w - 1 as node, cast(sum(n_bytes) over (w rows between unbounded preceding and current row) as bigint) as stop from h window w as (partition by file order by page_id nulls first, hash)),
l1 as (select file, node // 16 as node, min(stop - n_bytes) as start, max(stop) as stop, sha256(min(stop - n_bytes) || ',' || max(stop) || ',' || string_agg(hash, ',' order by node)) as hash from l group by file, node // 16),
l2 as (select file, node // 16 as node, min(start) as start, max(stop) as stop, sha256(min(start) || ',' || max(stop) || ',' || string_agg(hash, ',' order by node)) as hash from l1 group by file, node // 16),
l3 as (select file, sha256(min(start) || ',' || max(stop) || ',' || string_agg(hash, ',' order by node)) as hash from l2 group by file)
select page_id, file, stop - n_bytes as record_offset, n_bytes, l.hash as record_sha256, l3.hash as root_sha256, not (page_id % 97 = 13 and shut) as intact from l join l3 using (file)""",
    "op12_centroid_clustering": clustering_sql(),
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
lowest as (select text, min(doc_id) as first from d group by text),
f as (select row_number() over () as rid, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  (case when len(w) < 100 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end) || (case when 100 * strlen(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 'C' else '' end)
  || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > first then 'E' else '' end) as fails
  from d join lowest using (text) left join l using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
s as (select part, filter_order, step, filter_order[step] as x, n, good, toxic, fails,
  (select min(k) from unnest(range(1, 6)) u(k) where contains(fails, filter_order[k])) as hit from g, o, unnest(range(1, 6)) t(step)),
r as (select part, filter_order, step, x, sum(case when hit is null or hit > step then n else 0 end) as kept, sum(case when hit = step then n else 0 end) as removed,
  sum(case when hit < step and contains(fails, x) then n else 0 end) as redundant, sum(case when fails = x then n else 0 end) as unique_fails,
  sum(case when hit = step then good else 0 end) as good_lost, sum(case when hit = step then toxic else 0 end) as toxic_lost from s group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from r""",
}

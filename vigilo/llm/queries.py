"""The operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, shared_dir, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files
    manifest = write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files"),
                                 tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest)


@query("op7_simhash_near_dup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bk as (select item_id, w, least(10, len(w)) as k from b where len(w) > 0),
bw as (select distinct item_id, k, array_to_string(w[j:j + k - 1], ' ') as win from (select *, unnest(range(1, len(w) - k + 2)) as j from bk)),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as win
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
h as (select doc_id, item_id, i, dw.k from dw join bw on dw.k = bw.k and dw.win = bw.win),
p as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + k)) as place from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
      from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on d.doc_id = p.doc_id left join t on d.doc_id = t.doc_id
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontaminate import benchmark_hits
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def ids_crc32(ids, length):
    """CRC-32 of each list of ids, as unsigned 32-bit integers."""
    from pyspark.sql import functions as F

    from .common import crc32_ids
    return F.arrow_udf(crc32_ids, "long")(ids, length)


def packed_documents(docs: DataFrame) -> DataFrame:
    from .packing import pack
    found = pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return found.select("doc_id", "piece", "start", found.length.cast("long").alias("length"), ids_crc32("ids", "length").alias("ids_crc32"), "sequence_id", "offset")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


OP10_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, other) as (select vec_id, vec_id from v union select r.vec_id, l.b from r join l on r.other = l.a),
c as (select vec_id, min(other) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n from l group by a)
select c.vec_id, coalesce(n, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on c.vec_id = n.vec_id
"""


@query("op10_embedding_near_dup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dups import near_duplicate_vectors
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import scan, written
    found = scan(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *count, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


#: Rules of the URL query, and the words that put a host on its block list.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_HOSTS = "(casino|bets|pills|poker|lottery|xxx)"

OP2_SQL = r"""
with u as (select page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h,
                  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as p from pages),
v as (select page_id, coalesce(h, '') as host, coalesce(p, '') as path from u),
r(rule_host, rule_path, what) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(what, length(rule_host || rule_path)) as what
      from (select distinct host, path from v) d, r where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by host, path)
select page_id, v.host, v.path, rule, coalesce(what, case when regexp_matches(v.host, '(casino|bets|pills|poker|lottery|xxx)') then 'block' else 'allow' end) as verdict
from v left join m on v.host = m.host and v.path = m.path
"""


@query("op2_url_filter", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge
    return judge(table(spark, sf_dir, "pages"), URL_RULES, lambda host: host.rlike(LISTED_HOSTS))


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, d.payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d left join f on d.payload_digest = f.payload_digest
"""


@query("op3_warc_records", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(manifest, data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is text labelled good; the sample is as large as the share of such labels."""
    from pyspark.sql import functions as F

    from .resample import resample
    labels = table(spark, sf_dir, "labels")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    return resample(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"), share)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, fold, score
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

OP12_SQL = r"""
with recursive f as (select doc_id, lang, case when doc_id is null then '-' else octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id end as a,
       case when source is null then '-' else octet_length(encode(source)) || ':' || source end || case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end
       || case when n_chars is null then '-' else octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars end as b,
       text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
       list_reduce(list_concat([4294967295::bigint], flatten([[ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0] for c in string_split(cast(doc_id as varchar), '')])),
                   lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)) as crc from documents),
d as (select doc_id, lang, sha256(a || b || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) as leaf,
             case when xor(crc, 4294967295) % 3 = 0 then sha256(a || b || case when low is null then '-' else octet_length(encode(low)) || ':' || low end) end as claim from f),
k as (select lang, row_number() over (order by encode(lang) nulls first) - 1 as tree from (select distinct lang from d)),
l as (select doc_id, tree, leaf, claim, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as size
      from d join k on d.lang is not distinct from k.lang),
n as (select tree, 0 as level, i, size, leaf as h from l
      union all select tree, level + 1, i // 8, (any_value(size) + 7) // 8, sha256(string_agg(h, '' order by i)) from n where size > 1 group by tree, level, i // 8),
s as (select a.tree, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as x, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as y
      from n a join n b on a.tree = b.tree and a.level = b.level and a.i // 8 = b.i // 8 where a.size > 1 group by a.tree, a.level, a.i),
w as (select tree, i as leaf_i, 0 as level, i, size, coalesce(claim, leaf) as h, '' as proof from l
      union all select w.tree, leaf_i, w.level + 1, w.i // 8, (w.size + 7) // 8, sha256(x || w.h || y), proof || x || y from w join s on w.tree = s.tree and w.level = s.level and w.i = s.i where w.size > 1),
n2 as (select 0 as level, tree as i, (select count(*) from k) as size, h from n where size = 1
      union all select level + 1, i // 8, (any_value(size) + 7) // 8, sha256(string_agg(h, '' order by i)) from n2 where size > 1 group by level, i // 8),
s2 as (select a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as x, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as y
      from n2 a join n2 b on a.level = b.level and a.i // 8 = b.i // 8 where a.size > 1 group by a.level, a.i),
w2 as (select tree, leaf_i, 0 as level, tree as i, (select count(*) from k) as size, h, proof from w where size = 1
      union all select tree, leaf_i, w2.level + 1, w2.i // 8, (w2.size + 7) // 8, sha256(x || w2.h || y), proof || x || y from w2 join s2 on w2.level = s2.level and w2.i = s2.i where w2.size > 1),
root as (select h as root from n2 where size = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, w2.h as folded_root, w2.h = root as verified
from l join w2 on l.tree = w2.tree and l.i = w2.leaf_i and w2.size = 1 join (select tree, h as subroot from n where size = 1) t on l.tree = t.tree, root
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import documents_manifest
    found = documents_manifest(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"proof": "proof_sha256", "folded": "folded_root"})


OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product([cast(x as double) for x in a.v], [cast(x as double) for x in b.v]) as bigint) as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank, other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), every=50, positives=5, negatives=3, low=(50, 100), high=(95, 100), scale=256)


OP11_SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
v as (select r, doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select *, unnest(range(1, len(w) - 18)) as i from d)),
c as (select r, i, s from (select *, rank() over (partition by s order by doc_id nulls last, i) as place from v) where place > 1),
g as (select distinct r, unnest(range(i, i + 20)) as p from c),
x as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select r, string_agg(word, ' ' order by p) as kept, count(*) as n from x anti join g using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)
"""


@query("op11_substring_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substrings import deduplicate
    found = deduplicate(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

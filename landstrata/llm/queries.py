"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from landstrata.llm import alignment, binary, decontaminate, langid, licenses, line_dedup, packing, prefix_trie, sharding, simhash, substring_dedup, topk, url_filter
from landstrata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_best_fit_packing(spark, sf):
    """All documents in sequences of at most 2,048 tokens."""
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer(), end_id=0, capacity=2048)


@query
def op9_resharding(spark, sf):
    """All documents moved from 12 shards by source to 16 of equal bytes."""
    docs = table(spark, sf, "documents")
    old = sharding.write_layout(docs, F.pmod(F.xxhash64("source"), F.lit(12)))
    text = F.coalesce("row.text", F.lit(""))
    return sharding.reshard(spark, old, shards=16).select(
        "row.doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_token_binary(spark, sf):
    """All documents encoded, written as binary segments and read back."""
    path = binary.write_tokens(table(spark, sf, "documents"), tokenizer(), end_id=2)
    return binary.read_tokens(spark, path)


@query
def op2_substring_dedup(spark, sf):
    """All documents without the words of 50-word passages that an earlier document has too."""
    return substring_dedup.remove_repeats(table(spark, sf, "documents"), window=50)


@query
def op5_benchmark_decontamination(spark, sf):
    """All documents with the words and items of the benchmark that occur in them."""
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), length=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_exact_top_k(spark, sf):
    """The ten best other vectors for every hundredth vector."""
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"))
    return topk.top_k(vectors, F.col("id") % 100 == 0, k=10)


@query
def op7_language_id(spark, sf):
    """The language of every document, by a network trained on documents that are not held out."""
    docs = table(spark, sf, "documents").withColumn("held_out", langid.held_out())
    return langid.predict(docs, langid.fit(docs), ["doc_id", "held_out"])


@query
def op8_simhash_near_duplicates(spark, sf):
    """All documents with their fingerprint and the smallest document they are linked to."""
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Every hundredth vector against all others, by integer inner product.
ORACLES["op6_exact_top_k"] = """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e from embeddings where embedding is not null),
p as (select a.vec_id as query_id, b.vec_id as vec_id, cast(list_sum([a.e[i] * b.e[i] for i in range(1, len(a.e) + 1)]) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10"""


@query
def op3_line_dedup(spark, sf):
    """The lines of every document, and those that repeat an earlier line or are within two edits of one."""
    return line_dedup.repeated_lines(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.concat_ws(",", F.transform("gone", lambda i: i.cast("string"))).alias("removed_lines")
    )


@query
def op4_license_scan(spark, sf):
    """The licence notices found in every document."""
    found = licenses.scan(table(spark, sf, "documents"))
    return found.select("doc_id", F.concat_ws(",", "licences").alias("licences"), "n_places", "best", F.round("score", 9).alias("score"))


ORACLES["op4_license_scan"] = licenses.oracle_sql()

ORACLES["op2_substring_dedup"] = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
starts as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from d where len(ws) >= 50),
windows as (select doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as h from starts),
least as (select h, min(doc_id) as first from windows group by h),
cut as (select distinct doc_id, unnest(range(p, p + 50)) as i from windows join least using (h) where doc_id > first),
gone as (select doc_id, list(i) as g from cut group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(len(g), 0) as n_removed,
    sha256(array_to_string(case when g is null then ws else [ws[i] for i in range(1, len(ws) + 1) if not list_contains(g, i)] end, ' ')) as kept_sha256
from d left join gone using (doc_id)"""

ORACLES["op5_benchmark_decontamination"] = r"""
with words as (select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
w as (select kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from words),
items as (select id, ws, least(10, len(ws)) as k from w where kind = 'i' and len(ws) > 0),
cuts as (select id, k, ws, unnest(range(1, len(ws) - k + 2)) as p from items),
wanted as (select distinct id as item, k, array_to_string(ws[p:p + k - 1], ' ') as phrase from cuts),
sizes as (select distinct k from wanted),
places as (select id, ws, k, unnest(range(1, len(ws) - k + 2)) as p from w, sizes where kind = 'd' and len(ws) >= k),
hits as (select distinct p.id, p.p, p.k, item from (select id, k, p, array_to_string(ws[p:p + k - 1], ' ') as phrase from places) p join wanted using (k, phrase)),
covered as (select id, count(*) as n from (select distinct id, unnest(range(p, p + k)) as i from hits) group by id),
met as (select id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct id, cast(item as varchar) as item from hits) group by id)
select w.id as doc_id, len(ws) as n_words, coalesce(c.n, 0) as n_hit, coalesce(m.n, 0) as n_items, sha256(coalesce(m.items, '')) as items_sha256,
    coalesce(c.n, 0) > 0 as contaminated
from w left join covered c using (id) left join met m using (id) where kind = 'd'"""


# The policy by host and path, and the words in host names whose pages make the list.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UNWANTED_HOSTS = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"


@query
def op13_url_filter(spark, sf):
    """All pages judged by the rules and, where none fits, by the list: the URLs of pages on unwanted hosts."""
    pages = table(spark, sf, "pages")
    listed = pages.where(F.rlike(url_filter.host_of("url"), F.lit(UNWANTED_HOSTS))).select("url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES), listed, keep=["page_id"])


ORACLES["op13_url_filter"] = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as q from u),
c as (select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') as site,
    array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))), '&') as kept from p),
f as (select *, case when site <> '' then site || regexp_replace(path, '/+$', '') || case when kept <> '' then '?' || kept else '' end end as url from c),
listed as (select distinct url from f where url is not null and regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)')),
rules(verdict, h, s) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
r as (select host, path, arg_max(h || s, length(h || s)) as rule, arg_max(verdict, length(h || s)) as verdict
    from (select distinct host, path from f) x join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by host, path)
select page_id, f.host, f.path, r.rule, coalesce(r.verdict, case when f.url in (select url from listed) then 'block' else 'allow' end) as verdict
from f left join r on f.host = r.host and f.path = r.path"""


@query
def op12_conversation_prefix_trie(spark, sf):
    """All nodes of the trie of all conversations."""
    return prefix_trie.family_trie(table(spark, sf, "conversations"))



# The table of CRC-32 is worked out, as DuckDB has no such function.
ORACLES["op12_conversation_prefix_trie"] = r"""
with crc as (select [list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) for n in range(256)] as tab),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, md5(length(role) || ':' || role || text)) as ts from t group by conv_id),
ids as (select conv_id, ts, xor(list_reduce(list_prepend(4294967295, [cast(ascii(x) as bigint) for x in string_split(cast(conv_id as varchar), '')]),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 as h from own, crc),
built as (select i.conv_id, list_concat(coalesce(b.ts[1:h], []), i.ts[h + 1:]) as ts from ids i left join own b on b.conv_id = i.conv_id - i.conv_id % 20),
steps as (select conv_id, ts, unnest(range(0, len(ts) + 1)) as d from built),
paths as (select conv_id, d, len(ts) as n, case when d > 0 then ts[d].text else '' end as last, min(conv_id) over (partition by d, md5(cast(ts[1:d] as varchar))) as node from steps),
nodes as (select node, d, count(*) as n_convs, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = n) as ends,
    (count(*) - 1) * len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) as saved from paths group by node, d),
up as (select v.node, v.d, p.node as parent from nodes v left join paths p on p.conv_id = v.node and p.d = v.d - 1),
kids as (select parent as node, d - 1 as d, count(*) as n from up where d > 0 group by parent, d),
sums as (select p.node, p.d, sum(v.saved) as saved, count(*) filter (k.n is null) as leaves
    from nodes v left join kids k on k.node = v.node and k.d = v.d join paths p on p.conv_id = v.node and p.d <= v.d group by p.node, p.d)
select v.node as conv_id, v.d as depth, parent as parent_conv_id, n_convs, coalesce(k.n, 0) as n_children, leaves as n_leaves, cast(s.saved as bigint) as saved_tokens,
    sha256(coalesce(ends, '')) as ends_sha256
from nodes v join up on up.node = v.node and up.d = v.d join sums s on s.node = v.node and s.d = v.d left join kids k on k.node = v.node and k.d = v.d"""


@query
def op11_tokenizer_alignment(spark, sf):
    """The tokens of all documents by two tokenizers, aligned, and how common the links of each document are."""
    import public_tokenizers

    return alignment.link_counts(table(spark, sf, "documents"), tokenizer(), public_tokenizers.path("piece_bpe_32k.model"))

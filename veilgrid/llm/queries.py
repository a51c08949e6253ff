"""One query for each operator over the given tables; thin forms of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, blockknn, bpe, imatch, langid, licenses, metricjoin, neardup, packing, prefixtrie, roles, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(path: str) -> bytes:
    """A vocabulary file of the driver's tokenizer package."""
    with open(path, "rb") as f:
        return f.read()


@register("op1_collinear_repeats")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand, near enough, in an earlier document."""
    return substrings.repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


OP2_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
texts as (select doc_id, text, length(text)::bigint as n,
                 coalesce(lead(text) over (order by doc_id, text), first_value(text) over (order by doc_id, text)) as nxt,
                 coalesce(lead(doc_id) over (order by doc_id, text), first_value(doc_id) over (order by doc_id, text)) as nid from docs),
edited as (select doc_id, left(text, (n - n // 4)::bigint) || left(nxt, (n // 4)::bigint) as text from texts),
forms as (select doc_id, false as e, text from docs union all select doc_id, true, text from edited),
term as (select distinct doc_id, e, ('0x' || substr(md5(w), 1, 12))::bigint as t
         from (select doc_id, e, unnest(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from forms) where w <> ''),
lex as (select t >> 28 as slot from (select distinct doc_id, t >> 28 << 28 as t from term where not e) group by 1
        having count(*) * 1000 >= (select count(*) from docs) and count(*) * 5 <= (select count(*) from docs)),
subset as (select i, [0, 3, 8, 15][i // 8 + 1] as low, [7, 31, 127, 511][i // 8 + 1] as mask from range(32) r(i)),
inlex as (select * from term where t >> 28 in (select slot from lex)),
part as (select doc_id, e, i, substr(md5(string_agg(t::varchar, ',' order by t)), 1, 12) as h
         from inlex join subset on ((t >> low) & mask) = i % 8 group by all),
anyterm as (select distinct doc_id, e, 1 as one from inlex),
plain as (select f.doc_id, f.e, substr(md5(coalesce(string_agg(t.t::varchar, ',' order by t.t), '')), 1, 12) as h
          from forms f left join anyterm a using (doc_id, e) left join term t using (doc_id, e) where a.one is null group by all),
cell as (select f.doc_id, f.e, s.i, coalesce(p.h, case when s.i = 31 then q.h end, '-') as h
         from forms f cross join subset s left join part p on p.doc_id = f.doc_id and p.e = f.e and p.i = s.i
         left join plain q on q.doc_id = f.doc_id and q.e = f.e),
print as (select doc_id, e, string_agg(h, ':' order by i) as p, list(h order by i) as hs from cell group by all),
pairs as (select t.doc_id, t.n, a.p as fingerprint, b.p as edited_fingerprint, a.hs as x, b.hs as y, c.hs as z, d.text as edited
          from texts t join print a on a.doc_id = t.doc_id and not a.e join print b on b.doc_id = t.doc_id and b.e
          join print c on c.doc_id = t.nid and not c.e join edited d on d.doc_id = t.doc_id),
counts as (select *, len(list_filter(range(1, 33), lambda i: x[i] <> '-' or y[i] <> '-')) as ny, len(list_filter(range(1, 33), lambda i: x[i] <> '-' and x[i] = y[i])) as ey,
                  len(list_filter(range(1, 33), lambda i: x[i] <> '-' or z[i] <> '-')) as nz, len(list_filter(range(1, 33), lambda i: x[i] <> '-' and x[i] = z[i])) as ez from pairs)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, fingerprint, edited_fingerprint,
       case when ny = 0 then 1e0 else ey::double / ny end as near_edited, case when nz = 0 then 1e0 else ez::double / nz end as near_next from counts
"""


@register("op2_imatch", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every text and of its edited form."""
    return imatch.fingerprint_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("op3_role_repair")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair and rendering of every conversation, by turn."""
    return roles.format_chats(table(spark, sf_dir, "conversations"))


@register(
    "op4_block_matrix_knn",
    """
    with v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
               where vec_id is not null and embedding is not null),
    ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    s as (select q.id as query_id, c.id as vec_id, list_inner_product(q.e, c.e) as score
          from ok q join ok c on q.id <> c.id and len(q.e) = len(c.e) and q.id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest rows by inner product for every row whose vec_id is divisible by 20."""
    rows = blockknn.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return blockknn.nearest(rows.where(F.col("id") % 20 == 0), rows, 20)


@register(
    "op5_tensored_minhash",
    r"""
    with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    s as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
                                         else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
    e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
    r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on e.x = r.reach),
    m as (select doc_id, min(reach) as component_id from r group by 1)
    select m.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, component_id = m.doc_id as kept from m left join n using (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.link(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("op6_subword_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = langid.crc_of_id("doc_id") % 3 == 1
    found = langid.identify(docs, "doc_id", "text", "lang", ["doc_id"], ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@register("op7_diagonal_licenses")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of every whole text."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("op8_noisy_channel_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = langid.crc_of_id("doc_id") % 5 == 0
    found = toxicity.score(docs, table(spark, sf_dir, "labels"), "doc_id", "text", ["doc_id"], ~held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op9_bm25_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", file_bytes(TOKENIZER).decode(), public_tokenizers.PATTERN)


@register("op10_bpe_transducer")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document's whole text, as digests."""
    ranks, pattern = file_bytes(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"], ranks, pattern, public_tokenizers.PATTERN)
    back = bpe.decode(ids, "token_ids", ["doc_id", "token_ids"], ranks)
    return back.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP11_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
g as (select conv_id, turn, md5(strlen(role)::varchar || ':' || role || text) as dig, strlen(text)::bigint as bytes from t),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, dig) as pos from g),
n as (select conv_id, max(pos) as n from r group by 1),
c as (select conv_id, n, conv_id - conv_id % 5 as base,
             xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                 lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::bigint)))) % 9 as h from n),
b as (select c.conv_id, 0 as part, r.pos, r.dig, r.bytes from c join r on r.conv_id = c.base and r.pos <= c.h
      union all select c.conv_id, 1, r.pos, r.dig, r.bytes from c join r on r.conv_id = c.conv_id and r.pos > c.h),
l as (select c.conv_id, coalesce(list(b.dig order by part, pos) filter (b.dig is not null), []) as ds, coalesce(list(b.bytes order by part, pos) filter (b.dig is not null), []) as bs
      from c left join b using (conv_id) group by 1),
d as (select *, unnest(range(0, len(ds) + 1)) as depth from l),
pre as (select conv_id, depth, md5(array_to_string(ds[1:depth], ',')) as k, case when depth > 0 then md5(array_to_string(ds[1:depth - 1], ',')) end as up,
               case when depth > 0 then bs[depth] else 0 end as bytes, len(ds) = depth as done from d),
node as (select k, depth, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
                coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (done), '') as ends from pre group by k, depth),
kids as (select up as k, depth - 1 as depth, count(*) as n from node where up is not null group by all),
own as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids using (k, depth)),
tree as (select p.k, p.depth, sum((o.n_convs - 1) * o.bytes) as saved, sum((o.n_children = 0)::int) as n_leaves
         from own o join pre p on p.conv_id = o.conv_id and p.depth <= o.depth group by all)
select o.conv_id, o.depth::bigint as depth, u.conv_id as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children,
       t.n_leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, sha256(o.ends) as ends_sha256
from own o join tree t using (k, depth) left join own u on u.k = o.up and u.depth = o.depth - 1
"""


@register("op11_sparse_table_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations with its place in the trie."""
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
ok as (select vec_id, label, e, row_number() over () as k, sqrt(list_inner_product(e, e)) as n from v
       where vec_id is not null and label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.k, a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and a.k <> b.k and len(a.e) = len(b.e)
      where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(vec_id, reach) as (select distinct vec_id, vec_id from v union select r.vec_id, p.y from r join p on p.x = r.reach),
m as (select vec_id, min(reach) as component_id from r group by 1),
c as (select k, count(*) as n from p group by 1)
select v.vec_id, coalesce(c.n, 0)::bigint as n_links, m.component_id, v.vec_id = m.component_id as kept
from v left join ok on ok.vec_id = v.vec_id left join c on c.k = ok.k left join m on m.vec_id = v.vec_id
"""


@register("op12_pivot_range_join", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings of one label whose cosine is at least 0.98."""
    return metricjoin.link(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@register("op13_perfect_hash_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the two tokenizers on every whole text, with counts of linked ids over all documents."""
    return alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", file_bytes(TOKENIZER).decode(), public_tokenizers.PATTERN, file_bytes(PIECES))

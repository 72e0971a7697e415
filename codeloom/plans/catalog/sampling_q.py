"""Queries: package sizes, split, global index, batches, pairs, triplets, tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import tokens as TK
from codeloom.functions.text import fill_missing_source
from codeloom.operators import sampling as S
from codeloom.plans.registry import query
from codeloom.session import cut_lineage

SEED, EPOCH, BATCH = 42, 0, 16
VOCAB_MOD = TK.DEFAULT_VOCAB - 1


def _h(expr: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({expr}), 1, {digits}))::bigint"


def _id_list_sql(toks: str) -> str:
    """Ids of the first 256 tokens."""
    return f"list_transform({toks}[1:256], lambda x: {_h('x', 8)} % {VOCAB_MOD} + 1)"


def _padded_sql(ids: str, length: str) -> str:
    return f"array_to_string(list_concat({ids}, list_transform(range({length} - len({ids})), lambda x: 0)), ',')"


def _mask_sql(ids: str, length: str) -> str:
    return f"repeat('1', len({ids})) || repeat('0', {length} - len({ids}))"


def _sizes(t):
    return S.package_sizes(t["node_docs"], t["edge_docs"])


def _split(t):
    return S.group_split(_sizes(t), val=0.2, seed=SEED)


# --- shared SQL --------------------------------------------------------------------
_SPLIT_SQL = f"""
sz as (select package, count(*) as n from edge_docs group by package),
hk as (select package, n, {_h("'42:' || package")} as order_key from sz),
sp as (select package, n, order_key,
         coalesce(sum(n) over (order by order_key, package rows between unbounded preceding and 1 preceding), 0)
           as before_n, sum(n) over () as total from hk),
split as (select package, n, order_key, case when before_n < total * 0.8 then 'train' else 'validation' end as split
          from sp)"""

_NS_SQL = """
ns as (select package, node, case when s is null or s = '' then 'nothing' else s end as src
       from (select package, node, max_by(source_code, doc_id) as s from node_docs group by package, node) t)"""

_PAIRS_SQL = _NS_SQL + """,
pairs as (select e.package, e.edge_id, e.node1, e.node2, coalesce(a.src, 'nothing') as source1,
                 coalesce(b.src, 'nothing') as source2
          from edge_docs e left join ns a on a.package = e.package and a.node = e.node1
          left join ns b on b.package = e.package and b.node = e.node2)"""

_TRIP_SQL = _PAIRS_SQL + f""",
trip as (select p.*, d.node as node3, coalesce(c.src, 'nothing') as source3
         from pairs p
         join (select distinct package, n from node_docs) m on m.package = p.package
         join node_docs d on d.package = p.package and d.idx = {_h("'42:0:' || cast(p.edge_id as string)")} % m.n + 1
         left join ns c on c.package = p.package and c.node = d.node)"""


def _tok_sql(x: str) -> str:
    tt = f"trim(regexp_replace({x}, '[\\t\\n\\r]', ' ', 'g'))"
    return f"(case when {tt} = '' then []::varchar[] else string_split_regex({tt}, ' +') end)"


def _ids_sum_sql(toks: str) -> str:
    return (f"coalesce(list_sum(list_transform({toks}[1:256], lambda x: {_h('x', 8)} % {VOCAB_MOD} + 1)), 0)")


# --- queries -----------------------------------------------------------------------
@query("A4_unknown_edge_ratio", ["edge_docs"],
       """select package, count(*) as edges, count(*) filter (where starts_with(node2, '<unk>.')) as unknown,
  round(count(*) filter (where starts_with(node2, '<unk>.')) / count(*), 6) as ratio
from edge_docs group by package""")
def a4(t):
    r = S.unknown_edge_ratio(t["edge_docs"])
    return r.select("package", "edges", "unknown", F.round("ratio", 6).alias("ratio"))


@query("A5_package_sizes", ["node_docs", "edge_docs"],
       """select coalesce(n.package, e.package) as package, coalesce(n.nodes, 0) as nodes, coalesce(e.edges, 0) as edges
from (select package, count(*) as nodes from node_docs group by package) n
full join (select package, count(*) as edges from edge_docs group by package) e on e.package = n.package""")
def a5(t):
    return _sizes(t)


@query("P10_fill_missing_source", ["node_docs"],
       "select package, node, case when source_code is null or source_code = '' then 'nothing' else source_code end "
       "as source from node_docs")
def p10(t):
    return t["node_docs"].select("package", "node", fill_missing_source("source_code").alias("source"))


@query("W1_group_split", ["edge_docs"], "with " + _SPLIT_SQL.strip() + "\nselect package, n, split from split")
def w1(t):
    """Whole packages to train while the running edge count is below 80 %."""
    return _split(t).select("package", "n", "split")


@query("W2_merged_index", ["edge_docs"], "with " + _SPLIT_SQL.strip() + """,
loc as (select package, edge_id, row_number() over (partition by package order by edge_id) as li from edge_docs),
offs as (select package, coalesce(sum(n) over (order by order_key, package
                 rows between unbounded preceding and 1 preceding), 0) as off from split)
select l.package, l.edge_id, o.off + l.li - 1 as global_idx from loc l join offs o on o.package = l.package""")
def w2(t):
    """Position of each edge in the concatenation of all packages."""
    idx = S.merged_index(t["edge_docs"].select("package", "edge_id"), _split(t), "edge_id")
    return idx.select("package", "edge_id", "global_idx")


_W3_SQL = "with " + _SPLIT_SQL.strip() + f""",
tr as (select e.package, e.edge_id, row_number() over (order by {_h("'42:0:' || cast(e.edge_id as string)")}, e.edge_id)
              as p from edge_docs e join split s on s.package = e.package where s.split = 'train'),
va0 as (select e.package, e.edge_id, row_number() over (partition by e.package order by e.edge_id) as li,
               s.order_key from edge_docs e join split s on s.package = e.package where s.split = 'validation'),
voff as (select package, coalesce(sum(n) over (order by order_key, package
                 rows between unbounded preceding and 1 preceding), 0) as off from split where split = 'validation'),
va as (select v.package, v.edge_id, o.off + v.li as p from va0 v join voff o on o.package = v.package),
batches as (
  select 'train' as split, package, edge_id, p - 1 as pos, cast(floor((p - 1) / 16) as bigint) as batch_id from tr
  union all
  select 'validation', package, edge_id, p - 1, cast(floor((p - 1) / 16) as bigint) from va)"""


def _batches(t):
    rows = t["edge_docs"].select("package", "edge_id")
    # the light table that every step reads is written once
    rows = cut_lineage(rows.join(_split(t).select("package", "split", "order_key"), "package"))
    split = rows.select("package", "split", "order_key").distinct()
    train = S.assign_batches(rows.filter(F.col("split") == "train"), BATCH, True, "edge_id", SEED, EPOCH)
    train = train.drop("order_key")
    val_rows = rows.filter(F.col("split") == "validation").drop("order_key")
    val = S.merged_index(val_rows, split.filter(F.col("split") == "validation"), "edge_id")
    val = S.assign_batches(val, BATCH, False, "edge_id", index_col="global_idx").drop("global_idx")
    return train.unionByName(val)


@query("W3_assign_batches", ["edge_docs"], _W3_SQL + "\nselect split, package, edge_id, pos, batch_id from batches")
def w3(t):
    """Train batches of 16 in seeded shuffled order; validation in order."""
    return _batches(t).select("split", "package", "edge_id", "pos", "batch_id")


@query("J4_edge_pairs", ["node_docs", "edge_docs"],
       "with " + _PAIRS_SQL.strip() + "\nselect package, edge_id, node1, node2, source1, source2 from pairs")
def j4(t):
    p = S.edge_pairs(t["edge_docs"], t["node_docs"], "doc_id")
    return p.select("package", "edge_id", "node1", "node2", "source1", "source2")


@query("J5_triplets", ["node_docs", "edge_docs"],
       "with " + _TRIP_SQL.strip() +
       "\nselect package, edge_id, node1, node2, node3, source1, source2, source3 from trip")
def j5(t):
    tr = S.triplets(t["edge_docs"], t["node_docs"], "edge_id", "doc_id", SEED, EPOCH)
    return tr.select("package", "edge_id", "node1", "node2", "node3", "source1", "source2", "source3")


@query("U1_merge_graphs", ["edge_docs"],
       """select package, edge_id, node1, node2, type from edge_docs where package < 'src5'
union all select package, edge_id, node1, node2, null from edge_docs where package >= 'src5'""")
def u1(t):
    """Current-format datasets (with ``type``) merged with legacy ones (without)."""
    e = t["edge_docs"]
    cur = e.filter(F.col("package") < "src5").select("package", "edge_id", "node1", "node2", "type")
    legacy = e.filter(F.col("package") >= "src5").select("package", "edge_id", "node1", "node2")
    return S.merge_graphs([cur, legacy])


_TOKS = _tok_sql("case when source_code is null or source_code = '' then 'nothing' else source_code end")


@query("P16_tokenize", ["node_docs"],
       f"""select doc_id, len(toks) as n_tokens, least(len(toks), 256) as n_kept, {_ids_sum_sql('toks')} as id_sum
from (select doc_id, {_TOKS} as toks from node_docs) t""")
def p16(t):
    toks = TK.tokens(fill_missing_source("source_code"))
    d = t["node_docs"].select("doc_id", toks.alias("toks"))
    ids = TK.token_ids(TK.truncate("toks"))
    return d.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.least(F.size("toks"), F.lit(256)).cast("bigint").alias("n_kept"),
                    F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query("P17_token_count", ["node_docs"],
       f"""select doc_id, len(toks) as n_tokens, len(toks) > 256 as truncated
from (select doc_id, {_TOKS} as toks from node_docs) t""")
def p17(t):
    src = fill_missing_source("source_code")
    return t["node_docs"].select("doc_id", TK.token_count(src).cast("bigint").alias("n_tokens"),
                                 TK.was_truncated(src).alias("truncated"))


@query("P18_pad_batch", ["node_docs"],
       f"""with k as (select doc_id, {_id_list_sql('toks')} as ids,
                  row_number() over (order by {_h("'42:0:' || cast(doc_id as string)")}, doc_id) as p
           from (select doc_id, {_TOKS} as toks from node_docs) t),
b as (select doc_id, ids, cast(floor((p - 1) / 16) as bigint) as batch_id, p - 1 as pos from k),
w as (select *, max(len(ids)) over (partition by batch_id) as pad_to from b)
select doc_id, batch_id, pos, pad_to, {_padded_sql('ids', 'pad_to')} as ids, {_mask_sql('ids', 'pad_to')} as mask from w""")
def p18(t):
    """Seeded batches of 16; each row's ids and mask, padded to its batch's longest."""
    d = t["node_docs"].select("doc_id", TK.truncate(TK.tokens(fill_missing_source("source_code"))).alias("toks"))
    d = d.select("doc_id", TK.token_ids("toks").alias("ids"))
    b = S.assign_batches(d, BATCH, True, "doc_id", SEED, EPOCH)
    b = b.withColumn("pad_to", F.max(F.size("ids")).over(Window.partitionBy("batch_id")).cast("bigint"))
    return b.select("doc_id", "batch_id", "pos", "pad_to", F.array_join(TK.pad("ids", "pad_to"), ",").alias("ids"),
                    F.array_join(TK.attention_mask("ids", "pad_to"), "").alias("mask"))


_L2_SIDES = [f"""{_padded_sql(f'i{k}', f'n{k}')} as ids{k}, {_mask_sql(f'i{k}', f'n{k}')} as mask{k}""" for k in (1, 2, 3)]


@query("L2_build_training_set", ["node_docs", "edge_docs"],
       _W3_SQL + ",\n" + _TRIP_SQL.strip() + f""",
tk as (select package, edge_id, node1, node2, node3, {", ".join(f"{_tok_sql(f'source{k}')} as t{k}" for k in (1, 2, 3))} from trip),
ti as (select package, edge_id, node1, node2, node3, {", ".join(f"{_id_list_sql(f't{k}')} as i{k}" for k in (1, 2, 3))} from tk),
padded as (select b.split, b.batch_id, b.pos, ti.*,
  {", ".join(f"max(len(i{k})) over (partition by b.split, b.batch_id) as n{k}" for k in (1, 2, 3))}
  from batches b join ti on ti.package = b.package and ti.edge_id = b.edge_id)
select split, batch_id, pos, package, edge_id, node1, node2, node3, {", ".join(_L2_SIDES)} from padded""")
def l2(t):
    """Split → triplets → tokens → padded batches: every row's ids and masks."""
    from codeloom.plans.training import build_training_set

    out = build_training_set(t["edge_docs"], t["node_docs"], id_col="edge_id", order="doc_id",
                             seed=SEED, epoch=EPOCH, batch_size=BATCH, pad=True)
    sides = [c for i in (1, 2, 3) for c in (F.array_join(f"ids{i}", ",").alias(f"ids{i}"), F.array_join(f"mask{i}", "").alias(f"mask{i}"))]
    return out.select("split", "batch_id", "pos", "package", "edge_id", "node1", "node2", "node3", *sides)


@query("P16_vocabulary_ids", ["node_docs"],
       f"""with vocab as (select distinct unnest({_tok_sql('text')}) as token from benchmark),
v as (select token, {_h('token', 8)} % {VOCAB_MOD} + 1 as id from vocab),
t as (select doc_id, unnest(({_TOKS})[1:256]) as token from node_docs)
select n.doc_id, coalesce(sum(coalesce(v.id, 0)), 0) as id_sum, count(v.id) as n_known
from node_docs n left join t on t.doc_id = n.doc_id left join v on v.token = t.token group by n.doc_id""")
def p16v(t):
    """Token ids from a vocabulary table (tokens of ``benchmark``) by join;
    unknown tokens get id 0."""
    vocab = t["benchmark"].select(F.explode(TK.tokens("text")).alias("token")).distinct()
    vocab = vocab.select("token", TK.token_id("token").cast("int").alias("id"))
    d = t["node_docs"].select("doc_id", TK.truncate(TK.tokens(fill_missing_source("source_code"))).alias("toks"))
    ids = S.vocabulary_ids(d, ["doc_id"], "toks", vocab, unk_id=0)
    return ids.select("doc_id", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
                      F.size(F.filter("ids", lambda x: x != 0)).cast("bigint").alias("n_known"))

"""Queries: nearest neighbours, context retrieval, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.util import round6
from codeloom.operators.knn import nearest
from codeloom.plans.registry import query, sql_text
from codeloom.plans.retrieval import build_prompts, context_sources

_PAIRS_SQL = """
nn_d as (
  select a.dataset_name, a.id, b.id as neighbor_id,
         list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance
  from function_base a join function_base b on a.dataset_name = b.dataset_name and a.id <> b.id),
nn as (
  select * from (select *, row_number() over (partition by dataset_name, id order by distance, neighbor_id) as rank
                 from nn_d) t where rank <= 5)"""


def _nn_sql(select: str) -> str:
    return "with " + _PAIRS_SQL.strip() + "\n" + select


@query("J6_nearest", views=["function_base"], sql=None)
def j6_nearest(t):
    """Exact 5 nearest functions (Euclidean) inside each dataset."""
    nn = nearest(t["function_base"], "id", "embedding", "dataset_name", k=5)
    return nn.select("dataset_name", "id", "neighbor_id", "rank", round6("distance").alias("distance"))


@query("J6_nearest_cells", views=["function_base"], sql=None)
def j6_cells(t):
    """The same with blocks so small that every dataset is cut into pivot cells."""
    nn = nearest(t["function_base"], "id", "embedding", "dataset_name", k=5, block_size=128)
    return nn.select("dataset_name", "id", "neighbor_id", "rank", round6("distance").alias("distance"))


@query("W4_neighbour_rank", views=["function_base"], sql=None)
def w4_rank(t):
    """Rank positions 1..k per query (count of neighbours at each rank)."""
    nn = nearest(t["function_base"], "id", "embedding", "dataset_name", k=5)
    return nn.groupBy("dataset_name", "rank").agg(F.count(F.lit(1)).alias("n_queries"))


@query("J7_retrieve_context", views=["function_base"], sql=None)
def j7_context(t):
    """Neighbour code in rank order, one context block per function."""
    base = t["function_base"]
    nn = nearest(base, "id", "embedding", "dataset_name", k=5)
    ctx = context_sources(nn, base, "dataset_name", "id", "raw_source_code")
    return ctx.select("dataset_name", "id", T.context_block("sources").alias("context"))


@query("L4_build_prompts", views=["function_base"], sql=None)
def l4_prompts(t):
    """Prompt with the 5 nearest functions of the same dataset as context."""
    return build_prompts(t["function_base"], k=5)


@query("P13_prompt_no_context", views=["code_base"], sql=None)
def p13_prompt(t):
    """Prompt without context (signature only)."""
    return build_prompts(t["code_base"], with_context=False)


# --- oracle texts (need the pair CTEs after the fixture list) -------------------------
from codeloom.plans.registry import REGISTRY  # noqa: E402

REGISTRY["J6_nearest"].body = _nn_sql(
    "select dataset_name, id, neighbor_id, cast(rank as integer) as rank, round(distance, 6) as distance from nn")
REGISTRY["J6_nearest_cells"].body = REGISTRY["J6_nearest"].body
REGISTRY["W4_neighbour_rank"].body = _nn_sql(
    "select dataset_name, cast(rank as integer) as rank, count(*) as n_queries from nn group by dataset_name, rank")
_CTX = ("(" + sql_text(T.CONTEXT_HEADING) + " || coalesce(string_agg(b.raw_source_code || "
        + sql_text(T.CONTEXT_SEPARATOR) + ", '' order by nn.rank), ''))")
REGISTRY["J7_retrieve_context"].body = _nn_sql(
    f"""select nn.dataset_name, nn.id, {_CTX} as context
from nn join function_base b on b.dataset_name = nn.dataset_name and b.id = nn.neighbor_id
group by nn.dataset_name, nn.id""")
REGISTRY["L4_build_prompts"].body = _nn_sql(
    f"""select f.dataset_name, f.id, f.signature,
  {sql_text(T.PROMPT_HEAD)} || {sql_text(T.CONTEXT_HEADING)} || coalesce(c.ctx, '')
  || {sql_text(T.PROMPT_SIGNATURE_HEADING)} || f.signature || {sql_text(T.PROMPT_TAIL)} as prompt
from function_base f left join (
  select nn.dataset_name, nn.id,
         string_agg(b.raw_source_code || {sql_text(T.CONTEXT_SEPARATOR)}, '' order by nn.rank) as ctx
  from nn join function_base b on b.dataset_name = nn.dataset_name and b.id = nn.neighbor_id
  group by nn.dataset_name, nn.id) c on c.dataset_name = f.dataset_name and c.id = f.id""")
REGISTRY["P13_prompt_no_context"].body = (
    f"""select dataset_name, id, signature,
  {sql_text(T.PROMPT_HEAD)} || {sql_text(T.PROMPT_SIGNATURE_HEADING)} || signature || {sql_text(T.PROMPT_TAIL)} as prompt
from code_base""")

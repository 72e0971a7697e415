"""Queries: generated-code metrics, per-dataset aggregates and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.util import round6
from codeloom.operators import codemetrics as CM
from codeloom.plans.registry import query

IDS = ["conv_id", "turn"]
#: DuckDB's levenshtein counts bytes: for the check each character beyond ASCII of a
#: pair stands as one of these control characters there, which no text has.
_SPARE = "(" + " || ".join(f"chr({k})" for k in (*range(1, 9), 11, 12, *range(14, 32), 127)) + ")"
SQL_METRICS = ("levenshtein_distance", "ngram_match_score", "weighted_ngram_match_score")


def _tok(x: str) -> str:
    tt = f"trim(regexp_replace({x}, '[\\t\\n\\r]', ' ', 'g'))"
    return f"(case when {tt} = '' then []::varchar[] else string_split_regex({tt}, ' +') end)"


def _bleu_sql(weighted: bool, name: str) -> str:
    kw = ", ".join(f"'{k}'" for k in CM.PYTHON_KEYWORDS)
    w = f"(case when n = 1 then (case when g in ({kw}) then 1.0 else 0.2 end) else 1.0 end)" if weighted else "1.0"
    ps = []
    for k in range(1, 5):
        tot = f"(case when coalesce(tot{k}, 0) = 0 then 1.0 else tot{k} end)"
        ps.append(f"ln(case when coalesce(hit{k}, 0) = 0 then 0.1 / {tot} else hit{k} / {tot} end)")
    return f"""
{name}_tk as (select conv_id, turn, 'c' as side, {_tok('candidate')} as t from pairs
              union all select conv_id, turn, 'r', {_tok('reference')} from pairs),
{name}_gr as (select conv_id, turn, side, n, array_to_string(t[i:i+n-1], ' ') as g
              from (select conv_id, turn, side, t, unnest([1, 2, 3, 4]) as n from {name}_tk) a,
                   unnest(generate_series(1, len(t) - n + 1)) as s(i)),
{name}_cnt as (select conv_id, turn, n, g, count(*) filter (where side = 'c') as cc,
                      count(*) filter (where side = 'r') as rc from {name}_gr group by conv_id, turn, n, g),
{name}_pn as (select conv_id, turn, n, sum({w} * least(cc, rc)) as hit, sum({w} * cc) as tot
              from {name}_cnt group by conv_id, turn, n),
{name}_w as (select conv_id, turn,
  {", ".join(f"sum(case when n = {k} then hit end) as hit{k}" for k in range(1, 5))},
  {", ".join(f"sum(case when n = {k} then tot end) as tot{k}" for k in range(1, 5))}
  from {name}_pn group by conv_id, turn),
{name} as (select p.conv_id, p.turn,
  case when coalesce(hit1, 0) = 0 then 0.0
       else exp(({" + ".join(ps)}) / 4.0) *
            (case when len({_tok('p.candidate')}) > len({_tok('p.reference')}) then 1.0
                  else exp(1 - len({_tok('p.reference')}) / greatest(len({_tok('p.candidate')}), 1)) end) end as score
  from pairs p left join {name}_w w on w.conv_id = p.conv_id and w.turn = p.turn)"""


def _lev_sql(a: str, b: str) -> str:
    far = f"array_to_string(list_sort(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]'))), '')"
    one = lambda x: f"translate({x}, {far}, left({_SPARE}, length({far})))"
    return f"levenshtein({one(a)}, {one(b)})"


_PAIRS = """pairs as (select dataset_name, variant, conv_id, turn, reference, candidate from results_long
          where reference is not null and candidate is not null)"""

_SCORES_SQL = "with " + _PAIRS + "," + _bleu_sql(False, "bleu") + "," + _bleu_sql(True, "wbleu") + f""",
scores as (select p.dataset_name, p.variant, p.conv_id, p.turn,
  cast({_lev_sql('p.reference', 'p.candidate')} as double) as levenshtein_distance,
  b.score as ngram_match_score, w.score as weighted_ngram_match_score
  from pairs p join bleu b on b.conv_id = p.conv_id and b.turn = p.turn
  join wbleu w on w.conv_id = p.conv_id and w.turn = p.turn),
gm as (
  select dataset_name, variant, 'levenshtein_distance' as metric, avg(levenshtein_distance) as mean,
         stddev_pop(levenshtein_distance) as std from scores group by dataset_name, variant
  union all select dataset_name, variant, 'ngram_match_score', avg(ngram_match_score), stddev_pop(ngram_match_score)
         from scores group by dataset_name, variant
  union all select dataset_name, variant, 'weighted_ngram_match_score', avg(weighted_ngram_match_score),
         stddev_pop(weighted_ngram_match_score) from scores group by dataset_name, variant),
macro as (select variant, metric, avg(mean) as mean from gm group by variant, metric),
cmp as (select metric, max(case when variant = 'trained' then mean end) as trained,
               max(case when variant = 'not_trained' then mean end) as not_trained from macro group by metric)"""


def _scores(t):
    return CM.score_pairs(t["results_long"], ["dataset_name", "variant", *IDS], with_ast=False, partitions=t.partitions)


def _gm(t):
    return CM.generation_metrics(_scores(t), ["dataset_name", "variant"], list(SQL_METRICS))


def _cmp(t):
    return CM.compare_variants(CM.macro_average(_gm(t), ["variant"]))


@query("M6_edit_distance", ["results_long"],
       f"""select conv_id, turn, {_lev_sql('reference', 'candidate')} as distance
from results_long where reference is not null and candidate is not null""")
def m6(t):
    """Levenshtein distance of the whole texts, in characters."""
    rl = t["results_long"].filter(F.col("reference").isNotNull() & F.col("candidate").isNotNull())
    return rl.select(*IDS, CM.edit_distance("reference", "candidate").alias("distance"))


@query("M7_ngram_match", ["results_long"],
       "with " + _PAIRS + "," + _bleu_sql(False, "bleu") + "\nselect conv_id, turn, round(score, 6) as score from bleu")
def m7(t):
    s = CM.ngram_match(t["results_long"], IDS, partitions=t.partitions)
    return s.select(*IDS, round6("score").alias("score"))


@query("M8_weighted_ngram_match", ["results_long"],
       "with " + _PAIRS + "," + _bleu_sql(True, "wbleu") + "\nselect conv_id, turn, round(score, 6) as score from wbleu")
def m8(t):
    s = CM.ngram_match(t["results_long"], IDS, weighted=True, partitions=t.partitions)
    return s.select(*IDS, round6("score").alias("score"))


# The src files have three shapes.  Of the subtrees of a plain function (9, leaves not
# counted) 3 occur in the class with a method, which has 8, of which 3 occur in the
# function; both have two data-flow edges, of which one (the called name) is equal.
_SHAPES = """shape as (select package, doc_id, reference, candidate,
  case when starts_with(reference, 'def (') then 'bad' when starts_with(reference, 'class') then 'method' else 'plain' end as r,
  case when starts_with(candidate, 'def (') then 'bad' when starts_with(candidate, 'class') then 'method' else 'plain' end as c
  from src_pairs),
tree as (select package, doc_id, r <> 'bad' and c <> 'bad' as parsed,
  case when r = 'bad' or c = 'bad' then 0.0 when r = c then 1.0 when r = 'plain' then 3 / 9.0 else 3 / 8.0 end as syntax,
  case when r = 'bad' or c = 'bad' then null when r = c then 1.0 else 0.5 end as dataflow from shape)"""


@query("M9_syntax_match", ["src_pairs"],
       "with " + _SHAPES + "\nselect package, doc_id, round(cast(syntax as double), 6) as syntax_match_score, parsed from tree")
def m9(t):
    """Share of reference sub-trees found in the candidate (src file pairs)."""
    s = CM.ast_match(t["src_pairs"], ["package", "doc_id"], partitions=t.partitions)
    return s.select("package", "doc_id", round6("syntax_match_score").alias("syntax_match_score"), "parsed")


@query("M10_dataflow_match", ["src_pairs"],
       "with " + _SHAPES + "\nselect package, doc_id, cast(dataflow as double) as dataflow_match_score from tree")
def m10(t):
    """Share of reference def-use edges found in the candidate (src file pairs)."""
    s = CM.ast_match(t["src_pairs"], ["package", "doc_id"], partitions=t.partitions)
    return s.select("package", "doc_id", round6("dataflow_match_score").alias("dataflow_match_score"))


@query("M11_codebleu", ["src_pairs"],
       "with " + _SHAPES + """,
pairs as (select package as conv_id, doc_id as turn, reference, candidate from src_pairs),"""
       + _bleu_sql(False, "bleu") + "," + _bleu_sql(True, "wbleu") + """
select t.package, t.doc_id, cast(case when dataflow is null then 3 else 4 end as integer) as n_parts,
  round(case when dataflow is null then (b.score + w.score + syntax) / 3
             else (b.score + w.score + syntax + dataflow) / 4 end, 6) as codebleu
from tree t join bleu b on b.conv_id = t.package and b.turn = t.doc_id
join wbleu w on w.conv_id = t.package and w.turn = t.doc_id""")
def m11(t):
    """CodeBLEU of src file pairs: mean of the four parts (null parts left out)."""
    s = CM.score_pairs(t["src_pairs"], ["package", "doc_id"], partitions=t.partitions)
    return s.select("package", "doc_id", round6("codebleu").alias("codebleu"), "n_parts")


@query("F9_scored_pairs_only", ["results_long"],
       """select dataset_name, variant, count(*) as pairs,
  count(*) filter (where reference is not null and candidate is not null) as scored
from results_long group by dataset_name, variant""")
def f9(t):
    from codeloom.functions.predicates import scored_pair

    return t["results_long"].groupBy("dataset_name", "variant").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(scored_pair("reference", "candidate")).alias("scored"))


@query("A10_generation_metrics", ["results_long"],
       _SCORES_SQL + "\nselect dataset_name, variant, metric, round(mean, 6) as mean, round(std, 6) as std from gm")
def a10(t):
    """Per dataset and variant: mean and population std of each metric."""
    g = _gm(t)
    return g.select("dataset_name", "variant", "metric", round6("mean").alias("mean"), round6("std").alias("std"))


@query("A11_macro_average", ["results_long"],
       _SCORES_SQL + "\nselect variant, metric, round(mean, 6) as mean from macro")
def a11(t):
    m = CM.macro_average(_gm(t), ["variant"])
    return m.select("variant", "metric", round6("mean").alias("mean"))


@query("J8_compare_variants", ["results_long"],
       _SCORES_SQL + "\nselect metric, round(trained, 6) as trained, round(not_trained, 6) as not_trained from cmp")
def j8(t):
    c = _cmp(t)
    return c.select("metric", round6("trained").alias("trained"), round6("not_trained").alias("not_trained"))


@query("A12_metric_delta", ["results_long"],
       _SCORES_SQL + "\nselect metric, round(trained - not_trained, 6) as delta, trained - not_trained >= 0 as improved "
       "from cmp")
def a12(t):
    d = CM.metric_delta(_cmp(t))
    return d.select("metric", round6("delta").alias("delta"), "improved")


@query("P19_percent_title", ["results_long"],
       _SCORES_SQL + """
select metric, initcap_title, printf('%.1f', trained * 100) || '%' as trained_pct from (
  select metric, trained,
    array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')
      as initcap_title from cmp) t""")
def p19(t):
    c = _cmp(t)
    return c.select("metric", T.metric_title("metric").alias("initcap_title"), T.percent("trained").alias("trained_pct"))


_NAMES_SQL = "case metric " + " ".join(f"when '{k}' then '{v}'" for k, v in CM.DISPLAY_NAMES) + " end"
_POS_SQL = "case metric " + " ".join(f"when '{k}' then {i + 1}" for i, (k, _) in enumerate(CM.DISPLAY_NAMES)) + " end"


@query("P20_report_rows", ["results_long"],
       _SCORES_SQL + f"""
select {_POS_SQL} as position, metric,
  {_NAMES_SQL} || ' & ' || printf('%.1f', trained * 100.0) || '\\% & ' || printf('%.1f', not_trained * 100.0)
  || '\\% \\\\' as line
from cmp where metric in ({", ".join(f"'{k}'" for k, _ in CM.DISPLAY_NAMES)})""")
def p20(t):
    """Body lines of the comparison table (``Name & a% & b% \\\\``)."""
    return CM.report_rows(_cmp(t))


# the turns are prose, which does not parse: no syntax is matched and data flow is left out
_L6_SQL = _SCORES_SQL + """,
six as (select dataset_name, variant, unnest([
    {'metric': 'levenshtein_distance', 'v': levenshtein_distance},
    {'metric': 'codebleu', 'v': (ngram_match_score + weighted_ngram_match_score) / 3},
    {'metric': 'ngram_match_score', 'v': ngram_match_score},
    {'metric': 'weighted_ngram_match_score', 'v': weighted_ngram_match_score},
    {'metric': 'syntax_match_score', 'v': 0.0}, {'metric': 'dataflow_match_score', 'v': null}]) as m from scores)
select dataset_name, variant, m.metric as metric, round(avg(m.v), 6) as mean, round(stddev_pop(m.v), 6) as std
from six group by dataset_name, variant, m.metric"""


@query("L6_score_generations", ["results_long"], _L6_SQL)
def l6(t):
    """All metrics (incl. syntax / data-flow / CodeBLEU) per dataset and variant."""
    from codeloom.plans.evaluation import score_generations

    g = score_generations(t["results_long"], IDS, partitions=t.partitions)
    return g.select("dataset_name", "variant", "metric", round6("mean").alias("mean"), round6("std").alias("std"))


@query("L6_shared_signatures", ["results_long"], _L6_SQL)
def l6_shared(t):
    """The same where functions are known by a signature that both variants of a dataset share."""
    from codeloom.plans.evaluation import score_generations

    named = t["results_long"].withColumn("signature", F.concat(F.lit("f"), "turn"))
    g = score_generations(named, ["signature"], partitions=t.partitions)
    return g.select("dataset_name", "variant", "metric", round6("mean").alias("mean"), round6("std").alias("std"))


@query("L7_compare_report", ["results_long"],
       _SCORES_SQL + """
select metric, round(trained, 6) as trained, round(not_trained, 6) as not_trained,
       round(trained - not_trained, 6) as delta from cmp""")
def l7(t):
    """Macro averages per variant side by side, with the difference."""
    from codeloom.plans.evaluation import compare_report

    r = compare_report(_gm(t))["comparison"]
    return r.select("metric", round6("trained").alias("trained"), round6("not_trained").alias("not_trained"),
                    round6("delta").alias("delta"))

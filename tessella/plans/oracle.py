"""DuckDB SQL of the queries in the catalogue, written independently of the operators."""

from __future__ import annotations

from tessella.operators.narrate import PROMPT, TEMPLATE


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LABELLED = "labelled as (select l.doc_id, l.quality, l.toxic, d.n_chars from labels l join documents d on d.doc_id = l.doc_id)"
_SCORED = f"""{_LABELLED}, scored as (
  select 'a' as model, doc_id as row_id, quality as y, n_chars::double as grp, toxic,
    round(1.0::double / (1.0::double + exp(-(1.2::double + n_chars::double * -0.0004::double + toxic::double * 0.3::double))), 6) as p from labelled
  union all
  select 'b', doc_id, quality, n_chars::double, toxic,
    round(1.0::double / (1.0::double + exp(-(-0.3::double + n_chars::double * 0.0003::double + toxic::double * 0.5::double))), 6) from labelled)"""
_PREDICTED = f"{_SCORED}, predicted as (select *, (p >= 0.6)::int as yhat from scored)"
_CELLS = "count(*) filter (y = 1 and yhat = 1) as tp, count(*) filter (y = 0 and yhat = 1) as fp, count(*) filter (y = 1 and yhat = 0) as fn, count(*) filter (y = 0 and yhat = 0) as tn"


def _div(a: str, b: str) -> str:
    return f"case when ({b}) > 0 then ({a})::double / ({b})::double else 0.0::double end"


def _rates(digits: int = 6) -> str:
    made = {"accuracy": ("tp + tn", "tp + fp + fn + tn"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "f1": ("2 * tp", "2 * tp + fp + fn")}
    return ", ".join(f'round({_div(*v)}, {digits}) as "{k}"' for k, v in made.items())


_NULLS = "li as (select * replace (case when l_orderkey % 7 <> 0 then l_quantity end as l_quantity, case when l_orderkey % 11 <> 0 then l_discount end as l_discount) from lineitem)"
_FOLDS = "folds as (select doc_id as row_id, (row_number() over (partition by quality order by md5('42:' || doc_id::varchar), doc_id) - 1) % 5 as fold from labels)"
_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _each(template: str, names=_NUMERIC) -> str:
    return " union all ".join(template.format(c=c) for c in names)


def _u(tag: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{tag}'", *[f"({k})::varchar" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::ubigint::double / 4294967296.0::double)"


_POP = f"""pop as (select vec_id as ind_id, {_u("init:c", "vec_id")} * 3 - 2 as log10_c, floor({_u("init:p", "vec_id")} * 2)::int as penalty,
  floor({_u("init:w", "vec_id")} * 2)::int as class_weight, {_u("init:t", "vec_id")} * 0.4::double + 0.3::double as threshold from embeddings)"""
_FIT = f"fit as (select vec_id as ind_id, round({_u('fit', 'vec_id')}, 3) as fitness from embeddings)"
_KNN = """t as (select vec_id as tid, embedding::double[] as v from embeddings where vec_id % 10 <> 0),
  q as (select vec_id as qid, embedding::double[] as v from embeddings where vec_id % 10 = 0),
  d as (select qid, tid, list_distance(q.v, t.v) as dist from q, t),
  nn as (select *, row_number() over (partition by qid order by dist, tid) as rank from d)"""
_VOTES = f"""{_KNN}, votes as (select qid, rank as k, sum((label >= 5)::bigint) over (partition by qid order by rank) as votes
  from nn join embeddings e on e.vec_id = nn.tid where rank <= 15)"""
_SWEEP = f"""{_VOTES}, judged as (select k, (label >= 5)::int as y, (votes * 2 > k)::int as yhat from votes join embeddings e on e.vec_id = qid),
  cells as (select k, {_CELLS} from judged group by k), sweep as (
  select k, round({_div("2 * tp", "2 * tp + fp + fn")}, 6) as f1, round(1 - {_div("2 * tp", "2 * tp + fp + fn")}, 6) as error from cells)"""
_W = {"l_quantity": 0.8, "l_extendedprice": -0.5, "l_discount": 0.3, "l_tax": -0.2}


def _shap(background: str, digits: int = 4) -> str:
    return " union all ".join(f"select l_orderkey, l_linenumber, '{c}' as feature, {c} as value, round(({c} - (select avg({c}) from {background})) * {w}::double, {digits}) + 0.0::double as phi from lineitem" for c, w in _W.items())


def _cross(kind: str, prob: float) -> str:
    genes = ("log10_c", "penalty", "class_weight", "threshold")
    cols = []
    for i, g in enumerate(genes):
        swap = f"{_u(f'cx:{i}', 'pair')} < 0.5" if kind == "uniform" else f"{i} >= floor({_u('cx:cut', 'pair')} * 3) + 1"
        value = f"case when {_u('cx:gate', 'pair')} < {prob} and o_{g} is not null and {swap} then o_{g} else {g} end"
        cols.append(f"round({value}, 6) as {g}" if g in ("log10_c", "threshold") else f"({value})::int as {g}")
    other = ", ".join(f"o.{g} as o_{g}" for g in genes)
    return f"with {_POP}, m as (select p.*, p.ind_id // 2 as pair, {other} from pop p left join pop o on o.ind_id // 2 = p.ind_id // 2 and o.ind_id <> p.ind_id) select ind_id, {', '.join(cols)} from m"


def _sweep_fitness() -> str:
    return f"""with {_SCORED}, {_FOLDS}, each as (
  select y, p, grp, fold, threshold, (p >= threshold)::int as yhat from scored join folds using (row_id), (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as threshold) where model = 'a'
), cells as (select threshold, fold, {_CELLS} from each group by all
), r as (select threshold, fold, {_rates(9)} from cells
), md as (select threshold, fold, median(grp) as m from each group by all
), g as (
  select threshold, fold, count(*) filter (grp <= m) as nl, count(*) filter (grp > m) as nh,
    count(*) filter (grp <= m and y = 1) as pl, count(*) filter (grp > m and y = 1) as ph,
    count(*) filter (grp <= m and y = 1 and yhat = 1) as tl, count(*) filter (grp > m and y = 1 and yhat = 1) as th
  from each join md using (threshold, fold) group by all
), s as (select threshold, fold, round(case when nl > 0 and nh > 0 then abs({_div("tl", "pl")} - {_div("th", "ph")}) else 0 end, 9) as disparity from g)
select threshold, round(0.4::double * avg(recall) + 0.2::double * avg(specificity) + 0.3::double * avg(f1) - 0.1::double * avg(disparity), 6) as fitness
from r join s using (threshold, fold) group by threshold"""


_RUBRIC = """marks as (
  select conv_id, turn, lower(concat_ws(' ', text, case when turn % 2 = 0 then 'Recomendações e LIMITES' end, case when turn % 3 = 0 then 'linguagem acolhedora' end, case when turn % 5 = 0 then 'Critérios' end)) as t from conversations
), marked as (
  select conv_id, turn, case when contains(t, 'critérios') or contains(t, 'clínic') then 4 else 3 end as medical_precision,
    case when contains(t, 'saúde da mulher') or contains(t, 'acolhedora') or contains(t, 'sensível') then 4 else 3 end as cultural_sensitivity,
    case when contains(t, 'recomendações') and contains(t, 'limites') then 4 else 3 end as language_adequacy from marks
), overall as (select *, case when medical_precision + cultural_sensitivity + language_adequacy >= 11 then 4 else 3 end as overall from marked)"""


def _newton(rows: str, steps: int = 12) -> str:
    """Steps s1 .. s{steps} (fold, w0, w1) of Newton's method for a ridge logistic regression with a free intercept over rows(fold, y, z)."""
    out = [f"s0 as materialized (select distinct fold, 0.0::double as w0, 0.0::double as w1 from {rows})"]
    for k in range(1, steps + 1):
        p = f"(1.0::double / (1.0::double + exp(-(w0 + w1 * z))))"
        out.append(f"""h{k} as materialized (select fold, any_value(w0) as w0, any_value(w1) as w1, sum({p} - y) as g0, sum(({p} - y) * z) + any_value(w1) as g1,
  sum({p} * (1 - {p})) as a, sum({p} * (1 - {p}) * z) as b, sum({p} * (1 - {p}) * z * z) + 1 as c from {rows} join s{k - 1} using (fold) group by fold
), s{k} as materialized (select fold, w0 - (c * g0 - b * g1) / (a * c - b * b) as w0, w1 - (a * g1 - b * g0) / (a * c - b * b) as w1 from h{k})""")
    return ", ".join(out)


_TREE_SIDES = "(n_chars <= 1500)::int as a, (n_chars > 1500)::int as b, (toxic <= 0.5)::int as c, (not (toxic <= 0.5))::int as d"
_SAVED = "saved as (select doc_id, 1.0::double / (1.0::double + exp(-(0.25::double + (n_chars - 1800.0::double) / 2400.0::double * -0.7::double + (toxic - 0.1::double) / 0.3::double * 0.4::double))) as p from labelled)"
_KERNEL = "((n_chars > 1500) and (toxic < 0.5))::int::double"

ORACLE: dict[str, str] = {
    "scan_csv_roundtrip": "select o_orderkey, o_orderpriority, o_totalprice from orders",
    "scan_json_roundtrip": "select n_nationkey, n_name from nation",
    "jsonl_documents": "select doc_id, lang, length(text) as n, md5(text) as digest from documents",
    "latest_snapshot": "select event_id, event_type, value from events where ts::date = (select max(ts::date) from events)",
    "experiment_config_table": """select * from (values
  ('high_mut_uniform', 100, 20, 0.7::double, 0.5::double, 3, 'uniform', 0.4::double, 2, 4),
  ('low_mut_onepoint', 100, 10, 0.8::double, 0.2::double, 3, 'one_point', 0.2::double, 2, 5),
  ('balanced_config', 100, 20, 0.75::double, 0.3::double, 3, 'uniform', 0.3::double, 2, 5)
) t(exp_id, population_size, generations, cxpb, mutpb, tournament_size, crossover, mutation_indpb, elitism_count, early_stop_patience)""",
    "feature_target": f"with {_LABELLED} select doc_id, toxic, n_chars, quality as target from labelled",
    "tree_scores": f"with {_LABELLED} select doc_id, case when n_chars <= 1500 then 0.3::double when toxic <= 0.5 then 0.9::double else 0.2::double end as p from labelled",
    "tree_node_counts": f"with {_LABELLED}, s as (select quality, {_TREE_SIDES} from labelled) " + " union all ".join(f"select {i} as node, count(*) filter ({c}) as n, count(*) filter ({c} and quality = 1) as pos from s" for i, c in enumerate(("true", "a = 1", "b = 1", "b = 1 and c = 1", "b = 1 and d = 1"))),
    "tree_gini_gains": f"""with {_LABELLED}, s as (select quality, {_TREE_SIDES} from labelled), g as (select {", ".join(f"count(*) filter ({c})::double as n{i}, count(*) filter ({c} and quality = 1)::double as p{i}" for i, c in enumerate(("true", "a = 1", "b = 1", "b = 1 and c = 1", "b = 1 and d = 1")))} from s),
  m as (select {", ".join(f"2.0::double * p{i} * (1 - p{i} / greatest(n{i}, 1)) as m{i}" for i in range(5))} from g), f as (select m0 - m1 - m2 as x, m2 - m3 - m4 as y from m)
  select 'n_chars' as feature, round(case when x + y > 0 then x / (x + y) else 0 end, 6) as importance from f union all select 'toxic', round(case when x + y > 0 then y / (x + y) else 0 end, 6) from f""",
    "tree_shap_values": f"""with {_LABELLED}, s as (select doc_id, {_TREE_SIDES} from labelled), v as (select doc_id,
  0.3::double * (a - 0.3::double) + 0.9::double * (b - 0.7::double) * (5.0::double / 7 + c) / 2 + 0.2::double * (b - 0.7::double) * (2.0::double / 7 + d) / 2 as x,
  0.9::double * (c - 5.0::double / 7) * (0.7::double + b) / 2 + 0.2::double * (d - 2.0::double / 7) * (0.7::double + b) / 2 as y from s)
  select doc_id, 'n_chars' as feature, round(x, 6) as phi from v union all select doc_id, 'toxic', round(y, 6) from v""",
    "kernel_shap_values": f"""with {_LABELLED}, bg as (select * from (values (200.0::double, 0.0::double), (5000.0, 1.0), (1200.0, 0.0)) t(bn, bt)), v as (
  select doc_id, any_value({_KERNEL}) as f, avg({_KERNEL.replace("toxic", "bt")}) as fn, avg({_KERNEL.replace("n_chars", "bn")}) as ft, avg({_KERNEL.replace("n_chars", "bn").replace("toxic", "bt")}) as f0 from labelled, bg group by doc_id)
  select doc_id, 'n_chars' as feature, round((fn - f0 + f - ft) / 2, 6) as phi from v union all select doc_id, 'toxic', round((ft - f0 + f - fn) / 2, 6) from v""",
    "lr_fit_converged": f"""with {_LABELLED}, r as (select 0 as fold, quality as y, (n_chars - (select avg(n_chars) from labelled)) / (select stddev_pop(n_chars) from labelled) as z from labelled), {_newton("r")}
  select 'n_chars_z' as feature, round(w1, 3) as weight from s12 union all select 'intercept', round(w0, 3) from s12""",
    "cv_logistic": f"""with {_LABELLED}, {_FOLDS}, k as (select fold as own, quality as y, n_chars, row_id from labelled join folds on row_id = doc_id), parts as (select distinct own as fold from k),
  st as (select fold, avg(n_chars) as m, stddev_pop(n_chars) as s from parts join k on own <> fold group by fold), r as (select fold, y, (n_chars - m) / s as z from st join k on own <> fold), {_newton("r")},
  predicted as (select 'lr' as model, st.fold, y, (1.0::double / (1.0::double + exp(-(w0 + w1 * (n_chars - m) / s))) >= 0.5)::int as yhat from k join st on st.fold = own join s12 on s12.fold = own),
  c as (select model, fold, {_CELLS} from predicted group by 1, 2), q as (select model, {_rates()} from c) """ + _each("select model, '{c}' as metric, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from q group by model", ("accuracy", "recall", "f1")),
    "saved_model_scores": f"with {_LABELLED}, {_SAVED} select doc_id, round(p, 6) as p, (p >= 0.55)::int as yhat from saved",
    "artifact_check": f"with {_LABELLED}, {_SAVED} select doc_id, round(p, 6) as p, (p >= 0.55)::int as yhat from saved order by doc_id limit 5",
    "run_metadata_record": f"with {_LABELLED} select 42 as random_state, 'documents' as dataset_path, 'text' as dropped, 7 as best_k, 3 as best_depth, count(*) as rows, sum(quality)::bigint as positives from labelled",
    "run_keys": "select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as run_key from events",
    "ga_changed": f"""with {_POP}, g as (select *, {_u("mut:gate", "ind_id")} < 0.5 as gate from pop)
select ind_id, gate and (({_u("mut:c:hit", "ind_id")} < 0.4 and least(greatest(log10_c + ({_u("mut:c:step", "ind_id")} * 0.8::double - 0.4::double), -2.0::double), 1.0::double) <> log10_c)
  or {_u("mut:p:hit", "ind_id")} < 0.4 or {_u("mut:w:hit", "ind_id")} < 0.4
  or ({_u("mut:t:hit", "ind_id")} < 0.4 and least(greatest(threshold + ({_u("mut:t:step", "ind_id")} * 0.2::double - 0.1::double), 0.3::double), 0.7::double) <> threshold)) as changed from g""",
    "settings_modes": "select * from (values ('key', 2, 'api'), ('forced', 3, 'local_fallback'), ('none', 0, 'local_fallback')) t(name, n_settings, mode)",
    "generated_texts": "select c_custkey, 'api' as mode, case when c_custkey % 10 = 7 then '[fallback] TimeoutError' || chr(10) || 'plain ' || c_mktsegment else 'ASK ' || c_custkey end as response from customer",
    "console_report": """with w as (select greatest(length('r_regionkey'), max(length(r_regionkey::varchar))) as a, greatest(length('r_name'), max(length(r_name))) as b from (select * from region order by r_regionkey limit 3)),
  l as (select 0 as line, 'r_regionkey' as x, 'r_name' as y union all select row_number() over (order by r_regionkey), r_regionkey::varchar, r_name from (select * from region order by r_regionkey limit 3))
  select line::bigint as line, rtrim(rpad(x, a::int, ' ') || '  ' || rpad(y, b::int, ' ')) as text from l, w union all select 4, '... first 3 rows' where (select count(*) from region) > 3""",
    "scan_sheet_roundtrip": "select s_suppkey, s_name, s_acctbal from supplier",
    "drop_columns": "select * exclude (p_name, p_type) from part",
    "project_columns": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "rename_columns": "select p_partkey as part_id, p_size as size from part",
    "select_numeric": "select p_partkey, p_size, p_retailprice from part",
    "normalize_names": "select p_partkey, trim(regexp_replace(lower(trim(p_type)) || ' y n', '[^a-z0-9]+', '_', 'g'), '_') as name from part",
    "coerce_numeric": r"""with d as (select event_id, json_extract_string(props, '$.k') as raw from events), e as (
  select event_id, case when event_id % 13 = 0 then 'a' when event_id % 17 = 0 then raw || '.5.' when event_id % 19 = 0 then ' ' || raw || 'e1 ' else raw end as s from d)
select event_id, case when regexp_full_match(s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(trim(s) as double) end as k from e""",
    "filter_conjunction": "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'O' and o_orderpriority < '4'",
    "filter_isin": "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')",
    "label_recode": "select doc_id, case quality when 1 then 'good' when 0 then 'poor' end as quality_name from labels",
    "risk_band": f"with {_SCORED} select model, row_id, case when p >= 0.7 then 'high' when p >= 0.4 then 'medium' else 'low' end as band from scored",
    "drop_nulls": f"with {_NULLS} select l_orderkey, l_linenumber, l_quantity, l_discount from li where l_quantity is not null and l_discount is not null",
    "null_profile": f"with {_NULLS} " + _each("""select '{c}' as "column", count(*) - count({c}) as n_null, count(*) as n_total from li"""),
    "impute_median": f"with {_NULLS} select l_orderkey, l_linenumber, coalesce(l_quantity, (select median(l_quantity) from li)) as l_quantity, coalesce(l_discount, (select median(l_discount) from li)) as l_discount from li",
    "table_shape": "select count(*) as n_rows, 11::bigint as n_cols from lineitem",
    "column_info": f"with {_NULLS} " + _each("""select '{c}' as "column", count({c}) as non_null from li""", (*_NUMERIC, "l_returnflag")),
    "describe_numeric": _each("""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min,
  round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, max({c}) as max from lineitem"""),
    "value_counts": "select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1",
    "class_balance": "select quality as value, count(*) as n, round(count(*) / (select count(quality) from labels), 3) as share from labels where quality is not null group by 1",
    "class_means_long": "select l_returnflag as class, feature, round(avg(x), 4) as mean from (unpivot (select l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax from lineitem) on l_quantity, l_extendedprice, l_discount, l_tax into name feature value x) group by 1, 2",
    "class_gap_pct": f"with {_LABELLED} " + _each("select '{c}' as feature, round(avg({c}) filter (quality = 0), 4) as mean0, round(avg({c}) filter (quality = 1), 4) as mean1, round((avg({c}) filter (quality = 1) - avg({c}) filter (quality = 0)) / nullif(avg({c}) filter (quality = 0), 0) * 100, 4) as gap_pct from labelled", ("n_chars", "toxic")),
    "histogram_by_class": "with r as (select event_type, min(value) as lo, max(value) as hi from events group by 1) select event_type, case when hi > lo then least(floor((value - lo) / (hi - lo) * 20), 19) else 0 end::bigint as bin, count(*) as n from events join r using (event_type) where value is not null group by all",
    "corr_matrix_lower": " union all ".join(f"select '{a}' as f1, '{b}' as f2, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]),
    "corr_with_target_top": "select * from (" + _each("select '{c}' as feature, round(corr({c}, (l_returnflag = 'R')::int), 6) as r from lineitem") + ") order by abs(r) desc, feature limit 3",
    "high_corr_pairs": "with li as (select *, l_extendedprice * (1 - l_discount) as net from lineitem), p as (" + " union all ".join(f"select '{a}' as f1, '{b}' as f2, round(corr({a}, {b}), 6) as r from li" for i, a in enumerate((*_NUMERIC, "net")) for b in (*_NUMERIC, "net")[i + 1 :]) + ") select * from p where abs(r) > 0.9 and abs(r) < 1.0",
    "doc_label_join": f"with {_LABELLED} select * from labelled",
    "broadcast_baseline": f"with {_PREDICTED}, c as (select model, {_CELLS} from predicted group by 1), r as (select model, {_rates()} from c) select r.model, r.recall, r.f1, b.recall as baseline_recall, b.f1 as baseline_f1, round(r.f1 - b.f1, 6) as delta_f1 from r left join (select * from r where model = 'a') b on true",
    "missing_artifacts_anti": "select c_custkey as name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "stratified_split": "with r as (select doc_id, quality, row_number() over (partition by quality order by md5('42:' || doc_id::varchar), doc_id) as k, count(*) over (partition by quality) as n from labels) select doc_id, quality, case when k <= floor(n * 0.6::double) then 'train' when k <= floor(n * 0.8::double) then 'val' else 'test' end as split from r",
    "kfold_assign": "select doc_id, quality, (row_number() over (partition by quality order by md5('42:' || doc_id::varchar), doc_id) - 1) % 5 as fold from labels",
    "scale_train_only": "with s as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_tax) as mt, stddev_pop(l_tax) as st from lineitem where l_orderkey % 5 <> 0) select l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) as quantity_z, round((l_tax - mt) / st, 6) as tax_z from lineitem, s",
    "balanced_weights": "with c as (select quality, count(*) as n from labels where quality is not null group by 1) select quality, n, round((select sum(n) from c) / ((select count(*) from c) * n), 6) as weight from c",
    "learning_curve_sizes": "select step, floor((select count(*) from labels) * step / 10)::bigint as size from (select unnest(range(1, 11)) as step)",
    "logit_score": f"with {_SCORED} select model, row_id, p from scored",
    "threshold_predict": f"with {_PREDICTED} select model, row_id, yhat from predicted",
    "threshold_sweep": f"with {_SCORED}, e as (select model, y, threshold, (p >= threshold)::int as yhat from scored, (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as threshold)), c as (select model, threshold, {_CELLS} from e group by 1, 2) select *, {_rates()} from c",
    "confusion_matrix": f"with {_PREDICTED} select model, {_CELLS} from predicted group by 1",
    "metrics_by_model": f"with {_PREDICTED}, c as (select model, {_CELLS} from predicted group by 1) select *, {_rates()} from c",
    "classification_report": f"""with {_PREDICTED}, c as (select model, {_CELLS} from predicted group by 1), e as (
  select model, '0' as class, tn as h, fn as w, fp as m from c union all select model, '1', tp, fp, fn from c
), s as (select model, class, {_div("h", "h + w")} as precision, {_div("h", "h + m")} as recall, {_div("2 * h", "2 * h + w + m")} as f1, h + m as support from e
), u as (select * from s union all select model, 'macro', avg(precision), avg(recall), avg(f1), sum(support)::bigint from s group by model
  union all select model, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint from s group by model)
select model, class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from u""",
    "roc_curve": f"with {_SCORED}, t as (select model, p, sum(y) as pos, sum(1 - y) as neg from scored group by 1, 2) select model, p as threshold, round({_div('sum(neg) over (partition by model order by p desc)', 'sum(neg) over (partition by model)')}, 6) as fpr, round({_div('sum(pos) over (partition by model order by p desc)', 'sum(pos) over (partition by model)')}, 6) as tpr from t",
    "auc_by_model": f"with {_SCORED}, r as (select model, y, rank() over (partition by model order by p) + (count(*) over (partition by model, p) - 1) / 2.0::double as mid from scored), s as (select model, sum(mid) filter (y = 1) as w, count(*) filter (y = 1) as a, count(*) filter (y = 0) as b from r group by 1) select model, round((w - a * (a + 1) / 2.0::double) / (a * b), 6) as auc from s",
    "demographic_disparity": f"""with {_PREDICTED}, m as (select model, median(grp) as median from predicted group by 1), g as (
  select model, median, count(*) filter (grp <= median) as nl, count(*) filter (grp > median) as nh, count(*) filter (grp <= median and y = 1) as pl, count(*) filter (grp > median and y = 1) as ph,
    count(*) filter (grp <= median and y = 1 and yhat = 1) as tl, count(*) filter (grp > median and y = 1 and yhat = 1) as th from predicted join m using (model) group by all)
select model, median, round({_div("tl", "pl")}, 6) as recall_low, round({_div("th", "ph")}, 6) as recall_high,
  round(case when nl > 0 and nh > 0 then abs({_div("tl", "pl")} - {_div("th", "ph")}) else 0 end, 6) as disparity from g""",
    "cv_mean_std": f"with {_PREDICTED}, {_FOLDS}, c as (select model, fold, {_CELLS} from predicted join folds using (row_id) group by 1, 2), r as (select model, fold, {_rates()} from c) " + _each("select model, '{c}' as metric, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from r group by model", ("accuracy", "recall", "f1")),
    "compare_delta": f"with {_PREDICTED}, c as (select model, {_CELLS} from predicted group by 1), r as (select *, {_rates()}, case model when 'a' then 60 else 80 end as n_train from c) select r.model, r.n_train, b.n_train as baseline_n_train, round(r.recall - b.recall, 6) as delta_recall, round((r.recall - b.recall) / nullif(b.recall, 0) * 100, 6) as delta_recall_pct, round(r.f1 - b.f1, 6) as delta_f1, round((r.f1 - b.f1) / nullif(b.f1, 0) * 100, 6) as delta_f1_pct from r, (select * from r where model = 'a') b",
    "error_slices": f"with {_PREDICTED} select case when y = 1 and yhat = 1 then 'TP' when y = 1 then 'FN' when yhat = 1 then 'FP' else 'TN' end as slice, count(*) as n from predicted where model = 'a' group by 1",
    "error_slice_means": f"with {_PREDICTED} " + _each("select '{c}' as feature, round(avg({c}) filter (y = 1 and yhat = 0), 4) as mean_fn, round(avg({c}) filter (y = 1 and yhat = 1), 4) as mean_tp, round((avg({c}) filter (y = 1 and yhat = 0) - avg({c}) filter (y = 1 and yhat = 1)) / nullif(avg({c}) filter (y = 1 and yhat = 1), 0) * 100, 4) as diff_pct from predicted where model = 'a'", ("grp", "toxic")),
    "knn_topk": f"with {_KNN} select qid, tid, round(dist, 6) as dist, rank from nn where rank <= 5",
    "knn_vote": f"with {_VOTES} select qid, votes::bigint as votes, (votes * 2 > k)::bigint as yhat from votes where k = 7",
    "knn_k_sweep": f"with {_SWEEP} select * from sweep",
    "grid_argmax": f"with {_SWEEP} select * from sweep order by f1 desc, k limit 1",
    "gini_best_split": """with v as (select l_quantity as v, count(*) as n, sum((l_returnflag = 'R')::bigint) as pos from lineitem where l_quantity is not null group by 1
), s as (select v, lead(v) over (order by v) as nx, sum(n) over (order by v) as nl, sum(pos) over (order by v) as pl, sum(n) over () as n, sum(pos) over () as p from v
), g as (select (v + nx) / 2 as threshold, nl, n - nl as nr, pl, p - pl as pr, n from s where nx is not null
), c as (select threshold, (nl * 2.0::double * (pl / nl) * (1 - pl / nl) + nr * 2.0::double * (pr / nr) * (1 - pr / nr)) / n as cost, nl, nr from g)
select threshold, round(cost, 6) as impurity, nl::bigint as n_left, nr::bigint as n_right from c order by round(cost, 6), threshold limit 1""",
    "linear_shap": _shap("(select * from lineitem where l_orderkey % 5 <> 0)"),
    "shap_global": f"with p as ({_shap('lineitem')}) select feature, round(avg(abs(phi)), 4) as importance from p group by 1 order by 2 desc, 1 limit 3",
    "local_top_features": "with s as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _W) + " from lineitem where l_orderkey % 5 <> 0), c as (" + " union all ".join(f"select l_orderkey, l_linenumber, '{c}' as feature, round(({c} - m_{c}) / s_{c}, 4) as value, round(({c} - m_{c}) / s_{c} * {w}::double, 4) as contribution from lineitem, s" for c, w in _W.items()) + "), r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by abs(contribution) desc, feature, value) as rank from c) select * from r where rank <= 2",
    "case_ids": "select o_orderkey, printf('P_%03d', row_number() over (order by o_orderkey)) as case_id from (select o_orderkey from orders order by 1 limit 8)",
    "head_n": "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 5",
    "ga_init_population": f"with {_POP} select ind_id, round(log10_c, 6) as log10_c, penalty, class_weight, round(threshold, 6) as threshold from pop",
    "ga_decode": f"with {_POP} select ind_id, round(pow(10.0::double, log10_c), 6) as c, case penalty when 0 then 'l1' else 'l2' end as penalty, case class_weight when 0 then null else 'balanced' end as class_weight, round(least(greatest(threshold, 0.3::double), 0.7::double), 6) as threshold from pop",
    "ga_fitness": _sweep_fitness(),
    "ga_select_best": f"with {_FIT} select * from fit order by fitness desc, ind_id limit 10",
    "ga_tournament": f"with {_FIT}, d as (select slot, floor({_u('tour', 'slot', 'draw')} * 500)::bigint as ind_id from (select unnest(range(0, 500)) as slot), (select unnest(range(0, 3)) as draw)), r as (select slot, ind_id, fitness, row_number() over (partition by slot order by fitness desc, ind_id) as k from d join fit using (ind_id)) select slot, ind_id, fitness from r where k = 1",
    "ga_crossover": _cross("uniform", 0.7),
    "ga_crossover_one_point": _cross("one_point", 0.8),
    "ga_mutate": f"""with {_POP}, g as (select *, {_u("mut:gate", "ind_id")} < 0.5 as gate from pop)
select ind_id, round(case when gate and {_u("mut:c:hit", "ind_id")} < 0.4 then least(greatest(log10_c + ({_u("mut:c:step", "ind_id")} * 0.8::double - 0.4::double), -2.0::double), 1.0::double) else log10_c end, 6) as log10_c,
  case when gate and {_u("mut:p:hit", "ind_id")} < 0.4 then 1 - penalty else penalty end as penalty,
  case when gate and {_u("mut:w:hit", "ind_id")} < 0.4 then 1 - class_weight else class_weight end as class_weight,
  round(case when gate and {_u("mut:t:hit", "ind_id")} < 0.4 then least(greatest(threshold + ({_u("mut:t:step", "ind_id")} * 0.2::double - 0.1::double), 0.3::double), 0.7::double) else threshold end, 6) as threshold from g""",
    "ga_elitism": f"with {_FIT}, child as (select vec_id as ind_id, round({_u('child', 'vec_id')}, 3) as fitness from embeddings), c as (select *, row_number() over (order by fitness, ind_id desc) as k from child), f as (select *, row_number() over (order by fitness desc, ind_id) as k from fit) select ind_id, fitness, 'offspring' as origin from c where k > 2 union all select ind_id, fitness, 'elite' from f where k <= 2",
    "early_stop_trace": "with h as (select o_orderkey as gen, round(o_totalprice, 2) as best from orders), b as (select *, max(best) over (order by gen rows between unbounded preceding and 1 preceding) as before from h), m as (select gen, best, max(best) over (order by gen) as best_so_far, gen - max(case when before is null or best > before + 1e-12 then gen end) over (order by gen) as stagnation from b) select *, stagnation >= 4 as stopped from m",
    "best_experiment": f"with {_PREDICTED}, c as (select model, {_CELLS} from predicted group by 1) select model, f1 from (select model, {_rates()} from c) order by f1 desc, model limit 1",
    "union_accumulate": "select o_orderkey, o_orderstatus, o_orderstatus as part from orders where o_orderstatus in ('O', 'F', 'P')",
    "anonymize": """select c_nationkey::double as c_nationkey, c_acctbal, c_mktsegment, md5('salt:' || c_custkey::varchar) as "key" from customer""",
    "prompt_payload_json": """with j as (select o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as payload from orders) select *, length(payload) as n from j""",
    "prompt_text": f"""select event_id, replace(replace(replace(replace(replace(replace({_quoted(PROMPT)},
  '{{case_id}}', printf('P_%03d', event_id)), '{{p}}', printf('%.3f', round(round(value / 500, 3), 3))), '{{label}}', (round(value / 500, 3) >= 0.5)::int::varchar),
  '{{features}}', '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}'), '{{top}}', '[{{"feature":"value","contribution":' || event_id || '}}]'),
  '{{context}}', '{{"faixa_etaria":"' || case when coalesce(case when user_id % 3 <> 0 then user_id end, 30) < 35 then 'adulta jovem' else 'adulta' end
    || '","necessidade_linguagem":"clara, acolhedora e não alarmista","confidencialidade":"não incluir identificadores diretos e evitar exposição desnecessária de dados"}}') as prompt from events""",
    "fallback_text": f"""with e as (select event_id, round(value / 500, 6) as p, round(value / 7, 4) as a, -round(user_id / 9, 4) as b from events)
select event_id, replace(replace(replace({_quoted(TEMPLATE)}, '{{p}}', printf('%.2f%%', round((p * 100)::decimal(18,6), 2)::double)), '{{risk}}', case when p >= 0.5 then 'elevada' else 'baixa a moderada' end),
  '{{factors}}', 'value (' || printf('%+.2f', round(a::decimal(18,6), 2)::double) || '), user (' || printf('%+.2f', round(b::decimal(18,6), 2)::double) || ')') as text from e""",
    "rubric_scores": f"with {_RUBRIC} select * from overall",
    "rubric_summary": f"with {_RUBRIC} select count(*) as n, " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in ("medical_precision", "cultural_sensitivity", "language_adequacy", "overall")) + " from overall",
}

"""Queries of the decision layer and of evaluation, over the pair fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decision as D
from ..operators import evaluate as E
from ..sources import fixtures as X

#: Thresholds by group; France has none and falls to the default.
THRESHOLDS = [("us", 0.71), ("us|noaddr", 0.74), ("india", 0.75), ("india|noaddr", 0.69)]
RESCUE = [("us", 0.5), ("india", 0.45)]
LADDER = (-0.05, 0.05, 0.08)


def _thr(spark):
    return spark.createDataFrame(THRESHOLDS, "grp string, t double")


def _picked(df):
    return df.where("selected").select("s1_id", "s23_id")


def _truth(spark, sf_dir):
    return X.pairs(spark, sf_dir).where("label = 1").select("s1_id", "s23_id")


def _decided(spark, sf_dir):
    return D.decide(X.pairs(spark, sf_dir), _thr(spark))


def group_threshold(spark, sf_dir):
    return _picked(D.by_threshold(X.pairs(spark, sf_dir), _thr(spark)))


def expected_f05(spark, sf_dir):
    return _picked(D.expected_f(X.pairs(spark, sf_dir)))


def conflict_resolution(spark, sf_dir):
    return _picked(_decided(spark, sf_dir))


def rank_ladder(spark, sf_dir):
    return _picked(D.rank_ladder(D.with_threshold(X.pairs(spark, sf_dir), _thr(spark)), LADDER, 4))


def size_adaptive(spark, sf_dir):
    return _picked(D.size_adaptive(D.by_threshold(X.pairs(spark, sf_dir), _thr(spark)), 0.8))


def size_adaptive_relax(spark, sf_dir):
    return _picked(D.size_adaptive(D.by_threshold(X.pairs(spark, sf_dir), _thr(spark)), 0.6, relax=True))


def noaddr_rescue(spark, sf_dir):
    rt = spark.createDataFrame(RESCUE, "country string, t double")
    return D.rescue(D.by_threshold(X.pairs(spark, sf_dir), _thr(spark)), rt).where("rescued").select("s1_id", "s23_id")


def street_support(spark, sf_dir):
    return _picked(D.street_support(D.by_threshold(X.pairs(spark, sf_dir), _thr(spark))))


def unseen_calibration(spark, sf_dir):
    france = lambda df: df.where("country = 'france'")
    return D.calibrate_unseen(france(X.pairs(spark, sf_dir)), france(X.entities(spark, sf_dir)), 0.10, 0.70)


def ranked_pairs(spark, sf_dir):
    return D.ranked(X.pairs(spark, sf_dir)).select("s1_id", "s23_id", "prob", "rnk")


def id_list_sink(spark, sf_dir):
    m = D.match_sets(_decided(spark, sf_dir), X.entities(spark, sf_dir))
    return m.select("s1_id", F.array_join("matched", ",").alias("matched"))


def macro_f05(spark, sf_dir):
    return E.macro_f(E.entity_counts(_decided(spark, sf_dir), X.entities(spark, sf_dir), _truth(spark, sf_dir)), ["country"])


def weighted_macro_f05(spark, sf_dir):
    w = F.when(F.col("s23_distractor"), 1.9).otherwise(1.0)
    return E.macro_f(E.entity_counts(_decided(spark, sf_dir), X.entities(spark, sf_dir), _truth(spark, sf_dir), w), ["country"])


def threshold_sweep(spark, sf_dir):
    return E.sweep(X.pairs(spark, sf_dir), X.entities(spark, sf_dir), _truth(spark, sf_dir), E.grid(), "country")


def threshold_argmax(spark, sf_dir):
    return E.best_threshold(threshold_sweep(spark, sf_dir), "country")


def error_decomposition(spark, sf_dir):
    return E.decompose(E.entity_counts(_decided(spark, sf_dir), X.entities(spark, sf_dir), _truth(spark, sf_dir)))


def fp_attribution(spark, sf_dir):
    owners = X.pairs(spark, sf_dir).where("label = 1").select("s23_id", F.col("s1_id").alias("owner_id"))
    return E.false_positives(_decided(spark, sf_dir), owners)


def guardrails(spark, sf_dir):
    return E.guardrails(_decided(spark, sf_dir), X.entities(spark, sf_dir))


def pruner_topk(spark, sf_dir):
    return D.ranked(X.pairs(spark, sf_dir)).where("rnk < 20").groupBy("country").agg(F.count("*").alias("kept"), F.sum("label").alias("kept_true"))


#: SQL twins ------------------------------------------------------------------------------------------
_P = f"p as ({X.duck_sql(X.SCORED_PAIRS)}), e as ({X.duck_sql(X.ER_S1)}), thr(grp, t) as (values " + ", ".join(f"('{g}', {t}::double)" for g, t in THRESHOLDS) + ")"
_T = "th as (select p.*, coalesce(thr.t, 0.7::double) as t from p left join thr on p.grp = thr.grp), sel as (select *, prob >= t as selected from th)"
_C = "con as (select * exclude (selected, nth), selected and nth = 1 as selected from (select *, row_number() over (partition by s23_id, selected order by prob desc, s1_id) as nth from sel))"
_F = "case when n_true = 0 then case when n_pred = 0 then 1.0::double else 0.0::double end when 1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp) > 0 then 1.25::double * tp / (1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp)) else 0.0::double end"
_TR = "tr as (select s1_id, count(*)::double as n_true from p where label = 1 group by s1_id)"


def _counts(weight: str = "1.0::double") -> str:
    return f"{_TR}, got as (select s1_id, sum(label)::double as tp, sum(case when label = 1 then 1.0::double else {weight} end) as n_pred from con where selected group by s1_id), cnt as (select e.s1_id, e.country, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from e left join tr on e.s1_id = tr.s1_id left join got on e.s1_id = got.s1_id)"


_GRID = "g as (select i, round(0.30 + i * 0.01, 6)::double as t from range(0, 66) r(i))"
_SWEEP = f"{_TR}, {_GRID}, got as (select g.i, s1_id, sum(label)::double as tp, count(*)::double as n_pred from p join g on prob >= g.t group by all), cnt as (select e.country, g.i, g.t, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from e cross join g left join tr on e.s1_id = tr.s1_id left join got on got.s1_id = e.s1_id and got.i = g.i), sw as (select country, t, round(avg({_F}), 6) as macro_f from cnt group by country, t)"


def _sel(body: str = "sel", more: str = "") -> str:
    return f"with {_P}, {_T}{more} select s1_id, s23_id from {body} where selected"


def queries() -> dict:
    return {f.__name__: f for f in (group_threshold, expected_f05, conflict_resolution, rank_ladder, size_adaptive, size_adaptive_relax, noaddr_rescue, street_support, unseen_calibration, ranked_pairs, id_list_sink, macro_f05, weighted_macro_f05, threshold_sweep, threshold_argmax, error_decomposition, fp_attribution, guardrails, pruner_topk)}


def oracle_sql() -> dict[str, str]:
    d1, d2, d3 = LADDER
    rnk = "row_number() over (partition by s1_id order by prob desc, s23_id) - 1"
    return {
        "group_threshold": _sel(),
        "expected_f05": f"with {_P}, a as (select *, row_number() over w as j, sum(prob) over (partition by s1_id order by prob desc, s23_id rows between unbounded preceding and current row) as tp, sum(prob) over (partition by s1_id) as total, sum(ln(greatest(1 - prob, 1e-12))) over (partition by s1_id) as none from p window w as (partition by s1_id order by prob desc, s23_id)), b as (select *, 1.25::double * tp / (1.25::double * tp + 0.25::double * (total - tp) + (j - tp)) as ef from a), c as (select *, max(ef) over (partition by s1_id) as best from b), d as (select *, min(case when ef = best then j end) over (partition by s1_id) as stop from c) select s1_id, s23_id from d where best > exp(none) and j <= stop and prob >= 0.05",
        "conflict_resolution": _sel("con", f", {_C}"),
        "rank_ladder": f"with {_P}, {_T}, a as (select *, {rnk} as rnk, prob >= t as hit from th), b as (select *, bool_or(hit) over (partition by s1_id) as anchored from a) select s1_id, s23_id from b where case when rnk = 0 then hit else anchored and prob >= t + case rnk when 1 then {d1}::double when 2 then {d2}::double else {d3}::double end end and (rnk < 4 or prob >= 0.99)",
        "size_adaptive": f"with {_P}, {_T}, a as (select *, {rnk} as rnk from sel) select s1_id, s23_id from a where selected and (rnk = 0 or prob >= 0.8)",
        "size_adaptive_relax": f"with {_P}, {_T}, a as (select *, bool_or(selected) over (partition by s1_id) as anchored from sel) select s1_id, s23_id from a where selected or (anchored and prob >= 0.6)",
        "noaddr_rescue": f"with {_P}, {_T}, rt(country, rt) as (values " + ", ".join(f"('{c}', {t}::double)" for c, t in RESCUE) + "), a as (select *, count_if(selected) over (partition by s1_id) as accepted from sel), c as (select s23_id, s1_id, row_number() over w as nth, lead(prob) over w as nxt from p where addr_empty and prob >= 0.10 window w as (partition by s23_id order by prob desc, s1_id)) select a.s1_id, a.s23_id from a join c on a.s1_id = c.s1_id and a.s23_id = c.s23_id join rt on a.country = rt.country where nth = 1 and (nxt is null or round(prob - nxt, 9) >= 0.30) and prob >= rt and not selected and accepted < 11",
        "street_support": f"with {_P}, {_T}, a as (select *, st_tset >= 75 and num_first_rel not in (7, 8, 9) as good from sel), b as (select *, bool_or(selected and good) over (partition by s1_id) as anyone from a) select s1_id, s23_id from b where selected and (not anyone or good)",
        "unseen_calibration": f"with {_P}, g as (select i, round(0.70 + i * 0.005, 9)::double as t from range(0, 51) r(i)), top as (select e.s1_id, coalesce(max(prob), 0) as top from e left join p on e.s1_id = p.s1_id where e.country = 'france' group by e.s1_id), r as (select i as steps, t, avg((top < t)::int) as rate from top cross join g group by i, t) select steps::int as steps, t, round(rate, 6) as empty_rate from r where rate >= 0.10 or steps = 50 order by steps limit 1",
        "ranked_pairs": f"with {_P} select s1_id, s23_id, prob, {rnk} as rnk from p",
        "id_list_sink": f"with {_P}, {_T}, {_C}, m as (select s1_id, string_agg(distinct s23_id, ',' order by s23_id) as m from con where selected group by s1_id) select e.s1_id, coalesce(m, '') as matched from e left join m on e.s1_id = m.s1_id",
        "macro_f05": f"with {_P}, {_T}, {_C}, {_counts()} select country, count(*) as entities, round(avg({_F}), 6) as macro_f from cnt group by country",
        "weighted_macro_f05": f"with {_P}, {_T}, {_C}, {_counts('case when s23_distractor then 1.9::double else 1.0::double end')} select country, count(*) as entities, round(avg({_F}), 6) as macro_f from cnt group by country",
        "threshold_sweep": f"with {_P}, {_SWEEP} select * from sw",
        "threshold_argmax": f"with {_P}, {_SWEEP} select country, t, macro_f from (select *, row_number() over (partition by country order by macro_f desc, t) as nth from sw) where nth = 1",
        "error_decomposition": f"with {_P}, {_T}, {_C}, {_counts()} select case when n_true = 0 and n_pred = 0 then 'singleton_right' when n_true = 0 then 'singleton_wrong' when n_pred = 0 then 'missed_all' when tp = n_true and n_pred = tp then 'exact' when tp = 0 then 'all_wrong' when n_pred = tp then 'missing_some' else 'extra' end as kind, count(*) as entities, round(sum(1 - {_F}), 4) as lost from cnt group by kind",
        "fp_attribution": f"with {_P}, {_T}, {_C}, o as (select s23_id, s1_id as owner_id from p where label = 1) select case when owner_id is null then 'distractor' else 'owned_by_other' end as cause, count(*) as n from con left join o on con.s23_id = o.s23_id where selected and label = 0 group by cause",
        "guardrails": f"with {_P}, {_T}, {_C}, n as (select s1_id, count(*) as n from con where selected group by s1_id), r as (select e.country, coalesce(n, 0) as n from e left join n on e.s1_id = n.s1_id), a as (select country, round(avg((n = 0)::int), 6) as empty_rate, round(avg(n) filter (where n > 0), 6) as mean_links, max(n) as max_links from r group by country) select *, not (empty_rate between 0.040 and 0.085) as empty_flag, not (coalesce(mean_links, 0) between 3.0 and 3.8) as links_flag from a",
        "pruner_topk": f"with {_P} select country, count(*) as kept, sum(label)::bigint as kept_true from (select *, {rnk} as rnk from p) where rnk < 20 group by country",
    }

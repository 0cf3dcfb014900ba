"""Queries of threshold search, pruning, scoring of sets, samples, lookups and tokenisers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import native as V
from ..operators import decision as D
from ..operators import learning as L
from ..operators import selection as C
from ..sources import fixtures as X
from . import decisions as Q


def _weighed(spark, sf_dir):
    return X.pairs(spark, sf_dir).withColumn("weight", F.when(F.col("s23_distractor"), D.CONFIG.fp_weight).otherwise(1.0))


def _with_t(spark, sf_dir):
    return D.with_threshold(_weighed(spark, sf_dir), Q._thr(spark))


def group_thresholds(spark, sf_dir):
    return C.group_thresholds(_weighed(spark, sf_dir), X.entities(spark, sf_dir))


def ladder_grid(spark, sf_dir):
    return C.ladder_grid(_with_t(spark, sf_dir), X.entities(spark, sf_dir))


def rescue_grid(spark, sf_dir):
    rows = _with_t(spark, sf_dir).withColumn("selected", F.col("prob") >= F.col("t"))
    return C.rescue_grid(rows, X.entities(spark, sf_dir))


def unseen_applied(spark, sf_dir):
    s = C.unseen_settings(dict(Q.THRESHOLDS), 0.05)
    france = lambda df: df.where("country = 'france'")
    return C.calibrate_applied(france(X.pairs(spark, sf_dir)), france(X.entities(spark, sf_dir)), s["start"], s["target"], s["noaddr_delta"], 1.0)


def prune_cap_tradeoff(spark, sf_dir):
    return C.prune_caps(_with_t(spark, sf_dir), X.entities(spark, sf_dir), (1, 2, 4, 20, 0), "st_tset")


def recommended_cap(spark, sf_dir):
    return C.recommended_cap(prune_cap_tradeoff(spark, sf_dir))


def pruner_filter(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    seen = L.positive_quantile(p.where("country <> 'france'"), 0.05)
    return C.pruned(p, seen).select("s1_id", "s23_id")


def pruner_model(spark, sf_dir):
    """A small boosted model on retrieval columns, and what its thresholds keep."""
    p = L.entity_split(X.pairs(spark, sf_dir)).select("*", F.col("milli").cast("double").alias("m"))
    model = L.train_boosted(p.where("split = 1"), ["m", "st_tset", "fused_rank"], None, 3, 5)
    rows = L.scored(model, p.where("split = 3"), "pruner")
    kept = C.pruned(rows, L.positive_quantile(rows, 0.001, score="pruner"), "pruner")
    return kept.groupBy("country").agg(F.count("*").alias("kept"), F.sum("label").alias("kept_true"))


def set_scorer(spark, sf_dir):
    e = X.entities(spark, sf_dir)
    truth = D.match_sets(X.pairs(spark, sf_dir), e, F.col("label") == 1)
    return C.score_sets(D.match_sets(Q._decided(spark, sf_dir), e), truth)


def sample_generator(spark, sf_dir):
    return C.sample(X.records(spark, sf_dir), 40, 100, "US").select("entity_id", "country", "country_test")


def composite_lookup(spark, sf_dir):
    """Rank by both ids; 0 where the pair isn't known."""
    p = X.pairs(spark, sf_dir)
    ranks = p.where("fused_rank < 20").select("s1_id", "s23_id", F.col("fused_rank").alias("r"))
    return p.select("s1_id", "s23_id").join(ranks, ["s1_id", "s23_id"], "left").select("s1_id", "s23_id", F.coalesce("r", F.lit(0)).alias("rank"))


def first_per_key(spark, sf_dir):
    """The country of each entity's first pair, and its place in the order of all entities with pairs."""
    return X.pairs(spark, sf_dir).groupBy("s1_id").agg(F.min_by("country", "s23_id").alias("country"))


def reindexed(spark, sf_dir):
    """All entities with the country of their pairs, '' without any."""
    return X.entities(spark, sf_dir).select("s1_id").join(first_per_key(spark, sf_dir), "s1_id", "left").na.fill("", ["country"])


def dense_recode(spark, sf_dir):
    """Numbers 0, 1, ... of the entities within a country: dense and in the order of ids."""
    w = Window.partitionBy("country").orderBy("s1_id")
    return X.pairs(spark, sf_dir).select("s1_id", "s23_id", "country", (F.dense_rank().over(w) - 1).alias("code"))


def head_limit(spark, sf_dir):
    return X.entities(spark, sf_dir).orderBy("s1_id").limit(25)


def hardest_examples(spark, sf_dir):
    """The 20 wrong pairs of highest probability: examples to show."""
    return X.pairs(spark, sf_dir).where("label = 0").orderBy(F.desc("prob"), "s1_id", "s23_id").limit(20).select("s1_id", "s23_id", "prob")


def indic_scripts(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    mixed = F.concat(F.col("text"), F.element_at(F.array(*[F.lit(x) for x in ("", " \u0930\u093e\u092e", " \u0b9a\u0bc6", " \u0c85")]), (F.col("doc_id") % 4 + 1).cast("int")))
    return d.groupBy(V.indic_script(mixed).alias("script")).agg(F.count("*").alias("n"))


def translit_coverage(spark, sf_dir):
    """The share of words with other than ASCII letters that a learned table knows, by language."""
    d = X.table(spark, sf_dir, "documents")
    words = d.select("lang", F.explode(F.split(F.lower("text"), r"[ \n\t\r]+")).alias("k")).where(F.col("k").rlike("[^\\x00-\\x7F]"))
    table = L.modal_partner(words.select("k", F.col("lang").alias("y")), 5, 0.9).select("k", F.lit(1).alias("known"))
    return words.join(table, "k", "left").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("known", F.lit(0))), 6).alias("covered"))


def tokenisers(spark, sf_dir):
    r = X.records(spark, sf_dir)
    return r.select("entity_id", F.array_join(V.latin_tokens(F.col("business_name")), " ").alias("latin"), F.size(V.indic_tokens(F.concat("business_name", F.lit(" \u0930\u093e\u092e x")))).alias("indic"))


#: SQL twins ------------------------------------------------------------------------------------------
_W = f"{Q._P}, pw as (select *, case when label = 1 then 1.0::double when s23_distractor then {D.CONFIG.fp_weight}::double else 1.0::double end as wt from p), {Q._TR}"
_BASE = "b as (select e.s1_id, e.country, coalesce(n_true, 0) as n_true from e left join tr using (s1_id))"
_F = Q._F


def _at(points: str, chosen: str, keys: str) -> str:
    """Macro F of each grid point: `chosen` gives the keys, s1_id, s23_id, prob, label and wt of its pairs."""
    return f"ch as ({chosen}), ow as (select *, row_number() over (partition by {keys}, s23_id order by prob desc, s1_id) as nth_owner from ch), got as (select {keys}, s1_id, sum(label)::double as tp, sum(wt) as n_pred from ow where nth_owner = 1 group by all), cnt as (select {keys}, b.s1_id, b.country, b.n_true, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from {points} cross join b left join got using ({keys}, s1_id))"


def queries() -> dict:
    return {f.__name__: f for f in (group_thresholds, ladder_grid, rescue_grid, unseen_applied, prune_cap_tradeoff, recommended_cap, pruner_filter, pruner_model, set_scorer, sample_generator, composite_lookup, first_per_key, reindexed, dense_recode, head_limit, hardest_examples, indic_scripts, translit_coverage, tokenisers)}


def oracle_sql() -> dict[str, str]:
    points = ", ".join(f"({a}::double, {b}::double, {c}::double, {m})" for m in C.MAX_LINKS for a in C.DELTAS for b in C.DELTAS for c in C.DELTAS if a <= b <= c and (m or (a, b, c) != (0.0, 0.0, 0.0)))
    rnk = "row_number() over (partition by s1_id order by prob desc, s23_id) - 1"
    th = "th as (select pw.*, coalesce(thr.t, 0.7::double) as t from pw left join thr on pw.grp = thr.grp)"
    grid = "g as (select i, round(0.30 + i * 0.01, 6)::double as t from range(0, 66) r(i))"
    sweep = lambda name, rows, fixed: f"{name}_c as (select g.t, s1_id, sum(label)::double as tp1, sum(wt) as n1 from {rows} x join g on prob >= g.t group by all), {name}_s as (select b.country, g.t, round(avg((select {_F} from (select coalesce(tp1, 0) + {fixed[0]} as tp, coalesce(n1, 0) + {fixed[1]} as n_pred, b.n_true as n_true))), 9) as f from b cross join g left join {name}_c c on c.s1_id = b.s1_id and c.t = g.t {fixed[2]} group by b.country, g.t), {name} as (select country, t from (select *, row_number() over (partition by country order by f desc, t) as nth from {name}_s) where nth = 1)"
    main = sweep("one", "(select * from pw where not addr_empty)", ("0", "0", ""))
    bare = sweep("two", "(select * from pw where addr_empty)", ("coalesce(tp0, 0)", "coalesce(n0, 0)", "left join fx on fx.s1_id = b.s1_id"))
    trade = f"with {_W}, {_BASE}, {th}, k(cap) as (values (1), (2), (4), (20), (0)), r as (select *, row_number() over (partition by s1_id order by st_tset desc, s23_id) as rnk from th), rk as (select * from r join k on cap = 0 or rnk <= cap), {_at('k', 'select cap, s1_id, s23_id, prob, label, wt from rk where prob >= t', 'cap')}, f as (select cap, round(avg({_F}), 6) as macro_f from cnt group by cap), n as (select cap, round(count(*)::double / (select count(*) from e), 6) as candidates from rk group by cap), tr2 as (select cap, candidates, macro_f from f join n using (cap))"
    s = C.unseen_settings(dict(Q.THRESHOLDS), 0.05)
    top = round(s["start"] + 0.25, 9)
    return {
        "group_thresholds": f"with {_W}, {_BASE}, {grid}, {main}, fx as (select s1_id, sum(label)::double as tp0, sum(wt) as n0 from pw join one on pw.country = one.country where not addr_empty and prob >= one.t group by s1_id), {bare} select country as grp, t from one union all select country || '|noaddr', t from two where country in (select country from pw where addr_empty)",
        "ladder_grid": f"with {_W}, {_BASE}, {th}, k(d1, d2, d3, max_links) as (values {points}), a as (select *, {rnk} as rnk, prob >= t as hit from th), an as (select *, bool_or(hit) over (partition by s1_id) as anchored from a), {_at('k', 'select d1, d2, d3, max_links, s1_id, s23_id, prob, label, wt from an join k on anchored and case when rnk = 0 then hit else prob >= t + case rnk when 1 then d1 when 2 then d2 else d3 end end and (max_links = 0 or rnk < max_links or prob >= 0.99)', 'd1, d2, d3, max_links')} select d1, d2, d3, max_links, round(avg({_F}), 6) as macro_f from cnt group by all",
        "rescue_grid": f"with {_W}, {_BASE}, {th}, k(rt) as (values (2.0::double), " + ", ".join(f"({t}::double)" for t in C.RESCUE_GRID) + f"), s as (select *, prob >= t as selected, addr_empty and prob >= 0.10 as claim from th), c as (select *, row_number() over w as nth, lead(prob) over w as nxt, count_if(selected) over (partition by s1_id) as accepted from s window w as (partition by s23_id, claim order by prob desc, s1_id)), ab as (select *, claim and nth = 1 and (nxt is null or round(prob - nxt, 9) >= 0.30) and accepted < 11 as able from c), {_at('k', 'select rt, s1_id, s23_id, prob, label, wt from ab join k on selected or (able and prob >= rt)', 'rt')}, f as (select rt, country, sum({_F}) as f from cnt group by all), d as (select a.country, a.rt as t, round((a.f - z.f) / (select count(*) from e), 9) as gain from f a join f z on a.country = z.country and z.rt = 2 where a.rt < 2) select country, t, gain from (select *, row_number() over (partition by country order by gain desc, t) as nth from d where gain > 0) where nth = 1",
        "unseen_applied": f"with {Q._P}, pf as (select * from p where country = 'france'), g as (select i, round({s['start']} + i * 0.005, 4)::double as t from range(0, 52) r(i)), ch as (select i, s1_id, s23_id, prob from pf join g on prob >= case when addr_empty then least(0.99::double, g.t + ({s['noaddr_delta']}::double)) else g.t end), ow as (select *, row_number() over (partition by i, s23_id order by prob desc, s1_id) as nth from ch), h as (select i, count(distinct s1_id) as hit, count(*) as links from ow where nth = 1 group by i), z as (select (select count(*) from e where country = 'france') as all_, (select count(distinct s1_id) from pf) as able), r as (select g.i, g.t, 1 - coalesce(hit, 0) / able as rate, coalesce(links, 0) / all_ as links, greatest(0, ({s['target']}::double - (all_ - able) / all_) / (able / all_)) as aim from g left join h using (i) cross join z), l as (select *, lead(t) over (order by i) as nt, lead(links) over (order by i) as nl from r), q as (select *, case when rate >= aim then 'target' when nt is null or nt > 0.97 then 'most' when nt > {top} then 'raise' when nl < 0.8 then 'links' end as reason from l) select t, reason, round(rate, 6) as empty_rate, round(links, 6) as mean_links from q where reason is not null order by i limit 1",
        "prune_cap_tradeoff": trade + " select * from tr2",
        "recommended_cap": trade + " select * from tr2 where macro_f >= (select max(macro_f) from tr2) - 5e-5 order by case when cap = 0 then 2147483647 else cap end limit 1",
        "pruner_filter": f"with {Q._P}, q as (select country, round(quantile_cont(prob, 0.05), 9) as t from p where label = 1 and country <> 'france' group by country) select s1_id, s23_id from p left join q using (country) where prob >= coalesce(t, (select min(t) from q))",
        "set_scorer": f"with {Q._P}, {Q._T}, {Q._C}, {Q._counts()} select s1_id, round({_F}, 6) as f from cnt",
        "composite_lookup": f"with {Q._P} select s1_id, s23_id, case when fused_rank < 20 then fused_rank else 0 end as rank from p",
        "first_per_key": f"with {Q._P} select s1_id, min_by(country, s23_id) as country from p group by s1_id",
        "reindexed": f"with {Q._P}, f as (select s1_id, min_by(country, s23_id) as country from p group by s1_id) select e.s1_id, coalesce(f.country, '') as country from e left join f using (s1_id)",
        "dense_recode": f"with {Q._P} select s1_id, s23_id, country, dense_rank() over (partition by country order by s1_id) - 1 as code from p",
        "head_limit": f"with {Q._P} select * from e order by s1_id limit 25",
        "hardest_examples": f"with {Q._P} select s1_id, s23_id, prob from p where label = 0 order by prob desc, s1_id, s23_id limit 20",
        "indic_scripts": "select case doc_id % 4 when 1 then 'devanagari' when 2 then 'tamil' when 3 then 'kannada' else '' end as script, count(*) as n from documents group by 1",
        "translit_coverage": "with t as (select lang, unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) as k from documents), w as (select * from t where regexp_matches(k, '[^\\x00-\\x7F]')), c as (select k, lang, count(*) as n from w group by all), b as (select k, n, row_number() over (partition by k order by n desc, lang) as nth, round(n::double / sum(n) over (partition by k), 6) as share from c), tab as (select k from b where nth = 1 and n >= 5 and share >= 0.9) select lang, count(*) as n, round(avg((k in (select k from tab))::int), 6) as covered from w group by lang",
        "tokenisers": f"with r as ({X.duck_sql(X.ER_RECORDS)}) select entity_id, trim(regexp_replace(lower(business_name), '[^a-z0-9]+', ' ', 'g')) as latin, 1 as indic from r",
    }


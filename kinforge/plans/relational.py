"""Queries of joins, aggregates, set operations, learned tables and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import decision as D
from ..operators import learning as L
from ..operators import validate as Z
from ..sources import fixtures as X


def _sides(spark, sf_dir):
    r = X.records(spark, sf_dir)
    s1 = F.startswith("entity_id", F.lit("S1-"))
    return r.where(s1), r.where(~s1)


def owner_lookup(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    known = s1.select(F.col("entity_id").alias("owner_id"), F.col("business_name").alias("owner_name"))
    return s23.join(known, "owner_id", "left").select("entity_id", F.coalesce("owner_id", F.lit("-1")).alias("owner_id"), F.coalesce("owner_name", F.lit("")).alias("owner_name"))


def label_pairs(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    truth = _sides(spark, sf_dir)[1].where("owner_id is not null").select(F.col("entity_id").alias("s23_id"), F.col("owner_id").alias("s1_id"), F.lit(1).alias("hit"))
    return p.select("s1_id", "s23_id").join(truth, ["s1_id", "s23_id"], "left").select("s1_id", "s23_id", F.coalesce("hit", F.lit(0)).alias("is_match"))


def name_dup_count(spark, sf_dir):
    from pyspark.sql import Window

    s1, _ = _sides(spark, sf_dir)
    return s1.select("entity_id", F.count("*").over(Window.partitionBy("country", "business_name")).alias("name_dup"))


def core_name_lookup(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    n = s1.groupBy("country", "business_name").agg(F.count("*").alias("n"))
    return s23.join(n, ["country", "business_name"], "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("s1_core_count"))


def singleton_stats(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    n = s23.where("owner_id is not null").groupBy(F.col("owner_id").alias("entity_id")).agg(F.count("*").alias("n"))
    rows = s1.select("entity_id", "country").join(n, "entity_id", "left").select("country", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("country").agg(F.count("*").alias("entities"), F.count_if(F.col("n") == 0).alias("singletons"), F.max("n").alias("most"), F.sum("n").alias("links"))


def gt_explode(spark, sf_dir):
    _, s23 = _sides(spark, sf_dir)
    lists = s23.where("owner_id is not null").groupBy("owner_id").agg(F.array_join(F.sort_array(F.collect_set("entity_id")), " , ").alias("ids"))
    parsed = F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col("owner_id").alias("s1_id"), F.explode(parsed).alias("s23_id"))


def owner_uniqueness(spark, sf_dir):
    p = X.pairs(spark, sf_dir).where("label = 1")
    return p.groupBy("s23_id").agg(F.count("*").alias("owners")).agg(F.count("*").alias("owned"), F.count_if(F.col("owners") > 1).alias("violations"))


def _extra(spark, sf_dir):
    s1, s23 = _sides(spark, sf_dir)
    words = lambda c: F.split(F.lower(c), " ")
    p = X.pairs(spark, sf_dir).select("s1_id", "s23_id", "label")
    a = s1.select(F.col("entity_id").alias("s1_id"), words("business_name").alias("a"))
    b = s23.select(F.col("entity_id").alias("s23_id"), words("business_name").alias("b"))
    return p.join(a, "s1_id").join(b, "s23_id").select("s1_id", "s23_id", "label", F.explode(F.array_except("b", "a")).alias("token"))


def extra_token_stats(spark, sf_dir):
    return L.token_rates(_extra(spark, sf_dir))


def translit_mode_purity(spark, sf_dir):
    """The language of each word of the texts."""
    d = X.table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.split(F.lower("text"), r"[ \n\t\r]+")).alias("k"), F.col("lang").alias("y"))
    return L.modal_partner(words.where("k <> ''"))


def vocab_logprob(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return L.vocabulary(d.select(F.explode(F.split(F.lower("text"), r"[ \n\t\r]+")).alias("token")).where("token <> ''"))


def entity_split(spark, sf_dir):
    return L.entity_split(X.entities(spark, sf_dir)).groupBy("country", "split").agg(F.count("*").alias("n"))


def loco_split(spark, sf_dir):
    return L.leave_one_out(X.entities(spark, sf_dir), "india").groupBy("country", "split").agg(F.count("*").alias("n"))


def neg_subsample(spark, sf_dir):
    rows = L.subsample(X.pairs(spark, sf_dir))
    return rows.groupBy("country", "label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def mask_augment(spark, sf_dir):
    p = X.pairs(spark, sf_dir).select("s1_id", "s23_id", (F.col("fused_rank") % 3).alias("x_extra_cnt"), F.col("prob").alias("x_extra_min"), F.col("prob").alias("x_extra_mean"), F.lit(1.0).alias("x_extra_known"))
    return L.masked(p, 0.5)


def macro_sample_weights(spark, sf_dir):
    return L.macro_weights(X.pairs(spark, sf_dir)).select("s1_id", "s23_id", F.round("macro_weight", 6).alias("macro_weight"))


def quantile_threshold(spark, sf_dir):
    return L.positive_quantile(X.pairs(spark, sf_dir))


def model_metrics(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    return L.log_loss(p, "country").join(L.auc(p, "country"), "country")


KNOTS = {"us": [(0.0, 0.05), (0.4, 0.2), (0.7, 0.8), (1.0, 0.99)], "india": [(0.1, 0.0), (0.5, 0.5), (0.9, 1.0)]}


def isotonic_apply(spark, sf_dir):
    return L.calibrated(X.pairs(spark, sf_dir), KNOTS).select("s1_id", "s23_id", F.round("calibrated", 9).alias("calibrated"))


def isotonic_fit(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    knots = {c: L.isotonic_knots(p, c) for c in ("us", "india")}
    return L.calibrated(p, knots).groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 4).alias("mean"), F.round(F.avg("label"), 4).alias("rate"))


def boosted_ensemble(spark, sf_dir):
    p = L.entity_split(X.pairs(spark, sf_dir)).select("*", F.col("milli").cast("double").alias("m"))
    cols = ["m", "st_tset", "num_first_rel", "fused_rank"]
    train = p.where("split = 1")
    both = L.scored(L.train_forest(train, cols, 10, 5), L.scored(L.train_boosted(train, cols, None, 3, 5), p.where("split = 3"), "p1"), "p2")
    return D.combine(both, {"p1": 0.5, "p2": 0.5}).withColumn("grp", F.col("country")).groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 3).alias("mean_prob"))


def ensemble_combine(spark, sf_dir):
    p = X.pairs(spark, sf_dir).select("s1_id", "s23_id", F.col("prob").alias("p1"), F.when(F.col("fused_rank") % 4 > 0, F.col("st_tset") / 100.0).alias("p2"))
    return D.combine(p, {"p1": 0.6, "p2": 0.4}).select("s1_id", "s23_id", F.round("prob", 6).alias("prob"))


def keep_prob_filter(spark, sf_dir):
    c = EngineConfig()
    p = X.pairs(spark, sf_dir).where(F.greatest(F.col("prob"), F.col("st_tset") / 1000.0) >= c.keep_prob)
    return p.groupBy("grp").agg(F.count("*").alias("n"))


def semi_join(spark, sf_dir):
    o, c = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "customer")
    return c.join(o.where("o_totalprice > 100000").select("o_custkey"), c["c_custkey"] == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join(spark, sf_dir):
    """Customers without a costly order."""
    o, c = X.table(spark, sf_dir, "orders").where("o_totalprice > 480000"), X.table(spark, sf_dir, "customer")
    return c.join(o.select("o_custkey"), c["c_custkey"] == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def union_distinct(spark, sf_dir):
    o, n = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "lineitem")
    return o.select(F.col("o_orderkey").alias("k")).union(n.select(F.col("l_orderkey").alias("k"))).distinct()


def validator_violations(spark, sf_dir):
    _, s23 = _sides(spark, sf_dir)
    p = X.pairs(spark, sf_dir).where("prob >= 0.7")
    lists = p.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_list("s23_id")), ",").alias("ids"))
    bad = F.when(F.substring("s1_id", -1, 1) == "7", F.concat("s1_id", F.lit(" "), "ids")).when(F.substring("s1_id", -1, 1) == "3", F.concat("s1_id", F.lit("\t"), "ids", F.lit(","), F.split_part("ids", F.lit(","), F.lit(1)))).when(F.substring("s1_id", -1, 1) == "1", F.concat("s1_id", F.lit("\t"), "s1_id", F.lit(",X9-1,"), "ids"))
    lines = lists.select(F.coalesce(bad, F.concat("s1_id", F.lit("\t"), "ids")).alias("line"))
    return Z.violations(lines, X.entities(spark, sf_dir), s23.select(F.col("entity_id").alias("s23_id")))


def subset_check(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    return Z.not_contained(p.where("prob >= 0.5"), p.where("fused_rank < 20"))


def split_merge_roundtrip(spark, sf_dir):
    from ..sources.io import merge_parts, split_by_country

    e = X.entities(spark, sf_dir)
    order = e.select("s1_id", F.substring("s1_id", 4, 9).cast("long").alias("pos"))
    return merge_parts(order, list(split_by_country(e, ["India"])))


def candidate_stats(spark, sf_dir):
    p = X.pairs(spark, sf_dir).withColumn("selected", F.col("fused_rank") < 15)
    return Z.list_statistics(D.match_sets(p, X.entities(spark, sf_dir)))


_P = f"p as ({X.duck_sql(X.SCORED_PAIRS)})"
_E = f"e as ({X.duck_sql(X.ER_S1)})"
_R = f"r as ({X.duck_sql(X.ER_RECORDS)}), s1 as (select * from r where entity_id like 'S1-%'), s23 as (select * from r where entity_id not like 'S1-%')"


def _share(key: str, salt: str) -> str:
    return f"(('0x' || substring(md5('{salt}' || {key}), 1, 8))::bigint / 4294967296.0::double)"


def _curve(knots: list[tuple[float, float]]) -> str:
    out = f"case when prob < {knots[0][0]} then {knots[0][1]}::double"
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out += f" when prob < {x1} then {y0}::double + ({y1}::double - {y0}::double) * (prob - {x0}::double) / ({x1}::double - {x0}::double)"
    return out + f" else {knots[-1][1]}::double end"


def queries() -> dict:
    return {f.__name__: f for f in (owner_lookup, label_pairs, name_dup_count, core_name_lookup, singleton_stats, gt_explode, owner_uniqueness, extra_token_stats, translit_mode_purity, vocab_logprob, entity_split, loco_split, neg_subsample, mask_augment, macro_sample_weights, quantile_threshold, model_metrics, isotonic_apply, isotonic_fit, boosted_ensemble, ensemble_combine, keep_prob_filter, semi_join, anti_join, union_distinct, validator_violations, subset_check, split_merge_roundtrip, candidate_stats)}


def oracle_sql() -> dict[str, str]:
    us, ind = _curve(KNOTS["us"]), _curve(KNOTS["india"])
    split = _share("s1_id", "split")
    last = "substring(s1_id, -1, 1)"
    line = f"case when {last} = '7' then s1_id || ' ' || ids when {last} = '3' then s1_id || chr(9) || ids || ',' || split_part(ids, ',', 1) when {last} = '1' then s1_id || chr(9) || s1_id || ',X9-1,' || ids else s1_id || chr(9) || ids end"
    rule = lambda name, body: f"select '{name}' as rule, count(*) as n, coalesce((select string_agg(x, ',' order by x) from (select distinct x from ({body}) order by x limit 5)), '') as examples from ({body})"
    return {
        "owner_lookup": f"with {_R} select s23.entity_id, coalesce(s23.owner_id, '-1') as owner_id, coalesce(s1.business_name, '') as owner_name from s23 left join s1 on s23.owner_id = s1.entity_id",
        "label_pairs": f"with {_P}, {_R} select p.s1_id, p.s23_id, (s23.entity_id is not null)::int as is_match from p left join s23 on p.s23_id = s23.entity_id and p.s1_id = s23.owner_id",
        "name_dup_count": f"with {_R} select entity_id, count(*) over (partition by country, business_name) as name_dup from s1",
        "core_name_lookup": f"with {_R}, n as (select country, business_name, count(*) as n from s1 group by all) select entity_id, coalesce(n, 0) as s1_core_count from s23 left join n using (country, business_name)",
        "singleton_stats": f"with {_R}, n as (select owner_id, count(*) as n from s23 where owner_id is not null group by 1), c as (select country, coalesce(n, 0) as n from s1 left join n on s1.entity_id = n.owner_id) select country, count(*) as entities, count_if(n = 0) as singletons, max(n) as most, sum(n)::bigint as links from c group by country",
        "gt_explode": f"with {_R} select owner_id as s1_id, entity_id as s23_id from s23 where owner_id is not null",
        "owner_uniqueness": f"with {_P}, o as (select s23_id, count(*) as owners from p where label = 1 group by 1) select count(*) as owned, count_if(owners > 1) as violations from o",
        "extra_token_stats": f"with {_P}, {_R}, x as (select p.s1_id, p.s23_id, label, unnest(list_distinct(list_filter(string_split(lower(b.business_name), ' '), lambda t: not list_contains(string_split(lower(a.business_name), ' '), t)))) as token from p join s1 a on p.s1_id = a.entity_id join s23 b on p.s23_id = b.entity_id), pr as (select avg(label) as prior from (select distinct s1_id, s23_id, label from x)) select token, count(*) as n, round((sum(label) + 20.0::double * any_value(prior)) / (count(*) + 20.0::double), 6) as rate from x, pr group by token having count(*) >= 20",
        "translit_mode_purity": "with t as (select unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) as k, lang as y from documents), c as (select k, y, count(*) as n from t where k <> '' group by all), b as (select *, row_number() over (partition by k order by n desc, y) as nth, round(n::double / sum(n) over (partition by k), 6) as share from c) select k, y, n, share from b where nth = 1 and n >= 2 and share >= 0.5",
        "vocab_logprob": "with t as (select unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) as token from documents), c as (select token, count(*) as n from t where token <> '' group by token), s as (select sum(n) as total from c) select token, round(ln(n / total::double), 9) as logp from c, s where length(token) >= 2 and n >= 2",
        "entity_split": f"with {_E}, u as (select country, {split} as u from e) select country, case when u < 0.6 then 1 when u < 0.75 then 2 when u < 1.0 then 3 else 0 end as split, count(*) as n from u group by all",
        "loco_split": f"with {_E} select country, case when country = 'india' then 3 when {_share('s1_id', 'loco')} < 0.1 then 2 else 1 end as split, count(*) as n from e group by all",
        "neg_subsample": f"with {_P}, w as (select country, label, label = 1 or fused_rank < 25 as must, {_share(chr(40) + 's1_id || chr(124) || s23_id' + chr(41), 'neg')} as u from p) select country, label, count(*) as n, round(sum(case when must then 1.0::double else 1.0::double / 0.35::double end), 4) as weight from w where must or u < 0.35 group by all",
        "mask_augment": f"with {_P}, m as (select s1_id, s23_id, fused_rank % 3 as x_extra_cnt, prob, fused_rank % 3 > 0 and {_share('s23_id', 'mask')} < 0.25 as hit from p) select s1_id, s23_id, x_extra_cnt, case when hit then 0.5 else prob end as x_extra_min, case when hit then 0.5 else prob end as x_extra_mean, case when hit then 0.0::double else 1.0::double end as x_extra_known from m",
        "macro_sample_weights": f"with {_P} select s1_id, s23_id, round(case when label = 1 then 1.0::double / sum(label) over (partition by s1_id) else 1.0::double end, 6) as macro_weight from p",
        "quantile_threshold": f"with {_P} select country, round(quantile_cont(prob, 0.001), 9) as threshold from p where label = 1 group by country",
        "model_metrics": f"with {_P}, l as (select country, round(-avg(case when label = 1 then ln(least(greatest(prob, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6)) end), 6) as log_loss from p group by country), c as (select country, prob, sum(label) as pos, sum(1 - label) as neg from p group by all), w as (select *, pos * (coalesce(sum(neg) over (partition by country order by prob rows between unbounded preceding and 1 preceding), 0) + neg / 2.0::double) as won from c), a as (select country, round(sum(won) / (sum(pos) * sum(neg)), 6) as auc from w group by country) select country, log_loss, auc from l join a using (country)",
        "isotonic_apply": f"with {_P}, c as (select *, {us} as cu, {ind} as ci from p) select s1_id, s23_id, round(case country when 'us' then cu when 'india' then ci else (cu + ci) / 2 end, 9) as calibrated from c",
        "ensemble_combine": f"with {_P}, m as (select s1_id, s23_id, prob as p1, case when fused_rank % 4 > 0 then st_tset / 100.0::double end as p2 from p) select s1_id, s23_id, round(case when p2 is null then p1 * 0.6::double / 0.6::double else (p1 * 0.6::double + p2 * 0.4::double) / (0.6::double + 0.4::double) end, 6) as prob from m",
        "keep_prob_filter": f"with {_P} select grp, count(*) as n from p where greatest(prob, st_tset / 1000.0::double) >= 0.02 group by grp",
        "semi_join": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)",
        "anti_join": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)",
        "union_distinct": "select o_orderkey as k from orders union select l_orderkey from lineitem",
        "validator_violations": f"with {_P}, {_E}, {_R}, l0 as (select s1_id, string_agg(s23_id, ',' order by s23_id) as ids from p where prob >= 0.7 group by s1_id), l as (select {line} as line from l0), t as (select line, string_split(line, chr(9)) as q from l), ids as (select q[1] as s1_id, list_filter(list_transform(string_split(q[2], ','), lambda x: trim(x)), lambda x: x <> '') as ids from t where len(q) > 1), ea as (select s1_id, unnest(ids) as id from ids) "
        + " union all ".join([
            rule("no_tab", "select line as x from t where len(q) = 1"), rule("duplicate_s1", "select s1_id as x from ids group by s1_id having count(*) > 1"), rule("duplicate_ids", "select s1_id as x from ids where len(list_distinct(ids)) < len(ids)"),
            rule("s1_in_list", "select id as x from ea where id like 'S1-%'"), rule("bad_prefix", "select id as x from ea where not regexp_matches(id, '^S[123]-')"), rule("missing_s1", "select s1_id as x from e where s1_id not in (select s1_id from ids)"),
            rule("unexpected_s1", "select distinct s1_id as x from ids where s1_id not in (select s1_id from e)"), rule("unknown_id", "select distinct id as x from ea where id not in (select entity_id from s23)"),
        ]),
        "subset_check": f"with {_P} select s1_id, s23_id from p where prob >= 0.5 and fused_rank >= 20",
        "split_merge_roundtrip": f"with {_E} select * from e",
        "candidate_stats": f"with {_P}, {_E}, m as (select s1_id, count(distinct s23_id) as n from p where fused_rank < 15 group by 1), a as (select coalesce(n, 0) as n from e left join m using (s1_id)) select count(*) as n_rows, round(avg(n), 6) as mean_links, max(n) as max_links, count_if(n = 0) as n_empty from a",
    }

"""Queries of name and address functions and pair features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import native as V
from ..functions import tables as T
from ..functions.comparators import compare
from ..operators import features as P
from ..operators import learning as L
from ..sources import fixtures as X
from ..sources.stages import stage

COUNTRIES = X.duck_sql(X.ER_RECORDS)
INDIC = "[\u0900-\u0DFF]"


def script_detect(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.groupBy("lang", V.script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


def accent_fold(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(V.fold(F.col("text"))).alias("folded"))


def domain_detect(spark, sf_dir):
    r = X.records(spark, sf_dir)
    return r.where(V.is_domain(F.col("business_name"))).select("entity_id", "business_name")


def dba_split(spark, sf_dir):
    main, alt = V.dba(F.lower("business_name"))
    return X.records(spark, sf_dir).select("entity_id", main.alias("main"), alt.alias("alt")).where("alt <> ''")


def dotted_collapse(spark, sf_dir):
    r = X.records(spark, sf_dir)
    return r.where(F.contains("business_name", F.lit("."))).select("entity_id", V.dotted(F.lower("business_name")).alias("collapsed"))


def plain_names(spark, sf_dir):
    return X.records(spark, sf_dir).select("entity_id", V.plain(F.col("business_name")).alias("plain"), V.country(F.col("country")).alias("country"))


def legal_strip(spark, sf_dir):
    tokens = V.words(V.plain(F.col("business_name")))
    return X.records(spark, sf_dir).select("entity_id", F.array_join(V.legal_strip(tokens), " ").alias("core"), V.legal_code(tokens).alias("legal_code"))


def name_tokens(spark, sf_dir):
    return X.records(spark, sf_dir).select("entity_id", F.array_join(V.name_tokens(V.plain(F.col("business_name"))), " ").alias("tokens"))


def ordinal_strip(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    text = F.concat(F.col("o_orderkey") % 100, F.element_at(F.array(*[F.lit(x) for x in ("st", "nd", "rd", "th", "er", "eme")]), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" Avenue"))
    return o.select("o_orderkey", V.ordinal_strip(text).alias("stripped"))


def hyphen_ranges(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    text = F.concat(F.col("o_orderkey") % 500, F.lit("-"), F.col("o_orderkey") % 500 + F.col("o_orderkey") % 60 - 5, F.lit(" Main"))
    return o.select("o_orderkey", F.explode(V.ranges(text)).alias("r")).select("o_orderkey", "r.lo", "r.hi")


def house_numbers(spark, sf_dir):
    a = F.col("business_address")
    return X.records(spark, sf_dir).select("entity_id", F.array_join(V.numbers(a), ",").alias("nums"), F.coalesce(F.try_element_at(V.numbers(a), F.lit(1)), F.lit("")).alias("first_num"))


def address_components(spark, sf_dir):
    c = V.components(F.col("business_address"))
    return X.records(spark, sf_dir).select("entity_id", F.size(c).alias("n_components"), F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit("")).alias("last"), (F.trim("business_address") == "").alias("addr_empty"))


def postal_component(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("12 Main, "), F.when(F.col("o_orderkey") % 2 == 0, F.lpad(F.col("o_orderkey").cast("string"), 5, "0")).otherwise("City"), F.lit(" , Town"))
    return o.select("o_orderkey", V.postal(text).alias("postal"))


def _normalized(spark, sf_dir):
    """All records, normalised with the vocabulary of S1 names and the transliterations of known owners' names."""
    r = X.records(spark, sf_dir)
    return N.normalize(r, *learned(r))


def learned(records):
    """({word: log probability} of S1 names, {Indic word: Latin word} of the names of known owners). Where a
    pair's names have as many words all are set side by side, else the first and the last."""
    s1 = records.where(F.startswith("entity_id", F.lit("S1-")))
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(V.fold(F.col(c))), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) >= 2)
    logp = L.vocabulary(s1.select(F.explode(words("business_name")).alias("token")))
    one = s1.select(F.col("entity_id").alias("owner_id"), F.filter(F.split(F.regexp_replace(F.lower(V.fold(F.col("business_name"))), "[^a-z0-9]+", " "), " "), lambda x: x != "").alias("b"))
    indic = F.filter(F.split("business_name", r"\s+"), lambda x: x.rlike(INDIC))
    two = records.where(F.col("owner_id").isNotNull() & F.col("business_name").rlike(INDIC)).select("owner_id", indic.alias("a"))
    side = two.join(one, "owner_id").where("size(b) > 0")
    ends = F.expr("case when size(a) = size(b) then arrays_zip(a, b) when size(a) > 1 and size(b) > 1 then array(named_struct('a', a[0], 'b', b[0]), named_struct('a', element_at(a, -1), 'b', element_at(b, -1))) else array(named_struct('a', a[0], 'b', b[0])) end")
    table = L.modal_partner(side.select(F.explode(ends).alias("z")).select(F.col("z.a").alias("k"), F.col("z.b").alias("y")))
    return {r.token: r.logp for r in logp.toLocalIterator()}, {r.k: r.y for r in table.toLocalIterator()}


def full_normalize(spark, sf_dir):
    return _normalized(spark, sf_dir).select("entity_id", "country_norm", "name_norm", "name_core", "name_strict", "name_alt", "is_domain", "has_dba", "legal_code", "addr_norm", "street", "admin", "postal", "first_num", "n_components", "addr_empty")


def _pairs(spark, sf_dir):
    """True owners and same-country neighbours, with lower-case names and addresses."""
    r = X.records(spark, sf_dir)
    one = r.where(F.startswith("entity_id", F.lit("S1-"))).select(F.col("entity_id").alias("s1_id"), V.plain(F.col("business_name")).alias("name_1"), V.plain(F.col("business_address")).alias("addr_1"))
    two = r.where("owner_id is not null").select(F.col("entity_id").alias("s23_id"), F.col("owner_id").alias("s1_id"), V.plain(F.col("business_name")).alias("name_2"), V.plain(F.col("business_address")).alias("addr_2"))
    return two.join(one, "s1_id")


def jaro_winkler_pairs(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("c", compare(F.col("name_1"), F.col("name_2"), ("jw",)))
    return rows.select("s1_id", "s23_id", F.col("c.jw").alias("jw"))


def fuzzy_features(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("c", compare(F.col("name_1"), F.col("name_2")))
    return rows.select("s1_id", "s23_id", "c.ratio", "c.tsort", "c.tset", "c.partial")


def token_jaccard(spark, sf_dir):
    a, b = F.array_distinct(V.words(F.col("name_1"))), F.array_distinct(V.words(F.col("name_2")))
    return _pairs(spark, sf_dir).select("s1_id", "s23_id", F.round(P.jaccard(a, b), 6).alias("jac"), F.round(P.containment(a, b), 6).alias("contain"), F.size(F.array_except(b, a)).alias("extra"))


def digit_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("s1_id", "s23_id", F.round(P.digit_overlap(F.split("addr_1", " "), F.split("addr_2", " ")), 6).alias("overlap"))


def num_first_relation(spark, sf_dir):
    a, b = V.numbers(F.col("addr_1")), V.numbers(F.col("addr_2"))
    first = lambda x: F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))
    return _pairs(spark, sf_dir).select("s1_id", "s23_id", P.first_number_relation(first(a), a, first(b), b).alias("rel"))


def group_relative_gaps(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    return P.group_relative(p, ["st_tset", "milli"], "milli").select("s1_id", "s23_id", "gap_st_tset", "gap_milli", "rank_combined")


def pair_features(spark, sf_dir):
    pairs = X.records(spark, sf_dir).where("owner_id is not null").select(F.col("owner_id").alias("s1_id"), F.col("entity_id").alias("s23_id"))
    # Both sides of a pair come from the normalised records: written once.
    return P.pair_features(pairs, stage(_normalized(spark, sf_dir), "normalized"))


_R = f"with r as ({COUNTRIES})"
_FOLD_A, _FOLD_B = T.accents()
_LEGAL = "[" + ", ".join(f"'{w}'" for w in T.families()) + "]"
_UNSURE = "[" + ", ".join(f"'{w}'" for w in T.AMBIGUOUS.split()) + "]"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS.split()) + "]"
_CODES = "MAP {" + ", ".join(f"'{w}': {k}" for w, k in T.families().items()) + "}"


def _plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[&+]', ' and ', 'g'), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_TOK = f"tok as (select entity_id, list_filter(string_split({_plain('business_name')}, ' '), lambda x: x <> '') as t from r)"
_PAIR = f"{_R}, one as (select entity_id as s1_id, {_plain('business_name')} as name_1, {_plain('business_address')} as addr_1 from r where entity_id like 'S1-%'), two as (select entity_id as s23_id, owner_id as s1_id, {_plain('business_name')} as name_2, {_plain('business_address')} as addr_2 from r where owner_id is not null), pr as (select * from two join one using (s1_id))"
_DBA = r"^(.*?)\s*\b(?:d/b/a|dba|formerly|f/k/a|t/a|nka|a/k/a)\b\s*(.+)$"


def _nums(c: str) -> str:
    hits = rf"list_transform(regexp_extract_all(lower({c}), '\b([a-z]{{0,2}}\d+[a-z]{{0,2}})\b', 1), lambda x: regexp_replace(regexp_replace(x, '[a-z]', '', 'g'), '^0+([0-9])', '\1'))"
    return f"list_filter({hits}, lambda x, i: list_position({hits}, x) = i)"


def queries() -> dict:
    return {f.__name__: f for f in (script_detect, accent_fold, domain_detect, dba_split, dotted_collapse, plain_names, legal_strip, name_tokens, ordinal_strip, hyphen_ranges, house_numbers, address_components, postal_component, full_normalize, jaro_winkler_pairs, fuzzy_features, token_jaccard, digit_overlap, num_first_relation, group_relative_gaps, pair_features)}


def oracle_sql() -> dict[str, str]:
    doms = "|".join(T.DOMAINS.split())
    ham = "list_sum(list_transform(range(1, length(f1) + 1), lambda i: (substring(f1, i, 1) <> substring(f2, i, 1))::int))"
    return {
        "script_detect": "select lang, case when regexp_matches(text, '[\\x{0900}-\\x{0DFF}]') then 2 when regexp_matches(text, '[^\\x00-\\x7F]') then 1 else 0 end as script, count(*) as n from documents group by all",
        "accent_fold": f"select doc_id, md5(replace(replace(replace(replace(replace(translate(text, '{_FOLD_A}', '{_FOLD_B}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'AE'), 'Œ', 'OE')) as folded from documents",
        "domain_detect": f"{_R} select entity_id, business_name from r where regexp_matches(lower(trim(business_name)), '^[a-z0-9-]+\\.(?:{doms})$')",
        "dba_split": f"{_R}, s as (select entity_id, trim(regexp_extract(lower(business_name), '{_DBA}', 1)) as a, trim(regexp_extract(lower(business_name), '{_DBA}', 2)) as b from r) select entity_id, b as main, a as alt from s where length(b) >= 3 and length(a) > 0",
        "dotted_collapse": f"{_R}, s as (select entity_id, lower(business_name) as n, regexp_extract(lower(business_name), '\\b(?:[a-z]\\. ?)+[a-z]\\b\\.?') as m from r where contains(business_name, '.')) select entity_id, case when m = '' then n else replace(n, m, regexp_replace(m, '[. ]', '', 'g')) end as collapsed from s",
        "plain_names": f"{_R} select entity_id, {_plain('business_name')} as plain, lower(trim(country)) as country from r",
        "legal_strip": f"{_R}, {_TOK}, h as (select *, len(list_filter(t, lambda x: list_contains({_LEGAL}, x))) as hits from tok), k as (select *, list_filter(t, lambda x, i: not list_contains({_LEGAL}, x) or (i = 1 and list_contains({_UNSURE}, x) and hits >= 2)) as kept, list_filter(list_transform(t, lambda x: map_extract_value({_CODES}, x)), lambda v: v is not null) as codes from h) select entity_id, array_to_string(case when len(kept) > 0 then kept else t end, ' ') as core, coalesce(list_filter(codes, lambda v: v < 12)[1], codes[1], 0) as legal_code from k",
        "name_tokens": f"{_R}, {_TOK}, l as (select entity_id, list_filter(t, lambda x: length(x) >= 2) as l from tok), k as (select *, list_filter(l, lambda x: not list_contains({_STOP}, x)) as kept from l) select entity_id, array_to_string(case when len(kept) > 0 then kept else l end, ' ') as tokens from k",
        "ordinal_strip": "select o_orderkey, (o_orderkey % 100)::varchar || ' Avenue' as stripped from orders",
        "hyphen_ranges": "select o_orderkey, (o_orderkey % 500)::int as lo, (o_orderkey % 500 + o_orderkey % 60 - 5)::int as hi from orders where o_orderkey % 60 between 6 and 45",
        "house_numbers": f"{_R}, n as (select entity_id, {_nums('business_address')} as n from r) select entity_id, array_to_string(n, ',') as nums, coalesce(n[1], '') as first_num from n",
        "address_components": f"{_R}, c as (select entity_id, business_address, list_filter(list_transform(string_split(business_address, ','), lambda x: trim(x)), lambda x: x <> '') as c from r) select entity_id, len(c)::int as n_components, coalesce(c[-1], '') as last, trim(business_address) = '' as addr_empty from c",
        "postal_component": "select o_orderkey, case when o_orderkey % 2 = 0 and length(lpad(o_orderkey::varchar, 5, '0')) = 5 then lpad(o_orderkey::varchar, 5, '0') else '' end as postal from orders",
        "jaro_winkler_pairs": f"{_PAIR} select s1_id, s23_id, round(100 * jaro_winkler_similarity(name_1, name_2), 6) as jw from pr",
        "token_jaccard": f"{_PAIR}, a as (select s1_id, s23_id, list_distinct(list_filter(string_split(name_1, ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split(name_2, ' '), lambda x: x <> '')) as b from pr), c as (select *, len(list_intersect(a, b)) as c, len(a) as na, len(b) as nb from a) select s1_id, s23_id, round(case when na + nb - c > 0 then c::double / (na + nb - c) else 0 end, 6) as jac, round(case when least(na, nb) > 0 then c::double / least(na, nb) else 0 end, 6) as contain, (nb - c)::int as extra from c",
        "digit_overlap": f"{_PAIR}, a as (select s1_id, s23_id, list_distinct(list_filter(string_split(addr_1, ' '), lambda x: regexp_matches(x, '^[0-9]+$'))) as a, list_distinct(list_filter(string_split(addr_2, ' '), lambda x: regexp_matches(x, '^[0-9]+$'))) as b from pr) select s1_id, s23_id, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b))::double / greatest(len(a), len(b)) else 0 end, 6) as overlap from a",
        "num_first_relation": f"{_PAIR}, a as (select s1_id, s23_id, {_nums('addr_1')} as n1, {_nums('addr_2')} as n2 from pr), b as (select *, coalesce(n1[1], '') as f1, coalesce(n2[1], '') as f2 from a) select s1_id, s23_id, case when f1 = '' and f2 = '' then 0 when f1 = '' or f2 = '' then 1 when f1 = f2 then 2 when starts_with(f1, f2) or starts_with(f2, f1) then 3 when ends_with(f1, f2) or ends_with(f2, f1) then 4 when list_contains(n2, f1) then 5 when list_contains(n1, f2) then 6 when length(f1) = length(f2) and {ham} = 1 then 7 when length(f1) = length(f2) then 8 else 9 end as rel from b",
        "group_relative_gaps": f"with p as ({X.duck_sql(X.SCORED_PAIRS)}) select s1_id, s23_id, max(st_tset) over (partition by s1_id) - st_tset as gap_st_tset, max(milli) over (partition by s1_id) - milli as gap_milli, row_number() over (partition by s1_id order by milli desc, s23_id) as rank_combined from p",
    }

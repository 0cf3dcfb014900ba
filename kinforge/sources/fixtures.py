"""Entity-resolution inputs derived from the star-schema tables.

Each fixture is one SQL text that both Spark and DuckDB read; `{t}` stands for table t. Only integer
and string operations are used, so the engines agree to the last row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One S1 record per customer, one S2 or S3 record per order, with known owner and known noise.
ER_RECORDS = """
with cust as (
  select c_custkey as ck, case n_regionkey % 3 when 0 then 'US' when 1 then 'India' else 'France' end as country, n_name as city,
    p1.p_name as pn1, lower(p2.p_type) as pt, p3.p_name as pn2,
    case c_custkey % 5 when 0 then ' Inc' when 1 then ' LLC' when 2 then ' Pvt Ltd' when 3 then ' SARL' else '' end as suffix,
    (37 * c_custkey) % 9973 + 10 as num
  from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
  join (select p_partkey - (select min(p_partkey) from {part}) as i, p_name from {part}) p1 on p1.i = c_custkey % (select count(*) from {part})
  join (select p_partkey - (select min(p_partkey) from {part}) as i, p_type from {part}) p2 on p2.i = (7 * c_custkey + 3) % 100
  join (select p_partkey - (select min(p_partkey) from {part}) as i, p_name from {part}) p3 on p3.i = (7 * c_custkey + 3) % 100
), s1 as (
  select concat('S1-', lpad(cast(ck as varchar(20)), 9, '0')) as entity_id, concat(pn1, ' ', pt, suffix) as business_name,
    concat(cast(num as varchar(20)), ' ', pn2, ' Street, ', city) as business_address, country, cast(null as varchar(20)) as owner_id
  from cust
), ord as (
  select o_orderkey as ok, cust.*, o_orderkey % 20 as k, (o_orderkey % 20 < 5 or ck % 18 = 0) as distractor
  from {orders} join cust on o_custkey = ck
), s23 as (
  select concat(case when ok % 2 = 0 then 'S2-' else 'S3-' end, lpad(cast(ok as varchar(20)), 9, '0')) as entity_id,
    case when distractor then concat(pn1, ' holdings ', pt, suffix)
      when k = 5 then upper(concat(pn1, ' ', pt, suffix))
      when k = 6 then replace(concat(pn1, ' ', pt, suffix), 'o', '0')
      when k = 7 then concat(replace(concat(pn1, ' ', pt), ' ', ''), '.com')
      when k = 8 then concat('Old Name d/b/a ', pn1, ' ', pt, suffix)
      when k = 9 then concat(pn1, ' ', pt)
      when k = 10 then concat(pn1, ' ', pt, ' L.L.C.')
      else concat(pn1, ' ', pt, suffix) end as business_name,
    case when distractor then concat(cast(num + 3 + ok % 19 as varchar(20)), ' ', pn2, ' Street, ', city)
      when k = 11 then ''
      when k = 12 then concat(substring(cast(num as varchar(20)), 1, length(cast(num as varchar(20))) - 1), ' ', pn2, ' Street, ', city)
      when k = 13 then concat(cast(num as varchar(20)), ' ', pn2, ' St, ', city)
      when k = 14 then concat(city, ', ', cast(num as varchar(20)), ' ', pn2, ' Street')
      else concat(cast(num as varchar(20)), ' ', pn2, ' Street, ', city) end as business_address,
    country, case when distractor then null else concat('S1-', lpad(cast(ck as varchar(20)), 9, '0')) end as owner_id
  from ord
)
select * from s1 union all select * from s23
"""

#: Candidate pairs with a deterministic pseudo-probability, for the decision layer.
ER_PAIRS = """
with near as (
  select o_orderkey as ok, o_custkey as owner, j, o_custkey + j * (1 + o_orderkey % 4) as ck
  from {orders} cross join (select 0 as j union all select 1 union all select 2 union all select 3) js
), joined as (
  select n.*, case na.n_regionkey % 3 when 0 then 'us' when 1 then 'india' else 'france' end as country,
    (ok * 7919 + ck * 10473 + j * 3137) % 1000 as r
  from near n join {customer} c on n.ck = c.c_custkey join {nation} na on c.c_nationkey = na.n_nationkey
)
select concat('S1-', lpad(cast(ck as varchar(20)), 9, '0')) as s1_id,
  concat(case when ok % 2 = 0 then 'S2-' else 'S3-' end, lpad(cast(ok as varchar(20)), 9, '0')) as s23_id,
  country, (ok % 20 = 11) as addr_empty,
  case when j = 0 and ok % 20 >= 5 and ck % 18 <> 0 then 1 else 0 end as label,
  (ok % 20 < 5) as s23_distractor,
  cast(case when j = 0 and ok % 20 >= 5 and ck % 18 <> 0 then floor(400 + r * 0.6e0) else floor(r * 0.8e0) end as int) as milli,
  cast((ok * 13 + ck * 7) % 101 as int) as st_tset, cast((ok + 3 * ck) % 10 as int) as num_first_rel,
  cast((ok * 31 + ck * 17) % 30 as int) as fused_rank
from joined
"""
#: The same with prob (three decimals), group key and one row per pair.
SCORED_PAIRS = f"select p.*, milli / 1000e0 as prob, case when addr_empty then concat(country, '|noaddr') else country end as grp from ({ER_PAIRS}) p"

#: All S1 entities of the pair fixture with their country.
ER_S1 = """
select concat('S1-', lpad(cast(c_custkey as varchar(20)), 9, '0')) as s1_id,
  case n_regionkey % 3 when 0 then 'us' when 1 then 'india' else 'france' end as country
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
"""


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a fixture's or portable SQL in Spark, tables read straight from Parquet."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(re.sub(r"varchar\(\d+\)", "string", sql))


def duck_sql(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, ER_RECORDS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, SCORED_PAIRS)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, ER_S1)

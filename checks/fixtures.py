"""Old/new pairs with known defects, derived from the given tables by key arithmetic.

Each pair is one SQL text that both Spark and the checking engine run, so both see the same rows. The
remainders in them place the defects (a lost row, a changed amount); every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.sources.tables import parquet_tables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Row pair keyed by order.
F1_OLD = """
select o_orderkey, o_custkey, lpad(cast(o_custkey as varchar(20)), 10, '0') as custref, o_orderstatus,
       cast(o_totalprice as decimal(18,2)) as o_totalprice,
       concat(lpad(cast(extract(day from o_orderdate) as varchar(2)), 2, '0'), '/',
              lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '/',
              cast(extract(year from o_orderdate) as varchar(4))) as orderdate,
       o_orderpriority
from orders
"""
F1_NEW = """
select o_orderkey + case when o_orderkey % 211 = 7 then 100000000 else 0 end as id, o_custkey as custno,
       case when o_orderkey % 103 = 9 then null
            when o_orderkey % 89 = 3 then lower(o_orderstatus) else o_orderstatus end as status,
       cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 101 = 5 then 1.00 else 0.00 end as totalprice,
       concat(cast(extract(year from o_orderdate) as varchar(4)), '-',
              lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '-',
              lpad(cast(extract(day from o_orderdate) as varchar(2)), 2, '0')) as order_day,
       concat(o_orderstatus, '/', o_orderpriority) as label
from orders where o_orderkey % 97 <> 13
"""

# Legacy transactions in long form, amounts as text.
F2_OLD = """
select concat('P', lpad(cast(l_orderkey as varchar(20)), 8, '0')) as sysref, l_returnflag as affectcode,
       case when l_linestatus = 'O' then 'D' else 'C' end as debitcredit,
       cast(l_suppkey as varchar(20)) as loantranshostcode,
       cast(l_suppkey as varchar(20)) as accountno,
       cast(cast(l_extendedprice as decimal(18,2)) as varchar(30)) as transactionamount,
       cast(cast(l_quantity as decimal(18,2)) as varchar(30)) as quantity,
       case when l_linenumber = 1 then 'CONV' when l_partkey % 17 = 1 then cast(l_partkey as varchar(20))
            else concat('user', cast(l_suppkey % 7 as varchar(20))) end as tellerid,
       l_orderkey, l_partkey, l_linenumber
from lineitem
"""
# Target in wide form: one row per order.
F2_NEW = """
select concat('P', lpad(cast(l_orderkey as varchar(20)), 8, '0')) as sysref,
       sum(case when l_returnflag = 'A' and l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) else 0 end)
         + max(case when l_orderkey % 101 = 5 then 1.00 else 0.00 end) as credit_a,
       sum(case when l_returnflag = 'A' and l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2)) else 0 end) as debit_a,
       sum(case when l_returnflag = 'N' and l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) else 0 end) as credit_n,
       sum(case when l_returnflag = 'N' and l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2)) else 0 end) as debit_n,
       sum(case when l_returnflag = 'R' and l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) else 0 end) as credit_r,
       sum(case when l_returnflag = 'R' and l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2)) else 0 end) as debit_r,
       sum(cast(l_extendedprice as decimal(18,2))) as transactionamount,
       sum(cast(l_quantity as decimal(18,2))) + max(case when l_orderkey % 53 = 2 then 0.004 else 0.000 end) as quantity,
       sum(cast(l_extendedprice as decimal(18,2))) + sum(cast(l_quantity as decimal(18,2))) as amount_and_quantity
from lineitem where l_orderkey % 97 <> 13 group by l_orderkey
"""
# Target in long form: some rows lost, some doubled, one extra group per 991 orders.
F2B_NEW = """
select concat('P', lpad(cast(l_orderkey as varchar(20)), 8, '0')) as sysrefno, l_returnflag as affectcode,
       case when l_linestatus = 'O' then 'D' else 'C' end as debitcredit,
       cast(l_suppkey as varchar(20)) as accountno,
       cast(l_extendedprice as decimal(18,2)) as transactionamount,
       cast(l_quantity as decimal(18,2)) as quantity,
       case when l_linenumber = 1 and l_orderkey % 3 > 0 then 'CONV' when l_partkey % 17 = 1 then cast(l_partkey as varchar(20))
            else concat('ad.user', cast(l_suppkey % 7 as varchar(20))) end as tellerid,
       concat(l_returnflag, case when l_linestatus = 'O' then 'D' else 'C' end) as code_side,
       l_orderkey, l_partkey, l_linenumber
from lineitem where (l_orderkey * 7 + l_partkey) % 97 <> 0
union all
select concat('P', lpad(cast(l_orderkey as varchar(20)), 8, '0')), l_returnflag,
       case when l_linestatus = 'O' then 'D' else 'C' end, cast(l_suppkey as varchar(20)),
       cast(l_extendedprice as decimal(18,2)), cast(l_quantity as decimal(18,2)), 'ad.double',
       concat(l_returnflag, case when l_linestatus = 'O' then 'D' else 'C' end), l_orderkey, l_partkey, l_linenumber
from lineitem where l_orderkey % 89 = 1
union all
select concat('X', lpad(cast(o_orderkey as varchar(20)), 8, '0')), 'A', 'C', '0', cast(1.00 as decimal(18,2)),
       cast(1.00 as decimal(18,2)), 'ad.extra', 'AC', o_orderkey, 0, 0
from orders where o_orderkey % 991 = 5
"""
# Composite key: accounts are renumbered, some have no new number.
F3_MAP = """
select cast(s_suppkey as varchar(20)) as invaccountno, cast(s_suppkey + 900000 as varchar(20)) as newinvaccountno
from supplier where s_suppkey % 10 <> 3
"""
F3_NEW = """
select concat('P', lpad(cast(l_orderkey as varchar(20)), 8, '0')) as sysrefno,
       cast(l_suppkey + 900000 as varchar(20)) as lvaccountno,
       sum(cast(l_extendedprice as decimal(18,2))) + max(case when l_orderkey % 101 = 5 then 1.00 else 0.00 end) as amount,
       min(l_returnflag) as affectcode
from lineitem where l_orderkey % 97 <> 13 and l_suppkey % 10 <> 3 group by l_orderkey, l_suppkey
"""
# Long form per user and type against five columns per user.
F5_LONG = """
select user_id, event_type, sum(cast(value as decimal(18,4))) as v from events group by user_id, event_type
"""
F5_WIDE = """
select user_id,
       sum(case when event_type = 'click' then cast(value as decimal(18,4)) end) as click_value,
       sum(case when event_type = 'view' then cast(value as decimal(18,4)) end) as view_value,
       sum(case when event_type = 'error' then cast(value as decimal(18,4)) end) as error_value,
       sum(case when event_type = 'signup' then cast(value as decimal(18,4)) end) as signup_value,
       sum(case when event_type = 'purchase' then cast(value as decimal(18,4)) end)
         + max(case when user_id % 7 = 2 then 1.0000 else 0.0000 end) as purchase_value
from events where user_id % 13 <> 5 group by user_id
union all
select user_id, null, null, null, null, null from (select distinct user_id from events where user_id % 11 = 4 and user_id % 13 <> 5) d
union all
select user_id + 1000000000, cast(1 as decimal(18,4)), null, null, null, null
from (select distinct user_id from events where user_id % 17 = 3) e
"""
F6_OLD = "select o_orderkey, cast(o_custkey as varchar(20)) as custkey from orders"
F6_NEW = "select cast(c_custkey as varchar(20)) as custno, c_name from customer where c_custkey % 50 <> 1"
F7 = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, cast(null as varchar(10)) as all_null,
       '0' as all_zero, case when o_orderkey % 3 = 0 then '0' else '' end as zero_or_blank,
       cast(o_orderkey % 2 as varchar(2)) as zero_one, case when o_orderkey % 5 = 0 then 'true' else 'false' end as true_false,
       case when o_orderkey % 7 = 0 then null else 'x' end as some_null
from orders
"""
# Renamed schema: upper case, stripped hyphens, other ids, other formats.
F8_OLD = """
select o_orderkey as order_accountno, o_orderkey + 1000000000000000 as id, o_custkey as customer_key, o_orderstatus as order_status,
       cast(cast(o_totalprice as decimal(18,2)) as varchar(30)) as total_price,
       lower(o_orderpriority) as order_priority,
       concat(cast(extract(year from o_orderdate) as varchar(4)), '-', lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'),
              '-', lpad(cast(extract(day from o_orderdate) as varchar(2)), 2, '0')) as order_date,
       concat('A-', lpad(cast(o_orderkey as varchar(20)), 8, '0')) as document_no,
       case when o_orderkey % 2 = 0 then '1' else '0' end as active_flag,
       cast(null as varchar(10)) as spare, o_orderpriority as note_text
from orders
"""
F8_NEW = """
select o_orderkey as order_account_no, o_orderkey + 2000000000000000 as id, o_custkey as cust_key, o_orderstatus as orderstatus,
       cast(o_totalprice as decimal(18,2)) as total_price_amt,
       o_orderpriority as order_prio,
       concat(cast(extract(year from o_orderdate) as varchar(4)), '-', lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'),
              '-', lpad(cast(extract(day from o_orderdate) as varchar(2)), 2, '0'), ' 00:00:00') as order_datetime,
       concat('A', lpad(cast(o_orderkey as varchar(20)), 8, '0')) as documentno,
       cast(null as varchar(30)) as note_text, 7 as fixed_seven
from orders where o_orderkey % 97 <> 13
"""


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The given tables, registered as views for the fixture SQL."""
    found = parquet_tables(spark, folder, *(names or TABLES))
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def derive(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """DataFrame of a fixture SQL over the tables of a folder."""
    used = [t for t in TABLES if t in sql]
    tables(spark, folder, *used)
    return spark.sql(sql)

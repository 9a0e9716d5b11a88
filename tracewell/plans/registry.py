"""Registered queries over the driver's tables, and DuckDB SQL for each that SQL can express.

``query`` registers a function together with its SQL, under the function's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import normalize as N
from tracewell.functions import textmine as M
from tracewell.operators import rules as R
from tracewell.operators import scoring as S
from tracewell.operators import trace as G
from tracewell.operators import transfers as T
from tracewell.operators.components import connected_components
from tracewell.plans.tables import CLUSTERS, FUNDS, LINKS, TWO, funds, identity_edges, links, sessions, table, two_statements
from tracewell.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _marked(spark, sf):
    return T.mark_duplicates(two_statements(spark, sf))


# ---- scalars -----------------------------------------------------------------------------------


@query("""
with v as (select c_custkey, case c_custkey % 5 when 0 then '+91 9' || lpad(c_custkey::varchar, 9, '0') when 1 then '09' || lpad(c_custkey::varchar, 9, '0')
  when 2 then 'vm-bank' || chr(65 + (c_custkey % 20)::int) when 3 then (c_custkey % 9000)::varchar else null end as raw from customer),
d as (select *, regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g') as d from v)
select c_custkey, case when regexp_full_match(trim(coalesce(raw, '')), '[A-Za-z]{2}-?[A-Za-z]{5,8}') then upper(raw)
  when d = '' then null when length(d) > 10 and d like '0%' then right(ltrim(d, '0'), 10) when length(d) > 10 then right(d, 10) else d end as msisdn from d""")
def n07_msisdn(spark, sf):
    k = F.col("c_custkey")
    padded = F.lpad(k.cast("string"), 9, "0")
    raw = F.when(k % 5 == 0, F.concat(F.lit("+91 9"), padded)).when(k % 5 == 1, F.concat(F.lit("09"), padded)).when(k % 5 == 2, F.concat(F.lit("vm-bank"), F.char((65 + k % 20).cast("int")))).when(k % 5 == 3, (k % 9000).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", N.norm_msisdn(raw).alias("msisdn"))


@query("""
with v as (select c_custkey, case c_custkey % 4 when 0 then 'XXXX' || lpad(c_custkey::varchar, 6, '0') when 1 then '5010-' || lpad(c_custkey::varchar, 8, '0') when 2 then c_custkey::varchar else 'x12' end as raw from customer),
d as (select *, regexp_replace(raw, '[^0-9]', '', 'g') as d, regexp_matches(raw, '[xX*#]') as masked from v)
select c_custkey, case when masked then case when length(d) >= 4 then 'MASKED-' || right(d, 6) end when length(d) >= 6 then d end as account, masked from d""")
def n11_account(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("XXXX"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 1, F.concat(F.lit("5010-"), F.lpad(k.cast("string"), 8, "0"))).when(k % 4 == 2, k.cast("string")).otherwise("x12")
    return table(spark, sf, "customer").select("c_custkey", N.norm_account(raw).alias("a")).select("c_custkey", F.col("a.key").alias("account"), F.col("a.masked").alias("masked"))


@query("""
with v as (select event_id, '0' || (event_id % 300)::varchar || '.' || (user_id % 256)::varchar || '.016.' || (event_id % 7)::varchar as raw from events),
p as (select event_id, [cast(x as int) for x in string_split(raw, '.')] as o, regexp_full_match(raw, '(\\d{1,3}\\.){3}\\d{1,3}') as ok from v),
q as (select event_id, case when ok and list_max(o) <= 255 then array_to_string([x::varchar for x in o], '.') end as ip, o from p)
select event_id, ip, case when ip is not null then array_to_string([x::varchar for x in o[1:3]], '.') || '.0/24' end as subnet,
  coalesce(ip is not null and (o[1] in (10, 127) or (o[1] = 192 and o[2] = 168) or (o[1] = 172 and o[2] between 16 and 31)), false) as private from q""".replace("\\\\", "\\"))
def n14_ip(spark, sf):
    e = table(spark, sf, "events")
    raw = F.concat(F.lit("0"), (F.col("event_id") % 300).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit(".016."), (F.col("event_id") % 7).cast("string"))
    return e.select("event_id", N.norm_ip(raw).alias("ip"), N.subnet24(raw).alias("subnet"), N.is_private_ip(raw).alias("private"))


@query("""
with v as (select l_orderkey, l_linenumber, l_returnflag as f, cast(l_extendedprice as decimal(18, 2)) as p from lineitem),
t as (select *, case f when 'R' then '(' || p::varchar || ')' when 'A' then 'Rs. ' || p::varchar || ' Dr' else p::varchar || ' CR' end as raw from v)
select l_orderkey, l_linenumber, raw, case when f in ('R', 'A') then -p::double else p::double end as amount from t""")
def n19_amount(spark, sf):
    p = F.col("l_extendedprice").cast(T.MONEY).cast("string")
    f = F.col("l_returnflag")
    raw = F.when(f == "R", F.concat(F.lit("("), p, F.lit(")"))).when(f == "A", F.concat(F.lit("Rs. "), p, F.lit(" Dr"))).otherwise(F.concat(p, F.lit(" CR")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).withColumn("amount", N.parse_amount(F.col("raw")))


@query("""
with p as (select o_orderkey, cast(o_totalprice as decimal(18, 2)) as p from orders),
w as (select *, split_part(p::varchar, '.', 1) as w, split_part(p::varchar, '.', 2) as c from p)
select o_orderkey, case when length(w) > 3 then reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)(\\d)', '\\1,\\2')) || ',' || right(w, 3) else w end || case when c = '00' then '' else '.' || c end as inr from w""".replace("\\\\", "\\"))
def n20_inr(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.inr(F.col("o_totalprice").cast(T.MONEY)).alias("inr"))


@query("""
select event_id, date_trunc('second', ts) as layout_1, date_trunc('minute', ts) as layout_2, date_trunc('second', ts) as layout_3, date_trunc('second', ts) + interval 330 minutes as iso_utc, to_timestamp(floor(epoch(ts))::bigint) at time zone 'UTC' + interval 330 minutes as epoch from events""")
def n01_timestamps(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    as_ = lambda layout: N.parse_ts(F.date_format(ts, layout))
    seconds = F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("string")
    return table(spark, sf, "events").select("event_id", as_("dd/MM/yyyy HH:mm:ss").alias("layout_1"), as_("yyyy-MM-dd HH:mm").alias("layout_2"), as_("dd-MMM-yyyy HH:mm:ss").alias("layout_3"), as_("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso_utc"), N.parse_ts(seconds).alias("epoch"))


@query("""select p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as key, case when p_partkey % 2 = 0 then lower(substr(md5(p_partkey::varchar), 1, 2) || ':' || substr(md5(p_partkey::varchar), 3, 2) || ':' || substr(md5(p_partkey::varchar), 5, 2) || ':' || substr(md5(p_partkey::varchar), 7, 2) || ':' || substr(md5(p_partkey::varchar), 9, 2) || ':' || substr(md5(p_partkey::varchar), 11, 2)) end as mac,
  substr('35' || lpad(p_partkey::varchar, 13, '0'), 1, 14) as imei, 'u' || p_partkey || '@okbank' as upi, 'u' || p_partkey || '@mail.example.com' as email from part""")
def n06_keys(spark, sf):
    k = F.col("p_partkey").cast("string")
    mac = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.md5(k).substr(1, 12))).otherwise("00-11")
    return table(spark, sf, "part").select("p_partkey", N.norm_key(F.col("p_type")).alias("key"), N.norm_mac(mac).alias("mac"), N.norm_imei(F.concat(F.lit("35-"), F.lpad(k, 13, "0"))).alias("imei"), N.norm_upi(F.concat(F.lit(" U"), k, F.lit("@OkBank"))).alias("upi"), N.norm_email(F.concat(F.lit("<u"), k, F.lit("@Mail.example.com>"))).alias("email"))


_LEXICON = {"the": 1, "reward": 3, "http": 2, "license": 2, "die": 2, "que": 1, "token": 4, "la": 1}


@query("with h as (select conv_id, turn, lower(coalesce(text, '')) as t from conversations), s as (select *, " + " + ".join(f"case when contains(t, '{p}') then {w} else 0 end" for p, w in _LEXICON.items()) + " as raw from h) select conv_id, turn, cast(round_even(100 * (1 - exp(-raw / 12.0)), 0) as int) as score from s")
def t02_lure(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", M.lure(F.col("text"), _LEXICON)["score"].alias("score"))


@query(r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
i as (select doc_id, list_sort(list_distinct([array_to_string([cast(o as int)::varchar for o in string_split(x, '.')], '.') for x in regexp_extract_all(t, '\b(?:\d{1,3}\.){3}\d{1,3}\b') if list_max([cast(o as int) for o in string_split(x, '.')]) <= 255])) as ips,
  list_sort(list_distinct([lower(x) for x in regexp_extract_all(t, '(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b')])) as emails,
  list_sort(list_distinct([lower(x) for x in regexp_extract_all(t, '(?i)\b[0-9a-f]{64}\b')])) as hashes from d)
select * from i where len(ips) + len(emails) + len(hashes) > 0""")
def t01_indicators(spark, sf):
    i = table(spark, sf, "documents").select("doc_id", M.indicators(F.col("text")).alias("i")).select("doc_id", "i.ips", "i.emails", "i.hashes")
    return i.filter(F.size("ips") + F.size("emails") + F.size("hashes") > 0)


@query(r"""
with h as (select page_id, lower(coalesce(url, '')) as u, split_part(split_part(regexp_replace(lower(coalesce(url, '')), '^https?://', ''), '/', 1), ':', 1) as host from pages)
select page_id, host, length(host) - length(replace(host, '-', '')) >= 2 as hyphens, regexp_full_match(host, '(\d{1,3}\.){3}\d{1,3}') as raw_ip, ends_with(host, '.example.org') or ends_with(host, 'example.net') as known from h""")
def t06_hosts(spark, sf):
    host = F.substring_index(M.host_of(F.col("url")), ":", 1)
    risk = M.url_risk(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.array_contains(risk, "host with many hyphens").alias("hyphens"), F.array_contains(risk, "host is an IP address").alias("raw_ip"), (host.endswith(".example.org") | host.endswith("example.net")).alias("known"))


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(rf"""
with h as (select page_id, url, lower(coalesce(url, '')) as u, split_part(split_part(regexp_replace(lower(coalesce(url, '')), '^https?://', ''), '/', 1), ':', 1) as host from pages),
x as (select *, [t for t in {_listed(M.TLDS)} if ends_with(host, t)][1] as tld, [b for b in {_listed(M.BRANDS)} if contains(host, b)][1] as brand,
  len([g for g in {_listed(M.GENUINE)} if host = g or ends_with(host, '.' || g)]) > 0 or ends_with(host, '.gov.in') or ends_with(host, '.nic.in') or ends_with(host, '.rbi.org.in') as own from h)
select page_id, url, [r for r in [case when regexp_full_match(host, '(\d{{1,3}}\.){{3}}\d{{1,3}}') then 'host is an IP address' end, case when tld is not null then 'top-level domain ' || tld end,
  case when not own and brand is not null then 'brand ' || upper(brand) || ' on a foreign domain' end, case when ends_with(u, '.apk') then 'links to an Android package' end,
  case when length(host) - length(replace(host, '-', '')) >= 2 then 'host with many hyphens' end] if r is not null] as reasons from x""".replace("\\\\", "\\"))
def t03_url_risk(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", M.url_risk(F.col("url")).alias("reasons"))


@query(r"""select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>', ' \1 ', 'g'), '<[^>]+>', ' ', 'g') as text from pages""")
def t07_plain_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", M.plain_text(F.col("html")).alias("text"))


# ---- transfers ---------------------------------------------------------------------------------


@query(f"with {TWO} select src, dst, seq, corroborated from marked")
def w01_deduplicate(spark, sf):
    return _marked(spark, sf).select("src", "dst", "seq", "corroborated")


_FLOWS = """
legs as (select dst as node, cast(abs(amount) as decimal(18, 2)) as c, 0 as o from {t} union all select src, cast(abs(amount) as decimal(18, 2)), 1 from {t}),
flows as (select node, cast(coalesce(sum(c) filter (o = 0), 0) as double) as in_amount, count(*) filter (o = 0) as in_count, cast(coalesce(sum(c) filter (o = 1), 0) as double) as out_amount, count(*) filter (o = 1) as out_count from legs where c <> 0 group by node)"""
_ONCE = TWO + ", once as (select * from marked where not corroborated)"


@query(f"with {_ONCE}, {_FLOWS.format(t='once')} select * from flows")
def a03_node_flows(spark, sf):
    return T.node_flows(_marked(spark, sf))


@query(f"""with {TWO} select src, dst, count(*) as count, count(*) filter (corroborated) as corroborated, cast(coalesce(sum(cast(amount as decimal(18, 2))) filter (not corroborated), 0) as double) as amount, min(ts) as first, max(ts) as last, list_slice(list_sort(list(seq)), 1, 200) as events from marked group by src, dst""")
def a04_edges(spark, sf):
    return T.edges(T.mark_duplicates(two_statements(spark, sf, "src", "dst")))


@query(f"with {FUNDS}, {_FLOWS.format(t='funds')} select * from flows where in_amount > 0 and out_amount > 0 and out_amount >= 0.75 * in_amount")
def s_pass_through(spark, sf):
    return T.pass_through(T.node_flows(funds(spark, sf)))


_LAG = """
l as (select dst as node, ts, 0 as o from {t} where ts is not null union all select src, ts, 1 from {t} where ts is not null),
k as (select node, ts, o, max(case when o = 0 then ts end) over (partition by node order by ts, o rows unbounded preceding) as latest from l),
lags as (select node, min(epoch_us(ts) - epoch_us(latest)) / 6e7 as lag_minutes from k where o = 1 and latest is not null group by node)"""


@query(f"with {FUNDS}, {_LAG.format(t='funds')} select * from lags")
def w02_shortest_lag(spark, sf):
    return T.shortest_lag(funds(spark, sf), "MONTH")


@query("""with b as (select 'PHONE|' || user_id as node, count(*) over (partition by user_id order by ts range between interval 60 minutes preceding and current row) as n from events) select node, max(n) as burst from b group by node""")
def w03_largest_burst(spark, sf):
    return T.largest_burst(sessions(spark, sf), "node")


@query(f"""with {TWO}, p as (select src as node, cast(amount as decimal(18, 2)) as a, count(*) as n from marked group by all having count(*) >= 2), r as (select *, row_number() over (partition by node order by n desc, a desc) as k from p)
select node, cast(a as double) as amount, n as times from r where k = 1""")
def a10_repeated_amounts(spark, sf):
    return T.repeated_amounts(_marked(spark, sf), 2)


@query(f"""with {FUNDS} select src as node, count(*) filter (amount >= 40000 and amount < 50000 or amount >= 90000 and amount < 100000 or amount >= 190000 and amount < 200000) as in_bands from funds group by src having in_bands >= 3""")
def s_structuring(spark, sf):
    return T.structured(funds(spark, sf))


@query("""select 'PHONE|' || user_id as node, count(*) as stamped, count(*) filter (hour(ts) < 5) as at_night from events group by user_id having stamped >= 3 and at_night >= 0.25 * stamped""")
def s_night_share(spark, sf):
    return T.night_share(sessions(spark, sf), "node", share=0.25)


@query(f"with {FUNDS} select src as node, count(distinct dst) as partners from funds group by src having partners >= 3")
def s_fan_out(spark, sf):
    return T.fan(funds(spark, sf), "out")


@query("""with c as (select user_id, ts, event_id from events where event_type = 'click'), p as (select user_id, ts, event_id from events where event_type = 'purchase')
select c.event_id as contact, p.event_id as debit, c.user_id, (epoch_us(p.ts) - epoch_us(c.ts)) / 6e7 as gap_minutes from c join p on c.user_id = p.user_id and c.ts <= p.ts and c.ts >= p.ts - interval 180 minutes""")
def j13_contacts_before(spark, sf):
    e = table(spark, sf, "events")
    click = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("contact_ts"), F.col("event_id").alias("contact"))
    buy = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("debit_ts"), F.col("event_id").alias("debit"))
    return T.contacts_before(click, buy, "user_id").select("contact", "debit", "user_id", "gap_minutes")


@query("""with c as (select *, coalesce(text, '') like '%.' as ends from conversations), g as (select conv_id, turn, role, text, count(*) filter (role = 'user') over (partition by conv_id order by turn rows unbounded preceding) as message from c)
select conv_id, message, min(turn) as first_turn, count(*) as turns, cast(sum(length(coalesce(text, ''))) as bigint) as chars from g where message > 0 group by conv_id, message""")
def w06_stitched(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = table(spark, sf, "conversations").withColumn("message", F.count_if(F.col("role") == "user").over(w)).filter("message > 0")
    return g.groupBy("conv_id", "message").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("""select event_id, row_number() over (partition by user_id order by ts nulls last, event_id) as ordinal from events""")
def w05_ordinals(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(), "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).cast("long").alias("ordinal"))


@query("""with k as (select user_id, cast(json_extract(props, '$.k') as int) as k, event_id from events), r as (select user_id, k, event_id, row_number() over (partition by user_id, k order by event_id) as n from k)
select user_id, k, event_id as seq from r where n = 1""")
def a02_first_written(spark, sf):
    """First-write-wins values: of each user's values of a property, where it was first seen."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("user_id", k.alias("k"), "event_id").groupBy("user_id", "k").agg(F.min("event_id").alias("seq"))


@query("""select 'PHONE|' || user_id as node, count(*) as events, min(ts) as first_seen, max(ts) as last_seen, list_sort(list(distinct event_type)) as roles from events group by user_id""")
def a01_node_rollup(spark, sf):
    return sessions(spark, sf).groupBy("node").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_sort(F.collect_set("event_type")).alias("roles"))


@query("""with n as (select user_id, user_id % 40 as imei, event_type, count(*) as n, min(event_id) as s from events group by all), r as (select *, row_number() over (partition by imei, event_type order by n desc, s) as k from n)
select imei, event_type, user_id as subscriber from r where k = 1""")
def a08_serving_subscriber(spark, sf):
    """The most frequent number of each (handset, kind) pair; the first seen wins a tie."""
    n = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("imei"), "event_type", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("s"))
    return n.groupBy("imei", "event_type").agg(F.max_by("user_id", F.struct(F.col("n"), -F.col("s"))).alias("subscriber"))


# ---- rules -------------------------------------------------------------------------------------


def _clusters(spark, sf):
    return connected_components(identity_edges(spark, sf))


def _no_victims(spark):
    return spark.createDataFrame([], "node string")


def _rule(body: str, code: str, severity: str, confidence: str, score: str) -> str:
    return f"{body} select '{code}-' || entity as code, entity, {severity} as severity, '{confidence}' as confidence, cast({score} as int) as score, members from g"


@query(f"with {LINKS}, {CLUSTERS} select node, component from clusters")
def g02_components(spark, sf):
    return _clusters(spark, sf)


@query(_rule(f"with {LINKS}, g as (select dst as entity, list_sort(list(distinct src)) as members, count(distinct src) as n from links where rel = 'USES_HANDSET' group by dst having n >= 2)", "SHARED-HANDSET", "case when n >= 3 then 'HIGH' else 'MEDIUM' end", "HIGH", "case when n >= 3 then 18 else 12 end"))
def r01_shared_handset(spark, sf):
    return R.shared_handset(links(spark, sf))


@query(_rule(f"with {LINKS}, t as (select 'IMSI|' || user_id as node, ts from events where event_type = 'signup'), g as (select dst as entity, list_sort(list(distinct src)) as members, count(distinct src) as n, min(ts) as a, max(ts) as b from links join t on node = src where rel = 'SIM_IN_HANDSET' group by dst having n >= 3 and epoch_us(b) - epoch_us(a) <= 30::bigint * 86400000000 + 999999)", "SIM-VELOCITY", "case when n >= 4 then 'CRITICAL' else 'HIGH' end", "HIGH", "case when n >= 4 then 22 else 16 end"))
def r02_sim_velocity(spark, sf):
    seen = sessions(spark, sf).filter("event_type = 'signup'").select(F.concat(F.lit("IMSI|"), F.substring_index("node", "|", -1)).alias("node"), "ts")
    return R.sim_velocity(links(spark, sf), seen)


@query(_rule(f"with {LINKS}, g as (select src as entity, list_sort(list(distinct dst)) as members, count(distinct dst) as n from links where rel = 'USED_IP' group by src having n >= 2)", "HANDSET-HOP", "'MEDIUM'", "HIGH", "10"))
def r03_handset_hop(spark, sf):
    """On the tables a number has one handset, so addresses stand for handsets."""
    l = links(spark, sf).filter("rel = 'USED_IP'").withColumn("rel", F.lit("USES_HANDSET"))
    return R.handset_hop(l)


_VICTIM = "v as (select 'PHONE|' || user_id as node from events where user_id % 10 = 0 group by user_id)"


def _victims(spark, sf):
    return table(spark, sf, "events").filter("user_id % 10 = 0").select(F.concat(F.lit("PHONE|"), F.col("user_id")).alias("node")).distinct()


_ACTORS = "p as (select distinct {e} as entity, src as member from links where {w}), a as (select p.*, coalesce(component, member) as actor, v.node is not null as victim from p left join clusters c on c.node = member left join v on v.node = member), g as (select entity, list_sort(list(distinct member)) as members from a group by entity having count(distinct member) >= 2 and count(distinct actor) >= 2 and count(*) filter (not victim) > 0)"


@query(_rule(f"with {LINKS}, {CLUSTERS}, {_VICTIM}, {_ACTORS.format(e='dst', w='rel = ' + chr(39) + 'USED_IP' + chr(39))}", "SHARED-IP", "'HIGH'", "MEDIUM", "15"))
def r04_shared_ip(spark, sf):
    return R.shared_ip(links(spark, sf), _clusters(spark, sf), _victims(spark, sf))


@query(_rule(f"with {LINKS}, {CLUSTERS}, {_VICTIM}, wide as (select regexp_replace(dst, '^IP\\|(.*)\\.\\d+$', '\\1.0/24') as net from links where rel = 'USED_IP' group by 1 having count(distinct dst) >= 2), ".replace("\\\\", "\\") + _ACTORS.format(e=r"regexp_replace(dst, '^IP\|(.*)\.\d+$', '\1.0/24')", w=r"rel = 'USED_IP' and regexp_replace(dst, '^IP\|(.*)\.\d+$', '\1.0/24') in (select net from wide)"), "SHARED-SUBNET", "'MEDIUM'", "MEDIUM", "12"))
def r05_shared_subnet(spark, sf):
    return R.shared_subnet(links(spark, sf), _clusters(spark, sf), _victims(spark, sf))


@query(_rule(f"with {LINKS}, g as (select dst as entity, list_sort(list(distinct src)) as members, count(distinct src) as n from links where rel = 'USED_DEVICE' group by dst having n >= 2)", "SHARED-HW", "'HIGH'", "HIGH", "16"))
def r06_shared_hardware(spark, sf):
    return R.shared_hardware(links(spark, sf))


@query(_rule(f"with {FUNDS}, g as (select dst as entity, list_sort(list(distinct src)) as members, count(distinct src) as n from funds group by dst having n >= 3)", "FAN-IN", "case when n >= 4 then 'HIGH' else 'MEDIUM' end", "HIGH", "case when n >= 4 then 18 else 12 end"))
def r07_fan_in(spark, sf):
    return R.fan_in(funds(spark, sf).withColumn("rel", F.lit("FUNDS")))


@query(_rule("with g as (select sha256(text) as entity, list_sort(list(distinct 'APK|' || doc_id)) as members, count(*) as n from documents where text is not null group by 1 having n >= 2)", "APK-HASH", "'HIGH'", "HIGH", "15"))
def r08a_equal_packages(spark, sf):
    return R.equal_packages(table(spark, sf, "documents").select(F.concat(F.lit("APK|"), F.col("doc_id")).alias("node"), F.sha2("text", 256).alias("sha256")))


@query(_rule("with g as (select 'APK|' || event_id as entity, ['APK|' || event_id] as members, cast(floor(value) as int) as risk from events where floor(value) >= 55)", "MALICIOUS-APK", "case when risk >= 75 then 'CRITICAL' else 'HIGH' end", "HIGH", "case when risk >= 75 then 20 else 14 end"))
def r08b_malicious_packages(spark, sf):
    return R.malicious_packages(table(spark, sf, "events").select(F.concat(F.lit("APK|"), F.col("event_id")).alias("node"), F.floor("value").cast("int").alias("risk")))


@query(_rule(f"with {LINKS}, g as (select dst as entity, list_sort(list(distinct src)) as members, count(distinct src) as n from links where rel = 'LINKS_TO' group by dst having n >= 2)", "DOMAIN-PIVOT", "'MEDIUM'", "MEDIUM", "10"))
def r09_domain_pivot(spark, sf):
    return R.domain_pivot(links(spark, sf))


@query(_rule(f"with {LINKS}, {CLUSTERS}, p as (select src as entity, dst as member, coalesce(component, dst) as actor from links left join clusters on node = dst where rel = 'HOLDS'), g as (select entity, list_sort(list(distinct member)) as members from p group by entity having count(distinct member) >= 2 and count(distinct actor) >= 2)", "NAME-REUSE", "'LOW'", "LOW", "4"))
def r10_name_reuse(spark, sf):
    return R.name_reuse(links(spark, sf), _clusters(spark, sf))


@query(_rule("with g as (select 'ACCOUNT|MASKED-' || lpad(s_suppkey::varchar, 6, '0') as entity, list_sort(list(distinct 'ACCOUNT|' || lpad(c_custkey::varchar, 12, '0'))) as members from supplier join customer on right(lpad(s_suppkey::varchar, 6, '0'), 4) = right(lpad(c_custkey::varchar, 12, '0'), 4) group by 1)", "MASKED-MATCH", "'LOW'", "LOW", "3"))
def r11_masked_match(spark, sf):
    masked = table(spark, sf, "supplier").select(F.concat(F.lit("ACCOUNT|MASKED-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("node"))
    full = table(spark, sf, "customer").select(F.concat(F.lit("ACCOUNT|"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("node"))
    return R.masked_match(masked.unionByName(full))


@query(_rule(f"with {LINKS}, t as (select distinct 'PHONE|' || user_id as node from events where event_type = 'click'), g as (select dst as entity, list_sort(list(distinct src)) as members from links where rel = 'REGISTERED_ON' and dst in (select node from t) group by dst)", "RAIL-BRIDGE", "'MEDIUM'", "HIGH", "8"))
def r12_rail_bridge(spark, sf):
    roles = sessions(spark, sf).filter("event_type = 'click'").select("node", F.lit("a_party").alias("role"))
    return R.rail_bridge(links(spark, sf), roles)


@query(_rule(f"with {FUNDS}, c as (select dst from funds group by dst having count(distinct src) >= 3), n as (select src as node from funds group by src having bool_and(dst in (select dst from c)) and src not in (select dst from funds)), g as (select node as entity, [node] as members from n)", "ADDL-VICTIM", "'INFO'", "MEDIUM", "0"))
def r13_additional_victims(spark, sf):
    return R.additional_victims(T.additional_victims(funds(spark, sf)))


# ---- tracing, scoring, reports -------------------------------------------------------------------


def _origins(spark, sf):
    return funds(spark, sf).filter("src like 'ACCOUNT|C%'").select(F.min("src").alias("node"))


_TRACE = f"""{FUNDS}, {_FLOWS.format(t='funds')}, moved as (select * from funds where src <> dst),
o as (select node from flows order by out_amount - in_amount desc, node limit 1),
r0 as (select node, null::timestamp as at, null::bigint as via from o)""" + "".join(f""",
h{d} as (select {d} as depth, f.*, r.via from moved f join r{d - 1} r on f.src = r.node and (r.at is null or f.ts >= r.at){''.join(f' and f.seq not in (select seq from h{e})' for e in range(1, d))}),
r{d} as (select dst as node, min(ts) as at, arg_min(seq, struct_pack(t := ts, s := seq)) as via from h{d} group by dst)""" for d in range(1, 7)) + ", hops as (" + " union all ".join(f"select * from h{d}" for d in range(1, 7)) + ")"


@query(f"""with {_TRACE}, io as (select dst as node, ts, 0 as o, null as seq from hops union all select src, ts, 1, seq from hops),
k as (select seq, o, ts, max(case when o = 0 then ts end) over (partition by node order by ts, o rows unbounded preceding) as latest from io)
select depth, src, dst, amount, h.ts, h.seq, (epoch_us(h.ts) - epoch_us(latest)) / 6e7 as lag_minutes, via from hops h join k on k.o = 1 and k.seq = h.seq""")
def g03_trace(spark, sf):
    """Hops of the money of the node with the largest net loss, to the full depth."""
    f = materialize(funds(spark, sf))
    return G.trace(f, G.default_origins(T.node_flows(f)))


@query(f"""with recursive {FUNDS}, o as (select min(src) as node from funds where src like 'ACCOUNT|C%'),
h1 as (select dst, min(ts) as at from funds where src = (select node from o) group by dst),
h2 as (select f.dst, f.ts, f.seq from funds f join h1 on f.src = h1.dst and f.ts >= h1.at and f.src <> (select node from o)),
every as (select node, 0 as layer from o union all select dst, 1 from h1 union all select dst, 2 from h2)
select node, cast(min(layer) as int) as layer from every group by node""")
def g06_layers(spark, sf):
    o = _origins(spark, sf)
    return G.layers(G.trace(funds(spark, sf), o, 2, lags=False), o)


@query(f"""with {_TRACE}, p1 as (select seq, cast(amount as decimal(38, 2)) as total, [seq] as seqs from h1){''.join(f', p{d} as (select h.seq, cast(total + cast(amount as decimal(18, 2)) as decimal(38, 2)) as total, list_append(seqs, h.seq) as seqs from h{d} h join p{d - 1} p on p.seq = h.via)' for d in range(2, 7))},
every as ({' union all '.join(f'select * from p{d}' for d in range(1, 7))})
select cast(total as double) as total, cast(len(seqs) as int) as length, seqs from every where seq not in (select via from hops where via is not null) order by total desc, length desc, seqs limit 25""")
def g07_paths(spark, sf):
    """The 25 heaviest routes of the trail."""
    f = materialize(funds(spark, sf))
    return G.paths(materialize(G.trace(f, G.default_origins(T.node_flows(f)), lags=False)))


@query(f"with {_TRACE} select node, cast(min(layer) as int) as layer from (select node, 0 as layer from o union all select dst, depth from hops) group by node")
def g06a_layers_full(spark, sf):
    """As g06_layers, whose SQL ends at two hops, from the node with the largest net loss and to the full depth."""
    f = materialize(funds(spark, sf))
    o = materialize(G.default_origins(T.node_flows(f)))
    return G.layers(G.trace(f, o, lags=False), o)


@query(f"with {FUNDS}, paid as (select * from funds where src like 'ACCOUNT|C%'), {_FLOWS.format(t='paid')} select node, in_amount, out_amount from flows where in_amount > 0 and out_amount = 0")
def g05_terminals(spark, sf):
    """Where money comes to rest, of payments without returns."""
    return T.node_flows(funds(spark, sf).filter("src like 'ACCOUNT|C%'")).filter("in_amount > 0 and out_amount = 0").select("node", "in_amount", "out_amount")


_REASONS = f"""{FUNDS}, {_FLOWS.format(t='funds')}, {_LAG.format(t='funds')},
reasons as (
  select node, 'PASS_THROUGH' as code, 18.0::double as points from flows where in_amount > 0 and out_amount > 0 and out_amount >= 0.75 * in_amount
  union all select node, 'LAYER_30', 22 from lags where lag_minutes <= 30
  union all select node, 'LAYER_60', 15 from lags where lag_minutes > 30 and lag_minutes <= 60
  union all select node, 'LAYER_180', 8 from lags where lag_minutes > 60 and lag_minutes <= 180
  union all select src, 'FAN_OUT', 12 from funds group by src having count(distinct dst) >= 3
  union all select src, 'STRUCTURING', 12 from funds group by src having count(*) filter (amount >= 40000 and amount < 50000 or amount >= 90000 and amount < 100000 or amount >= 190000 and amount < 200000) >= 3
  union all select node, 'ROUND_SUM', 5 from (select src as node from funds group by src, cast(amount as decimal(18, 2)) having count(*) >= 3) group by node
  union all select src, 'NIGHT_OPS', 8 from funds where ts is not null group by src having count(*) >= 3 and count(*) filter (hour(ts) < 5) >= 0.4 * count(*)
  union all select node, 'VELOCITY', 10 from (select src as node, count(*) over (partition by src order by ts range between interval 60 minutes preceding and current row) as n from funds where ts is not null) group by node having max(n) >= 4)"""
_SCORES = _REASONS + """,
scores as (select node, raw, score, case when score >= 75 then 'CRITICAL' when score >= 55 then 'HIGH' when score >= 35 then 'MEDIUM' else 'LOW' end as band, reasons
  from (select node, sum(points) as raw, cast(round_even(100 * (1 - exp(-sum(points) / 55.0)), 0) as int) as score, list_sort(list(distinct code)) as reasons from reasons group by node))"""


@query(f"with {_REASONS} select * from reasons")
def s01_reasons(spark, sf):
    return S.financial_reasons(funds(spark, sf))


@query(f"with {_SCORES} select * from scores")
def s02_scores(spark, sf):
    return S.scores(S.financial_reasons(funds(spark, sf)))


@query(f"""with {_SCORES}, {LINKS[1:]}, {CLUSTERS[1:]}, n as (select s.*, coalesce(component, s.node) as cluster, in_amount, out_amount from scores s left join clusters c on c.node = s.node left join flows f on f.node = s.node),
g as (select cluster, max(struct_pack(s := score, r := raw, n := node)) as best, count(*) as members, cast(sum(cast(in_amount as decimal(18, 2))) as double) as received, cast(sum(cast(out_amount as decimal(18, 2))) as double) as sent from n group by cluster)
select cluster, best.n as "primary", best.s as score, members, received, sent from g""")
def s03_suspects(spark, sf):
    f = materialize(funds(spark, sf).select("src", "dst", "amount", "ts"))
    none = _no_victims(spark)
    out = S.suspects(S.scores(S.financial_reasons(f)), _clusters(spark, sf), T.node_flows(f), none.withColumn("layer", F.lit(0)), none)
    return out.select("cluster", "primary", "score", "members", "received", "sent")


@query(f"""with {FUNDS}, {_FLOWS.format(t='funds')}, top as (select node, in_amount + out_amount as turnover from flows order by turnover desc, node limit 600), e as (select src, dst, count(*) as count from funds group by src, dst)
select src, dst, count from e where src in (select node from top) and dst in (select node from top)""")
def k02_graph_payload(spark, sf):
    """Edges between the 600 nodes of largest turnover."""
    f = funds(spark, sf)
    top = T.node_flows(f).withColumn("turnover", F.col("in_amount") + F.col("out_amount")).orderBy(F.col("turnover").desc(), "node").limit(600).select("node")
    e = f.groupBy("src", "dst").agg(F.count("*").alias("count"))
    return e.join(F.broadcast(top.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(top.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst", "count")


@query(f"""with {FUNDS}, w as (select seq, ts, amount from funds order by amount desc, seq limit 40) select seq, ts, cast(row_number() over (order by ts, seq) as int) as place from w""")
def k06_timeline(spark, sf):
    """The 40 heaviest events, in order of time."""
    top = funds(spark, sf).orderBy(F.col("amount").desc(), "seq").limit(40)
    return top.select("seq", "ts", F.row_number().over(Window.orderBy("ts", "seq")).alias("place"))


@query("""select event_type, count(*) as events, count(distinct user_id) as entities, min(ts) as first, max(ts) as last from events group by event_type""")
def a18_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("entities"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f"""with {FUNDS}, ok as (select * from funds where status in ('F', 'O')) select src, dst, count(*) as count, cast(sum(cast(amount as decimal(18, 2))) as double) as amount from ok group by src, dst""")
def p11_status_gate(spark, sf):
    return funds(spark, sf).filter(F.col("status").isin("F", "O")).groupBy("src", "dst").agg(F.count("*").alias("count"), F.sum(T.cents("amount")).cast("double").alias("amount"))


@query(f"""with {LINKS}, n as (select distinct src as node from links union select dst from links) select split_part(node, '|', 1) as kind, count(*) as nodes from n group by 1""")
def j01_nodes_of_links(spark, sf):
    l = links(spark, sf)
    n = l.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return n.groupBy(R.kind_of("node").alias("kind")).agg(F.count("*").alias("nodes"))


@query(f"""with {LINKS}, {CLUSTERS} select component, list_sort(list(node)) as members, count(*) as size, bool_or(node like 'ACCOUNT|%') as financial from clusters group by component""")
def a06_cluster_rollup(spark, sf):
    return _clusters(spark, sf).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"), F.bool_or(F.col("node").startswith("ACCOUNT|")).alias("financial"))

"""Registered queries that run parsers and case operators over records made of the driver's tables.

Each turns a whole table into the records that an exhibit of its kind would give (raw text
under resolved fields), runs the library on them, and states the events in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import textmine as M
from tracewell.plans.case import Case
from tracewell.plans.registry import query
from tracewell.plans.tables import table
from tracewell.sources import events as E
from tracewell.sources import exhibits as X
from tracewell.storage import home, materialize


def _records(rows: DataFrame, kind: str, row: Column | str, part: str | Column = "row", **fields: Column) -> DataFrame:
    """Records of one exhibit, with times parsed as ``events`` does it; rows are dealt over all cores, as one part of a file may hold them all."""
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    values = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items())), lambda x: x["value"].isNotNull()))
    number = F.col(row) if isinstance(row, str) else row
    out = rows.select(F.lit("EX-001").alias("exhibit"), F.lit(f"{kind.lower()}.csv").alias("source"), F.lit(kind).alias("kind"), F.lit(False).alias("low_confidence"), (F.lit(part) if isinstance(part, str) else part).alias("part"), number.cast("int").alias("row"), F.lit(0).alias("sub"), values.alias("fields"))
    return E.timed(out)


def _nodes() -> Column:
    return F.transform("entities", lambda e: e["node"])


def _links() -> Column:
    return F.array_sort(F.transform("links", lambda x: F.concat_ws(" ", x["src"], x["rel"], x["dst"])))


def _day(c: str) -> Column:
    return F.date_format(F.col(c), "dd/MM/yyyy HH:mm:ss")


# ---- call records ------------------------------------------------------------------------------


def cdr_records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "MOC").when(F.col("event_type") == "view", "Incoming Voice").when(F.col("event_type") == "purchase", "SMS MT").when(F.col("event_type") == "signup", "SMS outgoing")
    number = lambda c: F.lpad(c.cast("string"), 9, "0")
    return _records(e, "CDR", "event_id", a_party=F.concat(F.lit("+91-9"), number(F.col("user_id"))), b_party=F.concat(F.lit("09"), number((F.col("user_id") * 7 + F.col("event_id") % 3) % 150)), call_type=kind, start=_day("ts"), imei=F.concat(F.lit("35"), F.lpad((F.col("user_id") % 40).cast("string"), 12, "0"), F.lit("0")), imsi=F.when(F.col("event_type") == "view", F.concat(F.lit("404"), F.lpad(F.col("user_id").cast("string"), 12, "0"))), cell=F.concat(F.lit("C-"), F.col("event_id") % 20))


_CDR = """
c as (select event_id as row, date_trunc('second', ts) as ts, '9' || lpad(user_id::varchar, 9, '0') as a, '9' || lpad(((user_id * 7 + event_id % 3) % 150)::varchar, 9, '0') as b, event_type as t,
  '35' || lpad((user_id % 40)::varchar, 12, '0') as imei, case when event_type = 'view' then '404' || lpad(user_id::varchar, 12, '0') end as imsi, 'C-' || event_id % 20 as cell,
  case when event_type in ('view', 'purchase') then 'IN' when event_type in ('click', 'signup') then 'OUT' end as direction, case when event_type in ('purchase', 'signup') then 'SMS' else 'CALL' end as talk from events),
n as (select imei, imsi, n, count(*) as c, min(r) as r from (select imei, imsi, a as n, row * 2 as r from c union all select imei, imsi, b, row * 2 + 1 from c) group by all),
served as (select imei, imsi, arg_max(n, struct_pack(c := c, r := -r, n := n)) as subscriber from n group by all),
k as (select c.*, subscriber, case when subscriber = a then a when subscriber = b then b when direction = 'IN' then b else a end as owner from c join served s on c.imei = s.imei and c.imsi is not distinct from s.imsi)"""


@query(f"""with {_CDR} select row, talk as kind, ts, direction, [x for x in ['PHONE|' || a, 'PHONE|' || b, 'IMEI|' || imei, 'IMSI|' || imsi, 'CELL|' || cell] if x is not null] as nodes,
  list_sort([x for x in [case when a = b then null when direction = 'IN' then 'PHONE|' || b || ' ' || talk || ' PHONE|' || a else 'PHONE|' || a || ' ' || talk || ' PHONE|' || b end, 'PHONE|' || owner || ' USES_HANDSET IMEI|' || imei,
    'IMEI|' || imei || ' SIM_IN_HANDSET IMSI|' || imsi, 'PHONE|' || owner || ' USES_SIM IMSI|' || imsi, 'PHONE|' || owner || ' SEEN_AT_CELL CELL|' || cell] if x is not null]) as links from k""")
def c01_call_events(spark, sf):
    """Orientation, SMS and call, the handset's owner, and all links of call records."""
    return E.calls(cdr_records(spark, sf)).select("row", "kind", "ts", "direction", _nodes().alias("nodes"), _links().alias("links"))


@query(f"with {_CDR} select imei, imsi, subscriber from served")
def c02_serving_subscribers(spark, sf):
    """The number most often beside each handset and card; the first seen wins ties."""
    return E.serving(cdr_records(spark, sf)).select("imei", "imsi", "subscriber")


# ---- statements --------------------------------------------------------------------------------


def bank_records(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    way = k % 5
    paid = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.when(way == 0, "ATM WDL MAIN ROAD").when(way == 1, F.concat(F.lit("UPI/P2M/u"), F.col("o_custkey") % 50, F.lit("@okbank/shop"))).when(way == 2, "Binance top up").otherwise("NEFT")
    other = F.when(way >= 3, F.concat(F.lit("7000-"), F.lpad((F.col("o_custkey") % 90).cast("string"), 8, "0")))
    return _records(o, "BANK", k, account=F.concat(F.lit("5010 "), F.lpad(F.col("o_custkey").cast("string"), 8, "0")), start=_day("o_orderdate"), narration=text, debit=F.when(way != 4, F.concat(F.lit("Rs. "), paid)), credit=F.when(way == 4, paid), cp_account=other, holder=F.concat(F.lit("HOLDER "), F.lpad((F.col("o_custkey") % 30).cast("string"), 3, "x")), ref=F.concat(F.lit("R"), k))


_BANK = """
b as (select o_orderkey as row, o_orderkey % 5 as way, '5010' || lpad(o_custkey::varchar, 8, '0') as acct, o_orderdate as ts, cast(cast(o_totalprice as decimal(18, 2)) as double) as amount, o_custkey,
  case when o_orderkey % 5 = 4 then 'CR' else 'DR' end as direction, case when o_orderkey % 5 = 1 then 'UPI|u' || o_custkey % 50 || '@okbank' when o_orderkey % 5 >= 3 then 'ACCOUNT|7000' || lpad((o_custkey % 90)::varchar, 8, '0') end as other, 'PERSON|Holder ' || upper(left(lpad((o_custkey % 30)::varchar, 3, 'x'), 1)) || substr(lpad((o_custkey % 30)::varchar, 3, 'x'), 2) as holder from orders)"""


@query(f"""with {_BANK} select row, ts, amount, direction, 'R' || row as reference, way = 0 as cashout, way = 2 as crypto, 'ACCOUNT|' || acct as flow_node,
  list_sort([x for x in [case when other is null then null when direction = 'DR' then 'ACCOUNT|' || acct || ' FUNDS ' || other else other || ' FUNDS ACCOUNT|' || acct end, holder || ' HOLDS ACCOUNT|' || acct] if x is not null]) as links from b""")
def c03_statement_events(spark, sf):
    """Amounts, direction, cash and crypto tags, payment addresses in narrations and links of bank rows."""
    return E.statements(bank_records(spark, sf)).select("row", "ts", "amount", "direction", "reference", "cashout", "crypto", F.col("flow.node").alias("flow_node"), _links().alias("links"))


# ---- payments, sessions, chats, mails, complaints ------------------------------------------------


@query("""with p as (select o_orderkey as row, 'UPI|u' || o_custkey || '@okbank' as payer, 'UPI|shop' || o_custkey % 100 || '@ybl' as payee, case o_orderstatus when 'O' then 'SUCCESS' when 'F' then 'FAILED' else '' end as st,
  cast(cast(o_totalprice as decimal(18, 2)) as double) as amount, 'ACCOUNT|' || lpad(o_custkey::varchar, 10, '0') as account, 'DEVICE|D' || o_custkey % 60 as device from orders)
select row, amount, nullif(st, '') as status, case when st = 'FAILED' then ['status FAILED'] else [] end as flags,
  list_sort([x for x in [case when st <> 'FAILED' then payer || ' FUNDS ' || payee end, account || ' LINKED_VPA ' || payer, payer || ' USED_DEVICE ' || device] if x is not null]) as links from p""")
def c04_payment_events(spark, sf):
    """The status gate and the links of UPI rows."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "Success").when(F.col("o_orderstatus") == "F", "failed")
    who = F.concat(F.lit("U"), F.col("o_custkey"), F.lit("@okbank"))
    r = _records(o, "UPI", "o_orderkey", payer_vpa=who, payee_vpa=F.concat(F.lit("shop"), F.col("o_custkey") % 100, F.lit("@YBL")), status=status, amount=F.concat(F.lit("INR "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")), payer_account=F.lpad(F.col("o_custkey").cast("string"), 10, "0"), device_id=F.concat(F.lit("D"), F.col("o_custkey") % 60))
    return E.payments(r).select("row", "amount", "status", "flags", _links().alias("links"))


@query("""with s as (select event_id as row, 'PHONE|9' || lpad(user_id::varchar, 9, '0') as who, 'IP|49.36.' || user_id % 7 || '.' || event_id % 50 as pub, 'IP|10.0.0.' || user_id % 9 as prv, 'IP|45.1.2.' || event_id % 11 as dst, 'DOMAIN|h' || event_id % 13 || '.example.org' as host from events)
select row, [who, pub, prv, dst, host] as nodes, list_sort([who || ' USED_IP ' || pub, who || ' USED_IP ' || prv, who || ' CONNECTED_TO ' || host, pub || ' CONNECTED_TO ' || dst]) as links from s""")
def c05_session_events(spark, sf):
    """Subscribers, addresses and hosts of data sessions."""
    e = table(spark, sf, "events")
    r = _records(e, "IPDR", "event_id", a_party=F.concat(F.lit("9"), F.lpad(F.col("user_id").cast("string"), 9, "0")), public_ip=F.concat(F.lit("049.36."), F.col("user_id") % 7, F.lit("."), F.col("event_id") % 50), private_ip=F.concat(F.lit("10.0.0."), F.col("user_id") % 9), dest_ip=F.concat(F.lit("45.1.2."), F.col("event_id") % 11), host=F.concat(F.lit("https://H"), F.col("event_id") % 13, F.lit(".example.org/a/b")), start=_day("ts"))
    return E.data_sessions(r).select("row", _nodes().alias("nodes"), _links().alias("links"))


_PHRASES = " + ".join(f"case when contains(t, '{p}') then {w} else 0 end" for p, w in M.LURES.items())
_HITS = "[x for x in [" + ", ".join(f"case when contains(t, '{p}') then '{p}' end" for p, _ in sorted(M.LURES.items(), key=lambda x: -x[1])) + "] if x is not null]"
_BAIT = ("share otp and kyc", "urgent refund now", "digital arrest by cbi", "nothing here", "rent your account for commission")
_LURED = "select conv_id, turn, role, [" + ", ".join(f"'{b}'" for b in _BAIT) + "][turn % 5 + 1] || ' ' || lower(coalesce(text, '')) as t from conversations"


def _baited(spark, sf):
    bait = F.element_at(F.array(*map(F.lit, _BAIT)), (F.col("turn") % 5 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(bait, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


@query(f"with h as ({_LURED}) select conv_id, turn, 'PERSON|' || upper(left(role, 1)) || substr(role, 2) as sender, cast(round_even(100 * (1 - exp(-({_PHRASES}) / 12.0)), 0) as int) as lure_score from h")
def c06_chat_events(spark, sf):
    """Senders and lures of chat messages, by the whole lexicon."""
    r = _records(_baited(spark, sf), "CHAT", F.col("conv_id") * 1000 + F.col("turn"), sender=F.col("role"), text=F.col("text"))
    return E.chats(r).select(F.floor(F.col("row") / 1000).cast("long").alias("conv_id"), (F.col("row") % 1000).cast("long").alias("turn"), F.col("entities")[0]["node"].alias("sender"), "lure_score")


@query(f"with h as ({_LURED}) select conv_id, turn, {_HITS} as hits from h")
def t02a_lure_hits(spark, sf):
    """The phrases of the lexicon in each message, by weight."""
    return _baited(spark, sf).select("conv_id", "turn", M.lure(F.col("text"))["hits"].alias("hits"))


@query("""with m as (select c_custkey as row, 'EMAIL|c' || c_custkey || '@mail.example.com' as sender, 'mail.example.com' as dom, c_custkey % 3 as w, 'EMAIL|to' || c_nationkey || '@x.example.org' as rcpt, 'IP|49.36.' || c_nationkey || '.' || c_custkey % 200 as ip from customer)
select row, sender, rcpt as recipient, ip, list_sort([x for x in [case when w = 1 then 'Return-Path differs from sender' end, case when w = 2 then 'Reply-To differs from sender' end, case when w = 0 then 'sender authentication failed' end, case when row % 4 = 0 then 'display name claims a brand' end] if x is not null]) as flags,
  list_sort([x for x in [case when w = 1 then 'EMAIL|other@y.example.org SPOOFS ' || sender end, sender || ' ON_DOMAIN DOMAIN|' || dom, sender || ' EMAILED ' || rcpt, sender || ' SENT_FROM_IP ' || ip] if x is not null]) as links from m""")
def c07_mail_events(spark, sf):
    """Envelope checks, hops and links of mails."""
    c = table(spark, sf, "customer")
    k, way = F.col("c_custkey"), F.col("c_custkey") % 3
    own = F.concat(F.lit("c"), k, F.lit("@Mail.example.com"))
    ip = F.concat(F.lit("49.36."), F.col("c_nationkey"), F.lit("."), k % 200)
    r = _records(c, "EMAIL", k, "mail", **{"from": F.concat(F.when(k % 4 == 0, "SBI Alerts").otherwise("Someone"), F.lit(" <"), own, F.lit(">"))}, return_path=F.concat(F.lit("<"), F.when(way == 1, "other@y.example.org").otherwise(own), F.lit(">")), reply_to=F.when(way == 2, "else@z.example.org"), to=F.concat(F.lit("to"), F.col("c_nationkey"), F.lit("@x.example.org")), subject=F.lit("a note"), body=F.lit("plain words"), received=F.concat(F.lit("from a ["), ip, F.lit("] by b")), auth=F.when(way == 0, "mx; spf=softfail; dkim=pass").otherwise("mx; spf=pass"))
    pick = lambda role: F.get(F.filter("entities", lambda e: e["role"] == role), F.lit(0))["node"]
    return E.mails(r).filter("kind = 'EMAIL'").select("row", pick("sender").alias("sender"), pick("recipient").alias("recipient"), pick("originating_ip").alias("ip"), F.array_sort("flags").alias("flags"), _links().alias("links"))


@query("""with v as (select c_custkey as row, 'PERSON|Customer#' || lpad(c_custkey::varchar, 9, '0') as who, 'PHONE|9' || lpad(c_custkey::varchar, 9, '0') as phone, 'ACCOUNT|' || lpad(c_custkey::varchar, 12, '0') as acct, 'UPI|c' || c_custkey || '@okbank' as upi, abs(cast(cast(c_acctbal as decimal(18, 2)) as double)) as amount from customer)
select row, [who, phone, acct, upi] as victims, amount, list_sort([who || ' HOLDS ' || phone, who || ' HOLDS ' || acct, who || ' HOLDS ' || upi, acct || ' LINKED_VPA ' || upi]) as links from v""")
def c08_complaint_events(spark, sf):
    """Victims and their identifiers in complaints."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    r = _records(c, "COMPLAINT", "c_custkey", "complaint", name=F.col("c_name"), phone=F.concat(F.lit("+91 9"), F.lpad(k, 9, "0")), account=F.lpad(k, 12, "0"), upi=F.concat(F.lit("C"), k, F.lit("@okbank")), amount=F.concat(F.lit("₹ "), F.abs(F.col("c_acctbal").cast("decimal(18,2)")).cast("string")), ack=k)
    return E.complaints(r).select("row", F.transform(F.filter("entities", lambda e: e["victim"]), lambda e: e["node"]).alias("victims"), "amount", _links().alias("links"))


_DUMP = "select p_partkey as row, 'com.app' || p_partkey % 70 as package, ['READ_SMS', 'RECEIVE_SMS', 'SEND_SMS', 'BIND_ACCESSIBILITY_SERVICE', 'SYSTEM_ALERT_WINDOW', 'CALL_PHONE'][1:p_partkey % 7] as perms, case p_partkey % 3 when 0 then 'com.android.vending' when 1 then 'unknown' end as installer from part"
_WEIGH = " + ".join(f"case when list_contains(perms, '{p}') then {w} else 0 end" for p, w in M.PERMISSIONS.items())


@query(f"""with d as ({_DUMP}), r as (select *, {_WEIGH} + case when len(perms) >= 4 then 12 else 0 end + case when len(perms) >= 5 then 5 else 0 end + case when installer is null then 5 when installer = 'unknown' then 8 else 0 end as raw from d),
s as (select *, cast(round_even(100 * (1 - exp(-raw / 22.0)), 0) as int) as risk from r) select row, 'APK|' || package as node, risk, case when risk >= 55 then ['package of high risk'] else [] end as flags, ['IMEI|35' || lpad((row % 50)::varchar, 12, '0') || ' INSTALLED APK|' || package] as links from s""")
def c09_package_events(spark, sf):
    """Risk and links of packages in a device dump."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    perms = F.slice(F.array(*map(F.lit, ("READ_SMS", "RECEIVE_SMS", "SEND_SMS", "BIND_ACCESSIBILITY_SERVICE", "SYSTEM_ALERT_WINDOW", "CALL_PHONE"))), F.lit(1), (k % 7).cast("int"))
    r = _records(p, "ANDROID", k, "package", package=F.concat(F.lit("Com.App"), k % 70), permissions=F.array_join(F.transform(perms, lambda x: F.concat(F.lit("android.permission."), x)), "\n"), installer=F.when(k % 3 == 0, "com.android.vending").when(k % 3 == 1, "unknown"), imei=F.concat(F.lit("35"), F.lpad((k % 50).cast("string"), 12, "0"), F.lit("1")))
    pick = F.get(F.filter("entities", lambda e: e["type"] == "APK"), F.lit(0))
    return E.devices(r).filter("kind = 'APP_INSTALL'").select("row", pick["node"].alias("node"), F.col("apk_risk").alias("risk"), "flags", _links().alias("links"))


# ---- files -------------------------------------------------------------------------------------


@query("""select 'CDR' as kind, 'EX-001' as exhibit, '9' || lpad(c_custkey::varchar, 9, '0') as a_party, '8' || lpad(c_nationkey::varchar, 9, '0') as b_party, c_custkey::varchar as duration, c_mktsegment as call_type from customer""")
def x01_delimited_exhibit(spark, sf):
    """A semicolon file through the manifest, the sniffed delimiter, the header, its type and its records."""
    c = table(spark, sf, "customer")
    rows = c.select(F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("Calling Party No."), F.concat(F.lit("8"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("Called-Number"), F.col("c_custkey").alias("Duration (sec)"), F.col("c_mktsegment").alias("Call Type"))
    path = f"{home(spark)}/exhibit-{rows.semanticHash() & 0xFFFFFFFF:x}"
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    got = X.records(X.manifest(spark, path))
    return got.select("kind", "exhibit", *(F.element_at("fields", f).alias(f) for f in ("a_party", "b_party", "duration", "call_type")))


@query("""select '9' || lpad(c_custkey::varchar, 9, '0') as a_party, '8' || lpad(c_nationkey::varchar, 9, '0') as b_party, c_mktsegment as call_type from customer""")
def x02_large_delimited(spark, sf):
    """The same by Spark's own reader, for tables of any size."""
    c = table(spark, sf, "customer")
    rows = c.select(F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("Calling Party No."), F.concat(F.lit("8"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("Called-Number"), F.col("c_mktsegment").alias("Call Type"))
    path = f"{home(spark)}/large-{rows.semanticHash() & 0xFFFFFFFF:x}"
    rows.write.mode("overwrite").option("header", True).option("sep", "|").csv(path)
    return X.read_delimited(spark, path).select("a_party", "b_party", "call_type")


# ---- cases -------------------------------------------------------------------------------------


def bank_case(spark: SparkSession, sf: str) -> Case:
    return Case.of_events(spark, E.numbered(E.statements(bank_records(spark, sf))))


_EV = "'EX-001-' || row || '-0'"


@query(f"""with {_BANK}, o as (select 'ACCOUNT|' || acct as node, 'subject_account' as role, row, ts from b union all select other, case when way = 1 then 'counterparty_vpa' else 'counterparty_account' end, row, ts from b where other is not null union all select holder, 'account_holder', row, ts from b)
select node, split_part(node, '|', 1) as type, list_sort(list(distinct role)) as roles, count(distinct row) as events, min(ts) as first, max(ts) as last from o group by node""")
def k10_case_nodes(spark, sf):
    """The node rollup of a case of statements."""
    return bank_case(spark, sf).nodes.select("node", "type", "roles", "events", "first", "last")


@query(f"""with {_BANK}, l as (select case when direction = 'DR' then 'ACCOUNT|' || acct else other end as src, case when direction = 'DR' then other else 'ACCOUNT|' || acct end as dst, row, ts, amount from b where other is not null),
m as (select *, coalesce(epoch_us(ts) // 60000000 - lag(epoch_us(ts) // 60000000) over (partition by src, dst, cast(amount as decimal(18, 2)) order by ts, row) <= 1, false) as twice from l)
select src, dst, count(*) as count, count(*) filter (twice) as corroborated, cast(sum(cast(amount as decimal(18, 2))) filter (not twice) as double) as amount, min(ts) as first, max(ts) as last from m group by src, dst""")
def k11_case_fund_edges(spark, sf):
    """The fund edges of a case of statements."""
    return bank_case(spark, sf).edges.filter("rel = 'FUNDS'").select("src", "dst", "count", "corroborated", "amount", "first", "last")


@query(f"""with {_BANK} select 'ACCOUNT|' || acct as node, case when way = 2 then 'CRYPTO' else 'CASH' end as mode, count(*) as count, cast(sum(cast(amount as decimal(18, 2))) as double) as amount, min(ts) as first, max(ts) as last
from (select *, row_number() over (partition by acct, cast(amount as decimal(18, 2)), ts order by row) as copy from b where way in (0, 2)) where copy = 1 group by 1, 2""")
def k12_case_cash_outs(spark, sf):
    """Withdrawals by node, with their span."""
    return bank_case(spark, sf).cash_totals


@query(f"""with {_BANK} select 'TXN' as kind, count(*) as events, min(ts) as first, max(ts) as last, (select count(distinct x) from (select 'ACCOUNT|' || acct as x from b union all select other from b union all select holder from b)) as entities from b""")
def k13_case_summary(spark, sf):
    """Events and entities of a case by kind."""
    return bank_case(spark, sf).summary()


@query(f"""with {_BANK}, w as (select row, ts, 3 + 2 * case when way in (0, 2) then 1 else 0 end as weight from b order by weight desc, row limit 40) select {_EV} as event_id, ts, cast(weight as double) as weight from w""")
def k14_case_timeline(spark, sf):
    """The 40 heaviest events of a case, in order of time."""
    return bank_case(spark, sf).timeline().select("event_id", "ts", F.col("weight").cast("double").alias("weight"))


@query(f"""with {_BANK}, l as (select 'ACCOUNT|' || acct as src, other as dst, row from b where direction = 'DR' and other is not null union all select other, 'ACCOUNT|' || acct, row from b where direction = 'CR'),
g as (select dst as entity, list_sort(list(distinct src)) as members from l where src <> dst group by dst having count(distinct src) >= 3),
t as (select dst as node, src as other, row from l union all select src, dst, row from l),
e as (select distinct entity, members, row from t join g on node = entity and list_contains(members, other)),
k as (select *, row_number() over (partition by entity order by row) as k from e)
select 'FAN-IN-' || entity as code, any_value(members) as members, list({_EV} order by row) as evidence from k where k <= 50 group by entity""")
def k15_fan_in_evidence(spark, sf):
    """Collectors with the first 50 events that show each with a payer."""
    from tracewell.operators import rules as R

    case = bank_case(spark, sf)
    found = materialize(R.fan_in(case.links.select("src", "dst", "rel").distinct()))
    return R.evidence(found, case.observations).select("code", "members", "evidence")


@query(f"""with {_BANK} select row, cast(row_number() over (order by ts, row) as bigint) as ordinal from b""")
def k16_case_ordinals(spark, sf):
    """The place of each event in order of time."""
    return E.ordinals(bank_case(spark, sf).events).select("row", F.col("ordinal").cast("long").alias("ordinal"))

"""Records of exhibits as canonical events, by column expressions alone.

Event: ``event_id, kind, ts, exhibit, source, row, seq, amount, direction, rail, reference, status,
narration, cashout, crypto, text, lure_score, apk_risk, flow, entities, links, flags``.  An entity is
``node, type, value, role, victim, reported, sha256, risk``; a link ``src, dst, rel, directed, amount``.
``event_id`` comes from the place in the exhibit, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import normalize as N
from tracewell.functions import textmine as M
from tracewell.storage import materialize

# Words of a narration that tell cash withdrawals and exchanges for crypto-currency.
CASH = ("atm", "cash wdl", "cash withdrawal", "cwdr", "nwd", "cash-wdl", "atw", "cashpoint", "wdl", "cash dep")
CRYPTO = ("binance", "wazirx", "coindcx", "crypto", "usdt", "bitcoin", "p2p")
PAID = ("", "SUCCESS", "S", "COMPLETED", "OK", "00")
INWARD = "(^|[^a-z])(incoming|inbound|terminating|in|mtc|mt|smt|rcvd|received)([^a-z]|$)"
OUTWARD = "(^|[^a-z])(outgoing|outbound|originating|out|moc|mo|smo|sent|dialled|dialed)([^a-z]|$)"
BRANDS_IN_NAMES = ("sbi", "hdfc", "icici", "axis", "kotak", "paytm", "npci", "rbi")


def field(name: str) -> Column:
    return F.nullif(F.trim(F.element_at("fields", name)), F.lit(""))


def entity(kind: str, value: Column, role: Column | str, *, victim: bool = False, reported: bool = False, sha256: Column | None = None, risk: Column | None = None) -> Column:
    """An entity, or null where the value is."""
    role = F.lit(role) if isinstance(role, str) else role
    parts = F.struct(N.node_id(kind, value).alias("node"), F.lit(kind).alias("type"), value.alias("value"), role.alias("role"), F.lit(victim).alias("victim"), F.lit(reported).alias("reported"), (sha256 if sha256 is not None else F.lit(None)).cast("string").alias("sha256"), (risk if risk is not None else F.lit(None)).cast("int").alias("risk"))
    return F.when(value.isNotNull(), parts)


def link(src: Column, dst: Column, rel: Column | str, directed: bool = True, amount: Column | None = None) -> Column:
    """A link of two entities, or null where one is missing or both are the same."""
    a, b = src["node"], dst["node"]
    rel = F.lit(rel) if isinstance(rel, str) else rel
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.struct(a.alias("src"), b.alias("dst"), rel.alias("rel"), F.lit(directed).alias("directed"), (amount if amount is not None else F.lit(None)).cast("double").alias("amount")))


def _hold(df: DataFrame, *made: Column) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns that are computed once a row, however often they are read, and these."""
    names = [f"_{len(df.columns) + i}" for i in range(len(made))]
    return df.withColumns(dict(zip(names, made, strict=True))), [F.col(n) for n in names]


def _entities(df: DataFrame, *told: tuple) -> tuple[DataFrame, list[Column]]:
    """As ``_hold``, of entities told by the arguments of ``entity``; values are normalised once."""
    df, values = _hold(df, *(v for _, v, *_ in told))
    return _hold(df, *(entity(t[0], v, *t[2:]) for t, v in zip(told, values, strict=True)))


def _keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by held columns; it stays above what computes them, as that isn't deterministic."""
    return df.withColumn("_task", F.spark_partition_id()).filter(condition & (F.col("_task") >= 0))


def _many(kind: str, values: Column, role: str) -> Column:
    return F.transform(values, lambda v: entity(kind, v, role))


def _fan(src: Column, many: Column, rel: str, directed: bool = True) -> Column:
    return F.transform(many, lambda e: link(src, e, rel, directed))


def _event(df: DataFrame, kind: Column | str, entities: list[Column], links: list[Column], more_entities: list[Column] = (), more_links: list[Column] = (), **columns: Column) -> DataFrame:
    nothing = {"amount": "double", "direction": "string", "rail": "string", "reference": "string", "status": "string", "narration": "string", "cashout": "boolean", "crypto": "boolean", "text": "string", "lure_score": "int", "apk_risk": "int", "flow": "struct<node:string,direction:string,amount:double>", "flags": "array<string>"}
    ts = F.col("ts")
    made = {k: columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in nothing.items()}
    ents = F.filter(F.concat(F.array(*entities), *more_entities), lambda e: e.isNotNull())
    lnks = F.filter(F.concat(F.array(*links), *more_links) if links or more_links else F.array().cast("array<struct<src:string,dst:string,rel:string,directed:boolean,amount:double>>"), lambda x: x.isNotNull())
    return df.select("exhibit", "source", "row", "sub", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), ts.alias("ts"), *made.values(), ents.alias("entities"), lnks.alias("links"))


def _flags(*pairs: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs)))


def _hosts(urls: Column, role: str) -> Column:
    return _many("DOMAIN", F.array_distinct(F.transform(urls, M.host_of)), role)


def serving(cdr: DataFrame) -> DataFrame:
    """``exhibit, imei, imsi, subscriber``: the ten-digit number most often beside a handset and card; the first seen wins ties."""
    sides = cdr.select("exhibit", "row", N.norm_imei(field("imei")).alias("imei"), N.norm_imsi(field("imsi")).alias("imsi"), F.posexplode(F.array(N.norm_msisdn(field("a_party")), N.norm_msisdn(field("b_party")))).alias("side", "n"))
    count = sides.filter("(imei is not null or imsi is not null) and n rlike '^[0-9]{10}$'").groupBy("exhibit", "imei", "imsi", "n").agg(F.count("*").alias("c"), F.min(F.col("row").cast("bigint") * 2 + F.col("side")).alias("r"))
    return count.groupBy("exhibit", "imei", "imsi").agg(F.max_by("n", F.struct(F.col("c"), -F.col("r"), F.col("n"))).alias("subscriber"))


def calls(records: DataFrame) -> DataFrame:
    cdr = records.filter("kind = 'CDR'")
    s = serving(cdr).withColumnsRenamed({"exhibit": "_x", "imei": "_imei", "imsi": "_imsi"})
    k = cdr.withColumns({"a": N.norm_msisdn(field("a_party")), "b": N.norm_msisdn(field("b_party")), "imei": N.norm_imei(field("imei")), "imsi": N.norm_imsi(field("imsi")), "t": F.lower(F.coalesce(field("call_type"), F.lit("")))})
    k = k.filter("a is not null or b is not null").join(s, (F.col("exhibit") == F.col("_x")) & F.col("imei").eqNullSafe(F.col("_imei")) & F.col("imsi").eqNullSafe(F.col("_imsi")), "left")
    direction = F.when(F.col("t").rlike(INWARD), "IN").when(F.col("t").rlike(OUTWARD), "OUT")
    sms = F.col("t").contains("sms") | F.col("t").isin("s", "smt", "smo") | F.col("t").contains("message")
    k, (direction, sms, text, raw) = _hold(k, direction, sms, field("sms_text"), field("imei"))
    inward = F.coalesce(direction == "IN", F.lit(False))
    k, (a, b, imei, imsi, cell) = _entities(k, ("PHONE", F.col("a"), "a_party"), ("PHONE", F.col("b"), "b_party"), ("IMEI", F.col("imei"), "handset"), ("IMSI", F.col("imsi"), "sim"), ("CELL", field("cell"), "cell"))
    owner = F.when(F.col("subscriber") == F.col("a"), a).when(F.col("subscriber") == F.col("b"), b).when(inward, F.coalesce(b, a)).otherwise(F.coalesce(a, b))
    k, (owner, urls, lure) = _hold(k, owner, M.indicators(text)["urls"], M.lure(text)["score"])
    k, (hosts,) = _hold(k, _hosts(urls, "linked_domain"))
    talk = F.when(sms, "SMS").otherwise("CALL")
    flags = _flags(((F.length(N.digits(raw)) == 15) & ~N.luhn_ok(raw), "IMEI fails its check digit"), (lure >= 35, "lure in SMS"), (F.exists(urls, lambda u: F.size(M.url_risk(u)) > 0), "risky link in SMS"))
    return _event(k, talk, [a, b, imei, imsi, cell], [F.when(inward, link(b, a, talk)).otherwise(link(a, b, talk)), link(owner, imei, "USES_HANDSET"), link(imei, imsi, "SIM_IN_HANDSET"), link(owner, imsi, "USES_SIM"), link(owner, cell, "SEEN_AT_CELL")], [hosts], [_fan(owner, hosts, "SENT_LINK")], direction=direction, text=text, lure_score=F.when(text.isNotNull(), lure), flags=flags)


def data_sessions(records: DataFrame) -> DataFrame:
    k = records.filter("kind = 'IPDR'")
    k, (site,) = _hold(k, field("host"))
    told = [("PHONE", N.norm_msisdn(field("a_party")), "subscriber"), *(("IP", N.norm_ip(field(f)), f) for f in ("public_ip", "private_ip", "dest_ip"))]
    k, (who, public, private, target, imei, imsi, host) = _entities(k, *told, ("IMEI", N.norm_imei(field("imei")), "handset"), ("IMSI", N.norm_imsi(field("imsi")), "sim"), ("DOMAIN", F.when(site.isNotNull(), M.host_of(site)), "destination"))
    k = _keep(k, who.isNotNull() | public.isNotNull() | private.isNotNull() | target.isNotNull() | site.isNotNull())
    flags = _flags((site.isNotNull() & (F.size(M.url_risk(site)) > 0), "risky destination"))
    return _event(k, "DATA_SESSION", [who, public, private, target, imei, imsi, host], [link(who, public, "USED_IP"), link(who, private, "USED_IP"), link(who, imei, "USES_HANDSET"), link(imei, imsi, "SIM_IN_HANDSET"), link(who, host, "CONNECTED_TO"), link(public, target, "CONNECTED_TO")], flags=flags)


def statements(records: DataFrame) -> DataFrame:
    """Bank rows; a statement that names its account once lends it to its other rows."""
    bank = records.filter("kind = 'BANK'").withColumn("_own", N.norm_account(field("account"))["key"])
    first = bank.groupBy("exhibit").agg(F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("row"))).alias("_file"))
    k = bank.join(F.broadcast(first), "exhibit").withColumn("acct", F.coalesce("_own", "_file"))
    k = k.withColumns({"d": N.parse_amount(field("debit")), "_c": N.parse_amount(field("credit")), "m": N.parse_amount(field("amount")), "tt": F.upper(F.coalesce(field("txn_type"), F.lit("")))})
    k = k.withColumn("c", F.when((F.col("d") != 0) & F.col("d").eqNullSafe(F.col("_c")), None).otherwise(F.col("_c")))
    debit, credit = F.coalesce(F.col("d") != 0, F.lit(False)), F.coalesce(F.col("c") != 0, F.lit(False))
    dr = F.when(debit, "DR").when(credit, "CR").when(F.col("tt").rlike("^(D|W$)"), "DR").when(F.col("tt").startswith("C"), "CR").when(F.col("m") < 0, "DR").otherwise("CR")
    value = F.abs(F.when(debit, F.col("d")).when(credit, F.col("c")).otherwise(F.col("m")))
    k = _keep(k.withColumns({"dr": dr, "value": value}), F.col("value") != 0)
    k, (text, low) = _hold(k, field("narration"), F.lower(F.coalesce(field("narration"), F.lit(""))))
    token = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\\s/|,;]+"), N.norm_upi), lambda v: v.isNotNull()), F.lit(0))
    k, (token,) = _hold(k, token)
    vpa = F.coalesce(token, F.get(M.indicators(text)["vpas"], F.lit(0)))
    told = (("ACCOUNT", F.col("acct"), "subject_account"), ("ACCOUNT", N.norm_account(field("cp_account"))["key"], "counterparty_account"), ("UPI", vpa, "counterparty_vpa"), ("PERSON", F.initcap(field("cp_name")), "counterparty"), ("PERSON", F.initcap(field("holder")), "account_holder"))
    k, (own, cp, via, person, holder, ip, mobile) = _entities(k, *told, ("IP", N.norm_ip(field("ip_addr")), "txn_ip"), ("PHONE", N.norm_msisdn(field("mobile")), "registered_mobile"))
    cash = reduce(lambda x, t: x | low.contains(t), CASH, F.lower(F.coalesce(field("channel"), F.lit(""))).isin("atm", "cash"))
    crypto = reduce(lambda x, t: x | low.contains(t), CRYPTO, F.lit(False))
    k, (other, cash, crypto) = _hold(k, F.coalesce(cp, via), cash, crypto)
    paid = F.when(F.col("dr") == "DR", link(own, other, "FUNDS", True, F.col("value"))).otherwise(link(other, own, "FUNDS", True, F.col("value")))
    flow = F.when(F.col("acct").isNotNull(), F.struct(own["node"].alias("node"), F.col("dr").alias("direction"), F.col("value").alias("amount")))
    return _event(k, "TXN", [own, cp, via, person, holder, ip, mobile], [paid, link(cp, via, "LINKED_VPA", False), link(person, other, "HOLDS", False), link(holder, own, "HOLDS", False), link(own, ip, "TXN_FROM_IP"), link(mobile, own, "REGISTERED_ON", False)], amount=F.col("value"), direction=F.col("dr"), rail=F.lit("BANK"), reference=field("ref"), narration=text, cashout=cash, crypto=crypto, flow=flow, flags=_flags((cash, "cash withdrawal"), (crypto, "exchange for crypto-currency")))


def payments(records: DataFrame) -> DataFrame:
    """UPI rows; only successful ones move funds."""
    k = records.filter("kind = 'UPI'").withColumns({"payer": N.norm_upi(field("payer_vpa")), "payee": N.norm_upi(field("payee_vpa")), "value": F.abs(N.parse_amount(field("amount"))), "st": F.upper(F.coalesce(field("status"), F.lit("")))})
    k = _keep(k, F.col("payer").isNotNull() | F.col("payee").isNotNull())
    told = [("UPI", F.col("payer"), "payer_vpa"), ("UPI", F.col("payee"), "payee_vpa"), *(("ACCOUNT", N.norm_account(field(f))["key"], f) for f in ("payer_account", "payee_account")), *(("PHONE", N.norm_msisdn(field(f)), f) for f in ("payer_mobile", "payee_mobile")), *(("PERSON", F.initcap(field(f)), f) for f in ("payer_name", "payee_name"))]
    k, (payer, payee, pa, ea, pm, em, pn, en, ip, device) = _entities(k, *told, ("IP", N.norm_ip(field("ip_addr")), "txn_ip"), ("DEVICE", field("device_id"), "device"))
    ok = F.col("st").isin(*PAID)
    links = [F.when(ok, link(payer, payee, "FUNDS", True, F.col("value"))), link(pn, payer, "HOLDS", False), link(en, payee, "HOLDS", False), link(pa, payer, "LINKED_VPA", False), link(ea, payee, "LINKED_VPA", False), link(pm, payer, "REGISTERED_ON", False), link(em, payee, "REGISTERED_ON", False), link(payer, ip, "TXN_FROM_IP"), link(payer, device, "USED_DEVICE")]
    return _event(k, "TXN", [payer, payee, pa, ea, pm, em, pn, en, ip, device], links, amount=F.col("value"), direction=F.lit("DR"), rail=F.lit("UPI"), reference=field("ref"), status=F.nullif(F.col("st"), F.lit("")), narration=field("narration"), flags=_flags((~ok, F.concat(F.lit("status "), F.col("st")))))


def mails(records: DataFrame) -> DataFrame:
    k = records.filter("kind = 'EMAIL'")
    addr = lambda c: N.norm_email(F.coalesce(F.nullif(F.regexp_extract(c, "<([^>]+)>", 1), F.lit("")), c))
    k, (sender, back, reply) = _entities(k, *(("EMAIL", addr(field(f)), r) for f, r in (("from", "sender"), ("return_path", "return_path"), ("reply_to", "reply_to"))))
    back = F.when(~back["value"].eqNullSafe(sender["value"]), back)
    reply = F.when(sender.isNotNull() & ~reply["value"].eqNullSafe(sender["value"]), reply)
    to = F.filter(F.transform(F.split(F.coalesce(field("to"), F.lit("")), "[,;]"), addr), lambda v: v.isNotNull())
    body = F.concat_ws("\n", field("subject"), field("body"), M.plain_text(field("html")))
    hops = F.filter(F.transform(F.regexp_extract_all(F.coalesce(field("received"), F.lit("")), F.lit("\\[?((?:\\d{1,3}\\.){3}\\d{1,3})\\]?"), F.lit(1)), N.norm_ip), lambda v: v.isNotNull())
    first = N.norm_ip(F.regexp_replace(F.coalesce(field("origin_ip"), F.lit("")), "[\\[\\] ]", ""))
    k, (back, reply, to, body, hops, first) = _hold(k, back, reply, to, body, hops, first)
    found = M.indicators(body)
    domain = entity("DOMAIN", F.when(sender.isNotNull(), F.substring_index(sender["value"], "@", -1)), "sender_domain")
    k, (recipients, ips, domain, urls, phones, vpas, score) = _hold(k, _many("EMAIL", to, "recipient"), _many("IP", F.array_distinct(F.filter(F.concat(F.array(first), hops), lambda v: v.isNotNull())), "originating_ip"), domain, found["urls"], _many("PHONE", found["phones"], "contact_in_body"), _many("UPI", found["vpas"], "vpa_in_body"), M.lure(body)["score"])
    k, (hosts,) = _hold(k, _hosts(urls, "payload_host"))
    fails = F.lower(F.coalesce(field("auth"), F.lit(""))).rlike("\\b(spf|dkim|dmarc)\\s*=\\s*(fail|softfail|none|permerror|temperror|neutral)\\b")
    k, (shown,) = _hold(k, F.lower(F.regexp_extract(F.coalesce(field("from"), F.lit("")), "^\\s*\"?([^\"<]+)\"?\\s*<", 1)))
    claims = reduce(lambda x, b: x | (shown.contains(b) & ~domain["value"].contains(b)), BRANDS_IN_NAMES, F.lit(False))
    flags = _flags((back.isNotNull(), "Return-Path differs from sender"), (reply.isNotNull(), "Reply-To differs from sender"), (fails, "sender authentication failed"), (F.coalesce(claims, F.lit(False)), "display name claims a brand"), (score >= 40, "lure in mail"), (F.exists(urls, lambda u: F.size(M.url_risk(u)) > 0), "risky link in mail"))
    mail = _event(k.filter("part = 'mail'"), "EMAIL", [sender, back, reply, domain], [link(back, sender, "SPOOFS", False), link(sender, domain, "ON_DOMAIN", False)], [recipients, ips, hosts, phones, vpas], [_fan(sender, recipients, "EMAILED"), _fan(sender, ips, "SENT_FROM_IP"), _fan(sender, hosts, "LINKS_TO"), _fan(sender, phones, "MENTIONS"), _fan(sender, vpas, "MENTIONS")], text=body, lure_score=score, flags=flags)
    name = F.lower(field("filename"))
    apk = entity("APK", F.when(name.endswith(".apk"), name), "attachment", sha256=field("sha256"))
    return mail.unionByName(_event(k.filter("part = 'attachment'"), "APP_INSTALL", [apk, F.when(apk.isNotNull(), sender)], [link(sender, apk, "DELIVERED")], flags=_flags((apk.isNotNull(), "package attached to mail"))))


def devices(records: DataFrame) -> DataFrame:
    k = records.filter("kind = 'ANDROID'")
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda v: F.trim(v) != "")
    k, (imeis,) = _hold(k, _many("IMEI", F.array_distinct(F.filter(F.transform(listed(field("imei")), N.norm_imei), lambda v: v.isNotNull())), "device_imei"))
    k, (wifi, blue, aid, phone, imsi) = _entities(k, ("MAC", N.norm_mac(field("wifi_mac")), "wifi_mac"), ("MAC", N.norm_mac(field("bluetooth_mac")), "bluetooth_mac"), ("DEVICE", field("android_id"), "android_id"), ("PHONE", N.norm_msisdn(field("msisdn")), "device_msisdn"), ("IMSI", N.norm_imsi(field("imsi")), "device_imsi"))
    each = lambda to, rel, directed=True, back=False: F.transform(imeis, lambda e: link(to, e, rel, directed) if back else link(e, to, rel, directed))
    device = _event(k.filter("part = 'device'"), "DEVICE", [wifi, blue, aid], [], [imeis], [each(wifi, "DEVICE_INTERFACE", False), each(blue, "DEVICE_INTERFACE", False), each(aid, "DEVICE_INTERFACE", False)], flags=_flags((F.exists(listed(field("imei")), lambda v: (F.length(N.digits(v)) == 15) & ~N.luhn_ok(v)), "IMEI fails its check digit")))
    sim = _event(k.filter("part = 'sim'"), "DEVICE", [phone, imsi], [link(phone, imsi, "USES_SIM")], [imeis], [each(phone, "USES_HANDSET", back=True), each(imsi, "SIM_IN_HANDSET")])
    p, (name, perms) = _hold(k.filter("part = 'package'").filter(field("package").isNotNull()), field("package"), F.filter(F.split(F.coalesce(field("permissions"), F.lit("")), "[,\\s]+"), lambda v: v != ""))
    p, (risk, hosts) = _hold(p, M.apk_risk(name, perms, field("installer"), listed(field("flags"))), _hosts(listed(field("hosts")), "c2_endpoint"))
    p, (apk,) = _hold(p, entity("APK", F.lower(name), "package", sha256=N.norm_sha256(field("sha256")), risk=risk))
    package = _event(p, "APP_INSTALL", [apk], [link(aid, apk, "INSTALLED")], [imeis, F.array_compact(F.array(aid)), hosts], [each(apk, "INSTALLED"), _fan(apk, hosts, "CONTACTS")], apk_risk=risk, flags=_flags((risk >= 55, "package of high risk"), (F.size(hosts) > 0, "package contacts a host")))
    sent = F.lower(F.coalesce(field("folder"), F.lit(""))).isin("sent", "outbox", "2", "outgoing")
    peer = entity("PHONE", N.norm_msisdn(field("address")), F.when(sent, "sms_recipient").otherwise("sms_peer"))
    found = M.indicators(field("body"))
    links_to = _hosts(found["urls"], "sms_link")
    score = M.lure(field("body"))["score"]
    sms = _event(k.filter("part = 'sms'"), "SMS", [peer], [], [links_to, _many("UPI", found["vpas"], "vpa_in_sms")], [_fan(peer, links_to, "SENT_LINK")], text=field("body"), lure_score=score, flags=_flags((score >= 40, "lure in SMS"), (sent & (score >= 40), "lure sent from this device")))
    host = entity("DOMAIN", F.when(field("url").isNotNull(), M.host_of(field("url"))), "visited")
    visit = _event(k.filter("part = 'visit'"), "DATA_SESSION", [host], [], [imeis], [each(host, "CONNECTED_TO")], flags=_flags((F.size(M.url_risk(field("url"))) > 0, "risky visit")))
    return device.unionByName(sim).unionByName(package).unionByName(sms).unionByName(visit).unionByName(_logs(records))


def _logs(records: DataFrame) -> DataFrame:
    k = records.filter("kind = 'ANDROID_LOG'")
    text = F.coalesce(field("text"), F.lit(""))
    imeis = _many("IMEI", F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)(?:imei|device\\s*id)\\D{0,12}(\\d{14,16})"), F.lit(1)), N.norm_imei)), "device_imei")
    macs = _many("MAC", F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)(?:hwaddr|mac|wlan0)\\D{0,12}([0-9a-f]{2}(?::[0-9a-f]{2}){5})"), F.lit(1)), N.norm_mac)), "wifi_mac")
    apks = _many("APK", M.indicators(text)["packages"], "package")
    cross = lambda many, rel, directed: F.flatten(F.transform(imeis, lambda e: F.transform(many, lambda m: link(e, m, rel, directed))))
    return _event(k, "DEVICE", [], [], [imeis, macs, apks], [cross(macs, "DEVICE_INTERFACE", False), cross(apks, "INSTALLED", True)], text=text)


def chats(records: DataFrame) -> DataFrame:
    k = records.filter("kind = 'CHAT'")
    number = F.when(field("sender").rlike("\\d{4}"), N.norm_msisdn(field("sender")))  # a name is not a sender id here
    k, (number, text) = _hold(k, number, field("text"))
    found = M.indicators(text)
    k, (sender, phones, vpas, accounts, urls, emails, score) = _hold(k, F.coalesce(entity("PHONE", number, "chat_sender"), entity("PERSON", F.initcap(field("sender")), "chat_sender")), _many("PHONE", found["phones"], "phone_in_chat"), _many("UPI", found["vpas"], "vpa_in_chat"), _many("ACCOUNT", found["accounts"], "account_in_chat"), found["urls"], found["emails"], M.lure(text)["score"])
    k, (hosts,) = _hold(k, _hosts(urls, "url_in_chat"))
    flags = _flags((F.size(vpas) > 0, "payment address in chat"), (F.size(accounts) > 0, "account number in chat"), (score >= 40, "lure in chat"), (F.exists(urls, lambda u: F.size(M.url_risk(u)) > 0), "risky link in chat"))
    return _event(k, "CHAT", [sender], [], [phones, vpas, accounts, hosts, _many("EMAIL", emails, "email_in_chat")], [_fan(sender, phones, "MENTIONS"), _fan(sender, vpas, "MENTIONS"), _fan(sender, accounts, "MENTIONS"), _fan(sender, hosts, "SENT_LINK")], text=text, lure_score=score, flags=flags)


def complaints(records: DataFrame) -> DataFrame:
    k = records.filter("kind = 'COMPLAINT'")
    ids = (("PHONE", N.norm_msisdn, "phone"), ("ACCOUNT", lambda c: N.norm_account(c)["key"], "account"), ("UPI", N.norm_upi, "upi"), ("EMAIL", N.norm_email, "email"))
    v, values = _hold(k.filter("part = 'complaint'"), *(f(field(n)) for _, f, n in ids), F.initcap(F.coalesce(field("name"), F.lit("Complainant"))))
    v, (*own, person) = _hold(v, *(entity(t, c, f"victim_{n}", victim=True) for (t, _, n), c in zip(ids, values, strict=False)), entity("PERSON", values[-1], "victim", victim=True))
    victim = _event(v, "COMPLAINT", [person, *own], [*(link(person, e, "HOLDS", False) for e in own), link(own[1], own[2], "LINKED_VPA", False)], amount=N.parse_amount(field("amount")), reference=field("ack"), narration=field("narrative"))
    x, values = _hold(k.filter("part = 'suspect'"), *(f(field(n)) for _, f, n in ids))
    return victim.unionByName(_event(x, "COMPLAINT", [entity(t, c, "reported_suspect", reported=True) for (t, _, _), c in zip(ids, values, strict=True)], []))


def timed(records: DataFrame) -> DataFrame:
    """``records`` with their time, ``ts``."""
    return records.withColumn("_start", N.ts_text(field("start"))).withColumn("ts", N.parse_ts_text(F.col("_start"))).drop("_start")


def events(records: DataFrame) -> DataFrame:
    """All events, numbered in the order of exhibits and rows; files are opened and times parsed once."""
    records = materialize(timed(records))
    parts = [f(records) for f in (calls, data_sessions, statements, payments, mails, devices, chats, complaints)]
    return numbered(reduce(lambda a, b: a.unionByName(b), parts))


def numbered(every: DataFrame) -> DataFrame:
    """Events with ``seq`` and ``event_id`` from their place in the exhibits."""
    seq = F.regexp_extract("exhibit", "(\\d+)$", 1).cast("bigint") * 1_000_000_000_000 + F.col("row").cast("bigint") * 100_000 + F.col("sub")
    return every.withColumn("seq", seq).withColumn("event_id", F.concat_ws("-", "exhibit", "row", "sub")).withColumn("flags", F.array_distinct(F.coalesce("flags", F.array().cast("array<string>"))))


def ordered(every: DataFrame) -> DataFrame:
    """Events by time, those without one last, else as they were read."""
    return every.orderBy(F.col("ts").asc_nulls_last(), "seq")


def ordinals(every: DataFrame) -> DataFrame:
    """``every`` with ``ordinal``, its place from 1 on in the order of ``ordered``: ranges of time are numbered apart, then shifted."""
    order = [F.col("ts").isNull(), "ts", "seq"]
    dealt = materialize(every.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("ordinal", local).join(F.broadcast(before), "_part").withColumn("ordinal", F.col("ordinal") + F.col("_before")).select(*every.columns, "ordinal")

"""Text intelligence as Column expressions: indicators, lures, risky links and packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import normalize as N

# Phrases of social engineering and their weights.
LURES = {
    "otp": 3, "one time password": 3, "cvv": 4, "pin number": 3, "upi pin": 4, "net banking password": 4, "atm pin": 4, "card number": 3,
    "kyc": 3, "re-kyc": 3, "account will be blocked": 4, "will be suspended": 3, "account blocked": 3, "immediately": 1, "within 24 hours": 2,
    "urgent": 2, "last warning": 3, "final notice": 2, "expire": 1, "deactivate": 2, ".apk": 4, "install the app": 3, "install this": 2,
    "download the app": 3, "anydesk": 5, "teamviewer": 4, "quick support": 3, "screen share": 3, "enable accessibility": 4, "lottery": 3,
    "you have won": 3, "cashback": 2, "refund": 2, "reward point": 3, "credit card reward": 3, "prize": 2, "gift": 1, "cyber cell": 3,
    "customs": 3, "parcel": 2, "fedex": 2, "narcotics": 4, "digital arrest": 5, "cbi": 3, "police verification": 3, "court notice": 3,
    "work from home": 2, "task based": 2, "telegram group": 3, "prepaid task": 3, "investment plan": 2, "guaranteed return": 3,
    "trading account": 2, "commission": 2, "use your account": 4, "rent your account": 5, "your bank account for": 3,
    "passbook and atm card": 4, "give me your account": 4,
}
# Top-level domains of ill repute, brands, and hosts of these brands.
TLDS = (".xyz", ".top", ".click", ".buzz", ".cfd", ".rest", ".shop", ".online", ".site", ".icu", ".link", ".live", ".fit")
BRANDS = ("sbi", "hdfc", "icici", "axis", "kotak", "paytm", "phonepe", "gpay", "npci", "rbi", "irctc", "epfo", "incometax")
GENUINE = (
    "sbi.co.in", "onlinesbi.sbi", "onlinesbi.com", "sbicard.com", "sbi.bank.in", "hdfcbank.com", "hdfclife.com", "icicibank.com",
    "icicidirect.com", "axisbank.com", "axisbank.co.in", "kotak.com", "kotak811.com", "paytm.com", "paytmbank.com", "phonepe.com",
    "pay.google.com", "npci.org.in", "rbi.org.in", "irctc.co.in", "epfindia.gov.in", "incometax.gov.in", "bankofbaroda.in",
    "pnbindia.in", "unionbankofindia.co.in",
)
# Weights of Android permissions.
PERMISSIONS = {
    "READ_SMS": 5, "RECEIVE_SMS": 5, "SEND_SMS": 4, "READ_CALL_LOG": 3, "ANSWER_PHONE_CALLS": 3, "CALL_PHONE": 2, "READ_CONTACTS": 2,
    "SYSTEM_ALERT_WINDOW": 4, "BIND_ACCESSIBILITY_SERVICE": 5, "REQUEST_INSTALL_PACKAGES": 3, "RECEIVE_BOOT_COMPLETED": 2,
    "FOREGROUND_SERVICE": 1, "READ_PHONE_STATE": 2, "QUERY_ALL_PACKAGES": 2,
}
STORES = ("com.android.vending", "com.google.android.packageinstaller", "play store", "google play")
# Patterns of indicators in free text.
PHONE = "(?<!\\d)(?:\\+?91[\\s\\-]?)?([6-9]\\d{9})(?!\\d)"
VPA = "(?i)\\b([a-z0-9._\\-]{2,64}@[a-z][a-z0-9]{1,24})\\b"
EMAIL = "(?i)\\b[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}\\b"
URL = "(?i)\\b(?:https?://|www\\.)[^\\s<>\"')]+"
IP = "\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b"
IMEI = "(?<!\\d)(\\d{15})(?!\\d)"
SHA = "(?i)\\b[0-9a-f]{64}\\b"
AMOUNT = "(?:rs\\.?|inr|₹)\\s*([\\d,]+(?:\\.\\d{1,2})?)"
ACCOUNT = "(?i)(?<![a-z])(?:a/?c(?:count)?(?:\\s*(?:no\\.?|number|#))?|acct)\\s*[:\\-#]?\\s*([0-9Xx*]{6,20})"
APK = "(?i)\\b([\\w\\-]+\\.apk)\\b"
PACKAGE = "(?i)\\b((?:com|in|org|net)\\.[a-z0-9_]+(?:\\.[a-z0-9_]+){0,4})\\b"


def _all(text: Column, pattern: str, group: int, norm=lambda x: x) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), norm)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def indicators(text: Column) -> Column:
    """A struct of the identifiers in a text, each list distinct and sorted (amounts in order); accounts only next to a word for account."""
    emails = _all(text, EMAIL, 0, N.norm_email)
    money = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(AMOUNT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    fields = {
        "phones": _all(text, PHONE, 1, N.norm_msisdn),
        "vpas": F.array_except(_all(text, VPA, 1, N.norm_upi), emails),
        "emails": emails,
        "urls": _all(text, URL, 0, lambda u: F.regexp_replace(u, "[.,);]+$", "")),
        "ips": _all(text, IP, 0, N.norm_ip),
        "imeis": _all(text, IMEI, 1),
        "accounts": _all(text, ACCOUNT, 1, lambda a: N.norm_account(a)["key"]),
        "hashes": _all(text, SHA, 0, F.lower),
        "apks": _all(text, APK, 1, F.lower),
        "packages": _all(text, PACKAGE, 1, F.lower),
        "amounts": F.filter(money, lambda x: x.isNotNull()),
    }
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def saturated(raw: Column, scale: float) -> Column:
    """100 (1 - exp(-raw / scale)), rounded half to even."""
    return F.bround(100 * (1 - F.exp(-raw / scale))).cast("int")


def lure(text: Column, lexicon: dict[str, int] = LURES) -> Column:
    """``struct(score, hits)``: phrases of the lexicon in the text, by weight, and their saturated sum."""
    low = F.lower(F.coalesce(text, F.lit("")))
    terms = sorted(lexicon.items(), key=lambda x: -x[1])
    raw = sum((F.when(low.contains(p), w).otherwise(0) for p, w in terms), F.lit(0))
    hits = F.array_compact(F.array(*(F.when(low.contains(p), p) for p, _ in terms)))
    return F.struct(saturated(raw, 12.0).alias("score"), hits.alias("hits"))


def host_of(url: Column) -> Column:
    """The host of a url, with port and www."""
    return F.substring_index(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^https?://", ""), "/", 1)


def genuine_host(host: Column) -> Column:
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), "^\\.+|\\.+$", "")
    own = [h.endswith(x) for x in (".gov.in", ".nic.in", ".rbi.org.in")] + [(h == s) | h.endswith("." + s) for s in GENUINE]
    out = F.lit(False)
    for c in own:
        out = out | c
    return out


def url_risk(url: Column) -> Column:
    """Reasons why a link looks like phishing."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.substring_index(host_of(url), ":", 1)
    tld = F.coalesce(*(F.when(host.endswith(t), t) for t in TLDS))
    brand = F.coalesce(*(F.when(host.contains(b), b.upper()) for b in BRANDS))
    return F.array_compact(F.array(
        F.when(host.rlike("^(\\d{1,3}\\.){3}\\d{1,3}$"), "host is an IP address"),
        F.when(tld.isNotNull(), F.concat(F.lit("top-level domain "), tld)),
        F.when(~genuine_host(host) & brand.isNotNull(), F.concat(F.lit("brand "), brand, F.lit(" on a foreign domain"))),
        F.when(u.endswith(".apk"), "links to an Android package"),
        F.when(F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))) >= 2, "host with many hyphens"),
    ))


def apk_risk(package: Column, permissions: Column, installer: Column, flags: Column) -> Column:
    """Risk from 0 to 100 of an installed package by its permissions, installer, build flags and name."""
    perms = F.array_distinct(F.transform(F.filter(F.coalesce(permissions, F.array().cast("array<string>")), lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(F.trim(p), "^android\\.permission\\.", "")))
    weights = F.create_map(*(F.lit(x) for kv in PERMISSIONS.items() for x in kv))
    raw = F.aggregate(perms, F.lit(0), lambda s, p: s + F.coalesce(F.element_at(weights, p), F.lit(0)))
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), perms)) == 0
    raw = raw + F.when(has("READ_SMS", "RECEIVE_SMS", "BIND_ACCESSIBILITY_SERVICE"), 12).otherwise(0)
    raw = raw + F.when(has("SYSTEM_ALERT_WINDOW", "BIND_ACCESSIBILITY_SERVICE"), 5).otherwise(0)
    by = F.lower(F.coalesce(installer, F.lit("")))
    raw = raw + F.when(by == "", 5).when(~by.isin(*STORES), 8).otherwise(0)
    raw = raw + 2 * F.size(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.lower(f).rlike("debug|test")))
    raw = raw + F.when(F.lower(F.coalesce(package, F.lit(""))).rlike("|".join(BRANDS)), 6).otherwise(0)
    return saturated(raw, 22.0)


def plain_text(html: Column) -> Column:
    """Text of HTML, with the targets of links kept."""
    linked = F.regexp_replace(F.coalesce(html, F.lit("")), "(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>", " $1 ")
    return F.regexp_replace(linked, "<[^>]+>", " ")

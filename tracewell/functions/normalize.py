"""Scalar normalisers as Column expressions: identifiers, amounts, timestamps.

All run inside whole-stage code generation; none needs Python on the executors.  A value that
isn't what it should be becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp layouts in order of precedence, day before month.
LAYOUTS = (
    ("\\d{4}-\\d{1,2}-\\d{1,2} \\d{1,2}:\\d{2}:\\d{2}", "y-M-d H:m:s"),
    ("\\d{4}-\\d{1,2}-\\d{1,2} \\d{1,2}:\\d{2}", "y-M-d H:m"),
    ("\\d{4}-\\d{1,2}-\\d{1,2}", "y-M-d"),
    ("\\d{4}/\\d{1,2}/\\d{1,2} \\d{1,2}:\\d{2}:\\d{2}", "y/M/d H:m:s"),
    ("\\d{4}/\\d{1,2}/\\d{1,2} \\d{1,2}:\\d{2}", "y/M/d H:m"),
    ("\\d{1,2}-\\d{1,2}-\\d{4} \\d{1,2}:\\d{2}:\\d{2}", "d-M-y H:m:s"),
    ("\\d{1,2}-\\d{1,2}-\\d{4} \\d{1,2}:\\d{2}", "d-M-y H:m"),
    ("\\d{1,2}-\\d{1,2}-\\d{4}", "d-M-y"),
    ("\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}:\\d{2}", "d/M/y H:m:s"),
    ("\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}", "d/M/y H:m"),
    ("\\d{1,2}/\\d{1,2}/\\d{4}", "d/M/y"),
    ("\\d{1,2}-[A-Za-z]{3}-\\d{4} \\d{1,2}:\\d{2}:\\d{2}", "d-MMM-y H:m:s"),
    ("\\d{1,2}-[A-Za-z]{3}-\\d{4} \\d{1,2}:\\d{2}", "d-MMM-y H:m"),
    ("\\d{1,2}-[A-Za-z]{3}-\\d{4}", "d-MMM-y"),
    ("\\d{1,2} [A-Za-z]{3} \\d{4} \\d{1,2}:\\d{2}:\\d{2}", "d MMM y H:m:s"),
    ("\\d{1,2} [A-Za-z]{4,9} \\d{4} \\d{1,2}:\\d{2}:\\d{2}", "d MMMM y H:m:s"),
    ("[A-Za-z]{3} \\d{1,2} \\d{4} \\d{1,2}:\\d{2}:\\d{2}", "MMM d y H:m:s"),
    ("\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}:\\d{2}", "M/d/y H:m:s"),
    ("\\d{14}", "yyyyMMddHHmmss"),
    # layouts of chat exports
    ("\\d{1,2}/\\d{1,2}/\\d{2} \\d{1,2}:\\d{2}", "d/M/yy H:m"),
    ("\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2} [AP]M", "d/M/y h:m a"),
    ("\\d{1,2}/\\d{1,2}/\\d{2} \\d{1,2}:\\d{2} [AP]M", "d/M/yy h:m a"),
)
ZONE = "Asia/Kolkata"


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9]", "")


def norm_key(header: Column) -> Column:
    """A column header as a comparison key: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(header.cast("string"), F.lit(""))), "[^a-z0-9]", "")


def norm_msisdn(value: Column) -> Column:
    """Ten-digit subscriber number; alphabetic sender ids in upper case; short codes as they are."""
    raw, d = _text(value), digits(value)
    bare = F.regexp_replace(d, "^0+", "")
    number = F.when((F.length(d) > 10) & d.startswith("0") & ~(d.startswith("91")), F.right(bare, F.lit(10))).when(F.length(d) > 10, F.right(d, F.lit(10))).otherwise(d)
    return F.when(raw.rlike("^[A-Za-z]{2}-?[A-Za-z]{5,8}$"), F.upper(raw)).otherwise(F.nullif(number, F.lit("")))


def norm_imei(value: Column) -> Column:
    """The 14-digit body of an IMEI."""
    d = digits(value)
    return F.when(F.length(d) >= 14, d.substr(1, 14))


def luhn_ok(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 15) & F.call_function("luhn_check", d)


def norm_imsi(value: Column) -> Column:
    return F.nullif(digits(value), F.lit(""))


def norm_account(value: Column) -> Column:
    """``struct(key, masked)``: digits, or MASKED- and the last six digits where characters are masked."""
    raw, d = _text(value), digits(value)
    masked = raw.rlike("[xX*#]")
    key = F.when(masked, F.when(F.length(d) >= 4, F.concat(F.lit("MASKED-"), F.right(d, F.lit(6))))).when(F.length(d) >= 6, d)
    return F.struct(key.alias("key"), masked.alias("masked"))


def norm_upi(value: Column) -> Column:
    raw = F.lower(_text(value))
    return F.when(raw.rlike("^[a-z0-9._\\-]{2,64}@[a-z][a-z0-9]{1,24}$"), raw)


def norm_email(value: Column) -> Column:
    raw = F.regexp_replace(F.lower(_text(value)), "^[<>]+|[<>]+$", "")
    return F.when(raw.rlike("^[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}$"), raw)


def norm_ip(value: Column) -> Column:
    """Dotted IPv4 without leading zeros; octets over 255 give null."""
    raw = _text(value)
    octets = F.transform(F.split(F.when(raw.rlike("^(\\d{1,3}\\.){3}\\d{1,3}$"), raw), "\\."), lambda o: o.cast("int"))
    return F.when(F.forall(octets, lambda o: o <= 255), F.array_join(F.transform(octets, lambda o: o.cast("string")), "."))


def subnet24(value: Column) -> Column:
    ip = norm_ip(value)
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))


def is_private_ip(value: Column) -> Column:
    return F.coalesce(norm_ip(value).rlike("^(10\\.|127\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)"), F.lit(False))


def norm_mac(value: Column) -> Column:
    raw = F.lower(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9a-fA-F]", ""))
    return F.when(F.length(raw) == 12, F.regexp_replace(raw, "(..)(?!$)", "$1:"))


def norm_sha256(value: Column) -> Column:
    raw = F.lower(_text(value))
    return F.when(raw.rlike("^[0-9a-f]{64}$"), raw)


def parse_amount(value: Column) -> Column:
    """The first number of a text; negative when it ends in DR, begins with a minus sign or has parentheses."""
    s = _text(value)
    number = F.regexp_replace(F.regexp_extract(F.replace(s, F.lit("₹"), F.lit(" ")), "-?\\d[\\d,]*\\.?\\d*", 0), "[,\\-]", "")
    size = F.nullif(number, F.lit("")).try_cast("double")
    negative = F.upper(s).endswith("DR") | s.startswith("-") | (s.contains("(") & s.contains(")"))
    return F.when(~s.isin("-", "--", "NA", "N/A"), F.when(negative & (size != 0), -size).otherwise(size))


def inr(amount: Column) -> Column:
    """Indian digit grouping, without .00."""
    fixed = F.format_string("%.2f", F.abs(amount.cast("double")))
    whole, part = F.substring_index(fixed, ".", 1), F.substring_index(fixed, ".", -1)
    grouped = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(whole.substr(F.lit(1), F.length(whole) - 3), "(\\d)(?=(\\d\\d)+$)", "$1,"), F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.when(amount.isNull(), "-").otherwise(F.concat(F.when(amount < 0, "-").otherwise(""), grouped, F.when(part == "00", "").otherwise(F.concat(F.lit("."), part))))


def from_epoch(seconds: Column) -> Column:
    """Wall-clock time of India, whatever the session's zone."""
    return F.expr("timestamp_ntz'1970-01-01 05:30:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def ts_text(value: Column) -> Column:
    """The text that ``parse_ts`` reads, with single blanks."""
    return F.regexp_replace(F.regexp_replace(_text(value), ", ", " "), "\\s+", " ")


def parse_ts(value: Column) -> Column:
    """A timestamp in Indian wall-clock time from epoch seconds or milliseconds, ISO 8601, the layouts or RFC 2822; else null."""
    return parse_ts_text(ts_text(value))


def parse_ts_text(s: Column) -> Column:
    """As ``parse_ts``, of a column made by ``ts_text``: each layout reads it, so it had best be computed once."""
    iso = s.rlike("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}")
    zone = F.regexp_extract(s, "(Z|[+-]\\d{2}:?\\d{2})$", 1)
    plain = F.try_to_timestamp(F.regexp_replace(s.substr(1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    pair = F.regexp_replace(zone, "[^0-9]", "")
    shift = F.when(zone == "Z", F.lit(0)).otherwise(sign * (pair.substr(1, 2).try_cast("int") * 60 + pair.substr(3, 2).try_cast("int")))
    moved = plain + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(330) - shift, F.lit(0))
    found = [
        F.when(s.rlike("^\\d{10}$"), from_epoch(F.when(s.rlike("^\\d{10}$"), s).cast("bigint"))),
        F.when(s.rlike("^\\d{13}$"), from_epoch(F.when(s.rlike("^\\d{13}$"), s).cast("bigint") / 1000)),
        F.when(iso & (zone != ""), moved),
        F.when(iso & (zone == "") & s.contains("T"), F.coalesce(plain, F.try_to_timestamp(F.regexp_replace(s.substr(1, 16), "T", " "), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"))),
    ]
    for shape, layout in LAYOUTS:
        found.append(F.when(s.rlike(f"^(?i:{shape})$"), F.try_to_timestamp(F.upper(s) if layout.endswith("a") else s, F.lit(layout)).cast("timestamp_ntz")))
    mail = F.regexp_extract(s, "^(?:[A-Za-z]{3} )?(\\d{1,2} [A-Za-z]{3} \\d{4} \\d{2}:\\d{2}:\\d{2})", 1)
    mail_zone = F.regexp_extract(s, "([+-]\\d{4})", 1)
    mail_shift = F.when(mail_zone.startswith("-"), -1).otherwise(1) * (mail_zone.substr(2, 2).try_cast("int") * 60 + mail_zone.substr(4, 2).try_cast("int"))
    found.append(F.when(mail != "", F.try_to_timestamp(mail, F.lit("d MMM y HH:mm:ss")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(330) - F.coalesce(mail_shift, F.lit(330)), F.lit(0))))
    return F.coalesce(*found)


def minutes_between(a: Column, b: Column) -> Column:
    """Absolute distance in minutes."""
    return F.abs(F.timestamp_diff("MICROSECOND", a, b)) / 6e7


def node_id(kind: Column | str, value: Column) -> Column:
    return F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, value)

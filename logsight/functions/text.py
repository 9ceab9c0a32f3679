"""Parsing and extraction as column expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of addresses and names in log lines.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
IPV6 = (
    r"(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
    r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}"
    r"|::1"
    r"|::)"
)
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
USER = r"(?i)(?:user=|for user )([a-z0-9._@-]{1,64})"
HOST = rf"(?i)host(?:name)?[= ]({LABEL}(?:\.{LABEL})*)"
FILE = r"(?:^|(?<=\s))(/(?:[a-zA-Z0-9._-]+/)*[a-zA-Z0-9._-]+)"
DOMAIN = rf"\b({LABEL}(?:\.{LABEL}){{0,10}}\.[a-zA-Z]{{2,63}})\b"
PROCESS = r"\b([a-zA-Z][a-zA-Z0-9_.-]{0,63})\[([0-9]{1,7})\]:"
PROCESS_NAME = r"(?i)process(?:_name)?[= ]([a-z][a-z0-9_.-]{0,63})"
PROCESS_ID = r"(?i)\bpid[= ]([0-9]{1,7})\b"
FILE_ENDINGS = (
    "conf", "log", "txt", "py", "sh", "yml", "yaml", "json", "xml", "gz", "bz2", "xz",
    "zst", "tar", "zip", "csv", "ini", "cfg", "pid", "sock", "lock", "tmp", "bak", "old",
)
#: Severities of syslog 0 to 7 on the scale 0 (trace) to 6 (fatal).
SYSLOG_SEVERITY = (6, 5, 5, 4, 3, 2, 1, 0)
SEVERITY_NAMES = ("TRACE", "INFORMATIONAL", "NOTICE", "WARNING", "ERROR", "CRITICAL", "FATAL")
MAX_PER_KIND = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of the value, which is computed once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _guarded(text: Column, sign: str, pattern: str, group: int = 0) -> Column:
    """The same, where the text holds what every match has in it; a plain search is far cheaper than the pattern. sign: in small letters."""
    there = F.contains(F.lower(text) if sign.isalpha() else text, F.lit(sign))
    return F.when(text.isNull() | there, _found(text, pattern, group)).otherwise(F.array().cast("array<string>"))


def decode(data: Column, max_bytes: int = 65_536, max_chars: int = 32_768) -> Column:
    """Bytes to text, cut to a number of bytes and then of characters (E1); bytes that are no UTF-8 become U+FFFD."""
    return F.substring(F.make_valid_utf8(F.substring(data, 1, max_bytes).cast("string")), 1, max_chars)


def severity(value: Column) -> Column:
    """Severity 0 to 6; anything else is 1."""
    return F.coalesce(F.when(value.between(0, 6), value.cast("int")), F.lit(1))


def mask(text: Column, max_chars: int = 8192) -> Column:
    """One space between tokens, addresses as <IP>, UUIDs as <UUID>."""
    plain = F.trim(F.regexp_replace(F.substring(text, 1, max_chars), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(plain, IPV4, "<IP>"), UUID, "<UUID>")


def template_of(text: Column) -> Column:
    """The exact-mask template: tokens that hold a digit become <*> (E4, exact mode)."""
    tokens = F.split(mask(text), " ")
    return F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("[0-9]")), F.lit("<*>")).otherwise(t)), " ")


def template_params(text: Column, template: Column) -> Column:
    """Tokens that stand where the template has <*>; none if the token counts differ (E5)."""
    own = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    slots = F.split(F.trim(F.regexp_replace(template, r"\s+", " ")), " ")

    def paired(both: Column) -> Column:
        pairs = F.filter(F.zip_with(both["own"], both["slots"], lambda o, s: F.struct(o.alias("o"), s.alias("s"))), lambda p: p["s"] == "<*>")
        return F.when(F.size(both["own"]) == F.size(both["slots"]), F.transform(pairs, lambda p: p["o"])).otherwise(F.array().cast("array<string>"))

    return let(F.struct(own.alias("own"), slots.alias("slots")), paired)


def ips(text: Column) -> Column:
    """IPv4, then IPv6 addresses, each once."""
    none = F.array().cast("array<string>")
    # an IPv6 address has :: or seven colons; an IPv4 address has a digit before a point
    six = F.when(F.contains(text, F.lit("::")) | (F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) >= 7), _found(text, IPV6)).otherwise(none)
    four = F.when(text.isNull() | F.rlike(text, F.lit(r"[0-9]\.[0-9]")), _found(text, IPV4)).otherwise(none)
    return F.slice(F.array_distinct(F.concat(four, six)), 1, MAX_PER_KIND)


def users(text: Column) -> Column:
    return F.slice(F.array_distinct(_guarded(text, "user", USER, 1)), 1, MAX_PER_KIND)


def hosts(text: Column) -> Column:
    found = F.filter(_guarded(text, "host", HOST, 1), lambda h: ~F.rlike(h, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")))
    return F.slice(F.array_distinct(found), 1, MAX_PER_KIND)


def files(text: Column) -> Column:
    return F.slice(F.array_distinct(_guarded(text, "/", FILE, 1)), 1, MAX_PER_KIND)


def domains(text: Column) -> Column:
    """Dotted names whose last label is no file ending."""
    ending = lambda d: F.lower(F.element_at(F.split(d, r"\."), -1))
    found = F.filter(_guarded(text, ".", DOMAIN, 1), lambda d: ~ending(d).isin(*FILE_ENDINGS))
    return F.slice(F.array_distinct(found), 1, MAX_PER_KIND)


def processes(text: Column) -> Column:
    """name:pid of `name[pid]:`, then names, then pids."""
    pairs = F.zip_with(_guarded(text, "[", PROCESS, 1), _guarded(text, "[", PROCESS, 2), lambda n, p: F.concat_ws(":", n, p))
    return F.slice(F.array_distinct(F.concat(pairs, _guarded(text, "process", PROCESS_NAME, 1), _guarded(text, "pid", PROCESS_ID, 1))), 1, MAX_PER_KIND)


def tagged(values: Column, params: Column) -> Column:
    """Each value with where it comes from: param, template, or unknown without params."""
    origin = lambda v, p: F.when(F.size(p) == 0, "unknown").when(F.array_contains(p, v), "param").otherwise("template")
    return let(params, lambda p: F.transform(values, lambda v: F.struct(v.alias("value"), origin(v, p).alias("source"))))


def syslog_header(line: Column) -> dict[str, Column]:
    """facility, severity_id and rfc of a line (A4); without a valid <PRI>: 1, notice."""
    pri = F.regexp_extract(line, r"^<([0-9]{1,3})>", 1)
    number = F.when(pri != "", pri.cast("int"))
    good = F.coalesce(number <= 191, F.lit(False))
    level = F.when(good, number.bitwiseAND(7)).otherwise(5)
    rest = F.when(pri != "", F.regexp_replace(line, r"^<[0-9]{1,3}>", "")).otherwise(line)
    return {
        "facility": F.when(good, F.shiftright(number, 3)).otherwise(1),
        "syslog_severity": level,
        "severity_id": F.element_at(F.array(*map(F.lit, SYSLOG_SEVERITY)), (level + 1).cast("int")),
        "rfc": F.when(F.startswith(rest, F.lit("1 ")), "5424").otherwise("3164"),
    }


def escaped(text: Column) -> Column:
    """Control characters as escapes."""
    for char, name in (("\n", "n"), ("\r", "r"), ("\x1b", "x1b"), ("\t", "t"), ("\x00", "x00"), (" ", "u2028"), (" ", "u2029")):
        text = F.replace(text, F.lit(char), F.lit("\\" + name))
    return text


def pattern_key(*parts: Column) -> Column:
    """Lower-case, trimmed parts with unsafe signs as -, joined by :."""
    return F.concat_ws(":", *(F.regexp_replace(F.lower(F.trim(p)), "[^a-z0-9_.-]", "-") for p in parts))


def entity_summary(lists: dict[str, Column], most: int = 5) -> Column:
    """A map of the lists that are not empty, cut to `most` values."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.slice(v, 1, most).alias("value")) for k, v in lists.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))


def synthetic_ip(host: Column) -> Column:
    """C<n> as 10.x.y.z by the bytes of n; null outside 1 to 0xFFFFFF."""
    n = F.regexp_extract(host, r"^C([0-9]{1,8})$", 1)
    n = F.when(n != "", n.cast("long"))
    byte = lambda k: F.shiftright(n, k).bitwiseAND(255).cast("string")
    return F.when(n.between(1, 0xFFFFFF), F.concat_ws(".", F.lit("10"), byte(16), byte(8), byte(0)))


def entity_shape(value: Column) -> Column:
    """uuid, ip, user, host or null."""
    v = F.trim(value)
    label = r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)"
    shape = F.when(F.rlike(v, F.lit("^" + UUID.replace("(?i)", "").replace("[0-9a-f]", "[0-9a-fA-F]") + "$")), "uuid")
    shape = shape.when(F.rlike(v, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")) | F.rlike(v, F.lit(rf"^{IPV6}$")), "ip")
    shape = shape.when(F.rlike(v, F.lit(r"^[^\s@\\]+[@\\]\S*$")), "user")
    return shape.when(F.rlike(v, F.lit(rf"^{label}(\.{label})+$")), "host")

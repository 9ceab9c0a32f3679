"""Deterministic ids of entities and alerts as UUID version 5 of canonical names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logsight.functions.text import IPV4, OCTET, UUID, let

# The name spaces of the entity types, and the one of DNS names for alerts.
NAMESPACES = {
    "user": "a1b2c3d4-0001-0000-0000-000000000001",
    "ip": "a1b2c3d4-0002-0000-0000-000000000002",
    "host": "a1b2c3d4-0003-0000-0000-000000000003",
    "process": "a1b2c3d4-0004-0000-0000-000000000004",
    "file": "a1b2c3d4-0005-0000-0000-000000000005",
    "domain": "a1b2c3d4-0006-0000-0000-000000000006",
    "alert": "6ba7b810-9dad-11d1-80b4-00c04fd430c8",
}


# Relations of ordered pairs of entity types.
RELATIONS = {
    ("user", "ip"): "authenticated_from",
    ("user", "host"): "logged_into",
    ("ip", "host"): "has_ip",
    ("user", "file"): "accessed",
    ("ip", "domain"): "resolved_to",
}


def _digest(namespace: str, name: Column) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(NAMESPACES.get(namespace, namespace).replace("-", ""))), F.encode(name, "UTF-8")))


def _from_digest(h: Column) -> Column:
    """The first 32 hex digits with version and variant bits set; null for null."""
    variant = F.substring(F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 1, 1)
    parts = [F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)]
    return F.concat(*parts)


def uuid5(namespace: str, name: Column) -> Column:
    """UUID 5 of a name; null for a null name."""
    return _from_digest(_digest(namespace, name))


def uuid5_each(namespace: str, names: Column) -> Column:
    """UUID 5 of each name of an array. Two passes, so that each digest is computed once."""
    return F.transform(F.transform(names, lambda n: _digest(namespace, n)), _from_digest)


def user_parts(raw: Column) -> tuple[Column, Column]:
    r"""(name, domain) in lower case of DOMAIN\name, name@domain or name."""
    s = F.lower(F.trim(raw))
    slash, at = F.instr(s, "\\"), F.length(s) - F.length(F.substring_index(s, "@", -1))
    has_slash, has_at = slash > 0, at > 0
    name = F.when(has_slash, F.substr(s, slash + 1)).when(has_at, F.substr(s, F.lit(1), at - 1)).otherwise(s)
    domain = F.when(has_slash, F.substr(s, F.lit(1), slash - 1)).when(has_at, F.substring_index(s, "@", -1)).otherwise("")
    return name, domain


def exploded_ipv6(raw: Column) -> Column:
    """The full form of an IPv6 address in lower case; null for anything else."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def tail(s: Column, octets: Column) -> Column:
        # the last four bytes may be written as an IPv4 address
        number = lambda i: F.split(octets, "[.]")[i].cast("int")
        pair = lambda i: F.lower(F.hex(number(i) * 256 + number(i + 1)))
        return F.when(octets != "", F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(octets)), pair(0), F.lit(":"), pair(2))).otherwise(s)

    def whole(p: Column) -> Column:
        # :: stands for one group of zeros at least
        zeros = 8 - F.size(p["left"]) - F.size(p["right"])
        return F.when(p["n"] == 1, p["left"]).when((p["n"] == 2) & (zeros >= 1), F.concat(p["left"], F.array_repeat(F.lit("0"), zeros), p["right"]))

    def written(full: Column) -> Column:
        good = (F.size(full) == 8) & F.forall(full, lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(good, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ":"))

    def parts(halves: Column) -> Column:
        return F.struct(F.size(halves).alias("n"), groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"))

    low = F.lower(F.trim(raw))
    both = let(low, lambda s: F.struct(s.alias("s"), F.regexp_extract(s, rf"^.*:((?:{octet}[.]){{3}}{octet})$", 1).alias("octets")))
    halves = let(both, lambda b: F.split(tail(b["s"], b["octets"]), "::"))
    return let(let(let(halves, parts), whole), written)


def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(raw: Column) -> Column:
    """Unicode form NFC, which Spark has no function for.

    Names in log lines are ASCII by their patterns, so ingest needs none of it;
    names from other sources pass through here before `entity_id`.
    """
    return F.pandas_udf(_nfc, "string")(raw)


def canonical(kind: str, raw: Column) -> Column:
    """The canonical name of an entity; null if malformed."""
    s = F.trim(raw)
    if kind == "ip":
        return F.when(F.rlike(s, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")) & ~F.rlike(s, F.lit(r"(^|\.)0[0-9]")), s).when(F.contains(s, F.lit(":")), exploded_ipv6(s))
    if kind == "user":
        # DOMAIN\\name and name@domain become domain:name; an empty domain leaves the name
        low = F.lower(s)
        slash = F.regexp_replace(F.regexp_replace(low, r"^\\\s*", ""), r"^([^\\]+)\\\s*(.*)$", "$1:$2")
        at = F.regexp_replace(F.regexp_replace(low, r"^(.*)\s*@$", "$1"), r"^(.*?)\s*@([^@]+)$", "$2:$1")
        return F.when(F.contains(low, F.lit("\\")), F.when(~F.endswith(low, F.lit("\\")), slash)).when(F.contains(low, F.lit("@")), F.when(~F.startswith(low, F.lit("@")), at)).when(low != "", low)
    if kind in ("host", "domain"):
        name = F.regexp_replace(F.lower(s), r"\.+$", "")
        return F.when(name != "", name)
    return F.when(s != "", s)


def entity_id(kind: str, raw: Column) -> Column:
    """Id of an entity (E13); null if its name is malformed."""
    return uuid5(kind, F.when(F.instr(raw, "\x00") == 0, canonical(kind, raw)))


def process_ids(raw: Column) -> Column:
    """Ids of processes; a bare pid is dropped if a name:pid has the same pid."""
    bare = lambda p: F.rlike(p, F.lit("^[0-9]+$"))
    named = F.transform(F.filter(raw, lambda p: F.contains(p, F.lit(":"))), lambda p: F.element_at(F.split(p, ":"), -1))
    kept = F.filter(raw, lambda p: ~(bare(p) & F.array_contains(named, p)))
    return F.array_distinct(uuid5_each("process", kept))


def entity_refs(ips: Column, users: Column, hosts: Column, domains: Column, files: Column, processes: Column) -> Column:
    """All ids of an event: ip, user, host, domain, file, process."""
    names = lambda kind, values: F.transform(values, lambda v: F.when(F.instr(v, "\x00") == 0, canonical(kind, v)))
    of = lambda kind, values: uuid5_each(kind, F.filter(names(kind, values), lambda n: n.isNotNull()))
    return F.concat(of("ip", ips), of("user", users), of("host", hosts), of("domain", domains), of("file", files), process_ids(processes))


def primary_entity(lists: dict[str, Column]) -> tuple[Column, Column]:
    """(type, value) of the first list in order that has a value; type ip without any."""
    kind, value = None, None
    for k, v in lists.items():
        there = F.size(v) > 0
        kind = F.when(there, k) if kind is None else kind.when(there, k)
        value = F.when(there, F.element_at(v, 1)) if value is None else value.when(there, F.element_at(v, 1))
    return kind.otherwise("ip"), value


def alert_id(*parts: Column | str) -> Column:
    """Id of an alert from the parts of its family's name."""
    return uuid5("alert", F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def register(spark: SparkSession) -> None:
    """SQL functions: the Python one, and the rest as SQL expressions."""
    spark.udf.register("nfc", F.pandas_udf(_nfc, "string"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION uuid5(space STRING, name STRING) RETURNS STRING RETURN "
        "(SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', cast(conv(substr(h, 17, 1), 16, 10) AS INT) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) "
        "FROM (SELECT sha1(concat(unhex(replace(space, '-', '')), encode(name, 'UTF-8'))) AS h))"
    )
    # table functions, to be joined laterally
    own, slots = (f"split(trim(regexp_replace({x}, r'\\s+', ' ')), ' ')" for x in ("message", "template"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION template_params(message STRING, template STRING) RETURNS TABLE(place INT, param STRING) RETURN "
        f"SELECT place, own[place] FROM (SELECT {own} AS own, {slots} AS slots) LATERAL VIEW posexplode(slots) p AS place, slot WHERE slot = '<*>' AND size(own) = size(slots)"
    )
    relations = [*RELATIONS.items(), (("process", "process"), "spawned_by")]
    forth, back = (" OR ".join(f"({a}.kind = '{x}' AND {b}.kind = '{y}')" for (x, y), _ in relations) for a, b in (("a", "b"), ("b", "a")))
    name = "CASE " + " ".join(f"WHEN (a.kind = '{x}' AND b.kind = '{y}') OR (b.kind = '{x}' AND a.kind = '{y}') THEN '{r}'" for (x, y), r in relations) + " END"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION infer_edges(typed ARRAY<STRUCT<kind: STRING, uuid: STRING>>) RETURNS TABLE(source_id STRING, target_id STRING, rel_type STRING) RETURN "
        f"SELECT CASE WHEN {forth} THEN a.uuid ELSE b.uuid END, CASE WHEN {forth} THEN b.uuid ELSE a.uuid END, {name} "
        f"FROM (SELECT typed AS all_of) LATERAL VIEW posexplode(all_of) p AS i, a LATERAL VIEW explode(slice(all_of, i + 2, size(all_of))) q AS b WHERE {forth} OR {back}"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION parent_technique(t STRING) RETURNS STRING RETURN CASE WHEN upper(t) RLIKE '^T[0-9]{4}([.][0-9]{3})?$' THEN split(upper(t), '[.]')[0] ELSE t END")
    plain = "trim(regexp_replace(substring(s, 1, 8192), r'\\s+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION masked(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace({plain}, r'{IPV4}', '<IP>'), r'{UUID}', '<UUID>')")
    # each step names the one before, so none is written twice
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION full_ipv6(raw STRING) RETURNS STRING RETURN "
        "(SELECT CASE WHEN size(whole) = 8 AND forall(whole, g -> g RLIKE '^[0-9a-f]{1,4}$') THEN array_join(transform(whole, g -> lpad(g, 4, '0')), ':') END FROM "
        "(SELECT CASE WHEN size(halves) = 1 THEN lows WHEN size(halves) = 2 AND size(lows) + size(highs) < 8 THEN concat(lows, array_repeat('0', 8 - size(lows) - size(highs)), highs) END AS whole FROM "
        "(SELECT halves, CASE WHEN halves[0] = '' THEN array() ELSE split(halves[0], ':') END AS lows, CASE WHEN coalesce(get(halves, 1), '') = '' THEN array() ELSE split(get(halves, 1), ':') END AS highs FROM "
        "(SELECT split(CASE WHEN bytes = '' THEN t ELSE concat(substr(t, 1, length(t) - length(bytes)), lower(hex(int(b[0]) * 256 + int(b[1]))), ':', lower(hex(int(b[2]) * 256 + int(b[3])))) END, '::') AS halves FROM "
        f"(SELECT t, bytes, split(bytes, '[.]') AS b FROM (SELECT lower(trim(raw)) AS t, regexp_extract(lower(trim(raw)), '^.*:(({octet}[.]){{3}}{octet})$', 1) AS bytes))))))"
    )

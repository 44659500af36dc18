"""Names: URNs, service endpoints, object keys, wire ids (Column in, Column out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dataset or element URN.
URN = r"^urn:ldp:([^:#]+):([^:#]+):([^:#]+):([^:#]+)(?:#([^:#]+))?$"
#: Object-store schemes and what each is written as.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}
OBJECT_SCHEMES = ("s3", "gs", "abfs")
PARTITION_TAIL = r"(/[A-Za-z_][A-Za-z0-9_]*=[^/]*)+$"


def urn_parts(urn: Column) -> Column:
    """(env, platform, system, dataset, element); null if the URN is not valid."""
    part = lambda i: F.regexp_extract(urn, URN, i)
    fields = [part(i).alias(n) for i, n in enumerate(("env", "platform", "system", "dataset"), 1)]
    return F.when(urn.rlike(URN), F.struct(*fields, F.nullif(part(5), F.lit("")).alias("element")))


def urn(env: Column, platform: Column, system: Column, dataset: Column, element: Column | None = None) -> Column:
    """renders a URN; a null element gives the dataset's."""
    base = F.concat(F.lit("urn:ldp:"), env, F.lit(":"), platform, F.lit(":"), system, F.lit(":"), dataset)
    return base if element is None else F.concat(base, F.coalesce(F.concat(F.lit("#"), element), F.lit("")))


def is_element(name: Column) -> Column:
    """whether this is an element of a dataset; service endpoints are not."""
    return name.rlike(r"^urn:ldp:[^#]*#.+")


def dataset_of(name: Column) -> Column:
    """without the last ``#...``."""
    return F.regexp_replace(name, r"#[^#]*$", "")


def node_kind(name: Column) -> Column:
    """SERVICE, ELEMENT or DATASET."""
    return F.when(name.startswith("service://"), "SERVICE").when(name.contains("#"), "ELEMENT").otherwise("DATASET")


def system_of(name: Column) -> Column:
    """The system of a URN, or a service endpoint's repository."""
    return F.when(name.startswith("service://"), F.regexp_extract(name, r"^service://([^/]*)", 1)).otherwise(F.regexp_extract(name, r"^urn:ldp:[^:]*:[^:]*:([^:#]*)", 1))


def without_env(name: Column) -> Column:
    """equal for the same asset in any environment."""
    return F.regexp_replace(name, r"^urn:ldp:[^:]*:", "urn:ldp:*:")


def canonical_scheme(scheme: Column) -> Column:
    """F6."""
    low = F.lower(scheme)
    return reduce(lambda c, kv: c.when(low == kv[0], kv[1]), SCHEMES.items(), F).otherwise(low)


def canonical_key(key: Column) -> Column:
    """no empty segments, no trailing ``name=value`` segments; null if nothing is left."""
    joined = F.array_join(F.filter(F.split(key, "/"), lambda s: s != ""), "/")
    return F.nullif(F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), joined), PARTITION_TAIL, ""), "^/", ""), F.lit(""))


_URL = r"(?is)^(jdbc:)?([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)"
_HOST = r"^(\[[^\[\]]*\]|[^:\[\]]*)(?::([0-9]*))?$"


def _authority(url: Column) -> tuple[Column, Column, Column]:
    """Host, port and whether they are one, of a url's authority: what follows the last @ of it."""
    place = F.regexp_replace(F.regexp_extract(url, _URL, 3), "(?s)^.*@", "")
    port = F.regexp_extract(place, _HOST, 2)
    host = F.lower(F.regexp_replace(F.regexp_extract(place, _HOST, 1), r"[\[\]]", ""))
    return host, port, place.rlike(_HOST) & ((port == "") | (port.try_cast("bigint") <= 65535))


def without_credentials(url: Column) -> Column:
    """F8: scheme, host, port and path alone; ``jdbc:`` urls as well. A text that is no url with an authority stays as it is.

    User info goes up to the last @ of the authority. Where what is left is no host and port, as after a password with a slash, it is null: no part of it can be told from a secret.
    """
    host, port, valid = _authority(url)
    jdbc = F.when(F.regexp_extract(url, _URL, 1) != "", "jdbc:").otherwise("")
    number = F.when(port != "", F.concat(F.lit(":"), port.try_cast("bigint").cast("string"))).otherwise("")
    plain = F.concat(jdbc, F.lower(F.regexp_extract(url, _URL, 2)), F.lit("://"), host, number, F.regexp_extract(url, _URL, 4))
    return F.when(F.regexp_extract(url, _URL, 3) == "", url).when(valid, plain)


def config_keys(text: Column) -> Column:
    """the keys of ``${key}`` in a text, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}]*)\}"), 1)))


def substitute(text: Column, config: Column) -> Column:
    """every ``${key}`` replaced; null if a key is missing."""
    keys = config_keys(text)
    done = F.aggregate(keys, text, lambda acc, k: F.replace(acc, F.concat(F.lit("${"), k, F.lit("}")), F.element_at(config, k)))
    return F.when(F.size(F.array_except(keys, F.map_keys(config))) == 0, done)


def service_url(url: Column) -> Column:
    """(host, route) of a service url, without user info, port and query; the scheme in any case. host is empty where the authority is none."""
    host, _, valid = _authority(url)
    route = F.nullif(F.regexp_extract(url, _URL, 4), F.lit(""))
    return F.struct(F.when(valid, host).otherwise("").alias("host"), F.coalesce(route, F.lit("/")).alias("route"))


def join_route(prefix: Column, suffix: Column) -> Column:
    """F11."""
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(suffix, "^/+", ""))


def wire_to_urn(wire: Column, env: str) -> Column:
    """``platform://system/dataset`` as a URN; null if it is not of that form."""
    form = r"^([a-z0-9]+)://([^/]+)/(.+)$"
    part = lambda i: F.regexp_extract(wire, form, i)
    return F.when(wire.rlike(form), urn(F.lit(env), part(1), part(2), part(3)))


def urn_to_wire(name: Column) -> Column:
    """F15."""
    p = urn_parts(name)
    return F.concat(p["platform"], F.lit("://"), p["system"], F.lit("/"), p["dataset"])


def column_matches(field: Column, column: Column) -> Column:
    """F16: equal but for case and the column's underscores."""
    return F.lower(field).isin(F.lower(column), F.replace(F.lower(column), F.lit("_"), F.lit("")))


def title(name: Column) -> Column:
    """the last part of a name."""
    return F.element_at(F.split(name, r"[:#/]"), -1)


def container(name: Column) -> Column:
    """the dataset that an element is in, or the system of a dataset."""
    return F.when(name.contains("#"), title(dataset_of(name))).otherwise(system_of(name))

"""Calls of one repository joined to the endpoints of another, by service, method and route.

A route is matched segment by segment down the tree of the templates' beginnings: at each level a call follows its own segment, or a variable, where such a beginning
is there. So a call meets at most what its path allows, never all endpoints of a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import service_url
from weftline.operators.checkpoints import cut

VARIABLE = "{}"


def segments(route: Column) -> Column:
    """The segments of a route, without empty ones; ``{name}`` and ``:name`` as a variable."""
    own = F.filter(F.split(route, "/"), lambda s: s != "")
    return F.transform(own, lambda s: F.when(s.rlike(r"^(\{.*\}|:.+)$"), F.lit(VARIABLE)).otherwise(s))


def linked(calls: DataFrame, endpoints: DataFrame, services: DataFrame) -> DataFrame:
    """Each call with the endpoint it reaches, or residue: (call_id, caller, service, endpoint_id, code).

    calls: (call_id, caller, method, url); endpoints: (endpoint_id, service, method, route); services: (host, service). Of several templates that fit, that with a literal where the others have a variable, at the first
    segment in which they differ, counts; of equal ones the smallest endpoint_id. Code: unknown-service (a host that no service has), unmatched-route, or null. A url without a host is an unknown service.
    """
    at = service_url(F.col("url"))
    named = calls.select("call_id", "caller", F.upper("method").alias("method"), at["host"].alias("host"), segments(at["route"]).alias("path"))
    named = cut(named.join(services.groupBy("host").agg(F.min("service").alias("service")), "host", "left"))
    templates = cut(endpoints.select("endpoint_id", "service", F.upper("method").alias("method"), segments(F.col("route")).alias("path")).groupBy("service", "method", "path").agg(F.min("endpoint_id").alias("endpoint_id")))
    begins = cut(templates.select("service", "method", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("begin")).distinct())
    front = named.where(F.col("service").isNotNull()).select("call_id", "service", "method", "path", F.array().cast("array<string>").alias("begin")).join(begins, ["service", "method", "begin"], "left_semi")
    ended = None
    depth = begins.agg(F.max(F.size("begin"))).first()[0] or 0
    for level in range(depth + 1):
        here = front.where(F.size("path") == level)
        ended = here if ended is None else ended.unionByName(here)
        if level == depth:
            break
        own = F.element_at("path", level + 1)
        further = front.where(F.size("path") > level).withColumn("next", F.explode(F.array_distinct(F.array(own, F.lit(VARIABLE))))).withColumn("begin", F.concat("begin", F.array("next"))).drop("next")
        front = cut(further.join(begins, ["service", "method", "begin"], "left_semi"))
    # a variable sorts after every literal
    order = F.transform("begin", lambda s: F.struct((s == VARIABLE).alias("variable"), s.alias("text")))
    hits = ended.join(templates.withColumnRenamed("path", "begin"), ["service", "method", "begin"]).groupBy("call_id").agg(F.min_by("endpoint_id", F.struct(order, "endpoint_id")).alias("endpoint_id"))
    told = named.join(hits, "call_id", "left")
    code = F.when(F.col("service").isNull(), "unknown-service").when(F.col("endpoint_id").isNull(), "unmatched-route")
    return told.select("call_id", "caller", "service", "endpoint_id", code.alias("code"))

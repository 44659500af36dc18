"""Queries on names, transforms and small rules (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import names, rules
from weftline.plans.registry import query
from weftline.sources.inputs import BASE, entity, table

U = f"""urns AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '{BASE}part#' || p_partkey WHEN 1 THEN '{BASE}part'
 WHEN 2 THEN 'service://repo-' || p_size || '/Part#get' ELSE 'urn:ldp:' || p_partkey END AS urn FROM part)"""


def _urns(spark, d):
    k = F.col("p_partkey")
    urn = F.when(k % 4 == 0, entity("part", k)).when(k % 4 == 1, f"{BASE}part").when(k % 4 == 2, F.concat(F.lit("service://repo-"), F.col("p_size").cast("string"), F.lit("/Part#get"))).otherwise(F.concat(F.lit("urn:ldp:"), k.cast("string")))
    return table(spark, d, "part").select(k.alias("id"), urn.alias("urn"))


@query(
    """SELECT id, CASE WHEN ok THEN split_part(urn, ':', 3) END AS env, CASE WHEN ok THEN split_part(urn, ':', 4) END AS platform, CASE WHEN ok THEN split_part(urn, ':', 5) END AS system,
    CASE WHEN ok THEN split_part(split_part(urn, ':', 6), '#', 1) END AS dataset, CASE WHEN ok AND contains(urn, '#') THEN split_part(urn, '#', 2) END AS element
    FROM (SELECT *, regexp_full_match(urn, 'urn:ldp:[^:#]+:[^:#]+:[^:#]+:[^:#]+(#[^:#]+)?') AS ok FROM urns)""",
    U,
)
def f1_urn_parts(spark, d):
    return _urns(spark, d).select("id", names.urn_parts(F.col("urn")).alias("u")).select("id", "u.env", "u.platform", "u.system", "u.dataset", "u.element")


@query(
    """SELECT id, starts_with(urn, 'urn:ldp:') AND contains(urn, '#') AS is_element, regexp_replace(urn, '#[^#]*$', '') AS dataset,
    CASE WHEN starts_with(urn, 'service://') THEN 'SERVICE' WHEN contains(urn, '#') THEN 'ELEMENT' ELSE 'DATASET' END AS kind,
    regexp_replace(urn, '^urn:ldp:[^:]*:', 'urn:ldp:*:') AS any_env FROM urns""",
    U,
)
def f2_f5_node_kinds(spark, d):
    u = F.col("urn")
    return _urns(spark, d).select("id", names.is_element(u).alias("is_element"), names.dataset_of(u).alias("dataset"), names.node_kind(u).alias("kind"), names.without_env(u).alias("any_env"))


@query("""SELECT count(*) AS n FROM urns a JOIN (SELECT DISTINCT replace(urn, 'staging', 'prod') AS other FROM urns) b
    ON regexp_replace(a.urn, '^urn:ldp:[^:]*:', '') = regexp_replace(b.other, '^urn:ldp:[^:]*:', '') AND a.urn LIKE 'urn:ldp:%:%'""", U)  # fmt: skip
def f4_same_asset(spark, d):
    u = _urns(spark, d)
    other = u.select(F.replace("urn", F.lit("staging"), F.lit("prod")).alias("other")).distinct()
    return u.where(F.col("urn").like("urn:ldp:%:%")).join(other, names.without_env(F.col("urn")) == names.without_env(F.col("other"))).agg(F.count("*").alias("n"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 's3' WHEN 1 THEN 's3' WHEN 2 THEN 'gs' ELSE 'hdfs' END AS scheme,
    nullif(regexp_replace(regexp_replace('/' || array_to_string(list_filter(string_split(regexp_extract(url, '://[^/]*(/.*)$', 1) || '//dt=1/h=' || page_id, '/'), lambda s: s <> ''), '/'),
    '(/[A-Za-z_][A-Za-z0-9_]*=[^/]*)+$', ''), '^/', ''), '') AS key FROM pages""")
def f6_f7_object_keys(spark, d):
    scheme = F.element_at(F.array(*map(F.lit, ("S3A", "s3", "gcs", "HDFS"))), (F.col("page_id") % 4 + 1).cast("int"))
    key = F.concat(F.regexp_extract("url", "://[^/]*(/.*)$", 1), F.lit("//dt=1/h="), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", names.canonical_scheme(scheme).alias("scheme"), names.canonical_key(key).alias("key"))


#: A url is made of parts, so what it must come to is known from them: passwords with @, :, ? and /, hosts in capitals, ports.
SECRETS = ["pw", "p@ss@", "a:b", "é%20", "p/w", ""]
MADE = "made AS (SELECT c_custkey AS k, 'h' || c_nationkey || '.Example' AS host, CASE WHEN c_custkey % 2 = 0 THEN ':' || (1000 + c_nationkey) ELSE '' END AS port, '/db' || c_custkey AS path, c_custkey % 6 AS kind FROM customer)"


def _made(spark, d, scheme):
    k = F.col("c_custkey")
    secret = F.element_at(F.array(*map(F.lit, SECRETS)), (k % 6 + 1).cast("int"))
    user = F.when(k % 6 == 5, "").otherwise(F.concat(F.lit("user:"), secret, F.lit("@")))
    port = F.when(k % 2 == 0, F.concat(F.lit(":"), (F.lit(1000) + F.col("c_nationkey")).cast("string"))).otherwise("")
    return table(spark, d, "customer").select(k, F.concat(F.lit(scheme), user, F.lit("h"), F.col("c_nationkey").cast("string"), F.lit(".Example"), port, F.lit("/db"), k.cast("string"), F.lit("?password=x#y")).alias("url"))


@query("SELECT k AS c_custkey, CASE WHEN kind <> 4 THEN 'jdbc:postgresql://' || lower(host) || port || path END AS url FROM made", MADE)
def f8_strip_credentials(spark, d):
    """Of a password with a slash no part is told from the host: null."""
    return _made(spark, d, "jdbc:PostgreSQL://").select("c_custkey", names.without_credentials(F.col("url")).alias("url"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'lake/' || s_nationkey || '/' || s_suppkey || '/' || s_nationkey END AS path,
    CASE WHEN s_suppkey % 3 = 0 THEN 'region' ELSE '' END AS missing FROM supplier""")
def f9_substitution(spark, d):
    s = table(spark, d, "supplier")
    text = F.when(F.col("s_suppkey") % 3 == 0, "lake/${nation}/${region}").otherwise("lake/${nation}/${id}/${nation}")
    config = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("id"), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", names.substitute(text, config).alias("path"), F.array_join(F.array_except(names.config_keys(text), F.map_keys(config)), ",").alias("missing"))


@query("""SELECT k AS c_custkey, CASE WHEN kind <> 4 THEN lower(host) ELSE '' END AS host, CASE WHEN kind = 4 THEN '/w@' || host || port || path ELSE path END AS route, CASE WHEN kind = 4 THEN 'api/w@' || host || port || path ELSE 'api' || path END AS joined FROM made""", MADE)
def f10_f11_service_urls(spark, d):
    s = names.service_url(F.col("url"))
    return _made(spark, d, "HTTP://").select("c_custkey", s["host"].alias("host"), s["route"].alias("route"), names.join_route(F.lit("api//"), s["route"]).alias("joined"))


#: Spellings of a transform, one for each remainder of the part's key, and what they all must come to.
SPELT = ["SUM( p_size )", "sum(p_size)", "CASE  When p_size >\n1.50 THEN 'A  AND b' else NULL END", "a AND b", "a and b", "cast(p_size As DATE)", "p_size+0.5*avg(x)", ""]
NORMAL = ["sum(p_size)", "sum(p_size)", "casewhenp_size>1.50then'AANDb'elseNULLend", "aANDb", "aandb", "cast(p_sizeasdate)", "p_size+0.5*avg(x)", ""]


@query("SELECT p_partkey, [" + ", ".join("'" + n.replace("'", "''") + "'" for n in NORMAL) + "][p_partkey % 8 + 1] AS transform FROM part")
def f12_normal_transform(spark, d):
    text = F.element_at(F.array(*map(F.lit, SPELT)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", rules.normal_transform(text).alias("transform"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, 'edge-' || substr(sha256('{{"edgeType":"DERIVES","from":["' || least(a, b) || '","' || greatest(a, b) || '"],"to":"{BASE}orders#' || l_orderkey || '"}}'), 1, 24) AS edge_key
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, '{BASE}part#' || l_partkey AS a, '{BASE}supplier#' || l_suppkey AS b FROM lineitem)""")
def f13_edge_keys(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return rows.select("*", rules.edge_key(F.array(entity("supplier", F.col("l_suppkey")), entity("part", F.col("l_partkey"))), entity("orders", F.col("l_orderkey")), F.lit("DERIVES")).alias("edge_key"))


#: Names with what JSON escapes, and how that is written.
ODD_NAMES = ['say "x"', "back\\\\slash", "é-ß", "tab\t", "😀", "plain"]
ODD_JSON = ['say \\"x\\"', "back\\\\\\\\slash", "\\u00e9-\\u00df", "tab\\t", "\\ud83d\\ude00", "plain"]


@query("SELECT c_custkey, 'edge-' || substr(sha256('{\"edgeType\":\"READS\",\"from\":[\"' || [" + ", ".join(f"'{n}'" for n in ODD_JSON) + "][c_custkey % 6 + 1] || '\"],\"to\":\"t' || c_custkey || '\"}'), 1, 24) AS edge_key FROM customer")
def f13_escaped_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, ODD_NAMES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", rules.edge_key(F.array(name), F.concat(F.lit("t"), F.col("c_custkey").cast("string")), F.lit("READS")).alias("edge_key"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'urn:ldp:staging:kafka:sys-' || c_nationkey || ':' || c_mktsegment END AS urn,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'kafka://sys-' || c_nationkey || '/' || c_mktsegment END AS wire FROM customer""")
def f14_f15_wire_ids(spark, d):
    wire = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("kafka:"), F.col("c_name"))).otherwise(F.concat(F.lit("kafka://sys-"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_mktsegment")))
    urn = names.wire_to_urn(wire, "staging")
    return table(spark, d, "customer").select("c_custkey", urn.alias("urn"), names.urn_to_wire(urn).alias("wire"))


#: Methods, and by the same remainder what they do; operations of a span, and their edge types.
METHODS = {"findByName": "READ", "saveAll": "WRITE", "flush": "WRITE", "merge": "UNKNOWN", "write": "UNKNOWN", "streamAll": "READ", "click": "UNKNOWN", "GetOne": "READ"}
OPERATIONS = {"select": "READS", "Insert": "WRITES", "PUT": "WRITES", "upsert": "CONNECTS", "query": "CONNECTS", "get": "READS", "": "CONNECTS"}


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""SELECT event_id, event_type IN ('purchase', 'view') AS matches, {_list(METHODS.values())}[event_id % 8 + 1] AS operation, {_list(OPERATIONS.values())}[event_id % 7 + 1] AS edge_type FROM events""")
def f16_f18_operations(spark, d):
    e, k = F.col("event_type"), F.col("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    field = F.when(e == "purchase", "LastName").when(e == "view", "last_name").otherwise("first")
    return table(spark, d, "events").select("event_id", names.column_matches(field, F.lit("last_name")).alias("matches"), rules.operation(pick(METHODS)).alias("operation"), rules.db_edge_type(pick(OPERATIONS)).alias("edge_type"))


@query("""SELECT o_orderkey, CASE WHEN c IN ('COLUMN_DROP') AND b >= 3 THEN 'BLOCK' WHEN c = 'NEW' THEN NULL WHEN b >= 2 THEN 'WARN' ELSE 'INFO' END AS severity,
    CASE WHEN b >= 3 THEN 'VERIFIED' WHEN b >= 1 THEN 'PROBABLE' ELSE 'INFERRED' END AS display, CASE b WHEN 4 THEN 96 WHEN 3 THEN 92 WHEN 2 THEN 78 WHEN 1 THEN 70 ELSE 55 END AS percent,
    CASE h WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'BREAK' ELSE 'WARN' END AS at_hop, CASE h WHEN 0 THEN 'RUNTIME,SCA' WHEN 1 THEN 'LLM' ELSE 'RUNTIME' END AS signals, CASE h WHEN 0 THEN o_orderdate WHEN 2 THEN o_orderdate END AS last_observed
    FROM (SELECT *, o_orderkey % 5 AS b, o_orderkey % 3 AS h, CASE o_orderstatus WHEN 'F' THEN 'COLUMN_DROP' WHEN 'O' THEN 'COLUMN_RENAME' ELSE 'NEW' END AS c FROM orders)""")
def f19_f21_severity(spark, d):
    band = rules.named(F.col("o_orderkey") % 5, rules.BANDS)
    change = F.when(F.col("o_orderstatus") == "F", "COLUMN_DROP").when(F.col("o_orderstatus") == "O", "COLUMN_RENAME").otherwise("NEW")
    claim = lambda m, at: F.struct(F.lit(m).alias("mechanism"), at.alias("observed_at"))
    day, before = F.col("o_orderdate"), F.col("o_orderdate") - F.make_dt_interval(F.lit(3))
    h = F.col("o_orderkey") % 3
    provenance = F.when(h == 0, F.array(claim("SCA", day), claim("RUNTIME", before), claim("RUNTIME", day))).when(h == 1, F.array(claim("LLM", day), claim("LLM", before))).otherwise(F.array(claim("RUNTIME", day), claim("", before)))
    shown = rules.displayed(band, provenance)
    return table(spark, d, "orders").select(
        "o_orderkey", rules.severity(change, band).alias("severity"), shown["display"].alias("display"), shown["percent"].alias("percent"), rules.hop_severity(h).alias("at_hop"),
        F.array_join(shown["signals"], ",").alias("signals"), shown["last_observed"].alias("last_observed"),
    )


#: Payloads, one for each remainder of the event's key, and what is wrong with them.
PAYLOADS = {
    '{"k": 1, "name": "x"}': None,
    '{"k": 1, "extra": 2}': None,
    '{"k": {"a": [{"DB.Statement": "select 1"}]}}': "PROHIBITED_FIELD",
    '{"k": ["Bearer abc"]}': "SECRET_VALUE",
    '{"k": {"values": []}}': "PROHIBITED_FIELD",
    '{"k": "payload", "body": "tokens"}': None,
    '{"k": "a password=1"}': "SECRET_VALUE",
    '{"k": "say \\"token\\": x"}': None,
    "{": "MALFORMED",
}


@query("""SELECT event_id, [""" + ", ".join("NULL" if v is None else f"'{v}'" for v in PAYLOADS.values()) + """][event_id % 9 + 1] AS problem, 'k' AS kept, ['name', 'extra', '', '', '', 'body', '', '', NULL][event_id % 9 + 1] AS unknown,
    event_id % 4 IN (0, 1) AS span_prohibited FROM events""")  # fmt: skip
def f22_f24_metadata(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    body = F.element_at(F.array(*map(F.lit, PAYLOADS)), (k % len(PAYLOADS) + 1).cast("int"))
    attributes = F.create_map(F.lit("k"), body, F.lit("drop_me"), body)
    span_key = F.when(k % 4 == 0, "http.request.Header.x").otherwise("http.route")
    span_value = F.when(k % 4 == 1, "TOKEN=1").otherwise(F.col("event_type"))
    return e.select("event_id", rules.prohibited(body).alias("problem"), F.array_join(F.map_keys(rules.only_allowed(attributes, ("k",))), ",").alias("kept"), F.array_join(rules.unknown_fields(body, ("k",)), ",").alias("unknown"), rules.span_prohibited(span_key, span_value).alias("span_prohibited"))


@query("""SELECT o_orderkey, greatest(0, CAST(epoch(TIMESTAMP '1996-01-01') - epoch(o_orderdate) AS BIGINT)) AS age_s, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'awaiting' ELSE 'failed' END AS category,
    o_orderkey % 10 AS stage, CASE WHEN o_orderkey % 3 = 0 THEN 'runtime' WHEN o_orderkey % 3 = 1 THEN 'llm' ELSE 'static' END AS evidence FROM orders""")
def f25_f30_run_states(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "O", "IN_REVIEW").otherwise("FAILED_TERMINAL")
    mechanisms = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("SCA"), F.lit("RUNTIME"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("LLM"), F.lit("SCA"))).otherwise(F.array(F.lit("SCA")))
    stage = F.concat(F.lit("B"), (F.col("o_orderkey") % 10).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", rules.age_seconds(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp")).alias("age_s"), rules.run_category(state).alias("category"), rules.stage_number(stage).cast("bigint").alias("stage"), rules.evidence_class(mechanisms).alias("evidence"))


@query("""SELECT id, list_last(regexp_split_to_array(urn, '[:#/]')) AS title,
    CASE WHEN contains(urn, '#') THEN list_last(regexp_split_to_array(regexp_replace(urn, '#[^#]*$', ''), '[:#/]')) WHEN starts_with(urn, 'service://') THEN split_part(substr(urn, 11), '/', 1)
    ELSE regexp_extract(urn, '^urn:ldp:[^:]*:[^:]*:([^:#]*)', 1) END AS container FROM urns""", U)  # fmt: skip
def f27_titles(spark, d):
    return _urns(spark, d).select("id", names.title(F.col("urn")).alias("title"), names.container(F.col("urn")).alias("container"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size) || '.' || (p_partkey % 9) END AS version,
    translate(to_base64(encode('["' || p_partkey || '","' || p_size || '"]')), '+/=', '-_') AS cursor FROM part""")
def f31_f32_versions(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "R__views.sql").otherwise(F.concat(F.lit("V"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 9).cast("string"), F.lit("__x.sql")))
    version = rules.version_tuple(name)
    return table(spark, d, "part").select("p_partkey", F.when(version.isNotNull(), F.array_join(F.transform(version, lambda v: v.cast("string")), ".")).alias("version"), rules.cursor(F.col("p_partkey"), F.col("p_size")).alias("cursor"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN [p_name || CASE WHEN p_partkey % 4 = 0 THEN ' "é"' ELSE '' END, p_partkey::VARCHAR][1] END AS first, CASE WHEN p_partkey % 4 < 2 THEN p_partkey::VARCHAR END AS second FROM part""")
def f32_cursors_read(spark, d):
    """Cursors of a name and a key, read again; some are cut short, some hold one text more."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 4 == 0, ' "é"').otherwise(""))
    whole = F.when(k % 4 == 3, rules.cursor(name, k, k)).otherwise(rules.cursor(name, k))
    text = F.when(k % 4 == 2, F.substring(whole, F.lit(1), F.length(whole) - 6)).otherwise(whole)
    read = rules.cursor_values(text, 2)
    return table(spark, d, "part").select("p_partkey", read[0].alias("first"), read[1].alias("second"))

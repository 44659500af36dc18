"""What Maven and Gradle build files say about the framework of a repository.

A pom is read by Spark's XML functions into one typed row. What it inherits (Boot evidence, properties) comes by joins with the pom of the coordinates that it names as its
parent, level by level, until nothing is new; so cycles end by themselves. Gradle files are cut into tokens by one expression; the block that a token stands in is a fold over
its own file's tokens. Versions are compared as arrays of numbers.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.checkpoints import cut

BOOT, PARENT, PLUGIN, STARTER = "org.springframework.boot", "spring-boot-starter-parent", "spring-boot-maven-plugin", "spring-boot-starter-data-jpa"
DATA, DIRECT = "org.springframework.data", "spring-data-jpa"
#: Supported versions are from the first on, and below the second.
FROM, BELOW = (3, 0, 0), (5, 0, 0)
CONFIGURATIONS = ("api", "compileOnly", "implementation", "runtimeOnly")

_COORDINATES = "groupId: string, artifactId: string, version: string"
_POM = f"groupId string, artifactId string, version string, parent struct<{_COORDINATES}>, properties map<string, string>, build struct<plugins: struct<plugin: array<struct<{_COORDINATES}>>>>, dependencies struct<dependency: array<struct<{_COORDINATES}, scope: string, optional: string>>>, corrupt string"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
_ITEM = "struct<kind: string, group: string, artifact: string, version: string, inherited: boolean>"
_TOLD = "struct<code: string, symbol: string>"


def semantic_version(text: Column) -> Column:
    """``3.2.10`` as [3, 2, 10]; null for any other form."""
    return F.when(text.rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\z"), F.transform(F.split(text, r"\."), lambda n: n.cast("decimal(38,0)")))


def is_supported(text: Column) -> Column:
    bound = lambda v: F.array(*[F.lit(n).cast("decimal(38,0)") for n in v])
    v = semantic_version(text)
    return F.coalesce((v >= bound(FROM)) & (v < bound(BELOW)), F.lit(False))


def is_dynamic(text: Column) -> Column:
    return text.rlike(r"\$\{|\$[A-Za-z_]|\+")


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _told(code: Column | str, symbol: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(code).alias("code"), lit(symbol).alias("symbol"))


def _item(kind: str, group: Column, artifact: Column, version: Column, inherited: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), group.alias("group"), artifact.alias("artifact"), version.alias("version"), inherited.alias("inherited"))


def boot_version_residue(version: Column) -> Column:
    """The residue of a Boot version; null if it is supported."""
    return F.when(version == "", _told("missing-boot-version", "<missing>")).when(is_dynamic(version), _told("dynamic-framework-evidence", version)).when(~is_supported(version), _told("unsupported-boot-version", version))


def poms(files: DataFrame) -> DataFrame:
    """Each pom.xml of (repository, path, content): its coordinates and its parent's, whether it is an aggregator, and ``pom``; ``bad`` has the residue of one that is not read."""
    own = files.where(F.element_at(F.split("path", "/"), -1) == "pom.xml").withColumn("pom", F.from_xml("content", _POM, _OPTIONS))
    declared = F.upper("content").rlike("<!DOCTYPE|<!ENTITY")
    malformed = F.col("pom").isNull() | F.col("pom.corrupt").isNotNull() | (F.trim("content") == "")
    bad = F.when(declared, _told("dynamic-framework-evidence", "DOCTYPE/ENTITY")).when(malformed, _told("malformed-build-file", "pom.xml"))
    own = own.withColumn("bad", bad)
    group = F.when(_text(F.col("pom.groupId")) != "", _text(F.col("pom.groupId"))).otherwise(_text(F.col("pom.parent.groupId")))
    return own.select(
        "repository", "path", "pom", "bad", group.alias("group"), _text(F.col("pom.artifactId")).alias("artifact"), _text(F.col("pom.parent.groupId")).alias("parent_group"), _text(F.col("pom.parent.artifactId")).alias("parent_artifact"),
        F.when(F.col("bad").isNull(), F.xpath_boolean("content", F.lit("/*/modules"))).otherwise(F.lit(False)).alias("aggregator"),
    )


def _maven_boot(read: DataFrame) -> DataFrame:
    """Adds each pom's own Boot evidence, residue, and whether it is relevant and invalid."""
    by_parent = (F.col("parent_group") == BOOT) & (F.col("parent_artifact") == PARENT)
    version = _text(F.col("pom.parent.version"))
    wrong = boot_version_residue(version)
    parent = F.when(by_parent & wrong.isNull(), F.array(_item("boot-parent", F.lit(BOOT), F.lit(PARENT), version, F.lit(False)))).otherwise(_none(_ITEM))
    read = read.withColumn("from_parent", parent).withColumn("told", F.when(by_parent & wrong.isNotNull(), F.array(wrong)).otherwise(_none(_TOLD)))
    group = lambda p: F.coalesce(F.trim(p["groupId"]), F.lit(BOOT))
    plugins = F.filter(F.coalesce("pom.build.plugins.plugin", F.array()), lambda p: (group(p) == BOOT) & (F.trim(p["artifactId"]) == PLUGIN))
    inherits = lambda p: (_text(p["version"]) == "") & (F.size("from_parent") == 1)
    resolved = lambda p: F.when(inherits(p), F.col("from_parent")[0]["version"]).otherwise(_text(p["version"]))
    read = read.withColumn("plugins", F.transform(plugins, lambda p: F.struct(resolved(p).alias("version"), inherits(p).alias("inherited"))))
    good = F.transform(F.filter("plugins", lambda p: boot_version_residue(p["version"]).isNull()), lambda p: _item("boot-plugin", F.lit(BOOT), F.lit(PLUGIN), p["version"], p["inherited"]))
    wrong_plugins = F.filter(F.transform("plugins", lambda p: boot_version_residue(p["version"])), lambda r: r.isNotNull())
    read = read.withColumn("told", F.concat("told", wrong_plugins)).withColumn("boot", F.concat("from_parent", good))
    relevant = by_parent | (F.size("plugins") > 0) | F.col("aggregator") | F.col("bad").isNotNull()
    told = F.when(F.col("bad").isNotNull(), F.array("bad")).otherwise(F.col("told"))
    return read.withColumn("told", told).withColumn("relevant", relevant).withColumn("invalid", F.size(told) > 0).drop("from_parent", "plugins")


def inherited_boot(read: DataFrame, levels: int | None = None) -> DataFrame:
    """Boot evidence of poms without any of their own, from the pom that they name as their parent, up to so many levels; None: as far as it goes.

    Of several poms of one repository with the same coordinates the one of the last path counts. A chain that leads back to itself, or out of the repository, gives none.
    """
    rows = cut(read)
    known = rows.where((F.size("boot") > 0) & (F.col("artifact") != "")).select("repository", "path", "group", "artifact", "boot")
    open_ = rows.where((F.size("boot") == 0) & (F.col("parent_artifact") != ""))
    found = known.limit(0).select("repository", "path", "boot")
    front = known
    for level in itertools.count(1):
        if levels is not None and level > levels:
            break
        giving = front.groupBy("repository", "group", "artifact").agg(F.max_by("boot", "path").alias("given")).select("repository", F.col("group").alias("parent_group"), F.col("artifact").alias("parent_artifact"), "given")
        got = open_.drop("boot").join(giving, ["repository", "parent_group", "parent_artifact"]).join(found.select("repository", "path"), ["repository", "path"], "left_anti")
        front = cut(got.select("repository", "path", "group", "artifact", F.transform("given", lambda b: b.withField("inherited", F.lit(True))).alias("boot")))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front.select("repository", "path", "boot")))
    given = found.select("repository", "path", F.col("boot").alias("given"))
    joined = rows.join(given, ["repository", "path"], "left")
    return joined.withColumn("relevant", F.col("relevant") | F.col("given").isNotNull()).withColumn("boot", F.coalesce("given", "boot")).drop("given")


def _with_jpa(rows: DataFrame, wanted: Column) -> DataFrame:
    """Judges the dependencies ``wanted``, (group, artifact, version) each, of rows that have their Boot evidence."""
    versions = F.array_distinct(F.transform("boot", lambda b: b["version"]))
    managed = F.when(F.size(versions) == 1, versions[0])
    rows = rows.withColumn("wanted", wanted).withColumn("managed", managed)
    dynamic = lambda d: is_dynamic(d["group"]) | is_dynamic(d["artifact"]) | is_dynamic(d["version"])
    version = lambda d: F.when(d["version"] != "", d["version"]).otherwise(F.col("managed"))
    name = lambda d: F.concat_ws(":", d["group"], d["artifact"])
    wrong = lambda d: F.when(dynamic(d), _told("dynamic-framework-evidence", F.concat_ws(":", d["group"], d["artifact"], d["version"]))).when(version(d).isNull(), _told("missing-jpa-version", name(d))).when(~is_supported(version(d)), _told("unsupported-jpa-version", version(d)))
    jpa = F.transform(F.filter("wanted", lambda d: wrong(d).isNull()), lambda d: _item("data-jpa", d["group"], d["artifact"], version(d), d["version"] == ""))
    told = F.filter(F.transform("wanted", wrong), lambda r: r.isNotNull())
    rows = rows.withColumn("jpa", jpa).withColumn("found", told)
    return rows.withColumn("told", F.concat("told", "found")).withColumn("invalid", F.col("invalid") | (F.size("found") > 0)).drop("wanted", "managed", "found")


_CLOSURE = ("repository", "path", "boot", "jpa", "relevant", "invalid", "aggregator", "told")


def maven_closures(files: DataFrame, levels: int | None = None) -> DataFrame:
    """(repository, path, boot, jpa, relevant, invalid, aggregator, told) of each pom."""
    read = inherited_boot(_maven_boot(poms(files)), levels)
    supported = lambda d: ((F.trim(d["groupId"]) == BOOT) & (F.trim(d["artifactId"]) == STARTER)) | ((F.trim(d["groupId"]) == DATA) & (F.trim(d["artifactId"]) == DIRECT))
    every = F.when(F.col("bad").isNull(), F.filter(F.coalesce("pom.dependencies.dependency", F.array()), supported)).otherwise(F.array())
    read = read.withColumn("relevant", F.col("relevant") | (F.size(every) > 0))
    active = F.filter(every, lambda d: F.coalesce(F.trim(d["scope"]), F.lit("compile")).isin("", "compile", "runtime") & (F.lower(F.coalesce(F.trim(d["optional"]), F.lit("false"))) != "true"))
    wanted = F.transform(active, lambda d: F.struct(F.trim(d["groupId"]).alias("group"), F.trim(d["artifactId"]).alias("artifact"), _text(d["version"]).alias("version")))
    return _with_jpa(read, wanted).select(*_CLOSURE)


#: Comments, strings, names, single marks; a slash or a lone quote that is none of these is a token of its own, which spoils the file.
_TOKEN = r"""(?s)//[^\n]*|/\*.*?\*/|\"{3}|'{3}|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[\p{L}_$][\p{L}\p{N}_.$-]*|\S"""
_OPEN, _CLOSE = "{([", "})]"


def gradle_tokens(content: Column) -> Column:
    """(kind, value, block) of each token of a Gradle file; block: the names of the braces around it, joined by a slash. Kind is string, name, mark, or bad."""
    raw = F.filter(F.regexp_extract_all(content, F.lit(_TOKEN), 0), lambda t: ~t.rlike(r"\A(?://|/\*)"))
    quoted, name = r"""(?s)\A(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')\z""", r"\A[\p{L}_$]"
    kind = lambda t: F.when(t.isin('"""', "'''", "/", '"', "'", "$/"), "bad").when(t.rlike(quoted), "string").when(t.rlike(name), "name").otherwise("mark")
    value = lambda t: F.when(t.rlike(quoted), F.regexp_replace(F.regexp_replace(t, r"(?s)\A.(.*).\z", "$1"), r"(?s)\\(.)", "$1")).otherwise(t)
    tokens = F.transform(raw, lambda t: F.struct(kind(t).alias("kind"), value(t).alias("value")))
    zero = F.struct(_none("string").alias("open"), _none("string").alias("label"), F.lit("").alias("last"), _none("struct<kind: string, value: string, block: string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        closes = F.instr(F.lit(_CLOSE), t["value"])
        mark, opens = t["kind"] == "mark", F.instr(F.lit(_OPEN), t["value"]) > 0
        match = F.when(F.size(s["open"]) > 0, F.element_at(s["open"], -1)).otherwise("") == F.substring(F.lit(_OPEN), closes, F.lit(1))
        here = F.array_join(F.filter(s["label"], lambda x: x != "("), "/")
        wrong = mark & (closes > 0) & ~match
        nested = mark & (t["value"] == "{") & s["last"].isin("dependencies", "plugins") & (F.size(s["open"]) > 0)
        out = F.concat(s["out"], F.array(F.struct(F.when(wrong | nested, "bad").otherwise(t["kind"]).alias("kind"), t["value"].alias("value"), here.alias("block"))))
        less = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        open_ = F.when(mark & opens, F.concat(s["open"], F.array(t["value"]))).when(mark & (closes > 0), less(s["open"])).otherwise(s["open"])
        label = F.when(mark & opens, F.concat(s["label"], F.array(F.when(t["value"] == "{", s["last"]).otherwise("(")))).when(mark & (closes > 0), less(s["label"])).otherwise(s["label"])
        return F.struct(open_.alias("open"), label.alias("label"), F.when(t["kind"] == "name", t["value"]).otherwise("").alias("last"), out.alias("out"))

    unclosed = lambda s: F.when(F.size(s["open"]) > 0, F.array(F.struct(F.lit("bad").alias("kind"), F.lit("").alias("value"), F.lit("").alias("block")))).otherwise(_none("struct<kind: string, value: string, block: string>"))
    return F.aggregate(tokens, zero, step, lambda s: F.concat(s["out"], unclosed(s)))


def _argument(i: Column) -> Column:
    """The place of the token after place i, a bracket left out."""
    return F.when(F.get("tokens", i)["value"] == "(", i + 1).otherwise(i)


def gradle_closures(files: DataFrame) -> DataFrame:
    """(repository, path, boot, jpa, relevant, invalid, aggregator, told) of each Gradle file."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(name.isin("build.gradle", "build.gradle.kts")).withColumn("tokens", gradle_tokens(F.col("content")))
    rows = rows.withColumn("bad", F.exists("tokens", lambda t: t["kind"] == "bad"))
    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    at = lambda i: F.get("tokens", i)
    is_ = lambda i, block, *values: (at(i)["kind"] == "name") & (at(i)["block"] == block) & at(i)["value"].isin(*values) & (at(_argument(i + 1))["kind"] == "string")
    close = lambda i: F.when(at(i)["value"] == ")", i + 1).otherwise(i)
    named = lambda i: close(_argument(i + 1) + 1)
    given = lambda i: F.when((at(named(i))["kind"] == "name") & (at(named(i))["value"] == "version") & (at(_argument(named(i) + 1))["kind"] == "string"), at(_argument(named(i) + 1))["value"])
    usable = (F.size("tokens") > 0) & ~F.col("bad")
    plugins = F.when(usable, F.filter(F.transform(F.filter(places, lambda i: is_(i, "plugins", "id")), lambda i: F.struct(at(_argument(i + 1))["value"].alias("id"), given(i).alias("version"))), lambda p: p["id"] == BOOT)).otherwise(F.array())
    wanted = F.when(usable, F.transform(F.filter(places, lambda i: is_(i, "dependencies", *CONFIGURATIONS)), lambda i: F.split(F.trim(at(_argument(i + 1))["value"]), ":"))).otherwise(F.array())
    supported = lambda p: (F.size(p) >= 2) & (((p[0] == BOOT) & (F.get(p, F.lit(1)) == STARTER)) | ((p[0] == DATA) & (F.get(p, F.lit(1)) == DIRECT)))
    rows = rows.withColumn("plugins", plugins).withColumn("parts", F.filter(wanted, supported))
    wrong = lambda p: F.when(p["version"].isNull(), _told("missing-boot-version", p["id"])).otherwise(boot_version_residue(p["version"]))
    rows = rows.withColumn("boot", F.transform(F.filter("plugins", lambda p: wrong(p).isNull()), lambda p: _item("boot-plugin", F.lit(BOOT), F.lit(""), p["version"], F.lit(False))))
    told = F.when(F.col("bad"), F.array(_told("malformed-build-file", name))).otherwise(F.filter(F.transform("plugins", wrong), lambda r: r.isNotNull()))
    rows = rows.withColumn("told", told).withColumn("invalid", F.size("told") > 0).withColumn("aggregator", F.lit(False))
    rows = rows.withColumn("relevant", F.col("bad") | (F.size("plugins") > 0) | (F.size("parts") > 0))
    # a coordinate of more than three parts is told as a dynamic one
    version = lambda p: F.when(F.size(p) > 3, "+").when(F.size(p) == 3, p[2]).otherwise("")
    return _with_jpa(rows, F.transform("parts", lambda p: F.struct(p[0].alias("group"), p[1].alias("artifact"), version(p).alias("version")))).select(*_CLOSURE)


def classify(files: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(repository, cell, evidence) and residue (repository, path, code, symbol) of files (repository, path, content).

    cell is spring-data-jpa where all relevant build files agree on one supported Boot version and on one version of each dependency, else null; evidence: what was found, ordered. A
    repository has as many rows here as it has build files.
    """
    closures = cut(maven_closures(files, levels).unionByName(gradle_closures(files)))
    relevant = closures.where("relevant")
    lacks = lambda cond, code: relevant.where(cond).select("repository", "path", F.lit(code).alias("code"), F.col("path").alias("symbol"))
    residue = [closures.select("repository", "path", F.explode("told").alias("r")).select("repository", "path", "r.code", "r.symbol"), lacks(F.size("boot") == 0, "missing-boot-evidence"), lacks((F.size("jpa") == 0) & ~F.col("aggregator"), "missing-jpa-dependency")]
    whole = files.select("repository").distinct().join(relevant.groupBy("repository").agg(F.lit(True).alias("some"), F.max(F.col("invalid") | (F.size("boot") == 0) | ((F.size("jpa") == 0) & ~F.col("aggregator"))).alias("incomplete")), "repository", "left")
    items = relevant.select("repository", "path", F.explode(F.concat("boot", "jpa")).alias("i")).select("repository", "path", "i.*")
    boots = items.where("kind <> 'data-jpa'").groupBy("repository").agg(F.array_sort(F.collect_set("version")).alias("boots"))
    jpas = items.where("kind = 'data-jpa'")
    odd = jpas.join(boots, "repository").groupBy("repository").agg(
        F.max(F.when(F.col("artifact") == DIRECT, F.concat_ws(":", "path", "kind", "group", "artifact", "version"))).alias("direct"),
        F.max(F.when(~F.col("inherited") & (F.col("artifact") == STARTER) & (F.split("version", r"\.")[0] != F.split(F.col("boots")[0], r"\.")[0]), F.concat(F.lit("boot="), F.col("boots")[0], F.lit(";jpa="), "version"))).alias("other"),
    )
    several = jpas.groupBy("repository", "group", "artifact").agg(F.array_sort(F.collect_set("version")).alias("versions")).where(F.size("versions") > 1)
    several = several.groupBy("repository").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.concat_ws(":", "group", "artifact"), F.lit("="), F.array_join("versions", "/")))), ";").alias("several"))
    whole = whole.join(boots, "repository", "left").join(odd, "repository", "left").join(several, "repository", "left")
    code = F.when(F.col("some").isNull(), _told("unknown-framework", DIRECT)).when(F.col("incomplete"), _told("", "")).when(F.size("boots") > 1, _told("ambiguous-framework-evidence", F.array_join("boots", "/")))
    code = code.when(F.col("direct").isNotNull(), _told("unsupported-direct-spring-data-jpa", F.col("direct"))).when(F.col("other").isNotNull(), _told("incompatible-framework-cell", F.col("other"))).when(F.col("several").isNotNull(), _told("ambiguous-framework-evidence", F.col("several")))
    whole = whole.withColumn("r", code)
    residue.append(whole.where(F.col("r.code") != "").select("repository", F.lit(None).cast("string").alias("path"), "r.code", "r.symbol"))
    coordinate = F.concat_ws(":", "path", "kind", "group", F.when(F.col("artifact") != "", F.col("artifact")), "version", F.when(F.col("inherited"), "inherited"))
    evidence = items.groupBy("repository").agg(F.array_sort(F.collect_set(coordinate)).alias("evidence"))
    cells = whole.join(evidence, "repository", "left").select("repository", F.when(F.col("r").isNull(), "spring-data-jpa").alias("cell"), F.when(F.col("r").isNull(), F.col("evidence")).otherwise(_none("string")).alias("evidence"))
    return cells, reduce(DataFrame.unionByName, residue)


def properties(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repository, path, name, value) of each pom, its own and those of its ancestors, the nearest first, with ``${...}`` replaced; and residue.

    A reference to a property that no pom of the chain has is unknown-property; one that leads back to itself is cyclic-property.
    """
    read = cut(poms(files).where("bad IS NULL").select("repository", "path", "group", "artifact", "parent_group", "parent_artifact", "pom"))
    up = read.groupBy("repository", "group", "artifact").agg(F.max("path").alias("ancestor")).select("repository", F.col("group").alias("parent_group"), F.col("artifact").alias("parent_artifact"), "ancestor")
    parents = cut(read.where("parent_artifact <> ''").join(up, ["repository", "parent_group", "parent_artifact"]).select("repository", "path", "ancestor"))
    reach = cut(read.select("repository", "path", F.col("path").alias("ancestor"), F.lit(0).alias("depth")))
    front = reach
    for depth in itertools.count(1):
        further = front.select("repository", F.col("path").alias("own"), F.col("ancestor").alias("path")).join(parents, ["repository", "path"]).select("repository", F.col("own").alias("path"), "ancestor")
        front = cut(further.join(reach.select("repository", "path", "ancestor"), ["repository", "path", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        reach = cut(reach.unionByName(front))
    built_in = ("project.version", "project.groupId", "project.artifactId")
    declared = read.select("repository", F.col("path").alias("ancestor"), F.explode(F.map_concat(F.map_filter(F.coalesce("pom.properties", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*built_in)), F.map_from_arrays(F.array(*[F.lit(b) for b in built_in]), F.array(_text(F.coalesce("pom.version", "pom.parent.version")), "group", "artifact")))).alias("name", "value"))
    values = cut(reach.join(declared, ["repository", "ancestor"]).groupBy("repository", "path", "name").agg(F.min_by(_text(F.col("value")), "depth").alias("value")))
    reference = r"\$\{([^}$]*)\}"
    while True:
        plain = values.where(~F.col("value").rlike(reference)).select("repository", "path", F.col("name").alias("ref"), F.col("value").alias("by"))
        asked = values.where(F.col("value").rlike(reference)).select("repository", "path", "name", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(reference), 1))).alias("ref"))
        told = asked.join(plain, ["repository", "path", "ref"]).groupBy("repository", "path", "name").agg(F.collect_list(F.struct("ref", "by")).alias("all"))
        if told.isEmpty():
            break
        replaced = F.aggregate("all", F.col("value"), lambda v, r: F.replace(v, F.concat(F.lit("${"), r["ref"], F.lit("}")), r["by"]))
        values = cut(values.join(told, ["repository", "path", "name"], "left").select("repository", "path", "name", F.when(F.col("all").isNotNull(), replaced).otherwise(F.col("value")).alias("value")))
    left = values.where(F.col("value").rlike(reference)).select("repository", "path", "name", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(reference), 1))).alias("ref"))
    there = values.select("repository", "path", F.col("name").alias("ref"), F.lit(True).alias("there"))
    residue = left.join(there, ["repository", "path", "ref"], "left").groupBy("repository", "path", "name").agg(F.when(F.count("*") > F.count("there"), "unknown-property").otherwise("cyclic-property").alias("code"))
    return values.where(~F.col("value").rlike(reference)), residue

"""Build files whose classification is plain from their text."""

import pytest
from pyspark.sql import functions as F

from weftline.sources import builds

FILES = "repository string, path string, content string"
JPA = "<dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-data-jpa</artifactId>{}</dependency>"


def pom(artifact="a", parent="", rest="", jpa=JPA.format("")):
    return f'<project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>g</groupId><artifactId>{artifact}</artifactId><version>1</version>{parent}{rest}<dependencies>{jpa}</dependencies></project>'


def boot(version):
    return f"<parent><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-parent</artifactId><version>{version}</version></parent>"


def of(artifact):
    return f"<parent><groupId>g</groupId><artifactId>{artifact}</artifactId></parent>"


GRADLE = "// build\nplugins { id 'java'; id(\"org.springframework.boot\") version '3.2.1' }\ndependencies { /* x */ implementation('org.springframework.boot:spring-boot-starter-data-jpa') }\n"


#: Files of a repository, the evidence of its cell if it has one, and what is residue.
CASES = [
    ({"pom.xml": pom(parent=boot("3.1.4"))}, "pom.xml:boot-parent:org.springframework.boot:spring-boot-starter-parent:3.1.4 pom.xml:data-jpa:org.springframework.boot:spring-boot-starter-data-jpa:3.1.4:inherited", []),
    ({"build.gradle": GRADLE}, "build.gradle:boot-plugin:org.springframework.boot:3.2.1 build.gradle:data-jpa:org.springframework.boot:spring-boot-starter-data-jpa:3.2.1:inherited", []),
    ({"pom.xml": pom(parent=boot("3.1.4"), jpa="")}, None, ["missing-jpa-dependency pom.xml"]),
    ({"pom.xml": pom(parent=boot("3.1.4"), jpa=JPA.format("<scope>test</scope>"))}, None, ["missing-jpa-dependency pom.xml"]),
    ({"pom.xml": pom(parent=boot("${v}"))}, None, ["dynamic-framework-evidence ${v}", "missing-boot-evidence pom.xml", "missing-jpa-dependency pom.xml", "missing-jpa-version org.springframework.boot:spring-boot-starter-data-jpa"]),
    ({"pom.xml": pom(parent=boot("10.0.0"))}, None, ["missing-boot-evidence pom.xml", "missing-jpa-dependency pom.xml", "missing-jpa-version org.springframework.boot:spring-boot-starter-data-jpa", "unsupported-boot-version 10.0.0"]),
    ({"pom.xml": pom(parent=boot("3.1.4"), jpa=JPA.format("<version>4.0.0</version>"))}, None, ["incompatible-framework-cell boot=3.1.4;jpa=4.0.0"]),
    ({"pom.xml": "<project>"}, None, ["malformed-build-file pom.xml", "missing-boot-evidence pom.xml", "missing-jpa-dependency pom.xml"]),
    ({"pom.xml": "<!DOCTYPE x><project/>"}, None, ["dynamic-framework-evidence DOCTYPE/ENTITY", "missing-boot-evidence pom.xml", "missing-jpa-dependency pom.xml"]),
    ({"pom.xml": pom(), "x.txt": ""}, None, ["missing-boot-evidence pom.xml", "missing-jpa-dependency pom.xml", "missing-jpa-version org.springframework.boot:spring-boot-starter-data-jpa"]),
    ({"x.txt": ""}, None, ["unknown-framework spring-data-jpa"]),
    ({"build.gradle": GRADLE.replace("dependencies", "a { dependencies") + "}"}, None, ["malformed-build-file build.gradle", "missing-boot-evidence build.gradle", "missing-jpa-dependency build.gradle"]),
    ({"build.gradle": GRADLE + "'"}, None, ["malformed-build-file build.gradle", "missing-boot-evidence build.gradle", "missing-jpa-dependency build.gradle"]),
    ({"build.gradle.kts": GRADLE.replace(" version '3.2.1'", "")}, None, ["missing-boot-evidence build.gradle.kts", "missing-boot-version org.springframework.boot", "missing-jpa-dependency build.gradle.kts", "missing-jpa-version org.springframework.boot:spring-boot-starter-data-jpa"]),
    ({"a/pom.xml": pom("a", boot("3.1.4")), "b/build.gradle": GRADLE}, None, ["ambiguous-framework-evidence 3.1.4/3.2.1"]),
]


@pytest.fixture(scope="module")
def classified(spark):
    """All cases as repositories of one table."""
    files = spark.createDataFrame([(str(i), p, c) for i, (own, _, _) in enumerate(CASES) for p, c in own.items()], FILES)
    cells, residue = builds.classify(files)
    return {r["repository"]: r for r in cells.collect()}, residue.collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cells(classified, i):
    _, cell, codes = CASES[i]
    cells, residue = classified
    row = cells[str(i)]
    assert (row["cell"], " ".join(row["evidence"])) == (("spring-data-jpa", cell) if cell else (None, ""))
    assert sorted(f"{r['code']} {r['symbol']}" for r in residue if r["repository"] == str(i)) == codes


def test_parents_at_any_distance_and_cycles(spark):
    chain = {"m0/pom.xml": pom("m0", boot("3.3.0"), "<modules><module>m1</module></modules>", "")} | {f"m{i}/pom.xml": pom(f"m{i}", of(f"m{i - 1}")) for i in range(1, 7)}
    cycle = {f"c{i}/pom.xml": pom(f"c{i}", of(f"c{(i + 1) % 3}")) for i in range(3)}
    files = spark.createDataFrame([("chain", p, c) for p, c in chain.items()] + [("cycle", p, c) for p, c in cycle.items()], FILES)
    cells, residue = builds.classify(files)
    assert {r["repository"]: (r["cell"], len(r["evidence"])) for r in cells.collect()} == {"chain": ("spring-data-jpa", 7 + 6), "cycle": (None, 0)}
    assert residue.where("repository = 'chain'").count() == 0 and residue.where("code = 'missing-boot-evidence'").count() == 3
    near = {r["path"]: len(r["boot"]) for r in builds.maven_closures(files, levels=1).where("repository = 'chain'").collect()}
    assert [near[f"m{i}/pom.xml"] for i in range(7)] == [1, 1, 0, 0, 0, 0, 0]


def test_properties(spark):
    poms = {
        "a/pom.xml": pom("a", "", "<properties><x>1</x><y>${x}.${project.version}</y><z>${y}-${w}</z><p>${q}</p><q>${p}</q></properties>"),
        "b/pom.xml": pom("b", of("a"), "<properties><x>2</x><w>w</w></properties>"),
        "c/pom.xml": pom("c", of("b"), "<properties><x>${y}</x></properties>"),
    }
    values, residue = builds.properties(spark.createDataFrame([("r", p, c) for p, c in poms.items()], FILES))
    found = {(r["path"][0], r["name"]): r["value"] for r in values.where(~F.col("name").startswith("project")).collect()}
    assert found == {("a", "x"): "1", ("a", "y"): "1.1", ("b", "x"): "2", ("b", "w"): "w", ("b", "y"): "2.1", ("b", "z"): "2.1-w", ("c", "w"): "w"}
    told = {(r["path"][0], r["name"]): r["code"] for r in residue.collect()}
    cyclic = {(f, n): "cyclic-property" for f in "abc" for n in "pq"} | {("c", n): "cyclic-property" for n in "xyz"}
    assert told == cyclic | {("a", "z"): "unknown-property"}


def test_versions(spark):
    rows = spark.createDataFrame([(v,) for v in ("3.0.0", "3.10.2", "4.99999999999999999999.0", "5.0.0", "2.9.9", "3.0", "3.0.0.RC", "", "03.1.1")], "v string")
    assert [r[0] for r in rows.where(builds.is_supported(F.col("v"))).collect()] == ["3.0.0", "3.10.2", "4.99999999999999999999.0", "03.1.1"]

"""Schema changes in SQL and in changelogs, on histories whose outcome is plain."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import schema_history
from weftline.sources import changelogs, extractors

XML = '<?xml version="1.0"?>\n<!-- <changeSet/> --><databaseChangeLog xmlns="http://l" xmlns:x="u">{}</databaseChangeLog>'
FILES = "repository string, path string, content string"


def replayed(spark, files):
    rows = spark.createDataFrame([("r", p, c) for p, c in files.items()], FILES)
    columns, residue = changelogs.replay(rows)
    found = {}
    for r in sorted(columns.collect(), key=lambda r: (r["table"], r["nth"])):
        found.setdefault(r["table"], []).append((r["column"], r["data_type"]) + (("key",) if r["primary_key"] else ()))
    return found, sorted((r["path"], r["code"], r["symbol"]) for r in residue.collect())


def table(name, *columns):
    return f'<createTable tableName="{name}">' + "".join(f'<column name="{c}" type="int"/>' for c in columns) + "</createTable>"


def changes(*parts):
    return "".join(f'<changeSet id="{i}" author="a>b">{p}</changeSet>' for i, p in enumerate(parts))


def test_changes_come_in_the_order_of_the_walk(spark):
    found, residue = replayed(
        spark,
        {
            "master.xml": XML.format(changes(table("t", "a")) + '<include file="b/one.xml"/>' + changes('<addColumn tableName="t"><column name="last" type="int"/></addColumn>') + '<includeAll path="all/"/>'),
            "b/one.xml": XML.format(changes('<addColumn tableName="t"><column name="b" type="varchar(3)"/></addColumn>') + '<include file="b/two.xml"/><include file="master.xml"/>'),
            "b/two.xml": XML.format(changes('<dropColumn tableName="t" columnName="a"/>', '<dropColumn tableName="t"><column name="b"/></dropColumn>', '<addColumn tableName="t"><column name="c" type="int"/></addColumn>') + '<include file="b/one.xml"/>'),
            "root.xml": XML.format('<include file="late.xml"/>' + changes('<dropTable tableName="gone"/>')),
            "late.xml": XML.format(changes(table("gone", "x"))),
        },
    )
    # a cycle has no root: what leads to master.xml only from itself is never entered
    assert (found, residue) == ({}, [])
    files = {"m.xml": XML.format(changes(table("t", "a")) + '<include file="b/one.xml"/>' + changes('<addColumn tableName="t"><column name="last" type="int"/></addColumn>') + '<includeAll path="z/"/>')}
    files |= {"b/one.xml": XML.format(changes('<addColumn tableName="t"><column name="b" type="varchar(3)"/></addColumn>') + '<include file="b/two.xml"/>')}
    files |= {"b/two.xml": XML.format(changes('<dropColumn tableName="t" columnName="a"/>', '<addColumn tableName="t"><column name="c" type="int"/></addColumn>') + '<include file="b/one.xml"/>')}
    files |= {f"z/{i}.xml": XML.format(changes(f'<addColumn tableName="t"><column name="z{i}" type="int"/></addColumn>')) for i in (2, 1)}
    found, residue = replayed(spark, files)
    assert found == {"t": [("b", "varchar(3)"), ("c", "int"), ("last", "int"), ("z1", "int"), ("z2", "int")]} and residue == []


def test_kinds_of_changes(spark):
    sql = "<sql>CREATE TABLE q (id BIGINT PRIMARY KEY, n DECIMAL(10, 2)); -- x\nALTER TABLE q ADD COLUMN a INT, ADD COLUMN b INT; SELECT 1 &lt; 2</sql>"
    files = {
        "m.xml": XML.format('<preConditions><x:or/></preConditions><property name="p" value="v"/>' + changes('<createTable tableName="t&amp;1" schemaName="s"><column name="id" type="int"><constraints primaryKey="TRUE"/></column></createTable><x:odd/>', sql + "<comment>c</comment><loadData tableName='q'/>", '<addColumn tableName="none"><column name="a" type="int"/></addColumn>', "<createTable/>", "<sql><![CDATA[DROP TABLE IF EXISTS none]]></sql>") + '<include file="lost.xml"/>'),
        "c.yaml": "databaseChangeLog: []",
        "bad.xml": "<databaseChangeLog><changeSet>",
        "empty.xml": "",
    }
    found, residue = replayed(spark, files)
    assert found == {"t&1": [("id", "int", "key")], "q": [("id", "BIGINT", "key"), ("n", "DECIMAL(10,2)"), ("a", "INT"), ("b", "INT")]}
    assert residue == sorted(
        [("bad.xml", "malformed-changelog", ""), ("empty.xml", "malformed-changelog", ""), ("c.yaml", "unsupported-changelog-format", ".yaml"), ("lost.xml", "missing-changelog-include", "lost.xml"), ("m.xml", "unmodelled-changelog-change", "odd")]
        + [("m.xml", "unmodelled-migration-statement", "SELECT"), ("m.xml", "ignored-changelog-change", "loadData"), ("m.xml", "unmodelled-changelog-change", "addColumn"), ("m.xml", "unmodelled-changelog-change", "createTable")]
    )


#: Statements, the columns they leave, and what is residue.
CASES = [
    ("-- first\nCREATE TABLE t (a INT) -- last\n; -- only this\n", ["a INT"], []),
    ("CREATE TABLE t (a INT); CREATE TABLE IF NOT EXISTS t (z INT)", ["a INT"], []),
    ("CREATE TABLE t (a INT); CREATE TABLE t (z INT)", ["z INT"], []),
    ("CREATE TABLE t (a INT); DROP TABLE t; CREATE TABLE IF NOT EXISTS t (z INT)", ["z INT"], []),
    ("CREATE TABLE t (a INT); ALTER TABLE t RENAME COLUMN a TO b", ["a INT"], ["unmodelled-migration-statement ALTER"]),
    ("CREATE TABLE t (a INT); ALTER TABLE t ADD COLUMN b INT, ADD COLUMN c VARCHAR(9) NOT NULL, DROP COLUMN a", ["b INT", "c VARCHAR(9)"], []),
    ("ALTER TABLE t ADD b INT", [], ["unknown-migration-table t"]),
    ("CREATE TABLE s.\"t\" (`a` DOUBLE  PRECISION, CHECK (a > 0)); ALTER TABLE t ALTER COLUMN a SET NOT NULL; ALTER TABLE t ALTER COLUMN z DROP NOT NULL; /* ; */ CREATE INDEX i ON t (a); INSERT INTO t VALUES (1)", ["a DOUBLE PRECISION"], ["unknown-migration-table z"]),
    ("GRANT ALL ON t TO x", [], ["unmodelled-migration-statement GRANT"]),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    """All cases as repositories of one table."""
    texts = spark.createDataFrame([(str(i), "p", sql) for i, (sql, _, _) in enumerate(CASES)], "repository string, path string, text string").withColumn("at", F.array(F.lit("1")))
    events, odd = schema_history.ddl(texts)
    left, lost = schema_history.replayed(events)
    return left.collect(), odd.unionByName(lost).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sql(outcomes, i):
    _, columns, codes = CASES[i]
    left, residue = outcomes
    assert [f"{r['column']} {r['data_type']}" for r in sorted(left, key=lambda r: r["nth"]) if r["repository"] == str(i)] == columns
    assert [f"{r['code']} {r['symbol']}" for r in residue if r["repository"] == str(i)] == codes


def test_migrations_by_version(spark):
    files = spark.createDataFrame([("db/V10__b.sql", "ALTER TABLE t DROP COLUMN a"), ("db/V2__a.sql", "CREATE TABLE t (a INT, b INT)"), ("db/R__r.sql", "DROP TABLE t")], "path string, content string")
    assert [tuple(r) for r in extractors.replay(files).collect()] == [("t", "b", "INT")]

"""Workflow definitions: errors found workflow by workflow, and by joins."""

import pytest

from weftline.operators import graph
from weftline.plans.queries import QUERIES

STAGES = "kind string, stage string, timeout_s int, max_attempts int, retry_class string, side_effect string, on_success array<string>, on_error array<string>"
WORKFLOWS = "kind string, entry string, timeout_s int, terminals array<string>"


def stage(kind, name, success, error, timeout=10, attempts=3, retry="NONE", effect="PURE"):
    return kind, name, timeout, attempts, retry, effect, success, error


DONE = ["terminal:DONE"]
ROWS = [
    *[stage("chain", f"c{i}", [f"c{i + 1}"] if i < 40 else DONE, DONE) for i in range(41)],
    *[stage("cycle", f"s{i}", [f"s{(i + 1) % 5}"], [f"s{i}"]) for i in range(5)], stage("cycle", "aside", ["s0"], ["terminal:LOST", "terminal:DONE"]),
    stage("twice", "a", ["b"], ["nowhere"]), stage("twice", "a", DONE, None, 0, 9), stage("twice", "b", [], [None], 500, 1, "ALWAYS", "ANY"), stage("twice", "b", ["a", None, "terminal:OTHER"], DONE),
    stage("several", "a", ["terminal:X"], ["terminal:Y"], 20), stage("several", "b", ["a"], ["terminal:Z", "b"], 90), stage("orphan", "a", ["b"], ["x"], -5), stage("unsure", "a", ["terminal:X"], ["a"]),
    stage("vague", "a", ["terminal:X", "b"], ["terminal:DONE"]), stage("vague", "b", ["terminal:X"], [None]), stage("named", "terminal:DONE", ["terminal:DONE"], ["other"]), stage("named", None, ["terminal:DONE"], ["ghost"]),
]
KINDS = [
    ("chain", "c0", 500, ["DONE"]), ("cycle", "s3", 10, ["DONE"]), ("twice", "a", 60, ["DONE"]), ("several", "a", 100, ["X"]), ("several", "b", 15, ["Y", "X"]), ("unsure", "a", 30, None), ("vague", "a", 30, ["DONE", None]),
    ("named", "terminal:DONE", 0, ["FAILED"]), ("empty", "a", 5, []), ("empty2", None, -1, ["DONE"]),
]


def found(df):
    rows = [tuple(r[c] for c in ("kind", "stage", "error")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_each_workflow_by_itself_as_by_joins(spark, monkeypatch):
    stages, kinds = spark.createDataFrame(ROWS, STAGES), spark.createDataFrame(KINDS, WORKFLOWS)
    by_joins = found(graph._errors_by_joins(stages, kinds))
    assert {e for _, _, e in by_joins} >= {"UNREACHABLE", "UNKNOWN_STAGE", "UNDECLARED_TERMINAL", "SUCCESS_WITHOUT_TERMINAL", "ERROR_WITHOUT_TERMINAL", "REPEATED_STAGE", "UNKNOWN_ENTRY", "CRITICAL_PATH"}
    assert ("chain", None, "CRITICAL_PATH") not in by_joins and not any(e == "UNREACHABLE" for k, _, e in by_joins if k == "chain")
    assert found(graph.workflow_errors(stages, kinds)) == by_joins
    for most in (0, 5):  # all, or the long ones, by joins
        monkeypatch.setattr(graph, "WORKFLOW", most)
        assert found(graph.workflow_errors(stages, kinds)) == by_joins


def test_stages_are_shuffled_once_and_not_checkpointed(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "cut", lambda df: pytest.fail("a checkpoint"))
    df = QUERIES["t8_workflow_errors"](spark, small)
    assert df.count()
    rows = df.select("kind")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([line for line in plan.splitlines() if " Exchange " in line and "ReusedExchange" not in line]) == 1, plan

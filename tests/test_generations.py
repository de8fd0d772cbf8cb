"""State in generations: runs that are killed anywhere are taken up without loss or repeat."""

import pytest

from leakloom.streaming.generations import Generations, resume, results

UNITS = {"a": "1", "b": "1", "c": "1"}


class Killed(Exception):
    pass


def _runner(spark, folder):
    seen = []

    def work(unit):
        seen.append(unit)
        return spark.range(len(seen) if unit == "x" else ord(unit) - 96)

    def run(units=UNITS, scanner="s", **more):
        seen.clear()
        return resume(Generations(spark, f"{folder}/state"), units, work, scanner, f"{folder}/out", **more), list(seen)

    return run, lambda units=UNITS: sorted((r["unit"], r["id"]) for r in results(spark, f"{folder}/out", sorted(units)).collect())


WHOLE = [("a", 0), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2)]


@pytest.mark.parametrize("where", ["a", "b", "c"])
def test_killed_before_a_commit(spark, tmp_path, where):
    run, rows = _runner(spark, tmp_path.as_uri())

    def kill(unit):
        if unit == where:
            raise Killed

    with pytest.raises(Killed):
        run(before_commit=kill)
    outcome, worked = run()
    assert worked == list(outcome.worked) == [u for u in "abc" if u >= where] and rows() == WHOLE and outcome.exit_code == 1
    again, worked = run()
    assert again.unchanged and worked == [] and again.exit_code == 1


def test_killed_while_a_generation_is_written(spark, tmp_path, monkeypatch):
    run, rows = _runner(spark, tmp_path.as_uri())
    real, calls = Generations.commit, []

    def half(self, state, note):
        calls.append(1)
        if len(calls) == 2:
            state.limit(1).write.mode("overwrite").parquet(f"{self.folder}/generation-{self.current() + 1}")  # no marker
            raise Killed
        return real(self, state, note)

    monkeypatch.setattr(Generations, "commit", half)
    with pytest.raises(Killed):
        run()
    store = Generations(spark, f"{tmp_path.as_uri()}/state")
    assert store.current() == 1 and [r["unit"] for r in store.read().collect()] == ["a"]
    assert run()[1] == ["b", "c"] and rows() == WHOLE


def test_changes_of_units_and_scanner(spark, tmp_path):
    run, rows = _runner(spark, tmp_path.as_uri())
    run()
    outcome, worked = run({"a": "1", "b": "2", "d": "1"})
    assert worked == ["b", "d"] and not outcome.unchanged and rows({"a", "b", "d"}) == [("a", 0), ("b", 0), ("b", 1), ("d", 0), ("d", 1), ("d", 2), ("d", 3)]
    store = Generations(spark, f"{tmp_path.as_uri()}/state")
    assert {r["unit"]: r["fingerprint"] for r in store.read().collect()} == {"a": "1", "b": "2", "d": "1"} and len(store.numbers()) == 3
    assert run({"a": "1", "b": "2"}, exit_code=lambda n: n)[0].exit_code == 3  # one that is no more leaves the state
    assert run({"a": "1", "b": "2"}, "other")[1] == ["a", "b"]


def test_two_runs_cannot_both_commit(spark, tmp_path):
    one, two = (Generations(spark, f"{tmp_path.as_uri()}/state", "k long") for _ in range(2))
    assert one.current() == 0 and one.read().collect() == [] and one.note() == {}
    one.commit(spark.range(2).withColumnRenamed("id", "k"), {"by": 1})
    two.current = lambda: 0  # it looked before the other's commit
    with pytest.raises(RuntimeError):
        two.commit(spark.range(3).withColumnRenamed("id", "k"), {"by": 2})
    assert one.note() == {"by": 1}

"""State that survives a killed run: numbered generations, seen only once they are whole.

A store is a folder of any file system that Spark can write. Each commit writes the whole state as a new generation
and then renames a small marker into place, which is what makes it the current one; a run that ends in between leaves
a generation without a marker, which nobody reads and the next commit writes over. Two runs that commit at once don't
both win: the second finds its marker there and fails.

``resume`` runs work unit by unit: each unit's results lie in a folder of their own, written before the state says
that the unit is done, so that a killed run is taken up where it stopped, nothing is lost and nothing comes twice. A run
over unchanged units repeats the last outcome without looking at anything.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "unit string, fingerprint string, findings long, generation long"
#: Generations that are kept, the current one among them.
KEPT = 3


class Generations:
    """Numbered generations of a table in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = STATE):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        self._files.mkdirs(self._path(f"{self.folder}/markers"))

    def numbers(self) -> list[int]:
        """Generations that are whole, in order."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.folder}/markers"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> int:
        """The number of the last whole generation, 0 without one."""
        return max(self.numbers(), default=0)

    def note(self) -> dict:
        """What was noted with the current generation."""
        number = self.current()
        return json.loads(self.spark.read.text(f"{self.folder}/markers/{number}.json", wholetext=True).first()[0]) if number else {}

    def read(self) -> DataFrame:
        """The current generation's rows; none without one."""
        number = self.current()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/generation-{number}") if number else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, note: dict) -> int:
        """Write the next generation, then mark it whole; its number. The rows may come from the current one."""
        number = self.current() + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/generation-{number}")
        marker, draft = f"{self.folder}/markers/{number}.json", self._path(f"{self.folder}/markers/.{number}.draft")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
        out.close()
        if self._files.exists(self._path(marker)) or not self._files.rename(draft, self._path(marker)):
            raise RuntimeError(f"another run has committed generation {number} of {self.folder}")
        for old in self.numbers()[:-KEPT]:
            self._files.delete(self._path(f"{self.folder}/markers/{old}.json"), False)
            self._files.delete(self._path(f"{self.folder}/generation-{old}"), True)
        return number


@dataclass(frozen=True)
class Outcome:
    """What a run came to: its exit code, the units that it worked on, and whether it repeated the last one."""

    exit_code: int
    worked: tuple[str, ...]
    unchanged: bool


def resume(store: Generations, units: dict[str, str], work: Callable[[str], DataFrame], scanner: str, out: str, exit_code: Callable[[int], int] = lambda n: int(n > 0), before_commit: Callable[[str], None] = lambda unit: None) -> Outcome:
    """Work on the units (name to fingerprint) that the state doesn't have as they are, and commit after each.

    ``scanner`` is the fingerprint of how units are worked on; another one makes all of them due again. Results of a
    unit go to ``out``/unit=..., in place of earlier ones. Units that are no more leave the state with the last commit.
    The number of units is the driver's; what is in them isn't.
    """
    note, spark = store.note(), store.spark
    same = note.get("scanner") == scanner
    known = {r["unit"]: r for r in store.read().collect()} if same else {}
    due = [u for u in sorted(units) if u not in known or known[u]["fingerprint"] != units[u]]
    if same and note.get("done") and not due and set(known) == set(units):
        return Outcome(note["exit_code"], (), True)
    state = {u: tuple(known[u]) for u in known if u in units}
    for unit in due:
        folder = f"{out}/unit={unit}"
        work(unit).write.mode("overwrite").parquet(folder)
        found = spark.read.parquet(folder).count()
        before_commit(unit)
        state[unit] = (unit, units[unit], found, store.current() + 1)
        store.commit(spark.createDataFrame(list(state.values()), store.schema), {"scanner": scanner, "done": False, "exit_code": None})
    code = exit_code(sum(row[2] for row in state.values()))
    store.commit(spark.createDataFrame(list(state.values()), store.schema), {"scanner": scanner, "done": True, "exit_code": code})
    return Outcome(code, tuple(due), False)


def results(spark: SparkSession, out: str, units: Sequence[str]) -> DataFrame:
    """The results of some units, with ``unit``."""
    rows = None
    for unit in units:
        one = spark.read.parquet(f"{out}/unit={unit}").withColumn("unit", F.lit(unit))
        rows = one if rows is None else rows.unionByName(one)
    return rows

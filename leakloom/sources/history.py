"""Version histories as tables: a partitioned reader, what a run has to look at, and its order.

``read`` is a data source whose partitions are ranges of a walk over commits: each task asks the repository for its own
range and streams it, so neither the driver nor a task holds a history. The repository (a clone, bare or not) must lie
where all machines can read it.

``reachable`` works on tables of commits and parents of any size, as a hosted service's export gives them.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leakloom.operators.running import checkpointed, numbered

_SCHEMA = "commit_seq long, commit string, parents array<string>, author string, when string, message string, patch string"
_FORM = "%x1e%H%x1f%P%x1f%an <%ae>%x1f%cI%x1f%B%x1f"
#: Commits in a partition.
RANGE = 2_000


class _Range(InputPartition):
    def __init__(self, skip: int, size: int, total: int):
        self.skip, self.size, self.total = skip, size, total


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.size = int(options.get("range", RANGE))
        self.most = int(options["maxCount"]) if "maxCount" in options else None
        self.walk = [*filter(None, options.get("starts", "--all").split(",")), *(f"^{x}" for x in options.get("stops", "").split(",") if x)]
        self.walk += [f"--since={options['since']}"] if options.get("since") else []
        self.patch = options.get("patch", "true").lower() == "true"
        self.merges = options.get("merges", "true").lower() == "true"
        paths = [f":(glob){p}" for p in options.get("include", "").split(",") if p] + [f":(exclude,glob){p}" for p in options.get("exclude", "").split(",") if p]
        self.paths = ["--", *paths] if paths else ["--"]

    def _git(self, *arguments: str) -> list[str]:
        return ["git", "-C", self.where, "-c", "core.quotePath=false", *arguments]

    def partitions(self) -> list[InputPartition]:
        n = int(subprocess.run(self._git("rev-list", "--count", *self.walk, *self.paths), capture_output=True, check=True).stdout or 0)
        n = n if self.most is None else min(n, self.most)
        return [_Range(k, min(self.size, n - k), n) for k in range(0, n, self.size)] or [_Range(0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.size:
            return
        listed = self._git("rev-list", "--date-order", f"--skip={partition.skip}", f"--max-count={partition.size}", *self.walk, *self.paths)
        hashes = subprocess.run(listed, capture_output=True, check=True).stdout
        at = {h: partition.total - 1 - partition.skip - k for k, h in enumerate(hashes.decode().split())}
        shown = ["-p", "-U3", *(["--diff-merges=first-parent"] if self.merges else [])] if self.patch else ["-s"]
        # the very commits that were listed, whether or not a walk along these paths would stop at them
        command = self._git("log", "--stdin", "--no-walk=unsorted", "--full-history", "--sparse", "--no-color", "--no-ext-diff", f"--format={_FORM}", *shown, *self.paths)
        with tempfile.TemporaryFile() as asked:  # a task's own question to git, gone with it
            asked.write(hashes)
            asked.seek(0)
            with subprocess.Popen(command, stdin=asked, stdout=subprocess.PIPE) as run:
                for record in _records(run.stdout):
                    commit, parents, author, when, message, patch = record.decode("utf-8", "replace").split("\x1f", 5)
                    yield at[commit], commit, parents.split(), author, when, message.rstrip("\n"), patch.lstrip("\n")
                if run.wait():
                    raise RuntimeError(f"git log failed with {run.returncode} in {self.where}")


def _records(stream) -> Iterator[bytes]:
    """What stands between record marks, one after another."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\x1e")
        yield from filter(None, whole)
    if rest:
        yield rest


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leakloom_history"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, repository: str, starts: Sequence[str] = ("--all",), stops: Sequence[str] = (), since: str | None = None, max_count: int | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), patch: bool = True, merges: bool = True, size: int = RANGE) -> DataFrame:
    """(commit_seq, commit, parents, author, when, message, patch): commits, the oldest being 0, with what they change against their first parent.

    Commits that ``starts`` reach and ``stops`` don't, not older than ``since``, the newest ``max_count`` of them, that
    touch paths which ``include`` and ``exclude`` allow (globs; patches are cut likewise). Without ``merges`` those
    have no patch. An empty history gives no rows; a repository that git can't read is an error.
    """
    spark.dataSource.register(HistorySource)
    options = {"path": repository, "starts": ",".join(starts), "stops": ",".join(stops), "include": ",".join(include), "exclude": ",".join(exclude), "patch": str(patch).lower(), "merges": str(merges).lower(), "range": str(size)}
    options |= {k: str(v) for k, v in (("since", since), ("maxCount", max_count)) if v is not None}
    return spark.read.format(HistorySource.name()).options(**options).load()


def metadata_chunks(commits: DataFrame) -> DataFrame:
    """(commit, commit_seq, path, text): each commit's author, date and message as a text to be scanned."""
    return commits.select("commit", "commit_seq", F.lit("COMMIT_METADATA").alias("path"), F.concat_ws("\n", "author", "when", "message").alias("text"))


def reachable(edges: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """(commit) that ``starts`` reach over (commit, parent) edges on ways that no commit of ``stops`` is on, each once.

    Commits in a row, with one parent and one child each, are drawn together first by doubling steps, as many as the
    logarithm of the longest row; then a frontier goes from row to row, as many rounds as merges and branches lie one
    behind another, not commits. What has been reached isn't joined again. Null and repeated rows count as nothing and
    once; a commit without parents needs no edge.
    """
    stops = stops.select("commit").filter("commit is not null").distinct()
    edges = edges.select("commit", "parent").filter("commit is not null and parent is not null and commit <> parent").distinct()
    edges = checkpointed(edges.join(stops, "commit", "left_anti").join(stops.select(F.col("commit").alias("parent")), "parent", "left_anti").select("commit", "parent"))
    starts = checkpointed(starts.select("commit").filter("commit is not null").distinct().join(stops, "commit", "left_anti"))
    single = lambda c: edges.groupBy(c).agg(F.count("*").alias("_n")).filter("_n = 1").select(c)
    links = edges.join(single("commit"), "commit").join(single("parent"), "parent")
    # each commit's place in its row: how far its oldest one is; pointers double until none moves
    steps = checkpointed(links.select("commit", F.col("parent").alias("last"), F.lit(1).cast("long").alias("far")))
    while True:
        onward = steps.select(F.col("commit").alias("last"), F.col("last").alias("_to"), F.col("far").alias("_more"))
        steps = checkpointed(steps.join(onward, "last", "left").select("commit", F.coalesce("_to", "last").alias("last"), (F.col("far") + F.coalesce("_more", F.lit(0))).alias("far"), F.col("_to").isNotNull().alias("moved")))
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    rows = steps.select("commit", F.col("last").alias("row"), "far")
    place = lambda c: (F.coalesce("row", F.col(c)).alias("row"), F.coalesce("far", F.lit(0)).alias("far"))
    among = lambda df, c: df.join(rows.withColumnRenamed("commit", c), c, "left")
    between = edges.join(links, ["commit", "parent"], "left_anti")
    # the oldest commit of a row leads on to the youngest of others
    ways = checkpointed(among(between.select(F.col("commit").alias("from"), "parent"), "parent").select(F.col("from"), *place("parent")))
    found = checkpointed(among(starts, "commit").select(*place("commit")).groupBy("row").agg(F.max("far").alias("far")))
    front = found.select("row")
    seen = front
    while True:
        fresh = ways.join(front.select(F.col("row").alias("from")), "from").groupBy("row").agg(F.max("far").alias("far"))
        found = checkpointed(found.unionByName(fresh).groupBy("row").agg(F.max("far").alias("far")))
        front = checkpointed(fresh.select("row").join(seen, "row", "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    level = found.withColumnRenamed("far", "_far")
    inside = rows.join(level, "row").filter("far <= _far").select("commit")
    return inside.unionByName(found.select(F.col("row").alias("commit")))


def oldest_first(commits: DataFrame, when: str = "when", commit: str = "commit") -> DataFrame:
    """Commits with commit_seq, their place from 0 by date, equal dates by name; nulls come first."""
    return numbered(commits, [F.col(when).asc_nulls_first(), F.col(commit).asc_nulls_first()], "commit_seq")

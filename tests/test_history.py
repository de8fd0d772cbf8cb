"""Histories: the partitioned reader against git itself, reachability and order against brute force."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from leakloom.operators import running
from leakloom.sources import history


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    where = tmp_path_factory.mktemp("repo")

    def run(*a, k=0):
        dates = {f"GIT_{x}_DATE": f"2024-01-01T00:00:{k:02d}+00:00" for x in ("AUTHOR", "COMMITTER")}
        return subprocess.run(["git", "-C", str(where), "-c", "user.name=n é", "-c", "user.email=e", "-c", "commit.gpgsign=false", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(where), **dates}).stdout.decode()

    run("init", "-q", "-b", "main")
    for k in range(12):
        if k == 4:
            run("checkout", "-q", "-b", "side")
        if k == 7:
            run("checkout", "-q", "main")
        name = "side.txt" if 4 <= k < 7 else "f.txt"
        (where / name).write_text("".join(f"line {j}\n" for j in range(k)) + f"value{k} é\n")
        run("add", ".")
        run("commit", "-q", "-m", f"c{k}\n\nbody \x1c of {k}", k=k)
        if k == 9:
            run("merge", "-q", "--no-ff", "-m", "merged", "side", k=k)
    return where, run


def test_ranges_are_the_whole_history(spark, repository):
    where, run = repository
    want = run("rev-list", "--all", "--date-order", "--reverse").split()
    for size in (1, 5, 100):
        df = history.read(spark, str(where), size=size)
        rows = sorted(df.collect(), key=lambda r: r["commit_seq"])
        assert df.rdd.getNumPartitions() == -(-13 // size)
        assert [r["commit"] for r in rows] == want and [r["commit_seq"] for r in rows] == list(range(13))
    assert rows[0]["parents"] == [] and rows[0]["author"] == "n é <e>" and rows[3]["message"].startswith("c3\n\nbody") and "+value3 é" in rows[3]["patch"]
    (merge,) = [r for r in rows if len(r["parents"]) == 2]
    assert "side.txt" in merge["patch"] and "f.txt b/f.txt" not in merge["patch"]
    assert [r["patch"] for r in history.read(spark, str(where), merges=False).collect() if len(r["parents"]) == 2] == [""]


def test_filters_of_commits_and_paths(spark, repository):
    where, run = repository
    heads = run("rev-list", "--date-order", "main").split()
    got = lambda **o: {r["commit"] for r in history.read(spark, str(where), size=2, **o).collect()}
    assert got(starts=["main"], stops=[heads[3]]) == set(run("rev-list", "main", f"^{heads[3]}").split())
    assert got(max_count=3) == set(run("rev-list", "--all", "--date-order").split()[:3])
    assert got(since="2024-01-01T00:00:05Z") == set(run("rev-list", "--all", "--since=2024-01-01T00:00:05Z").split())
    assert got(include=["side*"]) == set(run("rev-list", "--all", "--", "side.txt").split())
    assert got(exclude=["side*"]) == set(run("rev-list", "--all", "--", ":(exclude)side.txt").split())
    assert got(starts=["main"], stops=["main"]) == set()
    assert history.metadata_chunks(history.read(spark, str(where), patch=False)).filter("text like '%body%'").count() == 12
    with pytest.raises(Exception, match="(?i)git|CalledProcess|rev-list"):
        history.read(spark, f"{where}/none").collect()


def _brute(edges, starts, stops):
    parents = {}
    for a, b in edges:
        parents.setdefault(a, []).append(b)
    seen, todo = set(), [s for s in starts if s is not None and s not in stops]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [p for p in parents.get(c, []) if p is not None and p not in stops and p != c]
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_reachability_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(k, k - 1) for k in range(1, 150) if r.random() < 0.93] + [(r.randrange(60, 150), r.randrange(0, 60)) for _ in range(12)] + [(149, 149), (None, 3), (5, None), (140, 139)]
    starts, stops = [149, 120, 120, 31, None, 999], [] if seed == 0 else [77, 20, 31]
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "commit long")
    found = [x["commit"] for x in history.reachable(spark.createDataFrame(edges, "commit long, parent long"), table(starts), table(stops)).collect()]
    assert sorted(found) == sorted(_brute(edges, starts, set(stops)))


def test_long_rows_take_few_rounds(spark, monkeypatch):
    """Twenty thousand commits in a row: some fifteen doubling steps and one step of the frontier."""
    rounds, real = [], history.checkpointed
    monkeypatch.setattr(history, "checkpointed", lambda df: rounds.append(1) or real(df))
    edges = spark.range(1, 20_000).select(F.col("id").alias("commit"), (F.col("id") - 1).alias("parent"))
    one = lambda k: spark.createDataFrame([(k,)], "commit long")
    assert history.reachable(edges, one(15_000), one(40)).count() == 15_000 - 40
    assert len(rounds) < 30


def test_order_runs_over_all_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice(["2024", "2023", None]), f"c{k}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "when string, commit string, row int").repartition(7)
    got = [x["commit"] for x in history.oldest_first(df).orderBy("commit_seq").collect()]
    assert got == [c for _, c, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))]
    sums = running.running(df, [F.col("commit")], {"before": F.col("row"), "n": F.lit(1)}).orderBy("commit").collect()
    by_name = sorted(rows, key=lambda x: x[1])
    assert all(x["before"] == sum(y[2] for y in by_name[:k]) and x["n"] == k for k, x in enumerate(sums) if k % 50 == 0)
    assert running.numbered(df.filter("row < 0"), [F.col("row")], "k").collect() == []

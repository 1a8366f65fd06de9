"""The walk over folders against one that opens them in turn."""

import random

import pytest
from pyspark.sql import functions as F

from linkledger.functions import text as T
from linkledger.operators import scans


def walk(folders, root, ignored, depth, budget):
    """(path, match_name, leaf, depth, nth) by recursion over a dict of a folder's children."""
    out, stands, left = [], set(), budget
    key = lambda p: p.replace("\\", "/").rstrip("/").lower()
    away = {key(p if p.startswith("/") else f"{root}/{p}") for p in ignored}

    def into(folder, inherited, at):
        nonlocal left
        if at > depth:
            return
        for name in sorted(folders.get(folder, ())):
            path = f"{folder}/{name}"
            if name.startswith(".") or name.lower() in T.SKIPPED_FOLDERS or key(path) in away:
                continue
            if left == 0:
                return
            left -= 1
            generic = name.strip().lower() in T.GENERIC_FOLDERS
            match, leaf = (inherited if generic else name), generic and inherited != ""
            if leaf:
                stands.add(folder)
            if match:
                out.append((path, match, leaf, at, budget - left))
            into(path, match, at + 1)

    into(root, "", 1)
    return sorted(x for x in out if x[0] not in stands)


@pytest.mark.parametrize("depth, budget", [(3, 20000), (2, 9), (4, 17)])
def test_against_a_walk(spark, depth, budget):
    random.seed(budget)
    names = ["Downloads", "files", "A", "B", "a", "Übung", ".git", "node_modules", "Material ", "C 1"]
    paths = [(r, f"{r}/" + "/".join(random.choice(names) for _ in range(random.randrange(1, 6))) + "/f.pdf") for r in ("/r", "/s") for _ in range(60)]
    files = spark.createDataFrame([(r, p, k) for k, (r, p) in enumerate(paths)] + [("/r", "/elsewhere/A/f", 1), ("/r", "/r/f", 1), ("/s/", "/s/Z/f", 5)], "root string, path string, modified int")
    folders = scans.folders_of_files(files)
    ignored = spark.createDataFrame([("/r", "A/b"), ("/s", "/S/B/"), ("/s", " ")], "root string, path string")
    got = scans.scan(folders.repartition(3), ignored, depth, budget).collect()
    for root, away in (("/r", ["A/b"]), ("/s", ["/S/B/"])):
        children = {}
        for r, p in paths:
            parts = p.split("/")
            for n in range(2, len(parts) - 1 if r == root else 0):
                children.setdefault("/".join(parts[:n]), set()).add(parts[n])
        assert sorted((r["path"], r["match_name"], r["downloads_leaf"], r["depth"], r["nth"]) for r in got if r["root"] == root) == walk(children, root, away, depth, budget)
    assert [r["path"] for r in got if r["root"] == "/s/"] == ["/s/Z"]


def test_the_newest_file_counts(spark):
    files = spark.createDataFrame([("/r", "/r/a/b/x", 3), ("/r", "/r/a/y", 9), ("/r", "/r/a/b/z", 5)], "root string, path string, modified int")
    assert {(r["path"], r["parent"], r["modified"]) for r in scans.folders_of_files(files).collect()} == {("/r/a", "/r", 9), ("/r/a/b", "/r/a", 5)}
    assert scans.scan(scans.folders_of_files(files.where(F.lit(False))), files.select("root", "path")).collect() == []

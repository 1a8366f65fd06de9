"""Which folders of a listing can be destinations: a walk from each root down, with depth, budget and inherited names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..functions import text as T

#: How deep below a root a folder may be, and how many folders of a root are looked at.
DEPTH, BUDGET = 3, 20_000


def folders_of_files(files: DataFrame, root: str = "root", path: str = "path", modified: str = "modified") -> DataFrame:
    """(root, parent, path, name, modified) of the folders in which files (root, path, modified) lie, at any depth; modified is that of the newest file below.

    Each path gives its own leading folders, and they are aggregated before the shuffle, so a
    folder of very many files is no burden. Files outside their root are left out.
    """
    begin = F.regexp_replace(root, "/+$", "")
    below = F.filter(F.split(F.substring(F.col(path), F.length(begin) + 1, F.length(path)), "/"), lambda p: p != "")
    inner = files.where(F.startswith(F.col(path), F.concat(begin, F.lit("/")))).withColumn("_below", below).where(F.size("_below") > 1)
    leading = F.transform(F.sequence(F.lit(1), F.size("_below") - 1), lambda n: F.slice("_below", F.lit(1), n))
    each = inner.select(F.col(root).alias("root"), begin.alias("_begin"), F.explode(leading).alias("_names"), F.col(modified).alias("modified"))
    grouped = each.groupBy("root", "_begin", "_names").agg(F.max("modified").alias("modified"))
    joined = lambda names: F.concat_ws("/", F.col("_begin"), F.array_join(names, "/"))
    parent = F.when(F.size("_names") == 1, F.col("root")).otherwise(joined(F.slice("_names", F.lit(1), F.size("_names") - 1)))
    return grouped.select("root", parent.alias("parent"), joined(F.col("_names")).alias("path"), F.element_at("_names", -1).alias("name"), "modified")


def scan(folders: DataFrame, ignored: DataFrame, depth: int = DEPTH, budget: int = BUDGET) -> DataFrame:
    """(root, path, match_name, downloads_leaf, depth, nth, modified) of the folders that may be destinations.

    folders: (root, parent, path, name, modified), a row for each folder, parents of the first
    level being the root; ignored: (root, path), absolute or below the root, of which nothing
    is offered, nor of what lies below. A folder that is named for its role goes by the name of
    what it lies in, which it then stands for; on the first level it has no name and is no
    candidate, but names below it count. Folders are looked at as a walk does, each one before
    what it holds and its like by name (nth); after `budget` of a root the walk ends, and what
    it has found is used. Depth is bounded, so the walk is `depth` joins of one plan, by
    parent; of a root, no task sorts more than its `budget` first folders and its own rows.
    """
    absolute = F.when(F.col("path").rlike(r"^([/\\]|[A-Za-z]:)"), F.col("path")).otherwise(F.concat_ws("/", F.regexp_replace("root", "/+$", ""), F.col("path")))
    away = ignored.where(T.strip(F.col("path")) != "").withColumn("path", T.strip(F.col("path"))).select("root", T.folder_key(absolute).alias("_key")).distinct()
    open_ = folders.where(~P.is_skipped_folder(F.col("name"))).withColumn("_key", T.folder_key(F.col("path"))).join(away, ["root", "_key"], "left_anti").drop("_key")
    generic = P.is_generic_folder(F.col("name"))
    level = open_.where(F.col("parent") == F.col("root")).select("root", "parent", "path", "modified", F.when(generic, "").otherwise(F.col("name")).alias("match_name"), F.lit(False).alias("downloads_leaf"), F.lit(1).alias("depth"), F.array("name").alias("_place"))
    walked = level
    for n in range(2, depth + 1):
        above = level.select("root", F.col("path").alias("parent"), F.col("match_name").alias("_inherited"), F.col("_place").alias("_above"))
        level = open_.where(F.col("parent") != F.col("root")).join(above, ["root", "parent"]).select(
            "root", "parent", "path", "modified", F.when(generic, F.col("_inherited")).otherwise(F.col("name")).alias("match_name"), (generic & (F.col("_inherited") != "")).alias("downloads_leaf"), F.lit(n).alias("depth"), F.concat("_above", F.array("name")).alias("_place")
        )
        walked = walked.unionByName(level)
    met = walked.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("_place"))).where(F.col("nth") <= budget)
    stands = met.where("downloads_leaf").select("root", F.col("parent").alias("path")).distinct()
    return met.where("match_name <> ''").join(stands, ["root", "path"], "left_anti").select("root", "path", "match_name", "downloads_leaf", "depth", "nth", "modified")


LIMIT = 60
#: Names of the folders of a customer's path by remainders of its number.
FIRST = ["'.hidden'", "'node_modules'", "'Downloads'", "concat('Sem ', k % 4)", "concat('Sem ', k % 4)", "concat('Sem ', k % 4)", "concat('sem ', k % 4)"]
SECOND = ["'Material'", "concat('Course ', k % 23)", "concat('Course ', k % 23)", "concat('Kurs ', k % 5)"]
THIRD = ["'downloads'", "'Sheets'", "concat('old ', k % 2)"]
IGNORED = [("/u/1", "/U/1/Sem 1/"), ("/u/2", "Sem 2/Course 5"), ("/u/3", " ")]


def _case(k: str, names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(names)} = {n} THEN {name}" for n, name in enumerate(names)) + " END"


_PATH = f"concat('/u/', n % 4, '/', {_case('k', FIRST)}, '/', {_case('k // 3', SECOND)}, '/', {_case('k // 5', THIRD)}, '/deep/f', k)"


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that may be destinations among those in which customers' files lie, four people's."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    files = c.select(F.concat(F.lit("/u/"), F.col("n") % 4).alias("root"), F.expr(_PATH.replace("//", "div")).alias("path"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("k") % 1000).cast("int")).alias("modified"))
    return scan(folders_of_files(files), spark.createDataFrame(IGNORED, "root string, path string"), budget=LIMIT).withColumn("modified", F.col("modified").cast("string"))


QUERIES = {"folder_scan": folder_scan}
ORACLES = {
    "folder_scan": f"""
        WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
        files AS (SELECT '/u/' || n % 4 AS root, string_split({_PATH}, '/') AS p, DATE '2020-01-01' + (k % 1000)::INT AS modified FROM c),
        folders AS (SELECT root, array_to_string(p[1:3 + d], '/') AS path, array_to_string(p[1:2 + d], '/') AS parent, p[3 + d] AS name, max(modified) AS modified, lower(p[3 + d]) IN ('downloads', 'material') AS generic FROM files, range(1, 5) r(d) GROUP BY ALL),
        open AS (SELECT * FROM folders WHERE NOT starts_with(name, '.') AND name <> 'node_modules' AND NOT (root = '/u/1' AND lower(path) = '/u/1/sem 1') AND NOT (root = '/u/2' AND lower(path) = '/u/2/sem 2/course 5')),
        walk AS (SELECT root, path, modified, CASE WHEN generic THEN '' ELSE name END AS match_name, false AS leaf, 1 AS depth, [name] AS place FROM open WHERE parent = root
                 UNION ALL SELECT o.root, o.path, o.modified, CASE WHEN generic THEN match_name ELSE name END, generic AND match_name <> '', depth + 1, list_append(place, name) FROM walk w JOIN open o ON o.parent = w.path WHERE depth < {DEPTH}),
        met AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY root ORDER BY place))::INT AS nth FROM walk) WHERE nth <= {LIMIT})
        SELECT root, path, match_name, leaf AS downloads_leaf, depth::INT AS depth, nth, modified::DATE::VARCHAR AS modified FROM met m WHERE match_name <> '' AND NOT EXISTS (SELECT 1 FROM met l WHERE l.leaf AND l.path[1:length(l.path) - length(l.place[-1]) - 1] = m.path)"""
}

"""The join of courses and folders' names against all pairs, and at size."""

import random

from pyspark.sql import functions as F

from linkledger.operators import similarity


def test_no_pair_that_fits_is_missed(spark):
    random.seed(12)
    words = ["Algebra", "Algorithmen", "Daten", "Datenbanken", "Softwaretechnik", "Analysis", "Num", "Numerik", "Lineare", "Lin", "Ana", "Theorie", "TI", "A", "B", "Ab", "Abc", "Übung", "der", "2", "Technik", "Soft"]
    make = lambda sep, most: sep.join(random.choice(words) if random.random() < 0.7 else random.choice(words)[: random.randrange(1, 7)] for _ in range(random.randrange(1, most)))
    courses = [(make(" ", 5),) for _ in range(150)] + [("",), (" ",), ("12",)]
    names = [(make(random.choice([" ", "", "-", "_2"]), 5),) for _ in range(250)] + [("",), ("2024",), ("TdI",), ("SoTe",), ("a b n",)]
    c, n = spark.createDataFrame(courses, "course string").distinct(), spark.createDataFrame(names, "match_name string").distinct()
    fits = {(r[0], r[1]) for r in c.crossJoin(n).where(similarity.score(F.col("course"), F.col("match_name")) >= similarity.LEAST).collect()}
    met = {(r[0], r[1]) for r in similarity.candidates(c, n).collect()}
    assert len(fits) > 300 and not fits - met


def test_common_words_meet_nobody_where_a_rare_one_does(spark):
    """12,000 courses and 12,000 folders that all share one word, and each another one with its own partner."""
    name = F.concat(F.lit("Praktikum "), F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop"))
    courses = spark.range(12_000).select(name.alias("course"))
    folders = spark.range(12_000).select(name.alias("match_name"), F.concat(F.lit("/u/"), "id").alias("path"), F.lit(False).alias("downloads_leaf"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    met = similarity.candidates(courses, folders.select("match_name")).count()
    assert 12_000 <= met < 600_000  # of 144 million
    got = similarity.suggest(courses, folders, folders.where("false").select("path")).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    assert (got["n"], got["least"]) == (12_000, 1.0)


def test_a_course_that_many_folders_fit(spark):
    folders = spark.range(30_000).select(F.lit("Analysis").alias("match_name"), F.concat(F.lit("/u/"), "id").alias("path"), (F.col("id") % 3 == 0).alias("downloads_leaf"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 40 % 30_011).cast("int")).cast("timestamp").alias("modified"))
    courses = spark.createDataFrame([("Analysis",), ("analysis 2",), (None,)], "course string")
    got = similarity.suggest(courses, folders, folders.where("false").select("path")).collect()
    leaves = folders.where("downloads_leaf").orderBy(F.desc("modified")).limit(2).collect()
    sure = (leaves[0]["modified"] - leaves[1]["modified"]).days >= similarity.NEWER_DAYS
    # both courses want the newest leaf; the first by name keeps it
    assert [(r["course"], r["path"]) for r in got] == ([("Analysis", leaves[0]["path"])] if sure else [])

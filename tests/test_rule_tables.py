"""Tables of rules against each rule tried on each row."""

import random

import pytest
from pyspark.sql import functions as F

from linkledger.operators import rule_tables, rules
from linkledger.functions import text as T


def test_the_first_rule_that_fits_decides(spark):
    names = spark.createDataFrame([("Lineare Algebra",), ("Analysis 2",), ("Übung 3",), ("x",), ("ab",), (None,), ("",)], "n string")
    table = spark.createDataFrame([(3, "*", "any"), (1, "algebra", "A"), (2, "ana*[0-9]", "B"), (0, "übung ?", "C"), (4, "", "D"), (3, "*", "bny")], "priority int, pattern string, value string")
    want = {"Lineare Algebra": "A", "Analysis 2": "B", "Übung 3": "C", "x": "any", "ab": "any", None: None, "": "any"}
    assert {r["n"]: r["value"] for r in rule_tables.match_table(names, table, "n").collect()} == want


@pytest.mark.parametrize("part", [500, 2])
def test_against_all_pairs(spark, monkeypatch, part):
    """Literal, wildcard and class patterns of one and two characters, and none; many of each, and in several parts."""
    monkeypatch.setattr(rule_tables, "PART", part)
    random.seed(6)
    texts = ["".join(random.choice("abc ä") for _ in range(random.randrange(1, 9))) for _ in range(120)]
    pieces = ["a", "b", "c", "ab", "bca", "abcab", "*", "?", "*", "[ab]", "[^c]", "[b-c]"]
    patterns = ["".join(random.choice(pieces) for _ in range(random.randrange(1, 4))) for _ in range(150)]
    names = spark.createDataFrame([(t,) for t in texts], "n string")
    table = spark.createDataFrame([(random.randrange(60), p, f"v{k}") for k, p in enumerate(patterns)], "priority int, pattern string, value string")
    got = {r["n"]: (r["rule_priority"], r["value"]) for r in rule_tables.match_table(names, table, "n").collect()}
    normal = {r["n"]: r["m"] for r in names.select("n", T.match_text(F.col("n")).alias("m")).collect()}
    import re

    for text, m in normal.items():
        fits = [(r["priority"], r["value"]) for r in table.collect() for p in [rules._normal(r["pattern"])] if (re.match(rules.glob_regex(p), m) if re.search(r"[*?\[]", p) else p in m)]
        assert got[text] == min(fits, default=(None, None)), text


def test_rules_that_begin_alike_meet_few_names(spark):
    names = spark.range(20_000).select(F.concat(F.lit("Grundlagen der Analysis "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("n"))
    table = spark.range(100_000).select(F.col("id").alias("priority"), F.concat(F.lit("Grundlagen der *"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"), F.col("id").cast("string").alias("value"))
    prepared = rule_tables._prepared(table, ["pattern"])
    normal = names.select("n", T.match_text(F.col("n")).alias("_t0"))
    met = rule_tables.candidates(normal, prepared, ["_t0"]).count()
    # each digits' gram is in some thousandth of names; all pairs would be two thousand million
    assert met < 12_000_000
    got = rule_tables.match_table(names.where("n like '%00077'"), table.unionByName(spark.createDataFrame([(5, "*77", "found")], "priority long, pattern string, value string")), "n").collect()
    assert [(r["rule_priority"], r["value"]) for r in got] == [(5, "found")]


def test_rules_that_no_name_can_fit_meet_nobody(spark):
    names = spark.createDataFrame([("common words here",)], "n string")
    table = spark.range(1000).select(F.col("id").alias("priority"), F.concat(F.lit("common*q"), "id").alias("pattern"), F.lit("v").alias("value"))
    assert rule_tables.candidates(names.withColumn("_t0", F.col("n")), rule_tables._prepared(table, ["pattern"]), ["_t0"]).count() == 0


def test_destinations_as_by_single_rules(spark):
    made = [("*/ubung", "plain"), ("algebra/*/{Blatt}", "/d/{BLATT}"), ("bad", "no"), ("*/mat*", "m"), (" a / b ", "ab"), ("/x", "no"), ("x/", "no"), ("ana*/[mu]?????*", "six"), ("c/d/e", "deep"), ("*/{blatt}", "no course")]
    rows = [(c, s, f) for c in ("Lineare Algebra / A", "Analysis", "a", "c/d", None) for s in ("Übungen", "Material", "b", "e") for f in ("Blatt_3.pdf", "x.pdf")]
    files = spark.createDataFrame(rows, "c string, s string, f string")
    table = spark.createDataFrame([(k, p, v) for k, (p, v) in enumerate(made)], "priority int, pattern string, value string")
    got = rule_tables.destination_table(files, table, "c", "s", "f")
    want = files.select("c", "s", "f", rules.destination(F.col("c"), F.col("s"), F.col("f"), made).alias("destination")).where("c is not null")
    assert sorted(map(tuple, got.where("c is not null").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("c is null").count() == 8


def test_rules_alike_are_matched_once(spark, monkeypatch):
    """However many rules have the same pattern, only the first of them meets names."""
    seen = []
    prepared = rule_tables._prepared
    monkeypatch.setattr(rule_tables, "_prepared", lambda rules, patterns: seen.append(rules.count()) or prepared(rules, patterns))
    table = spark.range(2000).select((F.lit(5000) - F.col("id")).alias("priority"), F.concat(F.lit("a*/"), F.when(F.col("id") % 2 == 0, "b").otherwise("?/{Blatt}")).alias("pattern"), F.concat(F.lit("d"), "id").alias("value"))
    table = table.unionByName(table.where("priority <= 3002").withColumn("value", F.lit("c")))
    files = spark.createDataFrame([("ax", "b", "Blatt_3.pdf"), ("ax", "b", "x.pdf"), ("ax", "c", "Blatt_3.pdf"), ("x", "b", "x.pdf")], "c string, s string, f string")
    got = rule_tables.destination_table(files, table, "c", "s", "f").collect()
    assert {(r["c"], r["s"], r["f"]): r["destination"] for r in got} == {("ax", "b", "Blatt_3.pdf"): "c", ("ax", "b", "x.pdf"): "c", ("ax", "c", "Blatt_3.pdf"): "c", ("x", "b", "x.pdf"): None}
    found = rule_tables.match_table(files, table.withColumn("pattern", F.lit("?x")), "c").collect()
    assert {(r["c"], r["rule_priority"], r["value"]) for r in found} == {("ax", 3001, "c"), ("x", None, None)}
    assert seen == [2, 1]


def test_the_rarest_part_is_chosen_without_sorting(spark):
    """A rule's parts are counted by hash aggregates, whose memory doesn't follow the parts of a task's rules."""
    rules_ = spark.range(100).select(F.col("id").alias("priority"), F.concat(F.lit("abc*d"), "id").alias("pattern"), F.lit("v").alias("value"))
    names = spark.createDataFrame([("abc d7",), ("abcd77",)], "_t0 string")
    found = rule_tables.candidates(names, rule_tables._prepared(rules_, ["pattern"]), ["_t0"])
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["_t0"], r["priority"]) for r in found.collect()} == {("abc d7", 7), ("abcd77", 7), ("abcd77", 77)}


def test_empty_tables(spark):
    names = spark.createDataFrame([("a",)], "n string")
    none = spark.createDataFrame([], "priority int, pattern string, value string")
    assert [tuple(r) for r in rule_tables.match_table(names, none, "n").collect()] == [("a", None, None)]
    assert rule_tables.match_table(names.where("false"), none, "n").collect() == []

"""Routing by ordered rules: the first pattern that fits decides.

Rules are a table (priority, pattern, value), small by nature: a person writes them.
They are read by the driver when a query is built, so their number is checked there,
and become one expression; more than LIMIT rules are joined instead, by rule_tables.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import text as T

LIMIT = 500


def glob_regex(pattern: str) -> str:
    """A regular expression for a pattern with *, ? and [ ], for whole texts; * crosses slashes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            out += "[" + pattern[k + 1 : end].replace("\\", r"\\") + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def _normal(pattern: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", pattern.strip().lower()) if unicodedata.category(c) != "Mn")
    return " ".join(bare.split())


@F.pandas_udf(StringType())
def _as_regex(pattern: pd.Series) -> pd.Series:
    """Of rules, not of names: a glob's expression, or that of a part."""
    return pattern.map(lambda p: glob_regex(p) if re.search(r"[*?\[]", p) else f"(?s).*{re.escape(p)}.*")


def matches(normal: Column, pattern: str) -> Column:
    """Whether a text, normalised by match_text, fits a pattern: as a glob if it has *, ? or [, else as a part."""
    plain = _normal(pattern)
    if not plain:
        return F.lit(False)
    return normal.rlike(glob_regex(plain)) if re.search(r"[*?\[]", plain) else normal.contains(plain)


def first_value(normal: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule (pattern, value) that fits, or null."""
    if len(rules) > LIMIT:
        raise ValueError(f"{len(rules)} rules; use rule_tables beyond {LIMIT}")
    return functools.reduce(lambda out, rule: out.when(matches(normal, rule[0]), rule[1]), rules, F.when(F.lit(False), F.lit(None).cast("string"))) if rules else F.lit(None).cast("string")


def course_folder(title: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """A course's folder: by rule, else the default one, else its own name made safe."""
    own = F.lit(default) if default.strip() else T.safe_name(title)
    return F.coalesce(first_value(T.match_text(title), rules), own)


def section_folder(title: Column, rules: list[tuple[str, str]]) -> Column:
    """A section's folder: by rule, or its own name, made safe."""
    return T.safe_name(F.coalesce(first_value(T.match_text(title), rules), title))


def destination(course: Column, section: Column, file: Column, rules: list[tuple[str, str]]) -> Column:
    """The destination of rules ("course pattern/section pattern" or with "/{blatt}" behind, destination), or null.

    A rule with the placeholder holds only for files with a sheet number and goes before
    all others; its destination gets the sheet's folder.
    """
    c, s, number = T.match_text(course), T.match_text(section), T.sheet_number(file)
    sheets, plain = [], []
    for key, value in rules:
        key = key.strip()
        only = key.lower().endswith("/" + T.SHEET_PLACEHOLDER)
        key = key[: -len(T.SHEET_PLACEHOLDER) - 1].strip() if only else key
        head, slash, tail = key.rpartition("/")
        if not head or not slash or not tail:
            continue
        fits = matches(c, head.strip()) & matches(s, tail.strip())
        if only:
            sheets.append(F.when(fits & number.isNotNull(), T.fill_sheet(F.lit(value), number)))
        else:
            plain.append(F.when(fits, F.lit(value)))
    return F.coalesce(*sheets, *plain, F.lit(None).cast("string"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """names with the value of the longest prefix (prefix, value) before a slash, the first value by code point of equal ones; null without.

    An equi-join on every leading path of a name instead of a test of all pairs.
    """
    parts = F.split(F.col(name), "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = names.select(name).distinct().select(name, F.explode(leading).alias("prefix"))
    best = each.join(prefixes, "prefix").groupBy(name).agg(F.max_by("value", F.struct(F.length("prefix"), F.col("value"))).alias("value"))
    return names.join(best, name, "left")


def problems(rules: DataFrame) -> DataFrame:
    """(kind, pattern, problem) of rules (kind, pattern, value) that can't be used; kinds are course_folder, section_name, destination and course."""
    blank = lambda c: T.strip(F.col(c)) == ""
    bare = F.regexp_replace(T.strip(F.col("pattern")), r"(?i)/\{blatt\}$", "")
    sheet = bare != T.strip(F.col("pattern"))
    open_class = F.regexp_replace("pattern", r"\\.", "").rlike(r"\[[^\]]*$")
    what = (
        F.when(blank("pattern"), "empty pattern")
        .when((F.col("kind") == "destination") & ~bare.rlike("^.+/[^/]+$"), "not in the form course/section")
        .when((F.col("kind") != "course") & blank("value"), "empty value")
        .when((F.col("kind") == "destination") & F.lower("value").contains(T.SHEET_PLACEHOLDER) & ~sheet, "placeholder without sheet rule")
        .when(F.col("kind").isin("course", "course_folder") & open_class, "bad pattern")
    )
    return rules.select("kind", "pattern", what.alias("problem")).where("problem is not null")


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the rows that collide with it."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth"), ranked.where("_nth > 1").drop("_nth")


PART_RULES = [("*brass", "metal/brass"), ("polished*", "finish/polished"), ("STEEL", "metal/steel"), ("?mall*", "size/small"), ("e", "other/e")]
NATION_RULES = [("united*/part", "unions"), ("*/*copper*", "copper"), ("a/s/{blatt}", "sheets/{Blatt}"), ("*/*", "all")]


def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of part with the folder of the first rule that fits."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    return parts.select("p_partkey", "p_type", first_value(T.match_text(F.col("p_type")), PART_RULES).alias("folder"))


def rule_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's destination; rules for numbered sheets go first."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    file = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Blatt_").otherwise("notes"), (F.col("p_partkey") % 40).cast("string"), F.lit(".pdf"))
    return parts.select("p_partkey", destination(F.col("p_name"), F.col("p_type"), file, NATION_RULES).alias("destination"))


def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name an earlier part has."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return first_of_key(parts, ["p_name"], ["p_partkey"])[1]


def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the longest leading path of brand and type that has an owner."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = parts.select("p_partkey", F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("/"))).alias("path"))
    owners = parts.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("prefix")).unionByName(parts.where("p_partkey % 3 = 0").select(F.concat_ws("/", "p_brand", F.substring_index("p_type", " ", 1)).alias("prefix"))).distinct()
    return longest_prefix(names, owners.withColumn("value", F.concat(F.lit("owner of "), F.col("prefix"))), "path")


#: Rules by the remainder of a number, as kind, pattern and value; {k} is the number.
RULES = [("course_folder", " ", "x"), ("course_folder", "a{k}*", " "), ("course_folder", "[ab{k}", "x"), ("course", "*{k}", ""), ("course", "", ""), ("destination", "a{k}", "x"), ("destination", "a/b{k}", "x/{blatt}"), ("destination", "a/b{k}/{Blatt}", "x/{BLATT}"), ("section_name", "s{k}", "t"), ("section_name", "s{k}", ""), ("course", "x[{k}", ""), ("destination", "/b{k}", "x"), ("course_folder", "a[{k}]", "y")]


def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with rules made of customers' numbers."""
    key = F.col("c_custkey")
    shape = F.get(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("kind", "pattern", "value"), strict=True))) for r in RULES)), (key % len(RULES)).cast("int"))
    made = spark.read.parquet(f"{sf_dir}/customer.parquet").select(shape["kind"].alias("kind"), F.replace(shape["pattern"], F.lit("{k}"), key.cast("string")).alias("pattern"), shape["value"].alias("value"))
    return problems(made)


QUERIES = {"rule_problems": rule_problems, "rule_match": rule_match, "rule_precedence": rule_precedence, "key_collisions": key_collisions, "longest_prefix": longest_prefix_match}
ORACLES = {
    "rule_problems": f"""
        WITH r AS (SELECT ({[r[0] for r in RULES]})[k + 1] AS kind, replace(({[r[1] for r in RULES]})[k + 1], '{{k}}', c_custkey::VARCHAR) AS pattern, ({[r[2] for r in RULES]})[k + 1] AS value FROM (SELECT *, (c_custkey % {len(RULES)})::INT AS k FROM customer)),
        p AS (SELECT *, trim(value) = '' AS no_value, regexp_replace(trim(pattern), '/\\{{blatt\\}}$', '', 'i') AS bare FROM r),
        q AS (SELECT kind, pattern, CASE WHEN trim(pattern) = '' THEN 'empty pattern' WHEN kind = 'destination' AND (strpos(bare, '/') < 2 OR ends_with(bare, '/')) THEN 'not in the form course/section' WHEN kind <> 'course' AND no_value THEN 'empty value'
            WHEN kind = 'destination' AND contains(lower(value), '{{blatt}}') AND bare = trim(pattern) THEN 'placeholder without sheet rule' WHEN kind LIKE 'course%' AND strpos(pattern, '[') > strpos(pattern, ']') THEN 'bad pattern' END AS problem FROM p)
        SELECT * FROM q WHERE problem IS NOT NULL""",
    "rule_match": """SELECT p_partkey, p_type, CASE WHEN regexp_full_match(lower(p_type), '.*brass') THEN 'metal/brass' WHEN regexp_full_match(lower(p_type), 'polished.*') THEN 'finish/polished'
        WHEN contains(lower(p_type), 'steel') THEN 'metal/steel' WHEN regexp_full_match(lower(p_type), '.mall.*') THEN 'size/small' WHEN contains(lower(p_type), 'e') THEN 'other/e' END AS folder FROM part""",
    "rule_precedence": """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') AND contains(lower(p_type), 's') AND p_partkey % 3 = 0 THEN 'sheets/Blatt' || lpad((p_partkey % 40)::VARCHAR, 2, '0')
        WHEN starts_with(lower(p_name), 'united') AND contains(lower(p_type), 'part') THEN 'unions' WHEN contains(lower(p_type), 'copper') THEN 'copper' ELSE 'all' END AS destination FROM part""",
    "key_collisions": "SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1",
    "longest_prefix": """
        WITH names AS (SELECT p_partkey, p_brand || '/' || replace(p_type, ' ', '/') AS path FROM part),
        owners AS (SELECT p_brand AS prefix FROM part WHERE p_partkey % 7 = 0 UNION SELECT p_brand || '/' || split_part(p_type, ' ', 1) FROM part WHERE p_partkey % 3 = 0)
        SELECT p_partkey, path, (SELECT 'owner of ' || arg_max(prefix, length(prefix)) FROM owners WHERE path = prefix OR starts_with(path, prefix || '/')) AS value FROM names""",
}

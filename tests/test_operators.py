"""Operators on small tables."""

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkledger.functions import text
from linkledger.operators import changes, merges, messages, redaction, reports, rules, similarity, trees, visits
from linkledger.plans import listing
from linkledger.sources import tables
from linkledger.streaming import progress

RECORD = "key string, size long, modified string, fail_count int, failed_at string, unverified boolean"


def test_plan(spark):
    found = spark.createDataFrame([(k, k, u, s, m) for k, u, s, m in [("new", "a", 1, None), ("same", "a", 1, "x"), ("size", "a", 2, "x"), ("gone", "a", 1, "x"), ("blind", "a", None, None), ("mute", "a", None, "x"), ("waits", "a", 9, "x"), ("ready", "a", 9, "x"), ("same", "b", 3, "y")]], "key string, path string, url string, size long, modified string")
    state = spark.createDataFrame([("same", 1, "x", 0, None, False), ("size", 1, "x", 0, None, False), ("gone", 1, "x", 0, None, False), ("blind", None, None, 0, None, False), ("mute", 5, "x", 0, None, False), ("waits", 1, "x", 3, "2024-01-10 00:00:00", False), ("ready", 1, "x", 1, "2024-01-01 00:00:00", False)], RECORD)
    present = spark.createDataFrame([(k,) for k in ("same", "size", "blind", "mute", "waits", "ready")], "key string")
    now = F.lit("2024-01-12 00:00:00").cast("timestamp")
    got = {(r["key"], r["url"]): r["action"] for r in changes.plan(found, state, present, now).collect()}
    assert got == {("new", "a"): "DOWNLOAD", ("same", "a"): "SKIP", ("same", "b"): "COLLISION", ("size", "a"): "DOWNLOAD", ("gone", "a"): "DOWNLOAD", ("blind", "a"): "VERIFY", ("mute", "a"): "SKIP", ("waits", "a"): "BACKOFF", ("ready", "a"): "DOWNLOAD"}
    assert {r["action"] for r in changes.plan(found, state, present, now, force=True).collect()} == {"DOWNLOAD", "COLLISION"}


def test_backoff_steps(spark):
    assert [r[0] for r in spark.range(6).select(changes.backoff_hours(F.col("id"))).collect()] == [0, 6, 24, 72, 168, 168]


def test_globs():
    import re

    assert re.match(rules.glob_regex("a*[bc]?"), "a/xxcd") and not re.match(rules.glob_regex("a?"), "abc")


def test_folders_and_destinations(spark):
    one = spark.createDataFrame([("Lineare Algebra / A", "Übungen", "Blatt_3.pdf"), ("Analysis", "Material", "x.pdf")], "c string, s string, f string")
    rows = one.select(rules.course_folder(F.col("c"), [("*algebra*", "LA")]).alias("a"), rules.section_folder(F.col("s"), [("ubung", "Blaetter")]).alias("b"), rules.destination(F.col("c"), F.col("s"), F.col("f"), [("*/ubung", "plain"), ("algebra/*/{Blatt}", "/d/{BLATT}"), ("bad", "no")]).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("LA", "Blaetter", "/d/Blatt03"), ("Analysis", "Material", None)]


def test_sections(spark):
    t = datetime(2024, 1, 1)
    data = [("c", "A", "a", 0, t, False), ("c", "B2", "a", 0, t + timedelta(1), True), ("c", " ", "a", 0, t + timedelta(2), False), ("c", "B", "b", 4, t, None), ("c", "B", "b", 0, t, False)]
    got = visits.section_stats(spark.createDataFrame(data, "course string, section_title string, section_url string, files_found int, ts timestamp, had_children boolean")).orderBy(*visits.report_order()).collect()
    assert [(r["section_url"], r["visits"], r["empty_visits"], r["section_title"], r["had_children"], r["always_empty"]) for r in got] == [("a", 3, 3, "B2", True, True), ("b", 2, 1, "B", False, False)]


def test_runs_split_after_three_minutes(spark):
    t = datetime(2024, 1, 1)
    data = [(1, t), (1, t + timedelta(seconds=180)), (1, t + timedelta(seconds=360, microseconds=1))]
    assert [r["run"] for r in visits.runs(spark.createDataFrame(data, "k int, ts timestamp"), ["k"]).orderBy("ts").collect()] == [1, 1, 2]


def test_baseline(spark):
    got = reports.baseline_series(spark.createDataFrame([(1, 100), (2, 70), (3, 90), (4, 120), (5, 0)], "d int, n int"), "d", "n").orderBy("d").collect()
    assert [(r["baseline"], r["verdict"]) for r in got] == [(None, "established"), (100, "failed"), (100, "passed"), (100, "passed"), (120, "failed")]


@pytest.mark.parametrize("course, folder, least, most", [("Algorithmen und Datenstrukturen", "AlgData", 0.75, 1), ("Numerische Mathematik", "NuMa", 0.75, 1), ("Softwaretechnologie", "ST", 0, 0.74), ("Algorithmen und Datenstrukturen", "AD", 0.85, 0.85), ("Lineare Algebra", "Musik", 0, 0.1), ("Softwaretechnologie", "SoftTech", 0.9, 0.9), ("", "x", 0, 0)])
def test_scores(spark, course, folder, least, most):
    assert least <= spark.range(1).select(similarity.score(F.lit(course), F.lit(folder))).first()[0] <= most


def test_suggestions(spark):
    courses = ["Algorithmen und Datenstrukturen", "Numerische Mathematik", "Programmieren 1 (SoSe 26)", "Theorie der Informatik", "Lineare Algebra", "Analysis"]
    folders = [
        ("/u/AlgData/Downloads", "AlgData", True, "2026-05-01"),
        ("/u/old/AlgData", "AlgData", False, "2025-05-01"),
        ("/u/NuMa", "NuMa", False, "2026-05-01"),
        ("/u/Prog", "Prog", False, "2026-05-01"),
        ("/u/Programmieren", "Programmieren", False, "2025-11-01"),
        ("/u/TI", "TI", False, "2026-05-01"),
        ("/u/LinAlg", "LinAlg", False, "2026-05-01"),
        ("/u/LinAlg2", "Lin-Alg", False, "2026-04-28"),
        ("/u/Ana", "Ana", False, "2026-05-01"),
        ("/u/Musik", "Musik", False, "2026-05-01"),
    ]
    made = spark.createDataFrame(folders, "path string, match_name string, downloads_leaf boolean, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    taken = spark.createDataFrame([("/U/musik/",)], "path string")
    got = {r["course"]: r["path"] for r in similarity.suggest(spark.createDataFrame([(c,) for c in courses], "course string"), made, taken).collect()}
    assert got == {"Algorithmen und Datenstrukturen": "/u/AlgData/Downloads", "Numerische Mathematik": "/u/NuMa", "Programmieren 1 (SoSe 26)": "/u/Prog", "Analysis": "/u/Ana", "Theorie der Informatik": "/u/TI"}


def test_telling_words(spark):
    words = lambda x: spark.createDataFrame([(x,)], "x string").select(text.course_tokens(F.col("x"))).first()[0]
    assert words("Theorie der Informatik") == ["theorie", "informatik"] and words("Introduction to the Design of Things") == ["introduction", "to", "design", "things"]
    assert words("Übungen zur Analysis 2, WiSe26") == ["ubungen", "analysis"]


def test_exit_codes(spark):
    kinds = ["not_ready", "already_running", "offline", "already_succeeded", "anything"]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in kinds], "k string").select(messages.exit_code(F.col("k"))).collect()] == [3, 4, 5, 6, 1]


def test_redaction(spark):
    f = lambda g, m: spark.createDataFrame([(m,)], "m string").select(g(F.col("m"))).first()[0]
    assert f(redaction.sanitize, "Cookie: abc x") == "Cookie: [redacted] x"
    assert f(redaction.sanitize, "  ") == redaction.NOTHING
    assert f(redaction.sanitize, 'has "Cookies" in it') == redaction.STATE_MESSAGE
    assert f(redaction.sanitize, "ä b " * 200) == ("ä b " * 200).encode()[:500].decode() + redaction.CUT
    token = "A" * 40
    assert f(redaction.scrub, f"see https://h.org/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa/b?t={token} and {token}") == "see https://h.org/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa/b?... and [redacted]"
    assert f(redaction.scrub, f"got \x01{token}\x02 at http://a/b http://c/d#e") == f"got {token} at http://a/b http://c/d?..."
    assert f(redaction.without_marks, "\x01a\x02b") == "ab"


def test_groups_and_names(spark):
    page = 'var initial_data = [{"text": "<i>G\\u00a0 1</i>", "a_attr": {"href": "/BusinessGroup/5", "title": "t"}, "children": [{"text": "", "a_attr": {"href": "/BusinessGroup/6/x", "title": " T2"}}]}]'
    got = trees.groups(spark.createDataFrame([("p", page)], "p string, html string"), "p", "html").collect()
    assert sorted((r["id"], r["title"]) for r in got) == [("5", "G 1"), ("6", "T2")]


def test_trees_of_any_depth_without_python(spark):
    deep = '{"text": "d", "a_attr": {"href": "/CourseNode/%d"}, "children": ['
    chain = "var initial_data = [" + "".join(deep % k for k in range(40)) + "]}" * 40 + "]"
    two = 'var initial_data = [{"a_attr": {"href": "/CourseNode/1", "class": " "}, "li_attr": {"class": " node-en "}, "text": "<b>A</b> &amp; B", "children": true}, {"children": [{"a_attr": {"href": " /CourseNode/2 ", "title": " T "}}, {"a_attr": {"href": "/CourseNode/1"}}]}]; var initial_data = [{"a_attr": {"href": "/BusinessGroup/9"}}, {"a_attr": {"href": "/CourseNode/3"}, "children": "x"}]'
    pages = spark.createDataFrame([("deep", chain), ("two", two), ("none", "<p>"), ("cut", "var initial_data = [{"), (None, None)], "p string, html string")
    nodes = trees.tree_nodes(pages, "p", "html")
    got = nodes.collect()
    assert [(r["id"], r["depth"]) for r in sorted((r for r in got if r["p"] == "deep"), key=lambda r: r["pos"])] == [(str(k), k) for k in range(40)]
    assert [tuple(r) for r in sorted(got, key=lambda r: r["pos"]) if r["p"] == "two"] == [("two", 0, "1", "/CourseNode/1", "node-en", "A &amp; B", 0), ("two", 1, "2", "/CourseNode/2", "", "T", 1), ("two", 2, "3", "/CourseNode/3", "", "", 0)]
    assert {r["p"] for r in got} == {"deep", "two"}
    assert [(r["p"], r["id"]) for r in trees.groups(pages, "p", "html").collect()] == [("two", "9")]


def test_folders(spark):
    paths = ["/u/AlgData", "/u/AlgData/Downloads", "/u/.git/x", "/u/node_modules/y", "/u/Downloads/Z"]
    got = {r["path"]: (r["match_name"], r["downloads_leaf"]) for r in trees.folders_by_name(spark.createDataFrame([(p, None) for p in paths], "path string, modified timestamp")).collect()}
    assert got == {"/u/AlgData/Downloads": ("AlgData", True), "/u/Downloads/Z": ("Z", False)}


PAGE = """<table><tr><td><a data-file-name="s" href="/sendfile/a.pdf?x=1" title="Skript 1.pdf">s</a> 2 KB am 01.07.2026</td></tr></table>
<a href="/RepositoryEntry/7/CourseNode/9/Blatt">Übung</a><a href="https://k.org/b.pdf">b.pdf</a><a href="#">x</a><a href="/sendfile/a.pdf?x=1" title="again.pdf">s</a><a href="/login/c.pdf">c.pdf</a>"""


def test_listing(spark):
    pages = spark.createDataFrame([("https://h.org/RepositoryEntry/7/CourseNode/8", "7", "Kurs: A", "Material", PAGE)], "page_url string, entry string, course string, section string, html string")
    got = listing.placed(listing.files(pages, "https://h.org"), [("kurs", "K")], [], [], "/root").collect()
    assert [(r["name"], r["url"], r["size"], r["modified"], r["key"], r["path"]) for r in got] == [("Skript 1.pdf", "https://h.org/sendfile/a.pdf?x=1", 2048, "01.07.2026", "K/Material/Skript 1.pdf", "/root/K/Material/Skript 1.pdf")]
    absolute = listing.placed(listing.files(pages, "https://h.org"), [("kurs", "/else/K")], [], [], "/root").first()
    assert (absolute["key"], absolute["path"]) == ("Kurs_ A/Material/Skript 1.pdf", "/else/K/Material/Skript 1.pdf")
    assert [tuple(r) for r in listing.links_to_sections(pages).collect()] == [("repo|7|coursenode|8", "repo|7|coursenode|9|path|blatt")]


def test_state_files(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"files": {"a/b": {"size": 3, "modified": "x"}, "c": {"fail_count": 2, "failed_at": "2024-01-01T00:00:00Z", "unverified": true}}}')
    got = {r["key"]: r for r in tables.read_state(spark, str(tmp_path / "old.json")).collect()}
    assert got["a/b"]["size"] == 3 and got["a/b"]["fail_count"] == 0 and got["c"]["unverified"] and got["c"]["schema_version"] == 1
    assert tables.read_state(spark, str(tmp_path / "none.json")).collect() == []
    tables.write_state(tables.read_state(spark, str(tmp_path / "old.json")).drop("schema_version"), str(tmp_path / "new"))
    assert {r["schema_version"] for r in spark.read.json(str(tmp_path / "new")).collect()} == {2}


def test_lines_and_archives(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "outcome": "success"}\n\n{broken\n{"message": "x"}\n')
    assert [r["outcome"] for r in tables.read_history(spark, str(tmp_path / "h.jsonl")).collect()] == ["success"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.txt", "22")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    assert sorted((r["name"], bytes(r["content"])) for r in tables.zip_entries(files).collect()) == [("one.txt", b"1"), ("two.txt", b"22")]
    assert [r["cells"] for r in tables.xlsx_rows(spark.read.format("binaryFile").load(str(tmp_path / "b.xlsx"))).collect()] == [["Name", "", "7"]]
    tail, more = tables.log_tail(spark.range(10), "id", 3)
    assert [r[0] for r in tail.collect()] == [7, 8, 9] and more


def test_reads_settle(spark):
    data = [("a", k, n) for k, n in enumerate([1, 5, None, 5, 5, 5, 9])] + [("b", 0, None)]
    got = {r["k"]: (r["best"], r["settled"]) for r in progress.stable_read(spark.createDataFrame(data, "k string, seq int, n int"), "k").collect()}
    assert got == {"a": (5, True), "b": (-1, False)}


def test_warnings_of_a_stall(spark):
    events = spark.createDataFrame([("a", 0, 1), ("a", 100, 2), ("a", 350, 3), ("b", 0, 4)], "k string, at long, n long")
    got = merges.stall_warnings(events, "k", "n", F.lit(400).cast("long")).collect()
    assert sorted((r["k"], r["last"], r["n"], r["quiet"]) for r in got) == [("a", 100, 1, 180), ("a", 100, 2, 210), ("a", 100, 3, 240), *(("b", 0, k + 1, 180 + 30 * k) for k in range(8))]


def test_requests_keep_their_distance(spark):
    sent = merges.paced(spark.createDataFrame([("h", 0, 1), ("h", 100, 2), ("h", 150, 3), ("h", 2000, 4), ("i", 5, 5)], "h string, at long, n long"), "h", "at", "n").orderBy("n").collect()
    assert [(r["sent"], r["held"]) for r in sent] == [(0, 0), (250, 150), (500, 350), (2000, 0), (5, 0)]


def test_alerts(spark):
    t = datetime(2024, 1, 1)
    status = lambda *rows: spark.createDataFrame([(t + timedelta(hours=h), n, o) for h, n, o in rows], "timestamp timestamp, n long, outcome string")
    shown = lambda df, at=None: [r["n"] for r in messages.active_alert(df, F.lit(at).cast("timestamp")).collect()]
    assert shown(status((0, 1, "success"), (1, 2, "failure"))) == [2]
    assert shown(status((1, 2, "success"), (1, 3, "failure"))) == [3] and shown(status((1, 2, "failure"), (1, 3, "success"))) == []
    assert shown(status((1, 2, "failure")), t + timedelta(hours=1)) == [] and shown(status((0, 1, "failure"), (1, 2, "skipped"))) == []


def test_course_rows_of_all_courses(spark):
    got = merges.course_rows(spark.createDataFrame([(0, "*")], "place long, name string"), spark.createDataFrame([("b", "2"), ("a", "1")], "name string, folder string")).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(0, "a", "1"), (1, "b", "2")]


def test_what_is_reachable_ends_by_itself(spark):
    """A chain of any length, and roots that stop at their most while others go on."""
    chain = [(k, k + 1) for k in range(70)] + [(70, 3)]
    star = [(1000, 1000 + k) for k in range(1, 30)] + [(1001, 5000)]
    links = spark.createDataFrame(chain + star, "source long, target long")
    roots = spark.createDataFrame([("chain", 0), ("star", 1000), ("alone", 7000)], "root string, node long")
    got = {}
    for r in trees.reachable(roots, links, most=25).collect():
        got.setdefault(r["root"], []).append((r["depth"], r["node"]))
    assert sorted(got["chain"]) == [(k, k) for k in range(25)]
    assert sorted(got["star"]) == [(0, 1000)] + [(1, 1000 + k) for k in range(1, 25)] and got["alone"] == [(0, 7000)]
    whole = trees.reachable(roots.where("root <> 'star'"), links).collect()
    assert sorted(r["node"] for r in whole if r["root"] == "chain") == list(range(71))
    assert trees.reachable(roots.where("false"), links).collect() == []


def run_stream(spark, query, name, mode="append"):
    stream = query.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t = "2024-01-01 00:"
    lines = [("c", f"{t}00:00", "x"), ("c", f"{t}02:00", "y"), ("c", f"{t}20:00", "z"), ("d", f"{t}59:00", "w")]
    for k, row in enumerate(lines):
        spark.createDataFrame([row], "key string, ts string, message string").coalesce(1).write.mode("append").json(str(tmp_path / "e"))
    source = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / path))
    events = source("key string, ts timestamp, message string", "e")
    runs = run_stream(spark, progress.gap_sessions(events, "key"), "gap_runs")
    assert {(r["began"].minute, r["events"]) for r in runs if r["key"] == "c"} >= {(0, 2)}
    assert {r["last_message"] for r in run_stream(spark, progress.stalls(events, "key"), "stalled")} >= {"y"}
    spark.createDataFrame([("h", f"{t}{m}", s) for m, s in [("00:01", 200), ("00:30", 503), ("01:10", 429), ("09:00", 200)]], "host string, ts string, status int").coalesce(1).write.json(str(tmp_path / "b"))
    busy = run_stream(spark, progress.busy_hosts(source("host string, ts timestamp, status int", "b"), "host"), "busy", "complete")
    assert sorted((r["minute"].minute, r["answers"], r["busy"]) for r in busy) == [(0, 2, 1), (1, 1, 1), (9, 1, 0)]

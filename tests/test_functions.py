"""Functions on columns, case by case."""

import time

import pytest
from pyspark.sql import functions as F

from linkledger.functions import html as H
from linkledger.functions import predicates as P
from linkledger.functions import text as T
from linkledger.functions import urls as U


def apply(spark, function, *values):
    return spark.range(1).select(function(*(F.lit(v) for v in values)).alias("x")).first()["x"]


CASES = [
    (T.safe_name, ("  folder<>name  ",), "folder__name"),
    (T.safe_name, ("   ",), "unnamed"),
    (T.safe_name, ("LPT1",), "_LPT1"),
    (T.safe_name, ("a:b/c. .",), "a_b_c"),
    (T.match_text, ("  Übung \u00a0 Éa ß ø",), "ubung ea ß ø"),
    (T.fold, ("Größe Ø ñandú",), "grosse o nandu"),
    (T.words, ("AlgData",), ["alg", "data"]),
    (T.words, ("Math-Ba-NM20",), ["math", "ba", "nm", "20"]),
    (T.words, ("TUDMath",), ["tud", "math"]),
    (T.words, ("_2. Semester",), ["2", "semester"]),
    (T.words, ("",), []),
    (T.course_tokens, ("Algorithmen und Datenstrukturen (SoSe 26)",), ["algorithmen", "datenstrukturen"]),
    (T.size_bytes, ("x 245 KB y",), 250880),
    (T.size_bytes, ("1,5 MB",), 1572864),
    (T.size_bytes, ("223,7KB",), 229068),
    (T.size_bytes, ("none",), None),
    (T.modified_text, ("am 16.06.2026 um 14:11 Uhr",), "16.06.2026 um 14:11 Uhr"),
    (T.modified_text, ("01.07.2026, 09:06 Uhr",), "01.07.2026, 09:06 Uhr"),
    (T.modified_text, ("01.07.2026",), "01.07.2026"),
    (T.file_name, (" ", " a  b - ", "x/y"), "a b"),
    (T.file_name, ("", "", "x/y.pdf"), "y.pdf"),
    (T.section_title, ("http://x", "Gehe zu 1", "Material "), "Material"),
    (T.sheet_number, ("ue01_nm10_wi26-27.pdf",), 1),
    (T.sheet_number, ("Blatt1_A10.pdf",), 1),
    (T.sheet_number, ("A10_Blatt3.pdf",), 3),
    (T.sheet_number, ("U00.pdf",), 0),
    (T.sheet_number, ("p01.py",), 1),
    (T.sheet_number, ("ue2026.pdf",), None),
    (T.sheet_number, ("nm10.pdf",), None),
    (T.sheet_number, ("Lösung-4.pdf",), 4),
    (T.int_or_zero, (" 12 ",), 12),
    (T.int_or_zero, ("1x",), 0),
    (T.is_newer, ("0.2.0", "0.1.0"), True),
    (T.is_newer, ("v1.2", "1.2.0"), False),
    (T.is_newer, ("1.2.1", "1.2"), True),
    (T.is_newer, ("1.0", "dev"), None),
    (T.checksum_line, ("A" * 64 + "  file.exe",), "a" * 64),
    (T.checksum_line, ("zz file",), None),
    (T.is_time_of_day, ("23:59",), True),
    (T.is_time_of_day, ("24:00",), False),
    (T.scattered_minute, ("a",), "06:37"),
    (T.percent, (1, 0), 0),
    (T.percent, (2, 3), 66),
    (T.folder_key, ("C:\\Users\\Me\\A//b/./",), "c:/users/me/a/b"),
    (T.is_mojibake, ("GrÃ¶Ãe",), True),
    (T.is_mojibake, ("Größe",), False),
    (lambda a, b: T.since(a.cast("timestamp"), b.cast("timestamp")), ("2024-01-01 00:00:00", "2024-01-01 02:01:00"), "2 hours ago"),
    (lambda a, b: T.since(a.cast("timestamp"), b.cast("timestamp")), ("2024-01-01 00:00:00", "2024-01-09 00:00:00"), "1 Jan 2024"),
    (T.remaining, (90,), "under a minute"),
    (T.remaining, (47 * 3600,), "47 hours"),
    (U.resolve, ("https://h.org/a/b?x=1", "../c.pdf"), "https://h.org/c.pdf"),
    (U.resolve, ("https://h.org/a/b", "//k.org/z"), "https://k.org/z"),
    (U.resolve, ("https://h.org/a/b", "/z?q=1#f"), "https://h.org/z?q=1#f"),
    (U.resolve, ("https://h.org/a/b?x=1", ""), "https://h.org/a/b?x=1"),
    (U.resolve, ("https://h.org/a/b/", "./d/../e/."), "https://h.org/a/b/e/"),
    (U.resolve, ("https://h.org", "x"), "https://h.org/x"),
    (U.same_host, ("https://H.org:8080/x", "https://h.ORG"), True),
    (U.same_host, ("/x", "https://h.org"), True),
    (U.same_host, ("https://k.org/x", "https://h.org"), False),
    (U.entry_id, ("/auth/repositoryentry/42/CourseNode/1",), "42"),
    (U.crawl_form, ("https://h.org/p?b=1&target=fold_2&cmd=view#x",), "https://h.org/p?cmd=view&target=fold_2"),
    (U.section_key, ("https://h.org/RepositoryEntry/7/CourseNode/9/Blatt%201/", "7"), "repo|7|coursenode|9|path|blatt 1"),
    (U.section_key, ("https://h.org/RepositoryEntry/8", "7"), "foreign-repo|8"),
    (U.section_key, ("https://h.org/x?target=FOLD_3", "7"), "repo|7|target|fold_3"),
    (U.section_key, ("https://h.org/x?cmd=view", "7"), "repo|7|root"),
    (U.section_key, ("https://h.org/x?cmd=List", "7"), "repo|7|cmd|list"),
    (U.link_target, ("#", "window.open('/a.pdf')", "", ""), "/a.pdf"),
    (U.link_target, ("javascript:;", "location.href = \"/b\"", " ", ""), "/b"),
    (U.link_target, ("", "", "/data", ""), "/data"),
    (U.without_query, ("https://h.org/a?b",), "https://h.org/a?..."),
    (U.host_port, ("http://h.org/x",), "h.org:80"),
    (U.document_name, ("https://h.org/a/b%20c+d.html?x",), "b c+d.html"),
    (P.is_file, ("/sendfile?x", "Skript"), True),
    (P.is_file, ("/x", "a.PDF"), True),
    (P.is_file, ("/login/a.pdf", "a.pdf"), False),
    (P.is_file, ("/x", "Tabelle herunterladen.csv"), False),
    (P.is_section_folder, ("/RepositoryEntry/1/CourseNode/2", "Material"), True),
    (P.is_section_folder, ("/RepositoryEntry/1/CourseNode/2", "Forum"), False),
    (P.is_section, ("/RepositoryEntry/1/CourseNode/2", "Übersicht"), False),
    (P.section_allowed, ("https://h.org/RepositoryEntry/1/x", "1"), True),
    (P.section_allowed, ("https://h.org/RepositoryEntry/2/x", "1"), False),
    (P.section_allowed, ("https://h.org/auth/home", "1"), False),
    (P.file_allowed, ("https://k.org/a.pdf", "1", "https://h.org"), False),
    (P.folder_target, ("Course", "/CourseNode/1", " course"), False),
    (P.folder_target, ("Course", "/CourseNode/1/sub", "Course"), True),
    (P.is_show_all, ("javascript:;", "Seiten", "", "x pager-showall"), True),
    (P.is_show_all, ("/x?length=-1", "", "", ""), True),
    (P.is_show_all, ("/x", "Next", "", ""), False),
    (H.plain, ("<b>a</b>\n<i> b</i>",), "a b"),
    (H.attribute, ('href="a" HREF="b"', "href"), "b"),
    (H.redirect_target, ("window.location='https:\\/\\/h.org\\/x'",), "https://h.org/x"),
    (H.show_all_url, ('{"u":"/x?1-pager-showAllLink"}',), "/x?1-pager-showAllLink"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(spark, k):
    function, values, want = CASES[k]
    if function is H.attribute:
        assert spark.range(1).select(H.attribute(F.lit(values[0]), values[1]).alias("x")).first()["x"] == want
    else:
        assert apply(spark, function, *values) == want


ROWS = """<table><tr><td><img></td><td><a data-file-name="a.pdf" href="/sendfile/1" title="">A &amp; B</a></td><td>223,7KB</td><td>am 03.10.2025 um 11:07 Uhr</td></tr>
<tr><td><a data-file-name="x" href="/x">x</a><a data-file-name="y" href="/y">y</a> 5 KB</td></tr></table><A HREF="/out">out<br>side</A>"""


def test_rows_around_anchors(spark):
    pages = spark.createDataFrame([(1, ROWS)], "page_id long, html string")
    got = H.anchors(pages, ["page_id"]).orderBy("pos").collect()
    assert [r["href"] for r in got] == ["/sendfile/1", "/x", "/y", "/out"]
    assert got[0]["text"] == "A & B" and got[0]["row_text"] == "A & B 223,7KB am 03.10.2025 um 11:07 Uhr"
    assert [r["row_text"] for r in got[1:]] == ["x", "y", "out side"]


def test_rows_by_position(spark):
    # equal anchors in and outside rows; a row with a second anchor; a row whose only file is named with spaces; a tag that is no row
    row = '<tr class="f"><td><a href="/s" data-file-name="s">S</a></td><td>%s</td></tr>'
    page = "<a href='x'>none</a>" + row % "1&nbsp;KB" + '<a href="/s" data-file-name="s">S</a>' + row % '<a href="/more">more</a> 2 KB' + '<TR><td><a href="/t" data-file-name = "t">T</a>  3\n KB</td></TR><track><a href="/end">E</a>' + row % "4 KB"
    pages = spark.createDataFrame([(1, page), (2, "<a href=\"/a\">\x01a</a>"), (3, ""), (4, None), (5, "<tr><a href=\"/open\" data-file-name=\"o\">never closed")], "page_id long, html string").withColumn("pos", F.lit("kept out"))
    got = H.anchors(pages, ["page_id"]).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["pos"], r["href"], r["row_text"]) for r in got] == [(1, 0, "", "none"), (1, 1, "/s", "S 1 KB"), (1, 2, "/s", "S"), (1, 3, "/s", "S more 2 KB"), (1, 4, "/more", "S more 2 KB"), (1, 5, "/t", "T 3 KB"), (1, 6, "/end", "E"), (1, 7, "/s", "S 4 KB"), (2, 0, "/a", "a")]


def test_time_of_anchors_follows_the_page(spark):
    took = []
    for n in (500, 2000, 16000):
        page = "".join(f'<tr><td><a href="/s/{k}" data-file-name="f{k}">f{k}</a></td><td>{k} KB</td></tr>' for k in range(n))
        began = time.time()
        got = H.anchors(spark.createDataFrame([(1, page)], "page_id long, html string"), ["page_id"]).agg(F.count("*").alias("n"), F.count_if(F.col("row_text") == F.concat(F.col("file_name"), F.lit(" "), F.col("pos"), F.lit(" KB"))).alias("own")).first()
        assert got["n"] == got["own"] == n
        took.append(time.time() - began)
    assert took[2] < 10 * took[1] + 2


def test_frames_and_json(spark):
    body = '<iframe width="1" src="doc.html?a=1&amp;b=2" id="z"></iframe><iframe src="https://k.org/e.html"></iframe><iframe src="x.png"></iframe>'
    assert spark.range(1).select(H.frame_documents(F.lit(body), F.lit("https://h.org/p/q")).alias("x")).first()["x"] == ["https://h.org/p/doc.html?a=1&b=2"]
    arrays = lambda page: spark.range(1).select(F.transform(H.embedded_arrays(F.lit(page)), lambda v: F.to_json(v)).alias("x")).first()["x"]
    assert arrays('x var initial_data = [{"a": "]\\""}]; more [ var  initial_data=[1, 2 var initial_data = {}; var initial_data = [[]]') == ['[{"a":"]\\""}]', "[[]]"]
    assert arrays("var initial_data = [1, 2") == arrays("") == []
    assert apply(spark, H.unescape, "a &lt; &uuml;") == "a < ü"
    assert apply(spark, H.content_region, 'a<div id="content">b</div><footer>c') == 'id="content">b</div>'
    one, two = ('<a id="row-1a2b3c" href="/p;jsessionid=AA">t</a>', '<a id="row-9f8e7d" href="/p;jsessionid=BB">t</a>')
    assert apply(spark, H.without_volatile, one) == apply(spark, H.without_volatile, two) != apply(spark, H.without_volatile, two.replace(">t<", ">u<"))


def test_clicks(spark):
    body = '{"u":"/a","c":"id1","e":"focus"},{"u":"\\/b","c":"id1","x":1,"e":"click"},{"u":"/c","c":"id2","e":"click"}'
    assert apply(spark, H.click_url, body, "id1") == "/b"
    assert apply(spark, H.click_url, body, "id9") is None

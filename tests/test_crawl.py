"""The crawl over captured pages against a queue, page by page."""

import random

import pytest
from pyspark.sql import functions as F

from linkledger.plans import crawl as C

BASE = "https://h.example"


def address(e, j):
    return f"{BASE}/auth/RepositoryEntry/{e}" + (f"/CourseNode/{j}" if j else "")


def site(links, e=1):
    """pages of a course by links[j] = (tree, own, show_all) of node numbers, and what a queue of them does."""
    pages = []
    for j, (tree, own, every) in links.items():
        a = lambda k: f'<A HREF="/auth/RepositoryEntry/{e}/CourseNode/{k}" class="x{" node-en" if k % 7 == 6 else ""}" title="T:{k} by {j}">t</A>'
        body = "".join(map(a, own))
        if tree:
            nodes = ",".join(f'{{"text": "<i>S:{k}</i>", "li_attr": {{"class": "{"node-en" if k % 7 == 6 else ""}"}}, "a_attr": {{"href": "{address(e, k)}"}}, "children": []}}' for k in tree)
            body += f"<script>var initial_data = [{nodes}];</script>"
        if every:
            body += f'"u":"\\/list{e}-{j}?pager-showAllLink"'
            pages.append((f"{BASE}/list{e}-{j}?pager-showAllLink", "".join(map(a, every))))
        pages.append((address(e, j), body))
    return pages


def queue(links, most):
    seen, order, skipped, waiting, line = {0}, [], set(), set(), [(0, "Course", 0)]
    while line:
        j, title, depth = line.pop(0)
        if len(order) == most:
            waiting.add(j)
            continue
        order.append((j, title, depth))
        tree, own, every = links.get(j, ([], [], []))
        offers = [(k, f"S:{k}") for k in (tree if j == 0 else [])] + [(k, f"T_{k} by {j}") for k in [*own, *every]]
        for k, named in offers:
            if k not in seen and k != 0:
                seen.add(k)
                if k % 7 == 6:
                    skipped.add((k, named, depth + 1))
                else:
                    line.append((k, named, depth + 1))
    return order, skipped, waiting


@pytest.mark.parametrize("most", [6, 500])
def test_against_a_queue(spark, most):
    random.seed(2)
    graphs = {}
    for e in (1, 2, 3):
        nodes = list(range(25))
        some = lambda n: random.sample(nodes[1:], random.randrange(n))
        graphs[e] = {j: (some(3), some(4), some(3) if j % 2 else []) for j in nodes if j % 5 != 4 and j != 24}
    graphs[4] = {0: ([], [], [])}
    pages = [p for e, g in graphs.items() for p in site(g, e)]
    courses = spark.createDataFrame([(str(e), "Course", address(e, 0)) for e in [*graphs, 5]], "entry string, title string, url string")
    found = C.crawl(courses, spark.createDataFrame(pages, "url string, html string").repartition(4), BASE, most)
    rows = found.sections.collect()
    told = {r["entry"]: r for r in C.warnings(found, most).collect()}
    for e, g in [*graphs.items(), (5, {})]:
        order, skipped, waiting = queue(g, most)
        own = [r for r in rows if r["entry"] == str(e)]
        visited = sorted((r for r in own if not r["skipped"]), key=lambda r: r["nth"])
        assert [r["nth"] for r in visited] == list(range(1, len(order) + 1))
        assert [(r["url"], r["title"], r["depth"]) for r in visited] == [(address(e, j), t, d) for j, t, d in order]
        assert {(r["url"], r["title"], r["depth"]) for r in own if r["skipped"]} == {(address(e, j), t.replace(":", "_") if t[0] == "T" else t, d) for j, t, d in skipped}
        row = told[str(e)]
        assert (row["sections"], row["skipped"], row["waiting"], row["capped"]) == (len(order), len(skipped), len(waiting), bool(waiting))


def test_files_of_pages_lists_and_frames(spark):
    row = '<tr><td><a href="%s" data-file-name="%s">x</a></td><td>%s KB</td></tr>'
    pages = [
        (address(1, 0), row % ("/sendfile/a.pdf", "a.pdf", 3) + '<a href="/auth/RepositoryEntry/1/CourseNode/5">Five</a><iframe src="/d/one.html?t=1"></iframe><iframe src="https://other.example/d/one.html"></iframe><iframe src="/d/pic.png"></iframe>' + "".join(f'<iframe src="/d/n{k}.htm"></iframe>' for k in range(5))),
        (f"{BASE}/d/one.html?t=1", '<a href="b%20c.pdf">see here 7 KB</a><a href="/sendfile/a.pdf">again</a><a href="/auth/RepositoryEntry/1/CourseNode/9">no way</a><a href="https://other.example/e.pdf">e</a>'),
        *((f"{BASE}/d/n{k}.htm", f'<a href="k{k}.zip">z</a>') for k in range(5)),
        (address(1, 5), row % ("/sendfile/five.zip", "five.zip", 1) + '"u":"\\/all?pager-showAllLink"' + row % ("/sendfile/a.pdf", "a.pdf", 9)),
        (f"{BASE}/all?pager-showAllLink", row % ("/sendfile/six.zip", "six.zip", 6) + '<a href="/login">in</a>'),
        (address(1, 8), row % ("/sendfile/unreached.zip", "u", 1)),
    ]
    courses = spark.createDataFrame([("1", "Course", address(1, 0))], "entry string, title string, url string")
    found = C.crawl(courses, spark.createDataFrame(pages, "url string, html string"), BASE)
    got = {(r["section"], r["name"], r["url"].removeprefix(BASE), r["size"]) for r in C.crawled_files(found, BASE).collect()}
    # four frames at most, the first of which names its files by their addresses
    assert got == {("Course", "a.pdf", "/sendfile/a.pdf", 3072), ("Course", "b c.pdf", "/d/b%20c.pdf", None), *(("Course", f"k{k}.zip", f"/d/k{k}.zip", None) for k in range(3)), ("Five", "five.zip", "/sendfile/five.zip", 1024), ("Five", "six.zip", "/sendfile/six.zip", 6144)}


def test_no_courses_and_no_pages(spark):
    courses = spark.createDataFrame([("1", "Course", address(1, 0))], "entry string, title string, url string")
    pages = spark.createDataFrame([], "url string, html string")
    assert C.crawl(courses, pages, BASE).sections.count() == 1
    assert C.crawl(courses.where(F.lit(False)), pages, BASE).sections.count() == 0

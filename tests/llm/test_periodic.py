"""Periodic runs against a plain search of all stretches of all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkledger.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of every run, each stretch of each period tried, the smallest periods first."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // 4 + 1):
        a = 0
        while a + p < n:
            b = a
            while b + p < n and words[b] == words[b + p]:
                b += 1
            if b > a and b + p - a >= max(6, 4 * p) and (a, b + p) not in seen:
                seen.add((a, b + p))
                out.append((a, b + p - a, p))
            a = b + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *own, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(" ".join(kept))


def test_query_against_the_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert got == {plain_row(r["doc_id"], r["text"]) for r in docs}
    assert sum(r[1] > 0 for r in got) > 10


def runs_by_document(texts):
    words = [t.split() for t in texts]
    names = {w: k for k, w in enumerate(sorted({w for t in words for w in t}))}
    first = np.concatenate([[0], np.cumsum([len(t) for t in words])])
    found = periodic.find_runs(np.array([names[w] for t in words for w in t], np.int32), first)
    return [[tuple(int(x) for x in r[1:]) for r in found if r[0] == k] for k in range(len(texts))]


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_few_words(letters):
    random.seed(letters)
    texts = [" ".join(random.choice("abc"[:letters]) for _ in range(random.randrange(90))) for _ in range(150)]
    for _ in range(150):  # runs in runs, and beside runs
        part = [random.choice("ab"[:letters]) for _ in range(random.randrange(1, 14))]
        texts.append(" ".join(random.choices("ab", k=random.randrange(6)) + part * random.randrange(3, 9) + part[: random.randrange(len(part))] + random.choices("abc", k=random.randrange(9))))
    texts += [" ".join("abaabaabaab" * 6), " ".join("aaaaaab" * 9), " ".join("aab" * 4 + "aabaaba" * 5)]
    assert runs_by_document(texts) == [plain_runs(t.split()) for t in texts]


def test_runs_longer_than_a_chunk():
    random.seed(9)
    part = [str(random.randrange(10**6)) for _ in range(997)]
    words = ["x"] + part * 5 + part[:400] + ["y", "x"] + ["z"] * 5000
    assert runs_by_document([" ".join(words), "z z z z z z"]) == [[(1, 997 * 5 + 400, 997), (len(words) - 5000, 5000, 1)], [(0, 6, 1)]]


def test_time_follows_the_length():
    took = []
    for n in (100_000, 400_000):
        began = time.time()
        texts = [" ".join(["one"] * n), " ".join(["a", "b", "a"] * (n // 3)), " ".join(str(k * k % 1009) for k in range(n))]
        assert [len(r) for r in runs_by_document(texts)] == [1, 1, 1]
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1


def test_odd_rows(spark):
    long = " ".join(f"w{k % 701}" for k in range(120_000))
    data = [(None, None), (1, ""), (2, " \t\n"), (3, "a " * 6), (3, "a " * 6), (4, long), (5, "é é é é é É"), (6, "b\x0ba\rb\x0ca\nb a b a"), (7, "x\u00a0x x\u00a0x x\u00a0x x\u00a0x x\u00a0x x\u00a0x")]
    rows = spark.createDataFrame(data, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit("clash"))
    got = periodic.collapse(rows, "_runs").withColumn("r", F.to_json("_runs.runs")).select("doc_id", "r", "_runs.collapsed", "runs").collect()
    of = {r["doc_id"]: (r["r"], r[2]) for r in got}
    one = '[{"start":0,"length":%d,"period":%d}]'
    assert len(got) == 9 and {r["runs"] for r in got} == {"clash"}
    assert of == {None: ("[]", ""), 1: ("[]", ""), 2: ("[]", ""), 3: (one % (6, 1), "a"), 4: (one % (120_000, 701), " ".join(f"w{k}" for k in range(701))), 5: ("[]", "é é é é é É"), 6: (one % (8, 2), "b a"), 7: (one % (6, 1), "x\u00a0x")}
    assert periodic.collapse(rows.where("false")).collect() == []


def test_planting_keeps_documents_without_words_or_ids(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = spark.createDataFrame([(ids[0], None), (ids[1], " "), (ids[2], "one two"), (None, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in rows.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    assert got[ids[0]] is None and got[ids[1]] == " " and got[None] == "a b" and len(got[ids[2]].split()) == 2

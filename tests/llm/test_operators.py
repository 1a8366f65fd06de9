"""Every operator against its plain version, on the smallest tables and on odd rows."""

import math
import random
import re
import string
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linkledger.llm import class_lm, decontaminate, language, mixing, near_duplicates, neighbours, repeats, secrets, sharding, token_files

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, _hash string, n_bytes int"


def odd_rows():
    random.seed(5)
    long = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "épsilon", "ñu"]) + str(random.randrange(50)) for _ in range(4000))
    passage = " ".join(f"shared{k} words" for k in range(60))
    texts = [None, "", " \t\n", "one", "one", "ONE", "éß ñ", "a b", " x  y\n\nz  \t end ", "token = \"0123456789abcdef0123456789\" x", "<|endoftext|> in text", long, long, long + " more", passage, "before " + passage, passage + " after", "don't we'll  double  spaces", "日本語 テキスト、です。", "x" * 3000, "12345 67,89", "?!"]
    return [(k, t, ["en", "fr", None][k % 3], ["a", "b", None, "a"][k % 4], "clash", 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def awkward():
    random.seed(11)
    words = lambda n: " ".join("".join(random.choices("abcdeé", k=random.randrange(2, 9))) for _ in range(n))
    shared, other, near = words(80), words(60), words(300).split()
    texts = ["x" * 199, "x" * 200, "y" * 201, "y" * 500, "ab" * 150, shared, words(30) + shared + words(9), shared[3:230] + words(20), other + words(40) + other, words(500), None, "", "", "é" * 100, "é" * 100, shared[:199] + "!", "q" + other[:200] + "r"]
    for _ in range(12):
        copy = list(near)
        copy[random.randrange(len(copy))] = "EDIT"
        texts.append(" ".join(copy[random.randrange(9) :]))
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("table", ["odd", "small", "awkward"])
def test_repeats(spark, request, table, monkeypatch):
    docs = spark.createDataFrame(awkward(), "doc_id long, text string").repartition(4) if table == "awkward" else request.getfixturevalue(table)
    want = brute.repeats(pairs(docs))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = repeats.find_repeats(docs)
    assert rows(got, *columns) == want
    for r in got.collect():
        assert sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)) == r["n_removed"]


def test_repeats_of_an_empty_table(odd):
    assert repeats.find_repeats(odd.where("false")).collect() == []


def test_strings_of_one_name(monkeypatch):
    """Where names don't tell strings apart, their bytes do."""
    random.seed(4)
    text = np.frombuffer(b"".join(bytes(random.choices(b"ab", k=230)) for _ in range(6)) * 2, np.uint8)
    starts = np.arange(len(text) - repeats.LENGTH + 1)
    strings = [text[k : k + repeats.LENGTH].tobytes() for k in starts]
    want = [strings.count(x) > 1 for x in strings]
    assert repeats._repeated(text, starts).tolist() == want
    monkeypatch.setattr(repeats.Names, "at", lambda self, at, n: np.zeros(len(at), np.uint64) + np.uint64(7))
    assert repeats._repeated(text, starts).tolist() == want


def test_repeats_with_hot_pieces(spark, monkeypatch):
    """Strings in so many places that only their names are gathered."""
    rng = random.Random(9)
    shared = " ".join(f"h{k}" for k in range(90))
    texts = [" ".join(f"{rng.random()}"[2:8] for _ in range(30)) + shared + str(k) * 9 for k in range(1500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    monkeypatch.setattr(repeats, "CELL", 20_000)
    assert rows(repeats.find_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(pairs(docs))


def test_cover():
    assert {(a - b) % repeats.MODULUS for a in repeats.COVER.tolist() for b in repeats.COVER.tolist()} == set(range(repeats.MODULUS))


@pytest.mark.parametrize("table", ["odd", "small"])
def test_contamination(spark, request, table):
    docs = request.getfixturevalue(table)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(1000, "one"), (1001, " ".join(f"shared{k} words" for k in range(9))), (1002, None), (1003, "one"), (1004, "!!")], "item_id long, text string"))
    known = [tuple(r) for r in items.select("item_id", "text").collect()]
    for part_windows in (1_000_000, 50):
        found = decontaminate.find_hits(docs, items, "h", part_windows=part_windows)
        got = found.select("doc_id", "h.n_words", decontaminate.n_hit("h").alias("n_hit"), F.size("h.items").alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.transform("h.items", lambda x: x.cast("string")))), 256).alias("s"), decontaminate.contaminated("h").alias("c"))
        assert rows(got, "*") == brute.contamination(pairs(docs), known)


@pytest.mark.parametrize("table", ["odd", "small"])
def test_near_duplicates(request, table):
    docs = request.getfixturevalue(table)
    for shingle in (2, 5):
        assert rows(near_duplicates.near_duplicates(docs, shingle=shingle), "*") == brute.near(pairs(docs), shingle)
    left = near_duplicates.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted(r[0] for r in brute.near(pairs(docs), 5) if r[3])


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """Copies of one text of which most are too far apart, each with a mate within the limit."""
    rng = random.Random(6)
    base, texts = [f"w{k}" for k in range(200)], []

    def changed(words, n):
        return [f"x{rng.random()}" if k in at else w for at in [set(rng.sample(range(200), n))] for k, w in enumerate(words)]

    for _ in range(250):
        one = changed(base, 8)
        texts += [one, changed(one, 10)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    want = brute.near(pairs(docs), 2)
    assert 20 < len({r[2] for r in want}) < 400
    assert rows(near_duplicates.near_duplicates(docs, shingle=2), "*") == want
    monkeypatch.setattr(near_duplicates, "TILE", 50)
    assert rows(near_duplicates.near_duplicates(docs, shingle=2), "*") == want


def test_near_duplicates_of_an_empty_table(odd):
    assert near_duplicates.near_duplicates(odd.where("false")).collect() == []


def test_languages(odd, small):
    docs = small.withColumn("score", F.lit("clash"))
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model, "f").select("doc_id", "lang", F.col("f.lang").alias("p"), F.col("f.score").alias("s"), F.length("text").alias("n")).collect()
    judged = [r for r in found if brute.held_out(r["doc_id"], 0) and r["n"] >= 40]
    assert sum(r["p"] == r["lang"] for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r["s"] <= 1 for r in found)
    got = {r["doc_id"]: r["p"] for r in language.identify(odd, model, "f").select("doc_id", F.col("f.lang").alias("p")).collect()}
    assert {k for k, p in got.items() if p == "und"} == {0, 1, 2, 20, 21}
    nothing = language.learn(odd.where("false"))
    assert {r[0] for r in language.identify(odd, nothing, "f").select("f.lang").collect()} == {"und"}


def test_phrases_are_longest_matches():
    texts = {"a": b"the cat sat on the mat and the cat ran", "b": "élan vital été où déjà".encode()}
    model = language.Model(texts)
    for text in (b"the catsat xx mat", b"", b"zzz", "déjà élan".encode(), b"the cat sat on the mat and " * 30, b"the cat sat on the mat and the cat ran" * 40, b"on the " + b"catsat" * 200):
        want = []
        for name in model.languages:
            own, x, n = language._FOLD[np.frombuffer(texts[name], np.uint8)].tobytes(), language._FOLD[np.frombuffer(text, np.uint8)].tobytes(), int(len(text) > 0)
            match = b""
            for c in x:
                longer = match + bytes([c])
                if longer in own:
                    match = longer
                else:
                    n, match = n + 1, bytes([c]) if bytes([c]) in own else b""
            want.append(n)
        got = model.phrases(language._FOLD[np.frombuffer(text, np.uint8)], np.array([0, len(text)]))[:, 0].tolist()
        assert got == want


def test_shards(odd, small):
    for docs, limit in ((small, 20_000), (odd, 1000), (small, 1 << 40)):
        got = sharding.shards(docs, limit=limit)
        assert set(docs.columns) <= set(got.columns)
        size = next(c for c in got.columns if c.strip("_") == "n_bytes" and c not in docs.columns)
        by = got.groupBy("shard").agg(F.sum(size).alias("b"), F.count("*").alias("n"), F.first("shard_bytes").alias("s"), F.first("shard_docs").alias("d")).collect()
        assert sum(r["n"] for r in by) == docs.count()
        assert all((r["b"] <= limit or r["n"] == 1) and (r["b"], r["n"]) == (r["s"], r["d"]) for r in by)
        names = sorted(r["shard"] for r in by)
        assert not any(b.startswith(a) for a in names for b in names if a != b)
    assert sharding.shards(odd.where("false")).collect() == []


def test_shards_split_as_sql_says(small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for limit in (3000, 20_000, 1 << 40):
        want = con.execute(sharding.oracle(limit)).fetchall()
        columns = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
        got = rows(sharding.shards(small, limit=limit), *columns)
        assert got == sorted(want, key=str)
        assert (len({r[2] for r in got}) > 8) == (limit < 1 << 40)


def test_rows_of_one_id_split(spark):
    docs = spark.createDataFrame([(7, "x" * 100)] * 300 + [(8, "y")], "doc_id long, text string")
    by = sharding.shards(docs, limit=1000).groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in by) == 301 and all(r["b"] <= 1000 for r in by)


def test_secret_places():
    assert len(secrets.TERMS) == secrets.WINDOW + 1


def test_secrets(spark):
    cases = {
        "": ("", ""),
        None: ("", ""),
        'é token = "abcdef12" and secret=token: abcdefgh': ("assign:2:19", ""),
        "password:short": ("", ""),
        "PassWord: 123456": ("assign:0:16", ""),
        "x AKIA" + "A1" * 8 + " y": ("access:2:22", ""),
        "0123456789abcdef01234567 " * 2: ("hex:0:24,hex:25:49", ""),
        "key Zk3qP9xL2mV8tR5wY7bN1cD4 end": ("", "entropy:4:28"),
        "thisisalongwordwithoutdigits 111111111111-11111111111 path/to/some/other/file_name": ("", ""),
        "exampleZk3qP9xL2mV8tR5wY7bN1cD4": ("", ""),
        "aaaaaaaaaaaaaaaaaaaaaaaa1": ("hex:0:25", ""),
        "ababababababababababzzzz1": ("", ""),
        "KEY=9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B": ("", "entropy:4:44"),
        "id/DEADBEEF0A1B2C3D4E5F60718293A4B5C6D7E8F9": ("", "entropy:3:43"),
        "550e8400-e29b-41d4-a716-446655440000": ("", ""),
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "base long, text string")
    got = {r["base"]: (r["b"], r["a"]) for r in secrets.scan(docs, "found").select("base", secrets.joined(F.col("found.base")).alias("b"), secrets.joined(F.col("found.added")).alias("a")).collect()}
    assert got == {k: v for k, v in enumerate(cases.values())}


def hot_spans(value):
    """The hot windows of a candidate, touching ones as one, without those that the allow-list has."""
    spans = []
    for i in range(len(value) - secrets.WINDOW + 1):
        w = value[i : i + secrets.WINDOW]
        entropy = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
        if not re.search("[0-9]", w) or not re.search("[A-Za-z]", w):
            continue
        if re.fullmatch("[0-9a-fA-F]*", w):
            bits = 2.75
        elif re.fullmatch("[0-9A-Z]*", w):
            bits = 3.4
        elif re.fullmatch("[0-9A-Za-z]*", w):
            bits = 3.6
        else:
            bits = 3.8 if re.search("[a-z]", w) and re.search("[A-Z]", w) else 99
        if entropy >= bits - 1e-6:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + secrets.WINDOW
            else:
                spans.append([i, i + secrets.WINDOW])
    near = lambda a, b: value[max(0, a - secrets.WINDOW) : b + secrets.WINDOW]
    return [(a, b) for a, b in spans if b - a > secrets.SHORT or not re.search(secrets.ALLOWED, near(a, b))]


def test_windows_by_counting(spark):
    random.seed(3)
    values = ["".join(random.choice("abcdef0123456789ABCXYZ+/"[: random.choice([4, 16, 24])]) for _ in range(random.choice([20, 25, 60]))) for _ in range(60)]
    values += ["/".join(random.choice(["".join(random.choices(string.ascii_letters + string.digits, k=random.randrange(10, 40))), "some-words", "0" * 9, "EXAMPLE", "x" * 30]) for _ in range(n)) for n in (3, 8, 400)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.hot_spans(F.col("v")).alias("r")).collect()
    assert max(map(len, values)) > 3 * secrets.CHUNK
    for r in got:
        assert [(s["start"], s["end"]) for s in r["r"]] == hot_spans(r["v"])


def test_secrets_of_long_texts_take_seconds(spark):
    rng = random.Random(1)
    signs = string.ascii_letters + string.digits + "+/"
    texts = ["".join(rng.choices(signs, k=1_000_000)), " ".join(f"token=abcdef{k % 90:02d}" for k in range(100_000)), " ".join("".join(rng.choices(signs, k=24)) for _ in range(20_000))]
    for text, least in zip(texts, ((0, 1), (100_000, 0), (0, 15_000)), strict=True):
        began = time.time()
        r = secrets.scan(spark.createDataFrame([(text,)], "text string"), "f").select(F.size("f.base"), F.size("f.added")).first()
        assert r[0] == least[0] and r[1] >= least[1] and time.time() - began < 90


def test_mixing(odd, small):
    for docs in (odd, small, odd.where("false")):
        got = mixing.mix(docs).collect()
        assert len(got) == docs.count()
        total = sum(r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault(r["source"], []).append(r)
            assert 0 <= r["taken"] <= 2 * r["size"]
        assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1
        for v in by.values():
            assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 2 * v[0]["source_size"] + 1e-6
            assert sum(r["taken"] for r in v) == round(v[0]["target"])
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.orderBy(F.desc("text"), "doc_id")).collect()))
    copies = mixing.mixed_documents(small)
    assert copies.columns == small.columns


def test_mixing_of_equal_ids_in_any_order(spark):
    rng = random.Random(2)
    data = [([None, 7][k % 2], " ".join("w" * (1 + k % 5) for _ in range(1 + k % 9)), ["a", None, "b"][k % 3]) for k in range(59)]
    results = []
    for _ in range(3):
        results.append(sorted(map(str, mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(rng.randrange(1, 6))).collect())))
        rng.shuffle(data)
    assert results[0] == results[1] == results[2]


def test_token_files(spark, small, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs in (small, odd):
        to = str(tmp_path / str(docs.count()))
        token_files.write(docs, to, path)
        assert [tuple(r) for r in token_files.read(spark, to).orderBy("doc_id").collect()] == brute.tokens(pairs(docs), path)
    from tokenizers import Tokenizer

    one = token_files.read_document(spark, to, 17)
    assert [x.tolist() for x in one] == [[*Tokenizer.from_file(path).encode(odd_rows()[17][1], add_special_tokens=False).ids, 0]]
    token_files.write(odd.where("false"), str(tmp_path / "none"), path)
    assert token_files.read(spark, str(tmp_path / "none")).collect() == []


def test_pieces_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, own = Tokenizer.from_file(path), token_files.Encoder(path)
    random.seed(8)
    parts = ["a", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "x1", " ", " ", "　", "ñandú", "!", "…", "<|endoftext|>", "日本", "\x1c", "\x85", " the", "à", "…"]
    for _ in range(40):
        texts = ["".join(random.choices(parts, k=random.randrange(40))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        ids, n = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def test_class_lm(small, odd, monkeypatch):
    """Base columns and scores against plain sums over the classes that were found, few or all words in the broadcast table."""
    for frequent in (1 << 20, 300):
        monkeypatch.setattr(class_lm, "FREQUENT", frequent)
        for docs in (small, odd):
            want = brute.base_scores(pairs(docs))
            got = class_lm.score(docs).collect()
            for r in got:
                assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
                assert math.isclose(r["base_score"], want[r["doc_id"]][3], rel_tol=1e-9, abs_tol=1e-9)
            if docs is small:
                assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
            model, _, _, with_more = class_lm.learn(docs.select("text", (~class_lm.held_out(F.col("doc_id"))).alias("learned")))
            found = {int(np.uint64(h)): int(c) for h, c in zip(model.table.hashes, model.table.classes, strict=True)}
            found |= {w["hash"] % (1 << 64): w["class"] for r in with_more.where("more is not null").select("more").collect() for w in r["more"]}
            hash_of = lambda w: int(class_lm.WORDS.hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
            score = brute.class_scores(pairs(docs), lambda w: found.get(hash_of(w)), class_lm.CLASSES, class_lm.PRIOR)
            assert all(math.isclose(r["score"], score[r["doc_id"]], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    assert class_lm.score(odd.where("false")).collect() == []


def test_words_move_to_the_likeliest_class(monkeypatch):
    """best_classes against the likelihood of every move, for words that don't follow themselves."""
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    monkeypatch.setattr(class_lm, "WIDTH", 4 + 1 + class_lm.KINDS)
    rng = np.random.default_rng(3)
    n, width = 12, 8
    bigrams = rng.poisson(2, (n, n)) * (1 - np.eye(n, dtype=int))
    of = rng.integers(0, 4, n)
    of[-2:] = [4, 5]

    def joint_of(classes):
        joint = np.zeros((width, width))
        np.add.at(joint, (classes[:, None], classes[None, :]), bigrams)
        return joint

    def likelihood(classes):
        j = joint_of(classes)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(j) - f(j.sum(1)) - f(j.sum(0))

    entries = [(w, of[x], bigrams[w, x]) for w in range(10) for x in range(n)] + [(w, width + of[x], bigrams[x, w]) for w in range(10) for x in range(n)]
    words, slots, counts = class_lm.summed(*(np.array(c) for c in zip(*[e for e in entries if e[2]], strict=True)))
    own, best = class_lm.best_classes(words.astype(np.uint64), slots, counts, of[:10], joint_of(of))
    for w, k in zip(own.tolist(), best.tolist(), strict=True):
        values = []
        for c in range(4):
            moved = of.copy()
            moved[w] = c
            values.append(likelihood(moved))
        # a class that the word enters or leaves counts twice where it holds neighbours of the word, so moves are compared up to that
        assert values[k] >= max(values) - 3.0


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    of = np.repeat([0, 1, 2], 10)
    flow = np.array([[0, 50, 1], [1, 0, 50], [50, 1, 0]])
    counts = rng.poisson(flow[of][:, of]).astype(float)
    got = class_lm.exchange_clusters(counts, 30, 3, 10)
    assert all(len(set(got[of == c])) == 1 for c in range(3)) and len(set(got)) == 3


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[100:180] = x[100]
    data = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None]), (905, [1.0, 2.0]), (910, [2.0, 1.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    got = neighbours.nearest(vectors, vectors.where("vec_id % 5 = 0"), 10, shard=300)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 5):
        s = x @ x[q]
        best = [k for k in np.lexsort((np.arange(900), -s)) if k != q][:10]
        assert len(found[q]) == 10 and all(math.isclose(v, s[k], rel_tol=1e-12) for k, v in found[q])
        hits += len({k for k, _ in found[q]} & set(best))
    assert hits >= 0.95 * 1800
    assert found[905] == [(910, 4.0)] and found[910] == [(905, 4.0)] and not {900, 901, 902, 903, 904} & set(found)
    assert neighbours.nearest(vectors.where("false"), vectors, 3).collect() == []


@pytest.mark.parametrize("kind", ["one 1e4 times as long", "one 1e8 times as long", "mixed norms", "large components", "small components"])
def test_neighbours_of_any_norm(spark, kind):
    """Recall of at least 0.9 in shards with graphs, whatever the norms beside."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 32))
    if kind.startswith("one"):
        x[7] *= float(kind.split()[1])
    elif kind == "mixed norms":
        x *= 10.0 ** rng.integers(-3, 4, size=(4000, 1))
    else:
        x *= 1e30 if kind == "large components" else 1e-160
    vectors = spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(vectors, vectors.where("vec_id % 40 = 0"), 20, shard=1500)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert math.isclose(r["score"], float(x[r["query_id"]] @ x[r["vec_id"]]), rel_tol=1e-9)
    hits = 0
    for q in range(0, 4000, 40):
        y = x / np.abs(x).max()
        best = [k for k in np.argsort(-(y @ (x[q] / np.abs(x[q]).max()))) if k != q][:20]
        hits += len(found[q] & set(best))
    assert hits >= 0.9 * 100 * 20


def test_neighbours_tied_across_shards(spark):
    """Equal scores go by the smaller id, in whichever shards and bands they are."""
    one, two = [1.0, 0.0, 0.0], [1.0, 0.0, 5.0]  # equal products with the query, norms far apart
    data = [(0, [2.0, 0.0, 0.0])] + [(k, two if k % 3 else one) for k in range(1, 400)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("dims", F.lit("clash"))
    for shard in (40, 100_000):
        got = neighbours.nearest(vectors, vectors.where("vec_id = 0"), 20, shard=shard).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in got] == [(k, 2.0) for k in range(1, 21)]

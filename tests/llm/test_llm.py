"""The training-data operators against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import licences, lines, near, packing, pieces, quality, queries, scoring, sharding, suffixes, vectors
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, row int, spans string, rank long, z string, d int, n int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "to", "mi", "ré", "sun", "po"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, equal texts, white space, markup, wide characters; columns with clashing names."""
    long = prose(1, 30_000)
    shared = prose(2, 60)
    texts = [None, "", " \n\t ", "a", "one two", "x" * 3000, "aaaa " * 700, long, shared, shared, f"{prose(3, 40)}\n{shared}\n{prose(4, 30)}", f"{prose(5, 40)} {shared}", "日本語 text é́ 🙂 " * 40, "<|endoftext|> b", prose(6, 25), "\x00nul \x00 bytes", "line\n" * 50]
    rows = [(k, t, None, 1, "s", 2, "z", 3, 4) for k, t in enumerate(texts)]
    rows += [rows[7], rows[8], (None, shared, "en", 1, "s", 2, "z", 3, 4), (None, None, "en", 1, "s", 2, "z", 3, 4)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# 1


def test_license_oracle(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    mine = sorted(map(tuple, licences.op1_license_scan(spark, DATA).select("doc_id", "digest", "licence", "notices").collect()), key=key)
    theirs = sorted(connection.execute(f"SELECT doc_id, digest, licence, notices FROM ({licences.ORACLE})").fetchall(), key=key)
    assert mine == theirs


def test_license_oracle_on_whole_texts(spark, tmp_path):
    rows = [(k, t.upper() if k % 2 else f"Copyright (c) 2001 A\n{t}") for k, (_, t) in enumerate(licences.KNOWN)]
    rows += [(100, " ".join(licences.KNOWN[1][1].split())), (101, f"x\n{' '.join(licences.KNOWN[1][1].split())}\ny"), (102, "Licensed under CC BY 4.0." * 2), (103, ""), (104, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = sorted(map(str, (tuple(r) for r in licences.op1_license_scan(spark, str(tmp_path)).select("doc_id", "digest", "licence", "notices").collect())))
    theirs = sorted(map(str, connection.execute(f"SELECT doc_id, digest, licence, notices FROM ({licences.ORACLE})").fetchall()))
    assert mine == theirs and sum("None" not in m for m in mine) >= len(licences.KNOWN)
    own = spark.createDataFrame([("mine", "All of this is mine.")], "licence string, text string")
    out = licences.scan(spark.createDataFrame([(1, "all of this is MINE"), (2, "x\nAll of this is mine\ny")], "doc_id long, text string"), own).collect()
    assert {(r["doc_id"], r["licence"], r["notices"]) for r in out} == {(1, "mine", "mine"), (2, None, "mine")}
    assert {r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), own.where("false")).collect()} == {None}


def test_license_variants(spark, odd, empty):
    mit = licences.KNOWN[0][1]
    other = mit.upper().replace("<YEAR> <HOLDERS>", "1999 Someone Else").replace("LICENSE", "Licence").replace(",", " ,").replace("\n", "\r\n")
    rows = [(1, mit), (2, other), (3, mit + " extra"), (4, f"{prose(1, 30)}\nReleased under the MIT Licence!\n{prose(2, 9)}"), (5, None), (6, "")]
    out = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["licence"] == out[2]["licence"] == "MIT" and out[3]["licence"] is None
    assert out[4]["notices"] == "MIT" and out[5]["digest"] is None and out[6]["licence"] is None
    assert licences.scan(odd).count() == odd.count() and licences.scan(empty).count() == 0


# 2


def plain_scores(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = lambda t: [*WORD.findall((t or "").translate(lower)), None]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    counts = Counter()
    for d, t in rows:
        if fold(d) != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(d, fold(d) == 2, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t in rows]


def test_scores(documents, odd, empty):
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        key = lambda r: (str(r[0]), r[2], r[5])
        got = sorted(map(tuple, scoring.score(docs).collect()), key=key)
        want = sorted(plain_scores(rows), key=key)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9), (g, w)
            assert math.isfinite(g[6]) and g[6] <= 0
    held = [r for r in scoring.score(documents).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than the baseline on texts it has not seen
    assert scoring.score(empty).count() == 0


def test_scores_against_exact_interpolation(documents):
    """The model's own column, against one without buckets of n-grams, batches or bins."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(lower)), None]) for r in documents.select("doc_id", "text").collect()]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7

    def counted(some):
        one, two = Counter(), Counter()
        for d, t in rows:
            if some(fold(d)):
                one.update([*t, "<start>"])
                two.update(zip(["<start>", *t], t, strict=False))
        n = sum(v for k, v in one.items() if k != "<start>")
        return one, two, n, len(one) - ("<start>" in one)

    one, two, n, v = counted(lambda f: f not in (2, 3))
    held = [(a, b) for d, t in rows if fold(d) == 3 for a, b in zip(["<start>", *t], t, strict=False)]
    single = scoring.mixture(np.array([one[b] / n * (v + 1) for _, b in held]), np.ones(len(held)), 2000)
    by = defaultdict(list)
    for a, b in held:
        if one[a]:
            by[one[a].bit_length() - 1].append(two[a, b] / one[a] / (single * one[b] / n + (1 - single) / (v + 1)))
    weights = {f: scoring.mixture(np.array(x), np.ones(len(x)), 2000) for f, x in by.items()}
    one, two, n, v = counted(lambda f: f != 2)
    got = {r["doc_id"]: r["score"] for r in scoring.score(documents).collect()}
    for d, t in rows:
        want = 0.0
        for a, b in zip(["<start>", *t], t, strict=False):
            low = single * one[b] / n + (1 - single) / (v + 1)
            w = weights.get(one[a].bit_length() - 1, 0.0) if one[a] else 0.0
            want += math.log10(w * two[a, b] / max(one[a], 1) + (1 - w) * low)
        assert math.isclose(got[d], want, rel_tol=4e-3), (d, got[d], want)


def test_mixture():
    n = np.array([100.0, 900.0])
    best = max(np.linspace(0.001, 0.999, 999), key=lambda w: float((n * np.log(w * np.array([5.0, 0.2]) + 1 - w)).sum()))
    assert abs(scoring.mixture(np.array([5.0, 0.2]), n, 5000) - best) < 2e-3


# 3


def plain_classes(rows):
    doc, key, count, _ = near.shingles(pa.array([t or "" for _, t in rows], pa.large_string()))
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(key[a:b], near.weights(count[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = WORD.findall(rows[i][1] or "") == WORD.findall(rows[j][1] or "")
            if same or len(sets[i][0]) and near.similarity(sets[i], sets[j]) >= near.THRESHOLD:
                a, b = top(rows[i][0]), top(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {d: top(d) for d, _ in rows}


def test_classes(spark, documents, odd, empty):
    base = [prose(50 + k, 90).split() for k in range(3)]
    chain = []
    r = random.Random(5)
    for k in range(60):  # copies with a few words changed, more and more
        words = list(base[k % 3])
        for _ in range(k // 12):
            words[r.randrange(90)] = f"w{r.random()}"
        chain.append((1000 + k, " ".join(words)))
    rows = [(x["doc_id"], x["text"]) for x in documents.select("doc_id", "text").collect()] + chain
    got = {x["doc_id"]: x["class_id"] for x in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)
    out = near.classes(odd).collect()
    assert len(out) == odd.count() and all((x["class_id"] is None) == (x["doc_id"] is None) for x in out)
    assert {x["class_id"] for x in out if x["doc_id"] in (8, 9)} == {8} and {x["class_id"] for x in out if x["doc_id"] in (0, 1, 2)} == {0}
    kept = near.keep(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted({x["class_id"] for x in out} - {None})
    assert near.classes(empty).count() == 0 and near.keep(empty).count() == 0


def near_members(spark, texts):
    """Texts as nodes of their own components."""
    doc, key, count, _ = near.shingles(pa.array(texts, pa.large_string()))
    sig = near.signatures(doc, key, near.weights(count), len(texts))
    press = zstandard.ZstdCompressor()
    rows = [(k, k, sig[k].astype("<u2").tobytes(), press.compress(t.encode())) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "node long, root long, sig binary, z binary").repartition(4)


def tops(n, pairs):
    """The least member of each one's component."""
    top = list(range(n))
    for a, b in pairs:
        x, y = sorted((top[a], top[b]))
        top = [x if t == y else t for t in top]
    return top


@pytest.mark.parametrize("m", [200, 800])
def test_templates_bring_no_pairs(spark, m):
    """Pages of one template with other words each: no two meet, however many there are."""
    rng = np.random.default_rng(5)
    template = " ".join(f"t{k}" for k in range(100))
    texts = [f"{template} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(m)]
    members = near_members(spark, texts)
    early = near.prefixes(members)
    assert early.groupBy("element").count().where("count > 1").count() == 0
    assert near.candidates(members, floor=0.0).count() == 0


def test_templates_of_most_of_a_text_bring_no_pairs(spark):
    """A template of 85 % of each text: two such texts are 0.74 alike, which the shares alone rule out."""
    rng = np.random.default_rng(5)
    template = " ".join(f"t{k}" for k in range(200))
    members = near_members(spark, [f"{template} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 34)) for _ in range(100)])
    assert near.prefixes(members).count() > 0
    assert near.candidates(members, floor=0.0).count() == 0


def test_families_under_the_threshold_bring_few_pairs(spark):
    """Copies of one text with edits of their own: nearly all are 0.65 to 0.75 alike, and each at the threshold is met."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(120):
        words = [f"b{k}" for k in range(150)]
        for at in rng.integers(0, 150, rng.integers(3, 6)):
            words[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    members = near_members(spark, texts)
    sets = [(np.sort(k), w) for k, w in near._sets([r["z"] for r in members.orderBy("node").collect()])]
    sims = {(i, j): near.similarity(sets[i], sets[j]) for j in range(len(texts)) for i in range(j)}
    found = {(r["a"], r["b"]) for r in near.candidates(members).collect()}
    assert {p for p, s in sims.items() if s >= near.THRESHOLD} <= found
    assert len(found) < 0.4 * len(sims) < sum(s > 0.6 for s in sims.values())
    links = {(min(r), max(r)) for r in near.between(members.select("node", "root"), members.select("node", "z")).collect()}
    assert tops(len(texts), links) == tops(len(texts), [p for p, s in sims.items() if s >= near.THRESHOLD])


@pytest.mark.parametrize("first", [1, 16])
def test_links_between_components(spark, monkeypatch, first):
    """All links that join components are found: chains of edits, repeated parts, templates, blocks of a group."""
    monkeypatch.setattr(near, "FIRST", first)
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = np.random.default_rng(6)
    texts = []
    for family in range(4):
        words = [f"f{family}w{k}" for k in range(80)]
        for step in range(15):
            words = list(words)
            for at in rng.integers(0, 80, 1 + step % 3):
                words[at] = f"x{rng.integers(0, 50)}"
            texts.append(" ".join([f"t{k}" for k in range(60)] + words + words[: 10 * (step % 4)]))
    texts += ["a b c", "a b c d", " ".join(["a b c d e"] * 9), " ".join(["a b c d e"] * 10)]
    members = near_members(spark, texts)
    sets = [(np.sort(k), w) for k, w in near._sets([r["z"] for r in members.orderBy("node").collect()])]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if near.similarity(sets[i], sets[j]) >= near.THRESHOLD]
    found = near.between(members.select("node", "root"), members.select("node", "sig", "z"), floor=0.0).collect()
    pairs = {(max(r["a"], r["b"]), min(r["a"], r["b"])) for r in found}
    assert pairs <= set(want)
    assert tops(len(texts), pairs) == tops(len(texts), want)
    assert 4 < len(set(tops(len(texts), want))) < len(texts)


def test_signatures_estimate():
    r = np.random.default_rng(0)
    keys = np.sort(r.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = (keys[:320], np.where(np.arange(320) % 3, 1.0, 2.0)), (keys[60:], np.ones(340))
    want = near.similarity(a, b)
    plain = {int(k): [w, 0.0] for k, w in zip(*a, strict=True)}
    for k, w in zip(*b, strict=True):
        plain.setdefault(int(k), [0.0, 0.0])[1] = w
    v = np.array(list(plain.values()))
    assert math.isclose(want, sum(1 / np.maximum(v[:, 0] / x, v[:, 1] / y).sum() for x, y in v if x and y), rel_tol=1e-9)
    doc = np.repeat([0, 1], [320, 340])
    s = near.signatures(doc, np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), 2, 4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


# 4


def test_search(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = table.collect()
    ids = np.array([x["vec_id"] for x in rows])
    x = np.array([x["embedding"] for x in rows], np.float64)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = defaultdict(list)
    for r in vectors.search(table, rerank=100).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        found = sorted(got[int(ids[i])])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(math.isclose(f[2], s[np.flatnonzero(ids == f[1])[0]], rel_tol=1e-9) for f in found)
        hit, total = hit + len(best & {f[1] for f in found}), total + 5
    assert hit / total >= 0.9


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [0.0, 2.0]), (50, [1.0, 1.0])]
    got = [tuple(r) for r in vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 9), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 9)]
    assert vectors.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vectors.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# 5


def test_pieces_round_trip(documents, odd, empty):
    for docs in (documents, odd):
        encoded = pieces.encode(docs)
        back = sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(encoded).collect())
        assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert pieces.encode(empty).count() == 0
    one, two = ({r["doc_id"]: r["ids"] for r in pieces.encode(d).collect()} for d in (documents, documents.repartition(7)))
    assert one == two
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(documents, seed=1).collect()}
    assert other != one


def test_words_with_alike_polynomials():
    from tokenizers import Tokenizer

    for a, b in (("a", "b"), ("1", "7"), ("V", "]")):
        words = pa.array([thue_morse(2048, a, b), thue_morse(2048, b, a)])
        lattice = pieces.Lattice(pieces.model_path())
        ids, ends = pieces.encode_batch(lattice, [1, 2], words)
        assert [lattice.decode(ids[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)] == words.to_pylist()
        plain = Tokenizer.from_file(packing.tokenizer_path())
        ids, ends = packing.WordTokenizer(packing.tokenizer_path())(words)
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)] == [plain.encode(w, add_special_tokens=False).ids for w in words.to_pylist()]


def test_one_long_word():
    text = "".join(random.Random(8).choice("abcé日") for _ in range(60_000))
    lattice = pieces.Lattice(pieces.model_path())
    ids, ends = pieces.encode_batch(lattice, [5], pa.array([text]))
    assert lattice.decode(ids.tolist()) == text and ends.tolist() == [0, len(ids)]


def test_pieces_follow_the_weights():
    lattice = pieces.Lattice(pieces.model_path())
    net = lattice.words([b" sunto"])
    n = 20_000
    ids, ends = lattice.sample(net, np.zeros(n, np.int64), np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True))
    data = np.frombuffer(b" sunto", np.uint8)
    edges = defaultdict(list)
    for a, b, p, w in zip(*lattice.edges(data, np.full(6, 6)), strict=True):
        edges[int(a)].append((int(b), int(p), float(w)))
    paths = {}

    def walk(at, path, w):
        if at == 6:
            paths[tuple(path)] = w
        for b, p, x in edges[at]:
            walk(b, [*path, p], w + x)

    walk(0, [], 0.0)
    total = sum(math.exp(w) for w in paths.values())
    for path, w in paths.items():
        p = math.exp(w) / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


# 6


def plain_rules(text):
    words = WORD.findall(text or "")
    repeated = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if repeated[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    with_word = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(with_word) - len(set(with_word)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_rules(documents, labels, odd, empty):
    model = quality.fit(documents, labels)
    for docs in (documents, odd):
        want = sorted((str(r["doc_id"]), *plain_rules(r["text"])) for r in docs.select("doc_id", "text").collect())
        out = quality.score(docs, model).collect()
        assert sorted((str(r["doc_id"]), *r[1:7]) for r in out) == want
        assert not any(r["kept"] and r["base_failed"] for r in out)
    assert quality.score(empty, model).count() == 0 and quality.fit(empty, labels) is None
    assert quality.keep(odd, None).columns == odd.columns
    assert {r["kept"] for r in quality.score(documents, None).where("not base_failed").collect()} == {True}


def test_classifier_on_unseen_labels(spark):
    docs, known = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    model = quality.fit(docs, known.where("doc_id % 3 <> 0"))
    out = quality.score(docs, model).join(known.where("doc_id % 3 = 0"), "doc_id").where("not base_failed")
    right = out.agg(F.avg(((F.col("probability") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


# 7


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.choice([7, 16, 50])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fit = [k for k, room in enumerate(rooms) if room >= x]
            k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
            if not fit:
                rooms.append(capacity)
            rooms[k] -= x
        runs = packing.best_fit_decreasing(Counter(lengths), capacity)
        bins = defaultdict(list)
        for length, _, count, first, offset in runs:
            for b in range(count):
                bins[first + b].append((offset, length))
        assert len(bins) == len(rooms) and sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity


def test_pack(documents, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    for docs in (documents, odd):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(str(r["doc_id"]), k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        out = packing.pack(docs).collect()
        assert sorted((str(r["doc_id"]), *r[1:5]) for r in out) == sorted(want)
        rows = defaultdict(list)
        for r in out:
            rows[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in rows.values():
            ends = np.cumsum([0, *[n for _, n in sorted(s)]])
            assert [o for o, _ in sorted(s)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert packing.pack(empty).count() == 0


def test_pack_is_as_tight_as_plain_best_fit(documents):
    out = packing.pack(documents, capacity=512)
    lengths = sorted((r["length"] for r in out.select("length").collect()), reverse=True)
    rooms: list[int] = []
    for x in lengths:
        fit = [k for k, room in enumerate(rooms) if room >= x]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        if not fit:
            rooms.append(512)
        rooms[k] -= x
    assert out.select("sequence_id").distinct().count() == len(rooms)


def test_pack_ties(spark):
    rows = [(7, "one two three")] * 5 + [(8, "one two three")] * 3
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=16).collect()
    places = {(r["sequence_id"], r["offset"]) for r in out}
    assert len(places) == len(out) == 8


# 8


def plain_removals(rows, window=suffixes.WINDOW):
    found = Counter()
    for _, t in rows:
        b = (t or "").encode()
        found.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if found[b[i : i + window]] > 1:
                gone[i : i + window] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit", [suffixes.LIMIT, 2])
def test_repeats(spark, odd, documents, tmp_path, limit):
    r = random.Random(9)
    passage = prose(70, 120)
    rows = [(k, f"{prose(300 + k, 30)}{passage[r.randrange(60) : len(passage) - r.randrange(300)]}{prose(600 + k, 20)}") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    for docs in (spark.read.parquet(f"{tmp_path}/d"), odd, documents):
        pairs = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
        got = suffixes.dedup(docs, limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted((str(g[0]), *g[1:]) for g in got) == plain_removals(pairs)


def test_repeats_keep_characters(odd, empty):
    left = suffixes.texts(odd)
    texts = [r["text"] for r in left.collect()]
    assert left.columns == odd.columns and len(texts) == odd.count() and not any("�" in (t or "") for t in texts)
    assert sum(t is None for t in texts) == odd.where("text is null").count()
    assert sorted(map(str, left.drop("text").collect())) == sorted(map(str, odd.drop("text").collect()))
    assert suffixes.dedup(empty).count() == 0 and suffixes.texts(empty).count() == 0
    named = odd.select("doc_id", "text", *[F.lit("own").alias(c) for c in ("kept", "doc", "own", "key", "places", "bits", "n_bytes", "a.b")])
    assert suffixes.texts(named).columns == named.columns and {r["kept"] for r in suffixes.texts(named).collect()} == {"own"}
    assert suffixes.dedup(named).where("n_bytes > 0").count() > 0


def thue_morse(n: int, a: str, b: str) -> str:
    """Its polynomial hash modulo 2**64, of any odd base, is that of the text with ``a`` and ``b`` swapped."""
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("limit", [suffixes.LIMIT, 1])
def test_repeats_with_alike_polynomials(spark, limit):
    head, tail = prose(31, 90)[:240], prose(32, 20)[:32]
    rows = []
    for k, (a, b) in enumerate([("V", "]"), ("]", "V")]):
        rows += [(k, head + thue_morse(128, a, b) + tail + prose(40 + k, 50)), (k + 10, thue_morse(2048, a, b))]
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((str(g[0]), *g[1:]) for g in got) == plain_removals(rows)


def test_repeats_in_long_texts(spark):
    """Texts that are cut into several slices, with passages across the cuts."""
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(2 * suffixes.SLICE + 5000))
    passage = long[suffixes.SLICE // 2 - 150 : suffixes.SLICE // 2 + 250]
    rows = [(1, long), (2, f"x{passage}y"), (3, long[-300:])]
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (700, 2), 2: (400, 1), 3: (300, 1)}


def test_suffix_arrays():
    r = random.Random(4)
    for _ in range(500):
        x = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


# 9


def test_reshard(documents, odd, empty, tmp_path):
    for docs, old in ((documents, F.col("doc_id") % 7), (odd, F.when(F.col("doc_id") > 3, F.col("doc_id") % 5))):
        moves = sharding.reshard(docs.withColumn("old_shard", old.cast("int")), 5)
        out = moves.collect()
        assert len(out) == docs.count()
        counts = Counter(r["shard"] for r in out)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(5)) <= 1
        for s in range(5):
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.reshard(empty.withColumn("old_shard", F.lit(0)), 5).count() == 0


def test_reshard_moves_fewest_bytes(documents):
    old = lambda d: d * d % 11 % 7  # noqa: E731  uneven shards, two of which go
    moves = sharding.reshard(documents.withColumn("old_shard", (F.col("doc_id") * F.col("doc_id") % 11 % 7).cast("int")), 5).collect()
    sizes = defaultdict(list)
    for r in moves:
        assert r["old_shard"] == old(r["doc_id"])
        sizes[r["old_shard"]].append(r["size"])
    least, odd = divmod(len(moves), 5)
    # plain: shards that go send all; each other one its smallest rows beyond its quota; odd rows stay where they save most
    cost = {s: [sum(sorted(v)[: max(0, len(v) - least - extra)]) if s < 5 else sum(v) for extra in (0, 1)] for s, v in sizes.items()}
    saves = sorted((a - b for s, (a, b) in cost.items() if s < 5), reverse=True)
    assert sum(r["size"] for r in moves if r["shard"] != r["old_shard"]) == sum(a for a, _ in cost.values()) - sum(saves[:odd])


def test_rewrite(spark, tmp_path):
    rows = [(k, f"t{k}", k % 5, "s", 7) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old_shard int, shard string, slot int")
    first = docs.select("*", F.col("old_shard").alias("new_shard"), F.lit(0).alias("new_slot"))
    first.write.partitionBy("new_shard").parquet(f"{tmp_path}/out")
    untouched = {p.name for p in (tmp_path / "out").iterdir()}
    assert len(untouched) >= 5
    changed = sharding.rewrite(docs, sharding.reshard(docs, 3), f"{tmp_path}/out").collect()
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["doc_id"] for r in back) == list(range(20)) and {r["new_shard"] for r in back} == {0, 1, 2}
    assert {(r["shard"], r["slot"]) for r in back} == {("s", 7)} and sum(r["rows"] for r in changed) == 20
    now = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "text", "shard", "slot", F.col("new_shard").alias("old_shard"))
    assert sharding.rewrite(now, sharding.reshard(now, 3), f"{tmp_path}/other").count() == 0


def test_rewrite_keeps_repeated_rows(spark, tmp_path):
    rows = [(k, f"t{k}", k % 5, k) for k in range(8)] + [(1, "t1", 1, 8), (1, "t1", 3, 9), (1, "other", 2, 10), (None, "n", 0, 11), (None, "n", 4, 12), (None, None, 4, 13), (-1, "n", 2, 14), (2, None, None, 15), (2, "", 3, 16), (3, "t3", 3, 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old_shard int, row int")
    docs.where("old_shard is not null").withColumn("new_shard", F.col("old_shard")).withColumn("new_slot", F.lit(0)).write.partitionBy("new_shard").parquet(f"{tmp_path}/out")
    moves = sharding.reshard(docs, 3)
    sharding.rewrite(docs, moves, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["row"] for r in back) == list(range(18)) and all((r["doc_id"], r["text"]) == rows[r["row"]][:2] for r in back)
    assert sorted((r["new_shard"], r["new_slot"]) for r in back) == sorted((r["shard"], r["slot"]) for r in moves.collect())


def test_flow_moves_least():
    r = random.Random(3)
    for _ in range(30):
        blocks = [(s, k, r.randint(1, 4), 0) for s in range(3) for k in range(2)]
        blocks = [(s, k, n, n * (10 + 40 * k)) for s, k, n, _ in blocks]
        plan = sharding.plan(blocks, 4)
        rows = sum(b[2] for b in blocks)
        into = Counter()
        for s, k, t, n in plan:
            into[t] += n
        assert sum(into.values()) == rows and max(into.values()) - min(into[t] for t in range(4)) <= 1
        moved = sum(n * (10 + 40 * k) for s, k, t, n in plan if s != t)
        # plain: each old shard sends its cheapest rows beyond its quota, with the odd rows where they save most
        least, odd_rows = divmod(rows, 4)
        costs = []
        for s in range(3):
            own = sorted(10 + 40 * k for b, k, n, _ in blocks if b == s for _ in range(n))
            costs.append([sum(own[: max(0, len(own) - least - extra)]) for extra in (0, 1)])
        saves = sorted((a - b for a, b in costs), reverse=True)
        assert moved == sum(a for a, _ in costs) - sum(saves[:odd_rows])


# 10


def test_lines(spark, odd, empty):
    block = "\n".join(prose(800 + k, 8) for k in range(4))
    rows = [(1, f"{prose(1, 9)}\n{block}\n{prose(2, 9)}"), (2, f"{prose(3, 9)}\n{block}\n{prose(4, 9)}"), (3, f"{prose(5, 9)}\nshort\n{prose(6, 9)}"), (4, f"{prose(7, 9)}\nshort\n{prose(8, 9)}"), (5, None), (6, "")]
    out = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == f"{prose(3, 9)}\n{prose(4, 9)}" and out[2]["n_removed"] == 4
    assert out[3]["text"] == rows[2][1] and out[4]["n_removed"] == 0 and out[5]["text"] is None and out[6]["text"] == ""
    assert lines.dedup(odd).count() == odd.count() and lines.dedup(empty).count() == 0
    reordered = lines.patience([1, 2, 3, 4, 5], [4, 5, 1, 2, 3])
    assert reordered == [(0, 2), (1, 3), (2, 4)]


def test_lines_held_by_many(spark):
    one = prose(50, 30)
    rows = [(k, one) for k in range(150)]  # copies without a newline
    hot = prose(51, 60)
    rows += [(k, f"{prose(1000 + k, 9)}\n{hot}\n{prose(3000 + k, 9)}") for k in range(200, 500)]
    out = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(150) if out[k]["text"]] == [0]
    assert [k for k in range(200, 500) if hot in out[k]["text"]] == [200]
    assert all(out[k]["n_removed"] == 1 and out[k]["n_lines"] == 3 for k in range(201, 500))


def test_lines_of_large_groups(spark):
    text = "\n".join(prose(900 + k, 8) for k in range(5))
    rows = [(k, f"{prose(2000 + k, 6)}\n{text}") for k in range(200)]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["text"] == (rows[0][1] if r["doc_id"] == 0 else prose(2000 + r["doc_id"], 6)) for r in out)


def lines_of_all_pairs(rows):
    """Lines that any earlier document deletes, by aligning all pairs."""
    code, held = {}, {k: t.split("\n") for k, t in rows if k is not None and t}
    coded = {k: [code.setdefault(x, len(code)) for x in v] for k, v in held.items()}
    gone = defaultdict(set)
    by_line = defaultdict(list)
    for k in sorted(held):
        for other in {o for x in set(coded[k]) for o in by_line[x]}:
            for s, e in lines.blocks(coded[other], coded[k], [len(x) for x in held[k]]):
                gone[k] |= set(range(s, e))
        for x in set(coded[k]):
            by_line[x].append(k)
    return {k: "\n".join(x for i, x in enumerate(v) if i not in gone[k]) for k, v in held.items()}


def test_lines_against_all_pairs(spark):
    verse = "\n".join(f"v{k} w" for k in range(30))  # no two neighbours have 20 characters
    a, b, c, d = (prose(700 + k, 8) for k in range(4))
    rows = [(1, verse), (2, verse), (3, f"{prose(60, 9)}\n{verse}"), (10, f"{a}\n{b}\n{c}\n{d}"), (11, f"{prose(61, 9)}\n{a}"), (12, f"{b}\n{c}\n{d}\n{a}")]
    r = random.Random(5)
    pool = [prose(40 + k, 7) for k in range(12)] + ["", "x", "short line", "a longer line"] * 2
    rows += [(100 + k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for k in range(60)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2] == "" and out[3] == prose(60, 9) and out[12] == ""
    full = lines_of_all_pairs(rows)
    assert {k: t for k, t in out.items() if k in full} == full


@pytest.mark.parametrize(("m", "friends"), [(120, False), (400, False), (120, True)])
def test_lines_that_change_places(spark, monkeypatch, m, friends):
    """Header and footer change places halfway: few pairs a document, and the result of all pairs."""
    head, foot = prose(91, 8), prose(92, 8)
    rows = []
    for k in range(m):
        own = [prose(5000 + 2 * k, 7), prose(6000 + k // 2, 7) if friends else prose(5001 + 2 * k, 7)]  # a friend shares a line
        a, b = (head, foot) if k < m // 2 else (foot, head)
        rows.append((k, "\n".join([own[0], a, own[1], b])))
    met, plain = [], lines.aligned
    monkeypatch.setattr(lines, "aligned", lambda pairs, one, least: (met.append(pairs.count()), plain(pairs, one, least))[1])
    out = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == lines_of_all_pairs(rows) and sum(met) <= 4 * m


def test_few_lines_that_are_left_take_few_rounds(spark, monkeypatch):
    """A line that stands in a crossing place of all earlier outlines is tried against them in few rounds."""
    line, block = "this one line stands before or behind", "\n".join(f"line {k} of a block that all documents hold" for k in range(4))
    rows = [(k, f"{line}\n{block}\nthe line number {k // 2} of two friends, {k // 2}") for k in range(400)]
    rows.append((400, f"{block}\n{line}"))
    met, plain = [], lines.aligned
    monkeypatch.setattr(lines, "aligned", lambda pairs, one, least: (met.append(pairs.count()), plain(pairs, one, least))[1])
    out = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out[400] == line and len(met) <= 3 and sum(met) <= 1100


def test_op10_against_all_pairs(spark, documents):
    out = {r["doc_id"]: r["text"] for r in queries.QUERIES["op10_line_dedup"](spark, DATA).collect()}
    full = lines_of_all_pairs([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    assert {k: t for k, t in out.items() if k in full} == full and len(out) == documents.count()


def test_one_id_with_two_texts(spark):
    """Documents are told apart by their texts where a doc_id repeats."""
    a, b, c = (prose(4000 + k, 60) for k in range(3))
    rows = [(1, a), (5, f"{a}\n{b}"), (5, c), (5, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"], r["text"]) for r in lines.dedup(df).collect()), key=str)
    assert out == sorted([(1, a), (5, b), (5, c), (5, c), (9, "")], key=str)
    pair = [(5, a), (5, b), (3, a), (9, b), (9, b)]
    kept = sorted((r["doc_id"], r["text"]) for r in near.keep(spark.createDataFrame(pair, "doc_id long, text string")).collect())
    assert kept == sorted([(3, a), (5, b)])


def test_line_stage_against_all_pairs(spark, documents):
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, documents, DATA).select("doc_id", "text").collect()}
    full = lines_of_all_pairs([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    assert {k: t for k, t in out.items() if k in full} == full


# The pipeline


def test_pipeline(spark, documents):
    docs = documents
    names = documents.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "suffix_dedup", "best_fit_packing"]
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == names and docs.dtypes == documents.dtypes, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before
        before = now
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == before


def test_stages_on_odd_input(spark, odd, empty):
    named = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("n_lines", "n_removed", "kept", "own", "doc", "t", "root", "class_id", "node", "n_bytes", "a.b"))])
    for docs in (named, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name == "best_fit_packing":
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
                continue
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            rows, before = out.drop("text").collect(), Counter(map(str, docs.drop("text").collect()))
            assert not Counter(map(str, rows)) - before, name
            if name in ("line_dedup", "suffix_dedup"):
                assert len(rows) == docs.count()


def test_all_ten_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))

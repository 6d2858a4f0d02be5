"""Vector codes, URL filters and whitening against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import common, compression, urls, whitening
from tests.conftest import DATA

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, x int, code int, part int, n int, q int, c int, word int, host int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, non-finite, zero, large and negative vectors, another length, ties, repeated rows and ids, clashing names."""
    random = np.random.default_rng(3)
    rows = [(int(k), [float(v) for v in random.normal(size=6)], int(k) % 3) for k in random.permutation(90)]
    rows += [(90, None, 0), (91, [], 1), (92, [0.0] * 6, None), (93, [-0.0] * 6, None), (94, [NAN] * 6, 1), (95, [INF] + [0.0] * 5, 1), (96, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (97, [1.0] * 7, 2), (98, [900.0] * 6, 2), (99, [-900.0] * 6, None)]
    rows += [(None, [0.5] * 6, 1), (5, [0.5] * 6, 1), rows[3], rows[3]]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], SCHEMA).repartition(5)


def kept(df, scale):
    """(vec_id, label, integer vector) of the rows that take part, in order of ids."""
    out = []
    for r in df.collect():
        v = r["embedding"]
        if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v):
            out.append((r["vec_id"], r["label"], [math.floor(scale * float(c)) for c in v]))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


# 11


def plain_codes(rows, parts, entries, rounds):
    width = len(rows[0][2]) // parts
    books, codes, errors = [], [""] * len(rows), [0] * len(rows)
    for p in range(parts):
        x = [r[2][p * width : (p + 1) * width] for r in rows]
        book = [list(v) for v in x[:entries]]
        for k in range(rounds + 1):
            far = [[sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book] for v in x]
            at = [f.index(min(f)) for f in far]
            if k < rounds:
                for e in range(len(book)):
                    if own := [v for v, a in zip(x, at, strict=True) if a == e]:
                        book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books.append(book)
        codes = [c + f"{a:02x}" for c, a in zip(codes, at, strict=True)]
        errors = [e + min(f) for e, f in zip(errors, far, strict=True)]
    flat = ",".join(str(c) for b in books for e in b for c in e)
    labels = Counter()
    for r, e in zip(rows, errors, strict=True):
        labels[r[1]] += e
    return sorted((str(r[0]), str(r[1]), c, e, labels[r[1]], hashlib.sha256(flat.encode()).hexdigest()) for r, c, e in zip(rows, codes, errors, strict=True))


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(2, 7, 5), (3, 256, 2), (1, 1, 1), (6, 20, 8)])
def test_codes_are_those_of_plain_rounds(odd, parts, entries, rounds):
    found = compression.compressed(odd, parts=parts, entries=entries, rounds=rounds).collect()
    mine = sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found)
    assert mine == plain_codes(kept(odd, 1024), parts, entries, rounds)


def test_codes_by_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    mine = sorted(map(tuple, compression.op11_heap_lloyd(spark, DATA).collect()))
    assert mine == sorted(connection.execute(compression.ORACLE).fetchall())


def test_codes_pad_and_do_not_depend_on_layout(spark):
    random = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, [float(v) for v in random.integers(-3, 3, 5)], 0) for k in range(400)], "vec_id long, embedding array<double>, label int")
    tables = [sorted(map(tuple, compression.compressed(rows.repartition(n), parts=2, entries=30, rounds=3).collect())) for n in (1, 7)]
    assert tables[0] == tables[1] and len(tables[0]) == 400


def test_codes_of_few_vectors(spark, odd):
    assert compression.compressed(odd.limit(0)).collect() == []
    assert compression.compressed(odd.where("vec_id in (90, 91)")).collect() == []
    one = compression.compressed(odd.where("vec_id = 92"), parts=2).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("0000", 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        compression.compressed(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_rounds_pop_few_parts():
    """Late rounds rescan a small share of parts, and drift pops just those whose keys it has reached."""
    random = np.random.default_rng(1)
    centres = random.integers(-900, 900, (20, 8))
    x = (centres[random.integers(0, 20, 3000)] + random.integers(-60, 60, (3000, 8))).astype(np.int64)
    now = compression.Round(x[None, :20].copy(), np.zeros((1, 20)))
    keys, place, starts, _ = now.first(x, 0)
    popped = []
    for _ in range(12):
        entry = np.repeat(np.arange(20), np.diff(starts))
        book = np.stack([x[place[entry == e]].sum(0) // max((entry == e).sum(), 1) if (entry == e).any() else now.books[0, e] for e in range(20)])
        now = now.moved(book[None])
        out = compression.violated(keys, starts, now.drift[0])
        assert sorted(out) == np.flatnonzero(keys <= now.drift[0][entry]).tolist()
        popped.append(len(out))
        keys, place, starts, _ = now.later(x, 0, keys, place, starts)
        for e in range(20):
            h = keys[starts[e] : starts[e + 1]]
            assert all(h[i] >= h[(i - 1) // 2] for i in range(1, len(h)))
        far = ((x[place][:, None] - now.books[0][None]) ** 2).sum(2)
        assert (far.argmin(1) == np.repeat(np.arange(20), np.diff(starts))).all()
    assert popped[-1] < 300


# 12


def test_host_and_path(spark):
    cases = {
        "http://A.Example.com/En/x?q=/#/": ("a.example.com", "/En/x"), "https://a.b": ("a.b", ""), "x://h?p=/a": ("h", ""), "x://h#/a": ("h", ""), "http:///p": ("", "/p"),
        "a/b://c/d://e": ("c", "/d://e"), "no host/x": ("", ""), "": ("", ""), None: ("", ""), "http://ÉÀ.fr/É?": ("ÉÀ.fr", "/É"), "x://h/a\nb#c": ("h", "/a\nb"), "http://u@h:80/": ("u@h:80", "/"),
    }
    host, path = urls.host_and_path(F.coalesce("u", F.lit("")))
    found = spark.createDataFrame([(u,) for u in cases], "u string").select("u", host.alias("h"), path.alias("p")).collect()
    assert {r["u"]: (r["h"], r["p"]) for r in found} == cases


def test_rules(spark):
    cases = {
        ("com", "/"): "com/", ("a.com", ""): None, ("xcom", "/"): None, ("example.com", "/en/1"): "example.com/en/", ("m.example.com", "/en/"): "example.com/en/", ("www.example.com", "/en/1"): "www.example.com/en/",
        ("a.www.example.com", "/en/1"): "www.example.com/en/", ("aexample.com", "/en/1"): "com/", ("example.com", "/en"): "com/", ("b.net", "/es/"): "net/es/", ("b.net", "/de/"): None, ("", ""): None,
    }
    rule, verdict = urls.ruled(F.col("h"), F.col("p"), urls.RULES)
    found = spark.createDataFrame(list(cases), "h string, p string").select("h", "p", rule.alias("r"), verdict.alias("v")).collect()
    assert {(r["h"], r["p"]): r["r"] for r in found} == cases
    assert all(r["v"] == (dict(urls.RULES)[r["r"]] if r["r"] else None) for r in found)


def test_segmentation_is_the_most_probable():
    counts, total = {"free": 50, "book": 30, "books": 20, "store": 40, "a": 90, "re": 5, "fr": 2, "s": 1}, 500
    score = lambda words: sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)
    for text in ("freebooks", "bookstore", "afreestore", "zqx", "frea", "s"):
        cuts = [c for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n)]
        splits = [[text[a:b] for a, b in zip((0, *c), (*c, len(text)), strict=True)] for c in cuts]
        assert score(urls.segmented(text, counts, total)) == pytest.approx(max(map(score, splits)))
    assert urls.segmented("freebooks", counts, total) == ["free", "books"]
    long = "freebook" * 300
    assert urls.segmented(long, counts, total) == ["free", "book"] * 300


TEXTS = [("free books free the, Store",), ("the win of (the) cheap store",), (None,), ("",), ("the " * 50,), ("x" * 40,)]


def test_verdicts_are_those_of_plain_bayes(spark):
    sites = ["freestore", "thebook", "casinowin", "cheapbets.free", "thestore", "m.win-store"]
    made = [(k, f"http://{sites[k % 6]}.{('org', 'net', 'com')[k % 3]}/{('de', 'es', 'x1/y22')[k % 7 % 3]}/{k}") for k in range(120)]
    made += [(200, None), (201, ""), (202, "nothing"), (203, "http://" + "free" * 400 + ".org/" + "z/" * 3000), (1, made[1][1]), (None, made[4][1]), (204, "http://freestore.org/poker")]
    pages = spark.createDataFrame([(*p, 1, 2, 3) for p in made], "page_id long, url string, host int, word int, tokens int")
    texts = spark.createDataFrame(TEXTS, "text string")
    found = urls.judged(pages, texts).collect()
    assert sorted(str(r["page_id"]) for r in found) == sorted(str(p[0]) for p in made)
    words = Counter(w for (t,) in TEXTS for p in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if re.fullmatch(r"[^\W\d_]{1,32}", w := p.strip(urls.AROUND)))
    assert {r["word"]: r["count"] for r in urls.unigrams(texts).collect()} == words
    total = sum(words.values())
    known = words | {w: max(words.get(w, 0), urls.SHARE * total, 1) for w in urls.UNWANTED}

    def plain(host, path):
        stem = host.rpartition(".")[0] if "." in host else host
        out = [f"h:{w}" for p in re.findall(r"[^\W\d_]+", stem) for w in urls.segmented(p, known, total)]
        out.append("t:" + (host.rpartition(".")[2] if "." in host else ""))
        return out + ["p:" + ("0" if t[0].isdigit() else t) for t in re.findall(r"[^\W\d_]+|\d+", path.lower())]

    rows = [(plain(r["host"], r["path"]), r) for r in found]
    bad = [any(t[2:] in urls.UNWANTED and t[0] in "hp" for t in toks) for toks, _ in rows]
    counts = [Counter(t for (toks, _), b in zip(rows, bad, strict=True) if b == c for t in toks) for c in (True, False)]
    used = len(counts[0] | counts[1]) + 1
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    for toks, r in rows:
        score = prior + sum(math.log((counts[0][t] + 1) / (counts[0].total() + used)) - math.log((counts[1][t] + 1) / (counts[1].total() + used)) for t in toks)
        p = 1 / (1 + math.exp(-max(min(score, 700), -700)))
        assert r["probability"] == pytest.approx(p, abs=1e-9)
        assert r["verdict"] == (dict(urls.RULES)[r["rule"]] if r["rule"] else "block" if p >= urls.THRESHOLD else "allow")
    verdicts = {r["page_id"]: r["verdict"] for r in found if r["rule"] is None}
    assert verdicts[204] == "block" and set(verdicts.values()) == {"allow", "block"}


def test_urls_of_empty_tables_and_own_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/good", False), (2, "http://b.org/bad", True), (3, "http://c.org/bad", None)], "page_id long, url string, blocked boolean")
    texts = spark.createDataFrame(TEXTS, "text string")
    assert urls.judged(pages.limit(0), texts).collect() == []
    assert {r["verdict"] for r in urls.judged(pages, texts.limit(0)).collect()} == {"allow"}
    more = pages.unionByName(pages).unionByName(pages).unionByName(pages)
    found = {r["page_id"]: r["verdict"] for r in urls.judged(more, texts, labels=F.col("blocked"), threshold=0.6).collect()}
    assert found == {1: "allow", 2: "block", 3: "block"}


def test_hot_keys_are_looked_up_whole(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("host"), "id")
    values = spark.createDataFrame([("hot", 1), ("k2000", 2), ("none", 3)], "host string, v int")
    found = common.looked_up(rows, "host", values)
    assert found.count() == 3000 and found.where("v = 1").count() == 1500 and found.where("v = 2").count() == 1 and found.where("v is null").count() == 1499


# 13


def test_whitening_is_numpys(odd):
    rows = kept(odd, 256)
    x = np.array([r[2] for r in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    plain = (x - s / n) @ (u[:, :4] / np.sqrt(e[:4]))
    found = whitening.whitened(odd).collect()
    assert len(found) == 4 * len(rows)
    deviation = ((n * x - s) ** 2).sum(1)
    for c in range(4):
        own = sorted((str(r["vec_id"]), r["deviation"], round(abs(r["whitened"]), 7)) for r in found if r["component"] == c + 1)
        assert own == sorted((str(r[0]), int(d), round(abs(w), 7)) for r, d, w in zip(rows, deviation, plain[:, c], strict=True))
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-9
    assert {r["component"]: r["explained"] for r in found} == pytest.approx({c + 1: e[c] / e.sum() for c in range(4)}, rel=1e-9)
    signs = {(r["component"], r["whitened"] > 0) for r in found if r["vec_id"] == 98}
    assert len(signs) == 4  # repeated and other rows share the axes' signs


@pytest.mark.parametrize("d", [1, 2, 3, 8, 97, 130])
def test_products_cover_each_pair_once(spark, d):
    random = np.random.default_rng(d)
    x = random.normal(size=(40, d))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    means = x.mean(0)
    found = whitening.covariance(df, "v", [float(m) for m in means], 40)
    assert np.allclose(found, (x - means).T @ (x - means) / 40, atol=1e-12)


def test_whitening_of_few_vectors(spark, odd):
    assert whitening.whitened(odd.limit(0)).collect() == []
    assert whitening.whitened(odd.where("vec_id in (90, 91)")).collect() == []
    one = whitening.whitened(odd.where("vec_id in (92, 93)")).collect()
    assert len(one) == 8 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, 0.0)}
    two = whitening.whitened(odd.where("vec_id in (92, 98)")).collect()
    assert sorted(r["whitened"] for r in two if r["component"] == 1) == pytest.approx([-1, 1]) and all(r["whitened"] is None for r in two if r["component"] > 1)
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whitened(far).collect()} == {None, 0}

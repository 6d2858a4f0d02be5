"""URL filters: rules of hosts and paths, then naive Bayes over words of host and path.

Host names run words together; a unigram model, counted over a corpus of texts,
splits them by the most probable segmentation (Viterbi). Only substrings of the
hosts ask for their counts, by a join, so the vocabulary is never held in one
place. The classifier learns from all URLs, told apart by a list of words of
unwanted sites (or by labels that the caller has), and judges those that no rule
fits: it carries what it knows of these words over to the words around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The longest word of the unigram model.
LETTERS = 32
#: Features of the classifier: tokens by hash. A URL is blocked from this probability on.
BUCKETS, THRESHOLD = 1 << 18, 0.9
#: For the segmentation, a word of UNWANTED is at least this share of all words.
SHARE = 1e-5
#: Words of unwanted sites: a URL with one of them is an example of those to block.
UNWANTED = tuple("ads adult bet bets betting casino farm gambling pills poker porn sex spam track viagra xxx".split())
#: Rules (host and path, verdict) of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Both are empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    cut = F.locate("/", rest)
    host = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise("")
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls: its host is the URL's or a domain above, and the path starts with its path."""
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0].index("/"), x[0])):  # of equals the longer host
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: What stands around a word.
AROUND = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.sub_batches(batches):
        codes, _, words = common.words_of(batch.column("text"), lower=True)
        if not len(words):
            continue
        counts = np.bincount(codes, minlength=len(words))
        words = pc.ascii_trim(words.cast(pa.large_string()), AROUND)
        good = pc.match_substring_regex(words, rf"^\p{{L}}{{1,{LETTERS}}}$")  # of no invalid UTF-8 either
        yield pa.RecordBatch.from_arrays([words.filter(good).cast(pa.string()), pa.array(counts, pa.int64()).filter(good)], names=["word", "count"])


def unigrams(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """word, count: lower-case (A-Z) words of letters, without what stands around them, of all texts; longer ones than LETTERS are not words."""
    return texts.select(F.col(text_column).alias("text")).mapInArrow(_counted, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def segmented(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``piece``, of equals the one with the longest last word.

    A word's probability is its share of ``total``; an unseen one of n letters
    has 10 / (total * 10**n).
    """
    best, back = [0.0], [0]
    for end in range(1, len(piece) + 1):
        found, at = -math.inf, 0
        for start in range(max(0, end - LETTERS), end):
            c = counts.get(piece[start:end], 0)
            p = best[start] + (math.log(c / total) if c else math.log(10 / max(total, 1)) - (end - start) * math.log(10))
            if p > found:
                found, at = p, start
        best.append(found)
        back.append(at)
    words, end = [], len(piece)
    while end:
        words.append(piece[back[end] : end])
        end = back[end]
    return words[::-1]


def _segmenter(total: int, more: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces, known in zip(batch.column("pieces").to_pylist(), batch.column("known").to_pylist(), strict=True):
                counts = {k["word"]: k["count"] for k in known}
                counts |= {w: max(counts.get(w, 0), SHARE * total, 1) for w in more}
                out.append([w for p in pieces for w in segmented(p, counts, total)])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.string()))], names=["host", "words"])

    return run


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, word: the distinct substrings, of at most LETTERS letters, of each host's pieces."""
    made = lambda: pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.string())], names=["host", "word"])
    hosts, words = [], []
    for batch in batches:
        for host, pieces in zip(batch.column("host").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            own = {p[a:b] for p in pieces for a in range(len(p)) for b in range(a + 1, min(a + LETTERS, len(p)) + 1)}
            hosts += [host] * len(own)
            words += sorted(own)
            if len(words) >= 50_000:
                yield made()
                hosts, words = [], []
    yield made()


def host_words(hosts: DataFrame, words: DataFrame, more: Sequence[str] = UNWANTED) -> DataFrame:
    """host, words: the segmented pieces (runs of letters) of each distinct ``host``, by the counts of ``words`` and with the words ``more``; the top-level domain is left out."""
    total = words.agg(F.sum("count")).first()[0] or 0
    cut = hosts.select("host", F.regexp_extract_all(F.regexp_replace("host", r"\.[^.]*$", ""), F.lit(r"\p{L}+"), F.lit(0)).alias("pieces"))
    asked = common.written(cut.mapInArrow(_substrings, "host string, word string"), "asked")
    found = common.looked_up(asked, "word", words).where("count is not null")
    known = found.groupBy("host").agg(F.collect_list(F.struct("word", "count")).alias("known"))  # at most LETTERS words a letter
    joined = cut.join(known, "host", "left").select("host", "pieces", F.coalesce("known", F.array().cast("array<struct<word:string,count:bigint>>")).alias("known"))
    return joined.mapInArrow(_segmenter(total, more), "host string, words array<string>")


def tokens(words: Column, host: Column, path: Column) -> Column:
    """The classifier's tokens: a host's words and top-level domain, and runs of letters (lower-case) or of digits (all alike) of the path, marked apart."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    shaped = F.transform(parts, lambda t: F.concat(F.lit("p:"), F.when(F.rlike(t, F.lit(r"^\p{N}")), "0").otherwise(t)))
    top = F.regexp_extract(host, r"\.([^.]*)$", 1)
    return F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.array(F.concat(F.lit("t:"), top)), shaped)


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class Bayes:
    """Multinomial naive Bayes with add-one smoothing: log odds of blocking, of the prior and of each bucket."""

    def __init__(self, blocked: np.ndarray, allowed: np.ndarray, urls: tuple[int, int]):
        used = int(((blocked + allowed) > 0).sum()) + 1
        self.weights = np.log((blocked + 1) / (blocked.sum() + used)) - np.log((allowed + 1) / (allowed.sum() + used))
        self.prior = math.log((urls[0] + 1) / (urls[1] + 1))


def fit(rows: DataFrame) -> Bayes:
    """From rows with ``buckets`` and ``blocked``; both classes' counts by bucket are all that reaches the driver."""
    block = F.col("blocked").cast("long")
    urls = rows.agg(F.sum(block), F.sum(1 - block)).first()
    counts = np.zeros((2, BUCKETS))
    found = rows.select(block.alias("b"), F.explode("buckets").alias("k")).groupBy("k").agg(F.sum("b").alias("b"), F.sum(1 - F.col("b")).alias("a"))
    for k, b, a in found.collect():  # BUCKETS rows at most
        counts[0, k], counts[1, k] = b, a
    return Bayes(counts[0], counts[1], (urls[0] or 0, urls[1] or 0))


def _scored(weights, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            sums = np.concatenate(([0.0], np.cumsum(weights.value[lists.flatten().to_numpy()])))
            score = prior + sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(score, -700, 700))))], names=[*batch.schema.names, "probability"])

    return run


def judged(pages: DataFrame, texts: DataFrame, rules: Sequence[tuple[str, str]] = RULES, unwanted: Sequence[str] = UNWANTED, labels: Column | None = None, threshold: float = THRESHOLD, id_column: str = "page_id", url_column: str = "url", text_column: str = "text") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the probability of block, one row a page.

    The longest rule that fits decides (``rule``); without one (null) a URL is
    blocked from a probability of ``threshold`` on. ``texts`` give the words of
    the segmentation. The classifier learns from all pages: ``labels`` is a
    boolean column of ``pages`` (null: not an example), by default whether a word
    of host or path is ``unwanted``. Rules and these words become part of the
    plan, so they are short lists.

    Null URLs, and those without ``://``, have an empty host and path: they are
    judged by the classifier's prior alone. Very long hosts and paths count as a
    whole. Repeated rows and null ids keep their rows; other columns are ignored.
    Without an example of a class add-one smoothing decides; empty tables give no
    rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.coalesce(F.col(url_column), F.lit("")))
    given = F.lit(None).cast("boolean") if labels is None else labels
    cut = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"), given.alias("blocked"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = cut.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = common.written(rows.select("host").distinct(), "hosts")
    words = common.written(host_words(hosts, common.written(unigrams(texts, text_column), "words"), unwanted), "segments")
    marked = common.looked_up(rows, "host", words).withColumn("tokens", tokens(F.col("words"), F.col("host"), F.col("path")))
    if labels is None:
        listed = F.array(*[F.lit(f"{m}:{w}") for w in unwanted for m in "hp"]).cast("array<string>")
        marked = marked.withColumn("blocked", F.arrays_overlap("tokens", listed))
    marked = common.written(marked.select("page_id", "host", "path", "rule", "verdict", "blocked", F.transform("tokens", bucket).alias("buckets")), "tokens")
    model = fit(marked.where("blocked is not null"))
    weights = spark.sparkContext.broadcast(model.weights)  # BUCKETS numbers
    scored = marked.mapInArrow(_scored(weights, model.prior), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in marked.schema.fields)}, probability double")
    guess = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"), "probability")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of each of the ``pages``, with host names split by the words of ``documents``."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))

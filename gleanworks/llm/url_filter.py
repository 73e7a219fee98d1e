"""URL filter: host word segmentation and multinomial naive Bayes.

Host names and path parts are cut at characters that are no letters and no digits; each run of letters, a name, is split into words by a Viterbi search under a
unigram model: the words of the pages' own texts with all their counts, and the seed words. Words that make up at least ``WORD_SHARE`` of all (at most 1 / WORD_SHARE of them) go to
the tasks as an automaton that finds every word in a name in one walk; all other words are met by the substrings of the distinct names, of the lengths that such words have, in a join on
a 64-bit key. Letters of no word form pieces of any length. So a split does not depend on how large the table is, and takes time in proportion to a name's letters and the words found in it.

A naive Bayes model over the words of host and path is learnt from all pages: pages whose host holds a word of ``BLOCK_WORDS`` teach the block class, all others the allow class. Both classes
are smoothed by the same prior, ``PRIOR`` pseudo-counts in proportion to a word's share of all counts, so a name seen once in the larger class speaks for that class. Without block pages nothing is
blocked but by rules. Pages, words and counts meet in joins and aggregations on distinct words. Rules of the operator of the list are tried first.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the class shares alone; a null html adds no words; an empty table gives an
empty result; repeated rows are judged each; a very long url is a name of many letters, split in linear time. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import ascii_lower, batches, query, read, utf8
from .decontamination import item_words

# Fixed seed words of unwanted hosts.
BLOCK_WORDS = ("ads", "adult", "bets", "betting", "bingo", "casino", "clickbait", "escort", "gambling", "jackpot", "lottery", "malware", "payday",
               "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx")
# Fixed words that often stand beside them.
NEAR_WORDS = ("cheap", "farm", "free", "win", "best", "online", "shop", "news", "blog", "example", "html", "page", "www", "com", "net", "org")
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
WORD_SHARE, SEED_SHARE, PRIOR = 1e-5, 1e-4, 1.0
_PART = re.compile(r"[0-9]+|[^\W\d_]+")
PIECE, LETTER = 12.0, 4.0  # cost of a piece that is no word, and of each of its letters: below any word of the model


class Segmenter:
    """Splits a run of letters into the most probable words of a unigram model."""

    def __init__(self, shares: dict[str, float]):
        self.walk = ahocorasick.Automaton()
        for w, p in shares.items():
            self.walk.add_word(w, (len(w), math.log(p)))
        self.walk.make_automaton() if len(shares) else None

    def run(self, letters: str, more: tuple = ()) -> list[str]:
        """``more``: (start, length, share) of further words in ``letters``. Of equal splits the one whose last word is longest."""
        found: dict[int, list[tuple[int, float]]] = {}
        if len(self.walk):
            for end, (n, logp) in self.walk.iter(letters):
                found.setdefault(end + 1, []).append((n, logp))
        for start, n, share in more:
            found.setdefault(start + n, []).append((n, math.log(share)))
        best, back = [0.0], [0]
        open_at, open_value = 0, -PIECE  # where a piece that is no word had best begin: value + LETTER * begin is greatest
        for end in range(1, len(letters) + 1):
            at, top = open_at, open_value - LETTER * end
            if end in found:
                for n, logp in found[end]:
                    p = best[end - n] + logp
                    if p > top or (p == top and end - n < at):
                        at, top = end - n, p
            best.append(top)
            back.append(at)
            if top - PIECE + LETTER * end > open_value:
                open_at, open_value = end, top - PIECE + LETTER * end
        out, end = [], len(letters)
        while end:
            out.append(letters[back[end]:end])
            end = back[end]
        return out[::-1]


def parts(name: str) -> list[str]:
    """Runs of letters of a host or path; a run of digits counts as one word ``0``."""
    return ["0" if p[0].isdigit() else p for p in _PART.findall(name.lower())]


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (action, rule) that fits; a rule fits its host, all subdomains, and paths that start with its own."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _text_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches(frames):
        for t in utf8(b, "html"):
            seen.update(item_words(t))
        if len(seen) > 500_000:
            yield _counts(seen)
            seen.clear()
    yield _counts(seen)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) of the pages' texts, words of letters only."""
    counts = pages.select("html").mapInArrow(_text_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.where(F.col("word").rlike(r"^\p{L}+$")))


def _key(word: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(word.encode())).view(np.int64))


def _keyed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        ws = b.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([_key(w) for w in ws], pa.int64()), pa.array([len(w) for w in ws], pa.int32()), b.column("word"), b.column("n")],
                                         ["key", "length", "word", "n"])


def _names(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's runs of letters and digits in order, those of the host first."""
    for b in frames:
        for row, h, p in zip(*[b.column(c).to_pylist() for c in ("_row", "host", "path")]):
            hs, ps = parts(h), parts(p)
            n = len(hs) + len(ps)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([k < len(hs) for k in range(n)], pa.bool_()), pa.array(range(n), pa.int32()),
                                                  pa.array(hs + ps, pa.string())], ["_row", "of_host", "at", "name"])


def _substrings(lengths: list[int], common):
    """Keys of the substrings of names that may be words the tasks do not hold."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = common.value
        for b in frames:
            ids, starts, sizes, keys = [], [], [], []

            def out() -> pa.RecordBatch:
                got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((ids, pa.int64()), (starts, pa.int32()), (sizes, pa.int32()), (keys, pa.int64()))], ["id", "start", "length", "key"])
                for x in (ids, starts, sizes, keys):
                    x.clear()
                return got

            for i, name in zip(b.column("id").to_pylist(), b.column("name").to_pylist()):
                for n in lengths:
                    for start in range(len(name) - n + 1):
                        if (w := name[start:start + n]) not in held:
                            ids.append(i)
                            starts.append(start)
                            sizes.append(n)
                            keys.append(_key(w))
                    if len(ids) > 100_000:
                        yield out()
            yield out()

    return run


def _split(shares, total: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter(shares.value)
        for b in frames:
            ws = [cut.run(name, [(m["start"], m["length"], m["n"] / total) for m in more or ()]) if name != "0" else ["0"]
                  for name, more in zip(b.column("name").to_pylist(), b.column("more").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(ws, pa.list_(pa.string()))], ["name", "words"])

    return run


def segment(names: DataFrame, counts: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """(name, words) for distinct ``names(name)`` under the unigram model ``counts(word, n)`` and the seed words."""
    spark = names.sparkSession
    total = max(1, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common = F.col("n") >= share * total
    shares = {r.word: r.n / total for r in counts.where(common).collect()}  # at most 1 / share words
    seeds = (*BLOCK_WORDS, *NEAR_WORDS)
    for w in seeds:
        shares[w] = max(shares.get(w, 0.0), SEED_SHARE)
    held = spark.sparkContext.broadcast(shares)
    names = cut_lineage(names.withColumn("id", F.monotonically_increasing_id()))
    rare = counts.where(~common & ~F.col("word").isin(*seeds)).mapInArrow(_keyed, "key long, length int, word string, n long")
    rare = cut_lineage(rare)
    lengths = sorted(r[0] for r in rare.select("length").distinct().collect())  # numbers of letters in a word
    asked = names.mapInArrow(_substrings(lengths, held), "id long, start int, length int, key long")
    found = asked.join(rare.select("key", "length", "word", "n"), ["key", "length"])
    # a 64-bit key may stand for another word: the letters decide
    found = found.join(names, "id").where(F.substring("name", F.col("start") + 1, F.col("length")) == F.col("word"))
    more = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "n"))).alias("more"))  # words within one name
    rows = names.join(more, "id", "left").select("name", "more")
    return cut_lineage(rows.mapInArrow(_split(held, total), "name string, words array<string>"))


def log_odds(block: Column, allow: Column, total_block: float, total_allow: float, prior: float = PRIOR) -> Column:
    """Log odds of a word that the classes hold ``block`` and ``allow`` times, both smoothed towards its share of all counts."""
    pseudo = prior * (block + allow) / F.lit(float(max(1, total_block + total_allow)))
    return F.log((block + pseudo) / (total_block + prior)) - F.log((allow + pseudo) / (total_allow + prior))


def filter_urls(pages: DataFrame, rules=RULES, prior: float = PRIOR) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_words, log_odds."""
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    cut = cut_lineage(cut.withColumn("_row", F.monotonically_increasing_id()))
    named = cut_lineage(cut.select("_row", "host", "path").mapInArrow(_names, "_row long, of_host boolean, at int, name string"))
    split = segment(named.select("name").distinct(), unigrams(pages))
    words = cut_lineage(named.join(split, "name").select("_row", "of_host", "at", "words"))
    # the class that a page teaches, then words by class
    seeds = F.array(*map(F.lit, BLOCK_WORDS))
    blocked = F.coalesce(F.max(F.col("of_host") & F.arrays_overlap("words", seeds)), F.lit(False)).alias("blocked")
    hosts = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("of_host"), F.struct("at", "words")))), lambda x: x["words"])), " ")
    of_page = cut_lineage(words.groupBy("_row").agg(blocked, hosts.alias("host_words")))
    each = words.join(of_page.select("_row", "blocked"), "_row").select("_row", "blocked", F.explode("words").alias("word"))
    counts = cut_lineage(each.groupBy("word").agg(F.sum(F.col("blocked").cast("long")).alias("block"), F.sum((~F.col("blocked")).cast("long")).alias("allow")))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("block", "allow")]).first()
    n_pages = cut.count()
    n_block = of_page.where("blocked").count()
    shares = math.log((n_block + prior) / (n_pages - n_block + prior))
    odds = counts.select("word", log_odds(F.col("block"), F.col("allow"), *total, prior).alias("_odds"))
    sums = words.select("_row", F.explode("words").alias("word")).join(odds, "word").groupBy("_row").agg(F.collect_list("_odds").alias("_odds"))
    # summed in order of size, so that equal urls have equal odds
    sums = sums.select("_row", F.aggregate(F.array_sort("_odds"), F.lit(0.0), lambda x, y: x + y).alias("_sum"))
    judged = cut.join(of_page, "_row", "left").join(sums, "_row", "left").withColumns({
        "log_odds": F.lit(shares) + F.coalesce("_sum", F.lit(0.0)), "_r": rule_of(F.col("host"), F.col("path"), rules)})
    bad = (F.col("log_odds") > 0) if n_block else F.lit(False)
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.action", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                         F.coalesce("host_words", F.lit("")).alias("host_words"), "log_odds")


@query("op6_url_filter")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(read(spark, folder, "pages"))

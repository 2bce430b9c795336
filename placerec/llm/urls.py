"""URL filters: rules, then word segmentation of hosts and multinomial naive Bayes.

Concatenated host labels are split by a unigram Viterbi whose word counts come from
the visible words of all pages. Segmented host words and path tokens fall into
``BUCKETS`` hashed features; urls that a rule decides teach the classes block and
allow, and the log-odds judge the urls that no rule fits.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule and is judged by the class prior alone; without any url that a rule decides, or
with one class only, the method allows what no rule blocks (or follows that class);
repeated rows give equal rows; an empty table gives an empty table; only the id, url
and html columns are read.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerec.llm.shared import cut, drop

#: (verdict, host, path prefix).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BUCKETS = 1 << 16
#: The unigram model holds the words of 2 to so many letters of all pages: as many as a label of a host name may have.
LONGEST = 63
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n): counts over all pages of the words of 2 to ``LONGEST`` letters of their visible text."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("w")).where(F.length("w").between(2, LONGEST))
    return words.groupBy("w").agg(F.count("*").alias("n"))


class Segmenter:
    """The likeliest split of a run of letters into words; an unknown word costs by its length.

    ``counts`` needs to hold the words within the run only; ``total`` is that of all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = [math.log(total) + 2.3 * n for n in range(LONGEST + 1)]
        self.known: dict[str, list[str]] = {}

    def __call__(self, label: str) -> list[str]:
        got = self.known.get(label)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            best, back = [0.0], [0]
            for end in range(1, len(label) + 1):
                options = ((best[i] + self.cost.get(label[i:end], self.unknown[end - i]), i) for i in range(max(0, end - LONGEST), end))
                x, i = min(options)
                best.append(x)
                back.append(i)
            got, end = [], len(label)
            while end:
                got.append(label[back[end] : end])
                end = back[end]
            got = self.known[label] = got[::-1]
        return got


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def host_features(host: str, counts: dict[str, int], total: int) -> list[int]:
    """Buckets of a host's segmented words."""
    segment = Segmenter(counts, total)
    return [_bucket(f"h:{w}") for part in re.findall(r"[a-z]+|[^a-z.\-]+", host) for w in (segment(part) if part[0] in LOW else [part])]


def path_features(path: str) -> list[int]:
    return [_bucket(f"p:{w}" if not w.isdigit() else f"p:#{len(w)}{w[0]}") for w in re.findall(r"\w+", path)]


def segmented_hosts(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(host, at): the features of each distinct host.

    A host meets the words that stand in it, by an equi-join on its runs' substrings of up to ``LONGEST`` letters:
    the whole model is used, and none of it goes through the driver.
    """
    starts = lambda run: F.sequence(F.lit(1), F.length(run))
    ends = lambda run, i: F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(LONGEST), F.length(run) - i + 1)))
    runs = F.array_distinct(F.filter(F.split("host", "[^a-z]+"), lambda r: F.length(r) > 1))
    # substrings past the end are shorter ones again
    parts = hosts.select("host", F.explode(runs).alias("run")).select("host", "run", F.explode(starts(F.col("run"))).alias("i")).select("host", F.explode(F.transform(ends(F.col("run"), F.col("i")), lambda n: F.substring("run", F.col("i"), n))).alias("w")).distinct()
    known = parts.join(words, "w").groupBy("host").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def run(batches):
        for batch in batches:
            at = [host_features(h or "", {x["w"]: x["n"] for x in k or ()}, total) for h, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["host", "at"])

    return hosts.join(known, "host", "left").select("host", "known").mapInArrow(run, "host string, at array<int>")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: host, path, the rule that decides it, the verdict, and the log-odds of block."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "said": verdict})
    words = cut(unigrams(pages, html_col), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hosts = cut(segmented_hosts(named.select("host").distinct(), words, total), "hosts")
    drop(words)

    def with_path(batches):
        for batch in batches:
            at = [[*(h or ()), *path_features(p)] for h, p in zip(batch.column("at").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "rule", "said")), pa.array(at, pa.list_(pa.int32()))], ["id", "host", "path", "rule", "said", "at"])

    schema = T.StructType([*named.schema, T.StructField("at", T.ArrayType(T.IntegerType()))])
    rows = cut(named.join(hosts, "host", "left").select("id", "host", "path", "rule", "said", "at").mapInArrow(with_path, schema), "urls")
    drop(hosts)
    taught = rows.where(F.col("said").isNotNull())
    n = {r.said: r.n for r in taught.groupBy("said").agg(F.count("*").alias("n")).collect()}
    block, allow = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in taught.select("said", F.explode("at").alias("b")).groupBy("b").agg(F.sum((F.col("said") == "block").cast("long")).alias("x"), F.sum((F.col("said") == "allow").cast("long")).alias("y")).collect():
        block[r.b], allow[r.b] = r.x, r.y
    odds = np.log((block + 1) / (block.sum() + BUCKETS)) - np.log((allow + 1) / (allow.sum() + BUCKETS))
    prior = math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))
    if len(n) < 2:
        odds[:] = 0
    model = spark.sparkContext.broadcast((odds, prior))

    def scored(batches):
        odds, prior = model.value
        for batch in batches:
            score = [prior + float(odds[x].sum()) if x else prior for x in batch.column("at").to_pylist()]
            said = [v or ("block" if s > 0 else "allow") for v, s in zip(batch.column("said").to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "rule")), pa.array(said, pa.string()), pa.array(score, pa.float64())], [id_col, "host", "path", "rule", "verdict", "log_odds"])

    kind = named.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, log_odds double")

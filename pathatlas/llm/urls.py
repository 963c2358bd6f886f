"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Rules meet URLs by one equi-join for each number of labels that occurs in rule hosts (the last k labels of the URL's host),
so no URL is multiplied and hot suffixes like ``com`` stay splittable; the rules of one host are one row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .toxicity import logistic

BITS = 16
HANDED = 1 << 16  # rules that are handed to all tasks
SIZES = (3, 4, 5)

# The filter rules of the query as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

# A small labelled table of invented URLs; 1 means block.
LABELLED = [
    ("https://www.city-library.org/catalogue/history", 0), ("https://news.daily-herald.org/2024/politics/vote", 0),
    ("https://docs.openproject.org/guide/install", 0), ("https://en.encyclopedia.org/wiki/Botany", 0),
    ("https://physics.university.edu/research/papers", 0), ("https://www.health.gov/advice/vaccines", 0),
    ("https://blog.gardening.org/2023/05/tomatoes", 0), ("https://museum.art/exhibitions/spring", 0),
    ("https://forum.cooking.org/thread/bread-recipes", 0), ("https://www.weather.gov/forecast/week", 0),
    ("https://courses.university.edu/math/algebra", 0), ("https://journal.science.org/article/genome", 0),
    ("https://kb.software.org/help/settings", 0), ("https://travel.magazine.org/cities/lisbon", 0),
    ("https://books.archive.org/details/novel", 0), ("https://school.edu/teachers/lessons", 0),
    ("https://www.parliament.gov/bills/education", 0), ("https://music.review.org/albums/2022", 0),
    ("https://www.recipes.org/en/soup", 0), ("https://blog.history.org/de/berlin", 0),
    ("http://free-casino-slots.biz/bonus/spin", 1), ("http://www.hot-xxx-videos.org/porn/watch", 1),
    ("http://online-poker-bets.org/casino/jackpot", 1), ("http://cheap-viagra-pills.biz/buy/order", 1),
    ("http://ads.clicktracker.biz/banner/click", 1), ("http://adult-cams.xxx/live/sex", 1),
    ("http://torrent-warez.org/download/crack-keygen", 1), ("http://win-free-prize.biz/claim/iphone", 1),
    ("http://payday-loans-fast.biz/apply/loan", 1), ("http://sexy-girls-dating.org/adult/chat", 1),
    ("http://bet365-casino.org/sports/betting", 1), ("http://replica-watches-cheap.biz/buy/rolex", 1),
    ("http://porn-tube.xxx/free/videos", 1), ("http://track.adserver.biz/pixel/popup", 1),
    ("http://crack-serial-keygen.org/warez/download", 1), ("http://pills-pharmacy-online.biz/viagra/buy", 1),
    ("http://slots-jackpot.org/casino/free-spins", 1), ("http://escort-adult.org/sex/girls", 1),
    ("http://spam-links.biz/click/win", 1), ("http://gambling-poker.biz/bonus/bet", 1),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def match_rules(pages: DataFrame, rules: DataFrame, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``pages`` with ``rule`` (host + path of the longest fitting rule, else null) and ``rule_verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest (host + path, then host) wins;
    of equal rules ``block``. Rules with a null part fit nothing; a null host or path fits no rule. Rows keep their number. Up to
    HANDED rules are handed to all tasks, so the pages stay where they are; more are joined by exchange.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    labels = F.size(F.split("host", r"\."))
    counts = sorted(r[0] for r in rules.select(labels).distinct().collect())  # a handful of label counts
    few = rules.count() <= HANDED
    by_host = rules.groupBy(F.col("host").alias("_rule_host")).agg(F.collect_list(F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "verdict",
        "path", F.concat("host", "path").alias("rule"))).alias("_rules"))
    out, found = pages, []
    for k in counts:
        name = f"_rules_{k}"
        part = by_host.where(F.size(F.split("_rule_host", r"\.")) == k).withColumnRenamed("_rules", name)
        key = F.when(F.size(F.split(F.col(host_col), r"\.")) >= k, F.substring_index(F.col(host_col), ".", -k))
        out = out.join(F.broadcast(part) if few else part, key == F.col("_rule_host"), "left").drop("_rule_host")
        found.append(F.coalesce(F.col(name), F.array().cast(part.schema[name].dataType)))
    if not found:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    fits = F.filter(F.concat(*found), lambda r: F.startswith(F.col(path_col), r["path"]))
    return out.withColumn("_best", F.array_max(fits)).select(
        *[F.col(c) for c in pages.columns], F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def grams(host: str, path: str) -> list[int]:
    """Buckets of the distinct character n-grams of host and path, which are kept apart."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            found.update(mark + text[i:i + n] for i in range(len(text) - n + 1))
    return sorted({zlib.crc32(g.encode("utf-8")) & ((1 << BITS) - 1) for g in found})


@dataclass
class UrlModel:
    weight: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        g = grams(host, path)
        z = self.bias + float(self.weight[g].sum()) / max(1, len(g)) ** 0.5
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(labelled: list[tuple[str, str, int]], l2: float = 1e-4) -> UrlModel:
    """Logistic regression from (host, path, label) rows; without both labels the model has no weights and blocks nothing,
    or everything if all rows are to be blocked."""
    y = np.array([r[2] for r in labelled], np.float64)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(1 << BITS), 50.0 if len(y) and y[0] == 1 else -50.0)
    lists = [np.array(grams(h, p), np.int64) for h, p, _ in labelled]
    sizes = np.array([len(x) for x in lists])
    w, b = logistic(np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists), np.repeat(1 / np.sqrt(sizes), sizes), y, 1 << BITS, l2)
    return UrlModel(w, b)


def scorer(spark: SparkSession, model: UrlModel):
    shared = spark.sparkContext.broadcast(model)  # a fixed 2^16 weights

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(h or "", p or "") for h, p in zip(hosts, paths, strict=True)], dtype=float)
    return score


def labelled_rows(spark: SparkSession, labelled: list[tuple[str, int]]) -> list[tuple[str, str, int]]:
    """A small labelled URL table, with hosts and paths cut as for the pages."""
    df = spark.createDataFrame(labelled, "url string, y int")
    return [tuple(r) for r in df.select(host_of(F.col("url")), path_of(F.col("url")), "y").collect()]


def judge(pages: DataFrame, rules: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of ``pages``.

    A null url or one without ``://`` has an empty host and path, fits no rule and is judged by the model. Repeated rows and
    null ids keep a row each; an empty table gives an empty result; other columns are not read.
    """
    cut = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"),
                       F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"))
    out = match_rules(cut, rules).withColumn("score", scorer(pages.sparkSession, model)("host", "path"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


@query("op9_url_filters")
def op9(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    model = fit(labelled_rows(spark, LABELLED))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, model)

"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets base metrics and a base verdict from its whole text. Failures are summed by host
(the column `source`), and each host's failure rate is shrunk to the corpus: a beta prior is fitted to
the hosts by moments (beta-binomial, weights by size), and the shrunk rate is the posterior mean. A
host is rejected with all its documents where even the low end of what its rate may be (the posterior
mean less `CERTAIN` posterior deviations) is above what hosts of this corpus reach (the prior's mean and
`UNUSUAL` of its deviations), or above `max_host_failure` whatever the others do. Where hosts differ no
more than chance would have them differ, none is rejected: what they fail by is in their documents.

Texts never leave the scan: it writes narrow rows, which are then summed (partial sums first, so a
host with a third of all rows costs no more than another) and joined to the hosts. Repeated windows
are found inside a row by sorting 64-bit hashes of its windows; in a document of a million words the
odds that any two different windows meet are below one in ten million.

Nulls: a null text has no words (and fails), a null source is a host of its own, a null doc_id is kept.
Repeated rows each count. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import GAP, WORD, Scratch, text_or_empty

MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
MAX_HOST_FAILURE, UNUSUAL, CERTAIN = 0.5, 2.0, 2.0


def repeated_words(docs: DataFrame, words: str, window: int, out: str) -> DataFrame:
    """Adds the number of words that lie in windows found twice or more in their document."""
    n = F.size(words)
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<long>"))
    docs = docs.withColumn("_h", hashes)
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(e: Column, k: Column) -> Column:
        return e["h"].eqNullSafe(F.get("_s", k - 1)["h"]) | e["h"].eqNullSafe(F.get("_s", k + 1)["h"])

    docs = docs.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twice), lambda e: e["i"])))
    fresh = F.transform("_p", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_p", k + 1) - p, F.lit(window))))
    return docs.withColumn(out, F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_or_empty(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("host"),
        F.array_remove(F.split(text, GAP), "").alias("_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    rows = repeated_words(rows, "_words", WINDOW, "n_repeat_words")
    n = F.size("_words").cast("long")
    return rows.select(
        "doc_id", "host", n.alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)).alias("base_failed"),
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta of the hosts' failure rates, by moments; one row of sums comes to the driver.

    Hosts that differ no more than chance would have them differ share one rate: the prior is then as
    heavy as the whole corpus. Without any row it is (1, 1).
    """
    x = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.sum(F.col("k").cast("double") ** 2 / F.col("n")).alias("kk")).first()
    if not x["n"]:
        return 1.0, 1.0
    n, mean = float(x["n"]), x["k"] / x["n"]
    noise = mean * (1 - mean)
    spread, room = x["kk"] - n * mean * mean - noise * (x["h"] - 1), noise * (n - x["nn"] / n - (x["h"] - 1))
    share = min(max(spread / room, 1 / (n + 1)), 0.999) if room > 0 else 1 / (n + 1)
    weight = 1 / share - 1
    return max(mean * weight, 1e-9), max((1 - mean) * weight, 1e-9)


def variance(a, b):
    """The variance of a beta distribution; numbers or Columns."""
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def quality_rules(docs: DataFrame, max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """The base metrics of each document, its host's shrunk failure rate and the low end of it, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    base = scratch.write(base_metrics(docs), "base")
    hosts = scratch.write(base.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")), "hosts")
    alpha, beta = beta_prior(hosts)
    limit = min(max_host_failure, alpha / (alpha + beta) + UNUSUAL * variance(alpha, beta) ** 0.5)
    a, b = F.col("k") + alpha, F.col("n") - F.col("k") + beta
    rate = a / (a + b)
    verdicts = hosts.select(F.col("host").alias("_host"), rate.alias("host_failure"), (rate - CERTAIN * F.sqrt(variance(a, b))).alias("host_low"))
    verdicts = scratch.write(verdicts.withColumn("host_kept", F.col("host_low") <= limit), "verdicts")
    return base.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_failure", "host_low", "host_kept",
    )

"""Operator 4, quality rules at host level, in DataFrame functions only.

1. Every text is measured in one pass of array functions; nothing is exploded or shuffled for it.
2. A document fails when any rule fails. Failures are counted per host (the domain column).
3. Host rates are shrunk towards an empirical beta prior fitted by moments over all hosts, so a host of two documents
   is not condemned by one of them. A host is rejected if its failures are far more likely than the corpus's: the rate
   that its posterior exceeds by SURE standard deviations is above the rate of LIFT times the corpus's odds. Where hosts
   are alike none is that far off, however high the rate of them all.
4. Host verdicts are joined back to the documents, by broadcast up to 100,000 hosts and beyond with the hosts of many
   documents apart from the others.

Defined cases: null or blank text has no words and fails; a null host is a host of its own; repeated rows are judged
each; an empty table gives an empty result; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, join_counted, let, materialize, quoted, text_of, whole_row, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: A rejected host's odds of failure against the corpus's, at least; standard deviations of certainty.
LIFT, SURE = 4, 2
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(grams: Column) -> Column:
    """Words inside windows found twice or more, from the array of window hashes."""

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda total, x: total + x,
        )

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        # index -1 would be an error, so the first element looks at itself through a position past the end
        found = F.filter(s, lambda x, i: same(x, F.when(i == 0, F.size(s)).otherwise(i - 1)) | same(x, i + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["p"])), covered)

    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(pairs), repeated))


def measure(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """keep, and the five measures (bigint) of each whole text."""
    base = docs.select(*keep, text_of(quoted(text)).alias("__t")).withColumn("__w", words_of(F.col("__t")))
    grams = let(
        F.transform("__w", lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    base = base.withColumn("__g", F.when(F.size("__w") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>"))).withColumn("__l", lines)
    names = [c for c in base.columns if c not in ("__t", "__w", "__g", "__l")]
    return base.select(
        *names,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("__g")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def any_rule_failed() -> Column:
    """The base rules, too many symbols (over one for two words), or words of an odd mean length (under 2, over 14)."""
    n = F.col("n_words")
    return base_failed() | (2 * F.col("n_symbols") > n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, the failure rate shrunk by the empirical beta prior, and the verdict."""
    hosts = measured.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(any_rule_failed().cast("bigint")).alias("host_failures"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    # one row of moments comes to the driver, whatever the number of hosts
    got = hosts.agg((F.sum("host_failures") / F.sum("host_docs")).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean = min(max(got["mean"] or 0.0, 1e-6), 1 - 1e-6)
    strength = min(max(mean * (1 - mean) / got["var"] - 1, 1.0), 1e6) if got["var"] else 1e6
    rate, bound = F.col("host_rate"), LIFT * mean / (1 - mean + LIFT * mean)
    surely = rate - SURE * F.sqrt(rate * (1 - rate) / (F.col("host_docs") + strength + 1))
    return hosts.withColumn("host_rate", (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)).withColumn("host_rejected", surely > bound)


def _with_verdicts(measured: DataFrame) -> DataFrame:
    """measured (with __host) with the verdict of each row's host. A null host is one like others."""
    named = F.coalesce(F.concat(F.lit("="), "__host"), F.lit("null")).alias("__host")
    hosts = host_rates(measured, "__host").select(named, "host_docs", "host_rate", "host_rejected")
    rest = [c for c in measured.columns if c != "__host"]
    measured = measured.select(*rest, named)
    if hosts.count() <= 100_000:
        return measured.join(F.broadcast(hosts.drop("host_docs")), "__host")
    return join_counted(measured, hosts, ["__host"], "host_docs", measured.count())


def judge(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry (by default doc_id), the measures, base_failed, host_rate, host_rejected and kept, one row per input row.

    The measured rows are written once to the shared folder: counting hosts and judging documents both read them there.
    """
    carry = ["doc_id"] if carry is None else carry
    measured = materialize(measure(docs, [F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(carry)] + [F.col(quoted(host)).cast("string").alias("__host")], text), "rules")
    return _with_verdicts(measured).select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *MEASURES, base_failed().alias("base_failed"),
        "host_rate", "host_rejected", (~base_failed() & ~F.col("host_rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep."""
    row = docs.select(whole_row(docs, "__doc"), F.col(quoted(host)).cast("string").alias("__host"), F.col(quoted(text)).alias("__text"))
    measured = materialize(measure(row, [F.col("__doc"), F.col("__host")], "__text"), "rules")
    return _with_verdicts(measured).filter(~base_failed() & ~F.col("host_rejected")).select("__doc.*")

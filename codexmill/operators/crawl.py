"""What a log of fetch attempts, or a list of links, amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attempts for a URL, statuses that ask for patience, and seconds to wait for each attempt.
MAX_ATTEMPTS, PATIENCE, LONG_WAIT, SHORT_WAIT = 3, [429, 500, 503], 15.0, 1.5


def outcomes(attempts: DataFrame, keys: list[str], most: int = MAX_ATTEMPTS) -> DataFrame:
    """(keys, fetched, success_attempt, tries, wait_s) from (keys, attempt, status); a null status is a network error.

    Attempts after the first success or beyond ``most`` don't count. No wait follows a success,
    nor the last attempt unless it was told to be patient.
    """
    tried = attempts.where(F.col("attempt").between(1, most))
    success = F.min(F.when(F.col("status") == 200, F.col("attempt")))
    waits = F.when(F.col("status").isin(PATIENCE), LONG_WAIT * F.col("attempt")).when(F.col("attempt") < most, SHORT_WAIT * F.col("attempt")).otherwise(0.0)
    log = F.collect_list(F.struct("attempt", waits.alias("wait")))
    got = tried.groupBy(*keys).agg(success.alias("success_attempt"), log.alias("log"))
    made = F.filter("log", lambda x: F.col("success_attempt").isNull() | (x["attempt"] <= F.col("success_attempt")))
    failed = F.filter("log", lambda x: F.col("success_attempt").isNull() | (x["attempt"] < F.col("success_attempt")))
    wait = F.aggregate(failed, F.lit(0.0), lambda a, x: a + x["wait"])
    return got.select(*keys, F.col("success_attempt").isNotNull().alias("fetched"), "success_attempt", F.size(made).cast("long").alias("tries"), wait.alias("wait_s"))


def resolve(attempts: DataFrame, keys: list[str], most: int = MAX_ATTEMPTS) -> DataFrame:
    """(keys, fetched, valid, rounds, tries, wait_s) from (keys, round, attempt, status, valid).

    A round is a set of attempts as ``outcomes`` reads it. A page that the first round fetched but that is no article
    (``valid`` false or null at its success) is fetched once more; rounds that weren't due don't count.
    """
    by_round = outcomes(attempts, [*keys, "round"], most).where(F.col("round").between(1, 2))
    good = attempts.select(*keys, "round", F.col("attempt").alias("success_attempt"), F.coalesce("valid", F.lit(False)).alias("ok")).groupBy(*keys, "round", "success_attempt").agg(F.max("ok").alias("ok"))
    judged = by_round.join(good, [*keys, "round", "success_attempt"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    row = F.struct("fetched", "ok", "tries", "wait_s")
    both = judged.groupBy(*keys).agg(F.max(F.when(F.col("round") == 1, row)).alias("a"), F.max(F.when(F.col("round") == 2, row)).alias("b"))
    second = F.col("a.fetched") & ~F.col("a.ok") & F.col("b").isNotNull()
    none = F.lit(0)
    return both.where("a is not null").select(
        *keys, F.when(second, F.col("b.fetched")).otherwise(F.col("a.fetched")).alias("fetched"), F.when(second, F.col("b.ok")).otherwise(F.col("a.ok")).alias("valid"),
        (1 + second.cast("long")).alias("rounds"), (F.col("a.tries") + F.when(second, F.col("b.tries")).otherwise(none)).alias("tries"),
        (F.col("a.wait_s") + F.when(second, F.col("b.wait_s")).otherwise(none)).alias("wait_s"),
    )


def pending(links: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Links that are not among the pages at hand."""
    return links.join(done.select(*keys), keys, "left_anti")

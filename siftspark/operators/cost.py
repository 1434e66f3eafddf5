"""Cost ledger, budget and retries of provider calls."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_ranges, running

# Prices for a million tokens, in dollars, and the rate to yuan.
EMBED_PRICE, ANSWER_PRICE, RATE = 0.15, 0.6, 7.2
ATTEMPTS, FIRST_WAIT_S, MOST_WAIT_S = 3, 0.2, 2.0


def embedding_cost(tokens: Column) -> Column:
    return tokens / 1e6 * EMBED_PRICE * RATE


def answer_cost(chars: Column) -> Column:
    return chars / 1e6 * ANSWER_PRICE * RATE


def spent(ledger: DataFrame) -> DataFrame:
    """One row: spent, the sum of cny of successful calls (0 without any)."""
    return ledger.agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("cny"))), F.lit(0.0)).alias("spent"))


def allowed(ledger: DataFrame, limit: float, estimate: float) -> bool:
    return spent(ledger).first()["spent"] + estimate <= limit


def breaker(calls: DataFrame, limit: float, by: list[str], order: list[str]) -> DataFrame:
    """Calls (ok, cny) with ``before`` (spent by earlier ones of the group) and ``open``: true once the limit would be passed."""
    ok = F.when(F.col("ok"), F.col("cny")).otherwise(F.lit(0.0)).cast("double")
    out = running(in_ranges(calls, by, order), by, order, ok, "before").select(*calls.columns, "before")
    return out.withColumn("open", F.round(F.col("before") + F.col("cny"), 6) > limit)


class Permanent(Exception):
    """A failure that another attempt can't mend."""


def transient(status: int) -> bool:
    """429 and 5xx pass; other 4xx stay."""
    return status == 429 or status >= 500


def with_retries(call: Callable[[], object], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The call's result; failures but Permanent are tried again after waits that double up to a cap."""
    for i in range(attempts):
        try:
            return call()
        except Permanent:
            raise
        except Exception:
            if i + 1 == attempts:
                raise
            sleep(min(FIRST_WAIT_S * 2**i, MOST_WAIT_S))
    return None

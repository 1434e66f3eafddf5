"""Answers from hits: contexts, citations, the extractive answer and its token stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BAD_REQUEST, EngineError
from ..functions.text import answer_excerpt

# Texts of the extractive answer.
HEADER = "[MOCK] 基于检索片段的抽取式回答："
NOTHING = "知识库中暂无足够证据，请先入库文档或图片。"
EVIDENCE = "综合下列证据：\n"
CONTEXTS = 4


def check_question(question: str | None) -> str:
    if not question:
        raise EngineError(BAD_REQUEST, "question required")
    return question


def citations(hits: DataFrame) -> DataFrame:
    """(qid, index, id, context): each hit's title and content (else caption), numbered from 1."""
    body = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("caption", F.lit("")))
    return hits.select("qid", F.col("position").alias("index"), "id", F.concat("title", F.lit(" "), body).alias("context"))


def answers(questions: DataFrame, cites: DataFrame) -> DataFrame:
    """(qid, answer) of questions (qid, query): the first four contexts, excerpted and numbered; a fixed text without any."""
    few = cites.where(F.col("index") <= CONTEXTS).select("qid", F.struct("index", answer_excerpt(F.col("context")).alias("t")).alias("c"))
    lists = few.groupBy("qid").agg(F.sort_array(F.collect_list("c")).alias("cs"))  # at most four each
    lines = F.array_join(F.transform("cs", lambda c, i: F.concat((i + 1).cast("string"), F.lit(") "), c["t"], F.lit("\n"))), "")
    joined = questions.join(lists, "qid", "left")
    body = F.when(F.col("cs").isNull(), F.lit(NOTHING)).otherwise(F.concat(F.lit(EVIDENCE), lines))
    return joined.select("qid", F.concat(F.lit(HEADER), F.coalesce("query", F.lit("")), F.lit("\n\n"), body).alias("answer"))


def token_stream(answer: DataFrame) -> DataFrame:
    """(qid, seq, event, data): a token event for each character, then done."""
    chars = F.regexp_extract_all("answer", F.lit(r"[\s\S]"), F.lit(0))
    events = F.concat(
        F.transform(chars, lambda c, i: F.struct(i.alias("seq"), F.lit("token").alias("event"), c.alias("data"))),
        F.array(F.struct(F.size(chars).alias("seq"), F.lit("done").alias("event"), F.lit("").alias("data"))),
    )
    return answer.select("qid", F.explode(events).alias("e")).select("qid", "e.*")


def event_stream(answer: DataFrame, cites: DataFrame) -> DataFrame:
    """(qid, seq, event, data): meta (JSON of the citations) first, a token event for each character, an error if the call failed, done.

    ``answer``: qid, answer and optionally ok, error as answers_by gives them.
    """
    have = set(answer.columns)
    failed = ~F.coalesce(F.col("ok"), F.lit(True)) if "ok" in have else F.lit(False)
    error = F.coalesce(F.col("error"), F.lit("")) if "error" in have else F.lit("")
    lists = cites.groupBy("qid").agg(F.to_json(F.sort_array(F.collect_list(F.struct("index", "id")))).alias("_cites"))  # those of one answer
    rows = answer.join(lists, "qid", "left")
    none = F.array().cast("array<struct<event:string,data:string>>")
    one = lambda kind, data: F.array(F.struct(F.lit(kind).alias("event"), data.alias("data")))
    chars = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"[\s\S]"), F.lit(0)), lambda c: F.struct(F.lit("token").alias("event"), c.alias("data")))
    events = F.concat(one("meta", F.coalesce("_cites", F.lit("[]"))), chars, F.when(failed, one("error", error)).otherwise(none), one("done", F.lit("")))
    return rows.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", "e.event", "e.data")


def answers_by(questions: DataFrame, cites: DataFrame, generate: Callable[[str, list[str]], str]) -> DataFrame:
    """(qid, answer, ok, error) by a function of question and contexts, for a model of one's own; a failure is a row, not a lost batch."""
    lists = cites.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "context"))), lambda c: c["context"]).alias("contexts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for qid, q, c in zip(f["qid"], f["query"], f["contexts"]):
                try:
                    rows.append((qid, generate(q, list(c) if c is not None else []), True, None))
                except Exception as e:  # noqa: BLE001 - told in the row
                    rows.append((qid, None, False, str(e)))
            yield pd.DataFrame(rows, columns=["qid", "answer", "ok", "error"])

    return questions.select("qid", "query").join(lists, "qid", "left").mapInPandas(run, "qid long, answer string, ok boolean, error string")

"""Prompts, citations and extractive answers from ranked evidence."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import WS, strip

#: Texts of prompts and answers.
REFUSAL = "当前知识库没有检索到足够证据，暂时无法给出可靠结论。"
HEADER = "根据当前知识库，可以得到以下信息："
FOOTER = "\n以上结论仅依据已索引材料，请结合原文发布日期和完整上下文核验。"
BLANK_QUESTION = "问题不能为空"
EVIDENCE = r"(?s)\[证据(\d+)\].*?\n内容：(.*?)(?=\n\[证据\d+\]|\n\n图谱关系：|\z)"
EVIDENCE_TITLE, EVIDENCE_SOURCE, EVIDENCE_DATE, EVIDENCE_PAGE, EVIDENCE_TEXT = "标题：", "来源：", "发布日期：", "页码：", "内容："
NO_PAGE, NO_DATE, NOTHING = "无", "未提供", "无"
PROMPT_QUESTION, PROMPT_TEXTS, PROMPT_EDGES, PROMPT_END = "用户问题：", "\n\n文本证据：\n", "\n\n图谱关系：\n", "\n\n请直接给出答案，并按规则引用证据。"
SYSTEM = "只依据给出的证据和图谱关系回答；证据不足时说明不足；每个结论标注证据编号；不编造数字、日期和来源；不提供投资建议。"
MOST_EXCERPT, MOST_SENTENCE, MOST_POINTS, MOST_RELATIONS = 220, 180, 3, 30


def check_questions(questions: DataFrame) -> None:
    """Null questions and those of white space only raise."""
    if questions.where(F.col("question").isNull() | (strip(F.col("question")) == "")).limit(1).count():
        raise ValueError(BLANK_QUESTION)


def excerpt(content: Column) -> Column:
    return F.when(F.length(content) > MOST_EXCERPT, F.concat(F.substring(content, 1, MOST_EXCERPT), F.lit("…"))).otherwise(content)


def citations(evidence: DataFrame) -> DataFrame:
    """``query_id, number, chunk_id, title, source, page_number, score, excerpt`` in order of rank."""
    return evidence.select("query_id", F.col("rank").alias("number"), "chunk_id", "title", "source", "page_number", "score", excerpt(F.col("content")).alias("excerpt"))


def citations_for_display(cited: DataFrame) -> DataFrame:
    """Scores to four places, blanks for missing pages."""
    return cited.select("query_id", "number", "title", "source", F.coalesce(F.col("page_number").cast("string"), F.lit("")).alias("page"), F.round("score", 4).alias("score"), "excerpt")


def first_sentence(text: Column) -> Column:
    """White space collapsed; up to and with the first end mark; longer ones cut."""
    plain = strip(F.regexp_replace(text, f"[{WS}]+", " "))
    sentence = F.regexp_extract(plain, "^[^。！？!?]*[。！？!?]?", 0)
    cut = F.concat(F.regexp_replace(F.substring(sentence, 1, MOST_SENTENCE), f"[{WS}]+$", ""), F.lit("…"))
    return F.when(F.length(sentence) > MOST_SENTENCE, cut).otherwise(sentence)


def evidence_block() -> Column:
    """Six lines of one row of evidence; a missing or zero page prints NO_PAGE."""
    page = F.when(F.coalesce(F.col("page_number"), F.lit(0)) == 0, NO_PAGE).otherwise(F.col("page_number").cast("string"))
    date = F.when(F.coalesce(F.col("publish_time"), F.lit("")) == "", NO_DATE).otherwise(F.col("publish_time"))
    none = F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[证据"), F.col("rank").cast("string"), F.lit("]")),
        F.concat(F.lit(EVIDENCE_TITLE), F.coalesce("title", none)),
        F.concat(F.lit(EVIDENCE_SOURCE), F.coalesce("source", none)),
        F.concat(F.lit(EVIDENCE_DATE), date),
        F.concat(F.lit(EVIDENCE_PAGE), page),
        F.concat(F.lit(EVIDENCE_TEXT), F.coalesce("content", none)),
    )


def prompts(questions: DataFrame, evidence: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """``query_id, question, prompt, n_evidence``; relations (query_id, pos, source, relation, target) are cut at 30.

    A question has few pieces of evidence (its top-k) and at most 30 relations, so the lists are bounded.
    """
    blocks = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", evidence_block().alias("block")))).alias("blocks"))
    out = questions.join(blocks, "query_id", "left")
    if relations is not None:
        first = relations.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("_n") <= MOST_RELATIONS)
        line = F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target")
        lines = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("lines"))
        out = out.join(lines, "query_id", "left")
    else:
        out = out.withColumn("lines", F.lit(None).cast("array<struct<_n:int,line:string>>"))
    body = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit(NOTHING))
    edges = F.coalesce(F.array_join(F.transform("lines", lambda b: b["line"]), "\n"), F.lit(NOTHING))
    prompt = F.concat(F.lit(PROMPT_QUESTION), "question", F.lit(PROMPT_TEXTS), body, F.lit(PROMPT_EDGES), edges, F.lit(PROMPT_END))
    return out.select("query_id", "question", prompt.alias("prompt"), F.coalesce(F.size("blocks"), F.lit(0)).alias("n_evidence"))


def extractive(prompt: Column) -> Column:
    """The answer read from a prompt: first sentences of its first three pieces of evidence."""
    numbers = F.slice(F.regexp_extract_all(prompt, F.lit(EVIDENCE), F.lit(1)), 1, MOST_POINTS)
    texts = F.slice(F.regexp_extract_all(prompt, F.lit(EVIDENCE), F.lit(2)), 1, MOST_POINTS)
    points = F.filter(F.zip_with(numbers, texts, lambda n, t: F.struct(n.alias("n"), first_sentence(t).alias("s"))), lambda p: p["s"] != "")
    lines = F.transform(points, lambda p: F.concat(F.lit("- "), p["s"], F.lit("[证据"), p["n"], F.lit("]")))
    return F.when(F.size(numbers) == 0, REFUSAL).otherwise(F.concat_ws("\n", F.concat(F.array(F.lit(HEADER)), lines, F.array(F.lit(FOOTER)))))


def answers(prompted: DataFrame) -> DataFrame:
    return prompted.select("query_id", "question", extractive(F.col("prompt")).alias("answer"))


def remote_answers(prompted: DataFrame, base_url: str, model: str, api_key: str = "", timeout: int = 120) -> DataFrame:
    """Answers of a chat-completions service, one request a row; connections are made by the tasks."""
    if not base_url:
        raise ValueError("base_url must be set")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for prompt in batch["prompt"]:
                body = {"model": model, "temperature": 0.1, "stream": False, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]}
                texts.append(post_json(f"{base_url.rstrip('/')}/chat/completions", body, api_key, timeout)["choices"][0]["message"]["content"].strip())
            yield pd.DataFrame({"query_id": batch["query_id"], "question": batch["question"], "answer": texts})

    kind = prompted.schema["query_id"].dataType.simpleString()
    return prompted.select("query_id", "question", "prompt").mapInPandas(run, f"query_id {kind}, question string, answer string")


def post_json(url: str, body: dict, api_key: str, timeout: int) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
            return json.loads(reply.read())
    except (urllib.error.URLError, TimeoutError, ValueError) as error:
        raise RuntimeError(f"request to {url} failed: {error}") from error

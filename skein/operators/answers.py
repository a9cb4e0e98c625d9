"""Context, answers, citation markers, judge scores and costs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import passage_label, snippet
from ..registry import Registry
from ..shared import small

# Lengths, bounds of markers, and answers that need no model.
PASSAGE_CHARS, SNIPPET_CHARS, WIDEST_RANGE, LAST_PASSAGE, LOW_CITATIONS = 5000, 300, 10, 100, 3.5
ABSTAIN_WORD = "INSUFFICIENT_CONTEXT"
NO_CONTEXT = "No relevant passages were retrieved for this question."
ABSTAINED = "The retrieved passages do not answer this question."
JUDGED = ("relevance", "accuracy", "completeness", "citation_quality")
_MARKER = r"\[\s*(\d+(?:\s*[,;-]\s*\d+)*)\s*\]"


def build_context(passages: DataFrame, passage_chars: int = PASSAGE_CHARS) -> DataFrame:
    """``query_id, context``: labelled passages in order of rank, a blank line between.

    ``passages(query_id, rank, source, page_number, content)``: the passages of a
    query are the few that were retrieved for it.
    """
    label = passage_label(F.col("rank"), F.col("source"), F.col("page_number"))
    block = F.concat(label, F.lit("\n"), snippet(F.coalesce("content", F.lit("")), passage_chars, " ..."))
    rows = passages.select("query_id", "rank", F.coalesce(block, F.lit("")).alias("block"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"))


def parse_markers(answer: Column) -> Column:
    """Passage numbers cited in ``answer``, each at its first mention.

    ``[1-3]`` counts up where it spans ten numbers at most and stays within a
    hundred; other ranges count as their ends; what isn't a number is left out.
    """

    def part(p: Column) -> Column:
        ends = F.split(p, r"\s*-\s*")
        lo, hi = F.trim(F.get(ends, 0)).try_cast("int"), F.trim(F.get(ends, 1)).try_cast("int")
        spread = (F.size(ends) == 2) & (hi > lo) & (hi - lo <= WIDEST_RANGE) & (hi <= LAST_PASSAGE)
        run = F.when(spread, F.sequence(F.least(lo, hi), F.greatest(lo, hi)))
        return F.coalesce(run, F.transform(ends, lambda x: F.trim(x).try_cast("int")))

    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(_MARKER), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.flatten(F.transform(F.split(g, r"\s*[,;]\s*"), part))))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def unresolved_markers(markers: Column, passages: Column) -> Column:
    """Markers that name no passage of 1 to ``passages``."""
    return F.filter(markers, lambda n: (n < 1) | (n > passages))


def citations(answers: DataFrame, passages: DataFrame, snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """``query_id, position, marker, chunk_id, source, page_number, text_snippet, relevance_score``.

    One row for each marker of ``answers(query_id, answer)`` that names a passage.
    """
    marks = answers.select("query_id", F.posexplode(parse_markers(F.col("answer"))).alias("position", "marker"))
    p = passages.withColumnRenamed("rank", "marker")
    return marks.join(p, ["query_id", "marker"]).select(
        "query_id", "position", "marker", "chunk_id", "source", "page_number",
        snippet(F.coalesce("content", F.lit("")), snippet_chars, "...").alias("text_snippet"), F.col("score").alias("relevance_score"),
    )


def answer_status(raw: Column, passages: Column) -> Column:
    """``STRUCT<answer, confidence>``: the fixed answers without passages or on abstention, else the model's."""
    none = F.struct(F.lit(NO_CONTEXT).alias("answer"), F.lit(0.0).alias("confidence"))
    abstained = F.struct(F.lit(ABSTAINED).alias("answer"), F.lit(0.0).alias("confidence"))
    given = F.struct(raw.alias("answer"), F.lit(None).cast("double").alias("confidence"))
    return F.when(F.coalesce(passages, F.lit(0)) == 0, none).when(F.startswith(F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.lit(ABSTAIN_WORD)), abstained).otherwise(given)


def extractive_answer(passages: DataFrame, most: int = 2, chars: int = 120) -> DataFrame:
    """The offline model: the openings of the first passages, each with its marker."""
    piece = F.concat(snippet(F.coalesce("content", F.lit("")), chars, "..."), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    rows = passages.filter(F.col("rank") <= most).select("query_id", "rank", piece.alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "piece")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), " ").alias("answer"))


def with_retries(model: Callable[[str], str], transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), tries: int = 3, wait: float = 2.0, growth: float = 2.0, **settings) -> Callable[[str], str]:
    """``model`` called again after a transient error, ``wait`` seconds later and each time ``growth`` times longer.

    ``settings``, such as a temperature, are passed to the model if they aren't zero or None.
    """
    given = {k: v for k, v in settings.items() if v}

    def call(prompt: str) -> str:
        import time

        for n in range(tries - 1):
            try:
                return model(prompt, **given)
            except transient:
                time.sleep(wait * growth**n)
        return model(prompt, **given)

    return call


def model_column(prompt: Column, model: Callable[[str], str]) -> Column:
    """Answers of a model to a column of prompts, in Arrow batches."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else model(p))

    return ask(prompt)


def metered(prompt: Column, model: Callable[[str], tuple[str, int, int, int]], **retries) -> Column:
    """``STRUCT<answer, input_tokens, cached_tokens, output_tokens>`` of a model that counts; cached tokens aren't counted as input again."""
    ask = with_retries(model, **retries)

    @F.pandas_udf("answer string, input_tokens bigint, cached_tokens bigint, output_tokens bigint")
    def call(prompts: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0, 0) if p is None else ask(p) for p in prompts]
        return pd.DataFrame([(a, max(i - c, 0), c, o) for a, i, c, o in rows], columns=["answer", "input_tokens", "cached_tokens", "output_tokens"])

    return call(prompt)


def usage_totals(usage: DataFrame, key: str = "model") -> DataFrame:
    """``key, calls`` and the sums of tokens."""
    return usage.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])


#: Language models, factories of ``prompt -> answer``; none is shipped, a user registers them.
LANGUAGE_MODELS: Registry = Registry("language model")


def get_model(name: str) -> Callable[[str], str]:
    """A language model by ``name`` or ``name:version``."""
    head, _, version = name.partition(":")
    make = LANGUAGE_MODELS.named(head)
    return make(version) if version else make()


def checked_question(question: str) -> str:
    """A question that isn't blank, without outer white space."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    return question.strip()


NO_PASSAGES = "(no passages were retrieved)"
JUDGE_TEMPLATE = "Question:\n{question}\n\nPassages:\n{context}\n\nAnswer:\n{answer}\n{reference}\nGive JSON with " + ", ".join(JUDGED) + " from 1 to 5 and a rationale."


def judge_prompts(answers: DataFrame, contexts: DataFrame, references: DataFrame | None = None, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """``query_id, prompt``: what a judge is asked about each answer, with the passages that it was made from.

    ``answers(query_id, query, answer)``, ``contexts(query_id, context)`` as ``build_context``
    gives them, ``references(query_id, reference)``; without a reference its block is left out.
    """
    rows = answers.join(contexts, "query_id", "left")
    rows = rows.join(references, "query_id", "left") if references is not None else rows.withColumn("reference", F.lit(None).cast("string"))
    block = F.when(F.col("reference").isNotNull(), F.concat(F.lit("\nReference answer:\n"), "reference", F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("query_id", render(template, question=F.col("query"), context=F.coalesce("context", F.lit(NO_PASSAGES)), answer=F.col("answer"), reference=block).alias("prompt"))


def judge(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """The marks that ``model`` gives, as in ``judge_scores``."""
    return judge_scores(prompts.select("query_id", model_column(F.col("prompt"), model).alias("raw")))


def render(template: str, **fields: Column) -> Column:
    """``template`` with ``{name}`` replaced by columns."""
    out: Column = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def parse_judge(raw: Column) -> Column:
    """``STRUCT`` of four marks and a rationale from a judge's JSON; null unless all marks are 1 to 5."""
    kind = ", ".join(f"{n} INT" for n in JUDGED) + ", rationale STRING"
    s = F.from_json(raw, kind, {"mode": "PERMISSIVE"})
    ok = F.lit(True)
    for n in JUDGED:
        ok = ok & F.coalesce(s[n].between(1, 5), F.lit(False))
    return F.when(ok, s)


def judge_average(s: Column) -> Column:
    """Mean of the four marks."""
    return sum((s[n] for n in JUDGED[1:]), s[JUDGED[0]]) / 4.0


def judge_scores(raw: DataFrame) -> DataFrame:
    """``query_id``, the marks, ``average`` and ``confidence`` of ``raw(query_id, raw)``; unreadable ones are left out."""
    rows = raw.select("query_id", parse_judge(F.col("raw")).alias("s")).filter("s is not null")
    avg = judge_average(F.col("s"))
    return rows.select("query_id", *[F.col(f"s.{n}").alias(n) for n in JUDGED], avg.alias("average"), ((avg - 1.0) / 4.0).alias("confidence"))


def judge_means(scores: DataFrame) -> DataFrame:
    """One row: the number of scores, means of all marks, and whether citations are poor."""
    means = [F.round(F.avg(c), 6).alias(c) for c in (*JUDGED, "average")]
    return scores.agg(F.count(F.lit(1)).alias("scored"), *means).withColumn("citation_quality_is_low", F.coalesce(F.col("citation_quality") < LOW_CITATIONS, F.lit(False)))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage(model, input_tokens, cached_tokens, output_tokens)`` with ``cost_usd``; null for unknown models."""
    p = small(prices)
    cached = F.coalesce("cached_input_per_1m", "input_per_1m")
    usd = (F.col("input_tokens") * F.col("input_per_1m") + F.col("cached_tokens") * cached + F.col("output_tokens") * F.col("output_per_1m")) / 1e6
    return usage.join(p, "model", "left").withColumn("cost_usd", usd).drop("input_per_1m", "cached_input_per_1m", "output_per_1m")

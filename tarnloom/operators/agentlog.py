"""Folds of an agent's message log ``(thread, turn, role, content, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands in for a result that never came, and for pruned content.
INTERRUPTED = "The previous tool call did not complete because the run was interrupted. Retry the action if it is still needed."
STALE_SNAPSHOT = "[stale page snapshot pruned to save context — call get_snapshot to re-read this page; earlier refs are no longer valid]"
STALE_SCREENSHOT = "[earlier screenshot omitted to save context]"
PLACEHOLDERS = {"snapshot": STALE_SNAPSHOT, "screenshot": STALE_SCREENSHOT}
TRACE_LENGTH = 16


def dangling_calls(calls: DataFrame, results: DataFrame, thread: str = "thread") -> DataFrame:
    """A result for each call that has none: ``thread, call_id, name, content``; a repeated id is answered once."""
    known = calls.filter(F.col("call_id").isNotNull() & (F.col("call_id") != ""))
    first = known.groupBy(thread, "call_id").agg(F.min_by("name", "turn").alias("name"))
    return first.join(results.select(thread, "call_id"), [thread, "call_id"], "left_anti").withColumn("content", F.lit(INTERRUPTED))


def usage(messages: DataFrame, baseline: Column, input_price: float, output_price: float, thread: str = "thread") -> DataFrame:
    """Tokens and cost (prices per token) of the assistant's messages from turn ``baseline`` on."""
    own = messages.filter((F.col("role") == "assistant") & (F.col("turn") >= baseline))
    tokens = own.groupBy(thread).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return tokens.withColumn("cost", F.round(F.col("input_tokens") * input_price + F.col("output_tokens") * output_price, 6))


def budget_stop(messages: DataFrame, limit: float, thread: str = "thread", cost: str = "cost") -> DataFrame:
    """The first turn of each thread at which the running cost is over the limit, and that cost."""
    upto = Window.partitionBy(thread).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = messages.withColumn("spent", F.sum(cost).over(upto)).filter(F.col("spent") > limit)
    return running.groupBy(thread).agg(F.min("turn").alias("turn"), F.min_by("spent", "turn").alias("spent"))


def strip_calls(messages: DataFrame, stopped: DataFrame, thread: str = "thread") -> DataFrame:
    """``messages`` whose tool calls are dropped from the turn of :func:`budget_stop` on."""
    at = stopped.select(thread, F.col("turn").alias("__stop"))
    out = messages.join(at, thread, "left")
    return out.withColumn("tool_calls", F.when(F.col("__stop").isNull() | (F.col("turn") < F.col("__stop")), F.col("tool_calls"))).select(*messages.columns)


def final_answer(messages: DataFrame, thread: str = "thread", content: str = "content") -> DataFrame:
    """The last assistant message with content, else an empty text."""
    said = (F.col("role") == "assistant") & (F.col(content) != "")
    return messages.groupBy(thread).agg(F.coalesce(F.max_by(F.when(said, F.col(content)), F.when(said, F.col("turn"))), F.lit("")).alias("answer"))


def tools_used(calls: DataFrame, messages: DataFrame, thread: str = "thread") -> DataFrame:
    """Names of the called tools in order, and the number of assistant messages."""
    names = calls.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "position", "name"))), lambda s: s["name"]).alias("tools"))
    n = messages.groupBy(thread).agg(F.count_if(F.col("role") == "assistant").alias("iterations"))
    return n.join(names, thread, "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))


def prune(messages: DataFrame, thread: str = "thread", kind: str = "kind", content: str = "content") -> DataFrame:
    """All but the latest message of each kind in ``PLACEHOLDERS`` with its content replaced; no row goes.

    One aggregation and a join rather than a window: a thread of any length is no single task's.
    """
    latest = messages.filter(F.col(kind).isin(list(PLACEHOLDERS))).groupBy(thread, kind).agg(F.max("turn").alias("__latest"))
    note = F.element_at(F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv)), F.col(kind))
    out = messages.join(latest, [thread, kind], "left")
    return out.withColumn(content, F.when(F.col("__latest") > F.col("turn"), note).otherwise(F.col(content))).select(*messages.columns)


def tool_trace(calls: DataFrame, thread: str = "thread", length: int = TRACE_LENGTH) -> DataFrame:
    """The last calls as ``name(detail)``; only those are kept before they are gathered."""
    nth = F.row_number().over(Window.partitionBy(thread).orderBy(F.col("turn").desc(), F.col("position").desc()))
    text = F.when(F.coalesce("detail", F.lit("")) != "", F.concat("name", F.lit("("), "detail", F.lit(")"))).otherwise(F.col("name"))
    last = calls.withColumn("__nth", nth).filter(F.col("__nth") <= length).withColumn("text", text)
    return last.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "position", "text"))), lambda s: s["text"]).alias("trace"))


def step_limit(max_iterations: int) -> int:
    """Steps of the driver's loop: a model call and a tool call per iteration."""
    return 2 * max_iterations

"""Token budgets and history of ordered conversations.

Messages are rows (conv_id, pos, role, content, ...). Nothing sorts or collects a
whole conversation except the rendering of its history, which is one text by
definition; the rest uses partial aggregates per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: tiers, markers and caps
TIERS = ((0.92, "compact"), (0.80, "clear"), (0.70, "restrict"), (0.60, "remind"))
CLEARED = "[code block cleared – analysis already completed]"
CODE_MARKS = ("func ", "class ", "def ", "import ", "package ", "{", "```")
LARGE_BYTES, KEPT, REMINDER_BYTES, REMINDER_RECORDS, STEP_LIMIT = 2000, 10, 8000, 5, 100


def message_text(role: Column, content: Column, calls: Column | None = None) -> Column:
    base = F.concat(role, F.lit(": "), F.coalesce(content, F.lit("")))
    if calls is None:
        return base
    return F.concat(base, F.coalesce(F.array_join(F.transform(calls, lambda c: F.concat(F.lit(" [tool_call:"), c["name"], F.lit("("), c["arguments"], F.lit(")]"))), ""), F.lit("")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4)


def token_counts(messages: DataFrame, calls: str | None = None) -> DataFrame:
    """conv_id, messages, tokens."""
    text = message_text(F.col("role"), F.col("content"), F.col(calls) if calls else None)
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(estimated_tokens(text)).alias("tokens"))


def token_counts_by(messages: DataFrame, counter: Column) -> DataFrame:
    """As token_counts with an exact tokenizer's count column: 4 more a message, 3 a conversation; empty texts count 0."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), (F.sum(F.when(F.coalesce("content", F.lit("")) == "", 0).otherwise(counter + 4)) + 3).alias("tokens"))


def ratio(tokens: Column, most: int) -> Column:
    return tokens / F.lit(float(most)) if most > 0 else F.lit(0.0)


def tier(r: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(TIERS):
        out = F.when(r >= least, name).otherwise(out)
    return out


def is_large_code(content: Column, least: int = LARGE_BYTES) -> Column:
    marks = content.contains(CODE_MARKS[0])
    for m in CODE_MARKS[1:]:
        marks = marks | content.contains(m)
    return (F.octet_length(content) >= least) & content.contains("\n") & marks


def with_consumed(messages: DataFrame) -> DataFrame:
    """Adds consumed: an assistant message comes later in the conversation."""
    last = messages.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max("pos").alias("_last"))
    return messages.join(last, "conv_id", "left").withColumn("consumed", F.coalesce(F.col("_last") > F.col("pos"), F.lit(False))).drop("_last")


def cleared(messages: DataFrame, large: Column | None = None) -> DataFrame:
    """Large tool results that were consumed hold the marker instead; ids and places stay."""
    big = is_large_code(F.col("content")) if large is None else large
    gone = (F.col("role") == "tool") & F.col("consumed") & big
    return with_consumed(messages).withColumn("content", F.when(gone, CLEARED).otherwise(F.col("content")))


def tail(messages: DataFrame, n: int = KEPT) -> DataFrame:
    """The last n messages of each conversation; a limit per group before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.col("pos").desc())
    return messages.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, history as one text in order."""
    label = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("Tool Result: ")
    part = F.concat(label, F.coalesce("content", F.lit("")), F.coalesce("call_text", F.lit("")) if "call_text" in messages.columns else F.lit(""), F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("t"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("history"))


def compacted(messages: DataFrame, summaries: DataFrame, instruction: str, n: int = KEPT) -> DataFrame:
    """[instruction, summary] and the last n; unchanged where the summary is null or empty."""
    s = summaries.where(F.coalesce("summary", F.lit("")) != "").select("conv_id", "summary")
    kept = tail(messages.join(s.select("conv_id"), "conv_id", "left_semi"), n).select("conv_id", "pos", "role", "content")
    same = messages.join(s.select("conv_id"), "conv_id", "left_anti").select("conv_id", "pos", "role", "content")
    head = messages.select("conv_id").distinct().join(s, "conv_id").select("conv_id", F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("pos"), F.lit("user").alias("role"), F.lit(instruction).alias("content")),
        F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("assistant").alias("role"), F.col("summary").alias("content")),
    )))
    return head.unionByName(kept).unionByName(same)


def injected(messages: DataFrame, reminders: DataFrame) -> DataFrame:
    """A reminder before the conversation, unless it is empty."""
    r = reminders.where(F.coalesce("reminder", F.lit("")) != "")
    first = messages.select("conv_id").distinct().join(r, "conv_id").select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("user").alias("role"), F.col("reminder").alias("content"))
    return first.unionByName(messages.select("conv_id", "pos", "role", "content"))


def last_assistant(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max_by("content", "pos").alias("content"))


def paired_calls(calls: DataFrame, results: DataFrame, tools: list[str]) -> DataFrame:
    """Each call with its result in the calls' order; unknown tools give an error text, missing results null."""
    known = F.col("name").isin(*tools)
    r = results.select("conv_id", F.col("tool_call_id").alias("call_id"), F.col("content").alias("_c"), F.col("pos").alias("_p"))
    first = r.groupBy("conv_id", "call_id").agg(F.min_by("_c", "_p").alias("result"))
    out = calls.join(first, ["conv_id", "call_id"], "left")
    return out.withColumn("result", F.when(~known, F.concat(F.lit("error: unknown tool "), "name")).otherwise(F.col("result")))


def stop_reason(finish: Column, calls: Column) -> Column:
    """tool_use when there are calls or the finish says so; max_tokens for length; else end_turn."""
    by_finish = F.when(finish.isin("tool_calls", "function_call"), "tool_use").when(finish == "length", "max_tokens").otherwise("end_turn")
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, "tool_use").otherwise(by_finish)


def reminders(records: DataFrame, progress: DataFrame, most: int = REMINDER_BYTES, top: int = REMINDER_RECORDS) -> DataFrame:
    """task_id, reminder. records: task_id, ord, repo_name, symbol, summary; progress: task_id, step, nodes.

    Knowledge lines stop at the first that passes the byte budget; the progress header,
    the list of done nodes and the step line are each left out where they don't fit.
    """
    head1, head2 = "## 相关历史知识\n", "\n## 当前分析进度\n"
    line = F.concat(F.lit("- "), "repo_name", F.lit("/"), "symbol", F.lit("："), "summary", F.lit("\n"))
    w = Window.partitionBy("task_id").orderBy("ord")
    r = records.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).withColumn("l", F.coalesce(line, F.lit("")))
    r = r.withColumn("_b", F.sum(F.octet_length("l")).over(w) + len(head1.encode()))
    part1 = r.groupBy("task_id").agg(F.concat(F.lit(head1), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_b") <= most, F.struct("ord", "l")))), lambda x: x["l"]), "")).alias("a"))
    both = part1.join(progress.select("task_id", "step", "nodes"), "task_id", "full")
    a = F.coalesce("a", F.lit(""))
    room = lambda text, more: F.octet_length(text) + F.octet_length(more) <= most
    b = F.when(F.col("step").isNotNull() & room(a, F.lit(head2)), F.concat(a, F.lit(head2)))
    done = F.concat(F.lit("- 已完成节点："), F.array_join("nodes", ", "), F.lit("\n"))
    c = F.when((F.size("nodes") > 0) & room(b, done), F.concat(b, done)).otherwise(b)
    step = F.concat(F.lit("- 当前步骤："), F.col("step").cast("string"), F.lit("\n"))
    d = F.when(room(c, step), F.concat(c, step)).otherwise(c)
    return both.select("task_id", F.coalesce(d, a).alias("reminder"))


def run_outcomes(messages: DataFrame, limit: int = STEP_LIMIT) -> DataFrame:
    """conv_id, steps, tools, truncated, content of each run: an assistant message is a step; a run that uses up its steps is
    truncated and ends with its last content."""
    assistant = F.col("role") == "assistant"
    return messages.groupBy("conv_id").agg(
        F.count_if(assistant).alias("steps"), F.count_if(F.col("role") == "tool").alias("tools"), (F.count_if(assistant) >= limit).alias("truncated"), F.coalesce(F.max_by("content", F.when(assistant, F.col("pos"))), F.lit("")).alias("content")
    )


def system_prompt(repos: DataFrame, workspace: str, goal: str, tools: list[str], role: str, strategy: str) -> DataFrame:
    """One row, prompt: role, workspace, repositories in the order of ord, goal, tools and strategy. repos: ord, repo_name, repo_path, repo_role, url.

    The list of repositories is one text by definition; a repository without a URL has no such line.
    """
    # fixed values: headings and field names of the prompt
    url = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("\n  URL:  "), "url")).otherwise("")
    line = F.concat(F.lit("\n- Name: "), F.coalesce("repo_name", F.lit("")), F.lit("\n  Path: "), F.coalesce("repo_path", F.lit("")), F.lit("\n  Role: "), F.coalesce("repo_role", F.lit("")), url)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "")
    head = f"{role}\n\n## Workspace\nDirectory: {workspace}\n\n## Repositories"
    tail = f"\n\n## Analysis Goal\n{goal}\n\n## Available Tools" + "".join(f"\n- {t}" for t in tools) + f"\n\n## Analysis Strategy\n{strategy}\n"
    return repos.agg(F.concat(F.lit(head), lines, F.lit(tail)).alias("prompt"))

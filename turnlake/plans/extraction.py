"""Facts from pending sessions, and what they change in the memory table.

The relational steps are one Spark plan each; the language model is a callable
``prompt -> answer`` run on the executors. Answers are checkpointed before use,
because a model call must not be repeated when a later stage is recomputed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import dates
from turnlake.functions import text as tx
from turnlake.operators import documents, memories, similarity, slices
from turnlake.session import cut_lineage

Model = Callable[[str], str]

# --- fixed values -----------------------------------------------------------
SIMILAR_MEMORIES = 5
NO_MEMORIES = "(no existing memories found)"
NOTHING = "(none)"
FAILURES_IN_A_ROW = 5
# ----------------------------------------------------------------------------
WAVE = 64  # prompts sent out between two looks at what failed
WAVE_TASKS = 8
NOT_ASKED = "not asked: too many failures in a row"


@dataclass(frozen=True)
class Prompts:
    """Templates with ``{name}`` placeholders."""

    extract: str = (
        "Known profile:\n{existing_profile}\n\nSummary so far:\n{rolling_summary}\n\n"
        "Date: {conversation_date}\n\nConversation:\n{conversation}\n\n"
        'Answer as JSON: {"facts": [{"text": "", "category": "", "confidence": ""}], "summary_update": ""}'
    )
    update: str = (
        "New fact:\n{new_fact}\n\nStored memories:\n{existing_memories}\n\n"
        'Answer as JSON: {"action": "ADD|UPDATE|INVALIDATE|NOOP", "targetId": "", "reason": ""}'
    )
    profile: str = "Write a short profile from these memories:\n{memories}"


def fill(template: str, **values: Column) -> Column:
    """Template with its known placeholders replaced; values are not re-scanned."""
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.index("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not found:
            break
        start, name = min(found)
        pieces += [F.lit(rest[:start]), values[name]]
        rest = rest[start + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))


def cleaned_messages(messages: DataFrame, context_tag: str = tx.CONTEXT_TAG) -> DataFrame:
    """Cleaned section text per message row; rows with nothing left are dropped.

    Sections never span messages, so cleaning needs no whole document.
    """
    section = documents.section(F.col("role"), F.col("text"))
    cleaned = messages.withColumn("cleaned", documents.clean_session(section, context_tag))
    return cleaned.filter(F.length("cleaned") > 0).drop("text", "role")


def clean_sections(messages: DataFrame, context_tag: str = tx.CONTEXT_TAG) -> DataFrame:
    """(conv_id, turn, text): cleaned conversations, one row per section that is left."""
    return cleaned_messages(messages, context_tag).select("conv_id", "turn", F.col("cleaned").alias("text"))


def substance(messages: DataFrame, context_tag: str = tx.CONTEXT_TAG) -> DataFrame:
    """(conv_id, substantive): at least two real user messages; a plain sum."""
    sections = documents.substantive_sections(F.col("cleaned"))
    counted = cleaned_messages(messages, context_tag).groupBy("conv_id").agg(F.sum(sections).alias("_n"))
    everyone = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows"))
    return everyone.join(counted, "conv_id", "left").select(
        "conv_id", (F.coalesce("_n", F.lit(0)) >= documents.MIN_USER_SECTIONS).alias("substantive")
    )


def session_texts(sessions: DataFrame, messages: DataFrame, context_tag: str = tx.CONTEXT_TAG) -> DataFrame:
    """(capture_id, text, n_user) for representatives (capture_id, conv_id, end_turn).

    A session is one text whatever its length, as it is one prompt of a model.
    """
    members = (
        cleaned_messages(messages, context_tag)
        .join(sessions.select("capture_id", "conv_id", "end_turn"), "conv_id")
        .filter(F.col("turn") <= F.col("end_turn"))
    )
    listed = F.array_sort(F.collect_list(F.struct("turn", "cleaned")))
    return members.groupBy("capture_id").agg(
        F.array_join(F.transform(listed, lambda m: m["cleaned"]), "\n\n").alias("text"),
        F.sum(documents.substantive_sections(F.col("cleaned"))).alias("n_user"),
    )


def ask(prompts: DataFrame, key: str, model: Model, stop_after: int | None = None) -> DataFrame:
    """(key, content, error) for rows (key, prompt); a failed call leaves its row an error, and it pending.

    With ``stop_after`` the prompts go out in waves, in order of their key, and
    a run of so many failures in that order ends them: a service that is down is
    not asked for every row. Rows not asked have the error NOT_ASKED.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    answer, error = model(prompt), None
                    error = None if answer else "empty answer"
                except Exception as problem:  # noqa: BLE001 - any model failure leaves the row pending
                    answer, error = None, str(problem)
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({key: batch[key], "content": answers, "error": errors})

    schema = f"{key} string, content string, error string"
    asked = prompts.select(F.col(key).cast("string").alias(key), "prompt")
    if stop_after is None:
        return cut_lineage(asked.mapInPandas(call, schema))
    asked = cut_lineage(asked)
    waves = -(-asked.count() // WAVE)
    if waves > 1:  # ranges of keys of about WAVE rows, fixed by the checkpoint
        asked = cut_lineage(asked.repartitionByRange(waves, key).withColumn("_wave", F.spark_partition_id()))
    else:
        asked = asked.withColumn("_wave", F.lit(0))
    answers, streak = [], 0
    for wave in range(waves):
        own = asked.filter(F.col("_wave") == wave).drop("_wave").repartition(WAVE_TASKS)
        answers.append(cut_lineage(own.mapInPandas(call, schema)))
        # A flag for each prompt of the wave; the streak goes on from one wave to the next.
        for row in answers[-1].orderBy(key).select(F.col("error").isNotNull().alias("failed")).collect():
            streak = streak + 1 if row.failed else 0
            if streak >= stop_after:
                rest = asked.filter(F.col("_wave") > wave)
                unasked = rest.select(key, F.lit(None).cast("string").alias("content"), F.lit(NOT_ASKED).alias("error"))
                return reduce(DataFrame.unionByName, [*answers, unasked])
    return reduce(DataFrame.unionByName, answers) if answers else prompts.sparkSession.createDataFrame([], schema)


def extract_facts(
    pending: DataFrame,
    messages: DataFrame,
    model: Model,
    profile: str = "",
    summary: str = "",
    prompts: Prompts = Prompts(),
    context_tag: str = tx.CONTEXT_TAG,
) -> tuple[DataFrame, DataFrame]:
    """Facts of pending sessions, and the outcome per session.

    The first result has fact_id, source, valid_from and the fact columns. The
    second has capture_id and ``outcome``: skipped (too little content), done
    or failed; all but failed count as processed. Every session of a run sees
    the summary the previous run ended with.
    """
    texts = session_texts(pending, messages, context_tag)
    judged = pending.join(texts.select("capture_id", "n_user"), "capture_id", "left").withColumn(
        "worth", F.coalesce("n_user", F.lit(0)) >= documents.MIN_USER_SECTIONS
    )
    worthy = judged.filter("worth").select("capture_id", "ts")
    asked = texts.join(worthy, "capture_id").select(
        "capture_id",
        fill(
            prompts.extract,
            conversation=F.col("text"),
            existing_profile=F.lit(profile.strip() or NOTHING),
            rolling_summary=F.lit(summary.strip() or NOTHING),
            conversation_date=dates.utc_day(F.col("ts")),
        ).alias("prompt"),
    )
    answers = ask(asked, "capture_id", model, FAILURES_IN_A_ROW)
    failed_call = F.col("error").isNotNull() | memories.facts_error(F.col("content")).isNotNull()
    failed = answers.filter(failed_call).select("capture_id").distinct().withColumn("_failed", F.lit(True))
    outcomes = judged.join(failed, "capture_id", "left").select(
        "capture_id",
        F.when(~F.col("worth"), "skipped").when(F.col("_failed"), "failed").otherwise("done").alias("outcome"),
    )
    good = answers.filter(~failed_call).join(failed, "capture_id", "left_anti")
    facts = memories.parse_facts(good).join(worthy, "capture_id")
    return (
        facts.select(
            F.concat_ws("#", "capture_id", "fact_no").alias("fact_id"),
            "text",
            "category",
            "confidence",
            F.col("capture_id").alias("source"),
            F.col("ts").alias("valid_from"),
            "summary_update",
        ),
        outcomes,
    )


def decide_actions(facts: DataFrame, stored: DataFrame, model: Model, prompts: Prompts = Prompts()) -> DataFrame:
    """Add action, target_id and reason per fact, after a look at similar live memories."""
    live = stored.filter(F.col("invalidated_at").isNull())
    similar = similarity.top_k_join(
        facts, "fact_id", F.col("text"), live, "memory_id", F.col("text"), SIMILAR_MEMORIES
    ).join(live.select("memory_id", F.col("text").alias("_memory")), "memory_id")
    line = F.concat(F.lit("["), F.col("memory_id"), F.lit("] "), F.col("_memory"))
    # At most five lines per fact.
    shown = similar.groupBy("fact_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("_shown")
    )
    described = F.concat(
        F.lit("["), F.col("category"), F.lit("] ("), F.col("confidence"), F.lit(") "), F.col("text")
    )
    asked = facts.join(shown, "fact_id", "left").select(
        "fact_id",
        fill(
            prompts.update, new_fact=described, existing_memories=F.coalesce("_shown", F.lit(NO_MEMORIES))
        ).alias("prompt"),
    )
    answers = ask(asked, "fact_id", model).withColumn(
        "_decision", memories.parse_decision(F.coalesce("content", F.lit("")))
    )
    return facts.join(answers.select("fact_id", "_decision.*"), "fact_id")


def run_extraction(
    sessions: DataFrame,
    messages: DataFrame,
    processed: DataFrame,
    stored: DataFrame,
    extractor: Model,
    decider: Model,
    now: Column,
    profile: str = "",
    summary: str = "",
    prompts: Prompts = Prompts(),
) -> dict[str, DataFrame]:
    """One run: ``memories`` (next snapshot), ``processed``, ``actions`` and ``stats``.

    Callers write the snapshots with ``sources.sinks.write_snapshot``.
    """
    # Each step below feeds several results, so it is written once.
    pending = cut_lineage(sessions.join(processed.select("capture_id").distinct(), "capture_id", "left_anti"))
    facts, outcomes = extract_facts(pending, messages, extractor, profile, summary, prompts)
    facts, outcomes = cut_lineage(facts), cut_lineage(outcomes)
    actions = cut_lineage(memories.resolve_actions(decide_actions(facts, stored, decider, prompts), stored))
    done = outcomes.filter(F.col("outcome") != "failed").select("capture_id")
    sessions_done = outcomes.agg(F.count_if(F.col("outcome") == "done")).scalar()
    facts_found = facts.agg(F.count(F.lit(1))).scalar()
    return {
        "memories": memories.apply_actions(stored, actions, now),
        "processed": processed.select("capture_id").unionByName(done).distinct(),
        "actions": actions,
        "outcomes": outcomes,
        "stats": memories.action_counts(actions)
        .withColumn("conversations_processed", sessions_done)
        .withColumn("facts_extracted", facts_found),
    }


def profile_prompt_parts(lines: DataFrame, prompts: Prompts = Prompts(), group: str = "wallet_id") -> DataFrame:
    """(group, part, prompt): numbered memories cut into parts of bounded length."""
    part = F.shiftright(F.col("n") - 1, slices.SLICE_BITS)
    listed = F.array_sort(F.collect_list(F.struct("n", "line")))
    return lines.groupBy(group, part.alias("part")).agg(
        fill(
            prompts.profile, memories=F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
        ).alias("prompt")
    )

"""Markdown documents with YAML front matter: rendering, parsing, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import dates
from turnlake.functions import text as tx

# --- fixed values -----------------------------------------------------------
ROLE_HEADINGS = {"system": "## System", "user": "## User", "assistant": "## Assistant"}
MIN_USER_CHARS = 20
MIN_USER_SECTIONS = 2
# ----------------------------------------------------------------------------

FRONT_MATTER = r"\A---\n([\s\S]*?)\n---"


def front_matter(entries: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{key}: "), value.cast("string")) for key, value in entries.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def field(matter: Column, key: str) -> Column:
    """Value of ``key: value``; '' when absent. An empty value stays empty."""
    return tx.js_trim(F.regexp_extract(matter, rf"(?m)^{key}:[ \t]*(.+)$", 1))


def heading(role: Column) -> Column:
    return (
        F.when(role == "system", ROLE_HEADINGS["system"])
        .when(role == "user", ROLE_HEADINGS["user"])
        .when(role == "assistant", ROLE_HEADINGS["assistant"])
    )


def section(role: Column, content: Column) -> Column:
    return F.concat(heading(role), F.lit("\n"), content)


# --- turn documents ---------------------------------------------------------


def render_turn() -> Column:
    """Document of a stored turn row."""
    matter = front_matter(
        {
            "id": F.col("turn_id"),
            "sessionId": F.col("session_id"),
            "tool": F.col("tool"),
            "timestamp": dates.iso_utc(F.col("ts")),
            "turnIndex": F.col("turn_index"),
            "contextFingerprint": F.col("fingerprint"),
        }
    )
    return F.concat(
        matter,
        F.lit("\n\n## User\n"),
        F.col("user_content"),
        F.lit("\n\n## Assistant\n"),
        F.col("assistant_content"),
        F.lit("\n"),
    )


def turn_path() -> Column:
    """``{day}/{session}-{index}.md`` below the turns folder."""
    return F.concat(
        dates.utc_day(F.col("ts")), F.lit("/"), F.col("session_id"), F.lit("-"), F.col("turn_index"), F.lit(".md")
    )


def _turn_sections(body: Column) -> dict[str, Column]:
    """What follows the first heading of each role; the answer takes all the rest."""
    asked, answered = f"{ROLE_HEADINGS['user']}\n", f"{ROLE_HEADINGS['assistant']}\n"

    def after(text: Column, mark: str) -> Column:
        at = F.locate(mark, text)
        return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")

    question = after(body, asked)
    end = F.locate(f"\n{ROLE_HEADINGS['assistant']}", question)
    own = F.when(end > 0, F.substring(question, F.lit(1), end - 1)).otherwise(question)
    return {"user_content": tx.js_trim(own), "assistant_content": tx.js_trim(after(body, answered))}


def _turn_fields(docs: DataFrame, content: str, opening: str) -> DataFrame:
    split = docs.withColumns(
        {
            "_matter": F.regexp_extract(content, FRONT_MATTER + opening, 1),
            "_body": F.regexp_replace(content, FRONT_MATTER + opening, ""),
        }
    )
    index = F.regexp_extract(field(F.col("_matter"), "turnIndex"), r"\A[+-]?\d+", 0)
    return split.withColumns(
        {
            "turn_id": field(F.col("_matter"), "id"),
            "session_id": field(F.col("_matter"), "sessionId"),
            "tool": field(F.col("_matter"), "tool"),
            "timestamp": field(F.col("_matter"), "timestamp"),
            "turn_index": F.coalesce(index.try_cast("bigint"), F.lit(0)),
            "fingerprint": F.coalesce(
                F.nullif(field(F.col("_matter"), "contextFingerprint"), F.lit("")), F.lit(tx.DEFAULT_FINGERPRINT)
            ),
            **_turn_sections(F.col("_body")),
        }
    ).drop("_body")


def parse_turns(docs: DataFrame, content: str = "content") -> DataFrame:
    """Strict parse: rows without id, session or time are left out."""
    parsed = _turn_fields(docs, content, r"\n")
    required = (F.col("turn_id") != "") & (F.col("session_id") != "") & (F.col("timestamp") != "")
    return parsed.filter(required).drop("_matter")


def parse_turns_lenient(docs: DataFrame, content: str = "content") -> DataFrame:
    """Lenient parse: front matter required, every field defaults."""
    parsed = _turn_fields(docs.filter(F.col(content).rlike(FRONT_MATTER)), content, r"\n?\n?")
    return parsed.drop("_matter", "fingerprint")


# --- conversation documents -------------------------------------------------


def conversation_sections(messages: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """(conv_id, turn, text): the markdown file of each conversation, one row per message.

    The row of the first message also holds the front matter. Rows in order of
    ``turn``, separated by blank lines, are the file; a conversation of any
    length has this form, and no row or task gathers a whole one.
    """
    heads = messages.groupBy("conv_id").agg(
        F.min("turn").alias("_first"), F.sum(tx.message_tokens(F.col("text"))).cast("bigint").alias("tokens")
    )
    matter = front_matter(
        {
            "id": F.concat(F.lit("conv_"), F.col("conv_id")),
            "tool": attributes["tool"],
            "provider": attributes["provider"],
            "model": attributes["model"],
            "timestamp": dates.iso_utc(attributes["ts"]),
            "tokenEstimate": F.col("tokens"),
            "incognito": attributes["incognito"],
        }
    )
    own = section(F.col("role"), F.col("text"))
    first = F.concat(matter, F.lit("\n\n"), own)
    return messages.join(heads, "conv_id").select(
        "conv_id", "turn", F.when(F.col("turn") == F.col("_first"), first).otherwise(own).alias("text")
    )


def render_capture() -> Column:
    """Document of one captured request: capture columns and its message array."""
    matter = front_matter(
        {
            "id": F.col("capture_id"),
            "tool": F.col("tool"),
            "provider": F.col("provider"),
            "model": F.col("model"),
            "timestamp": dates.iso_utc(F.col("ts")),
            "tokenEstimate": F.aggregate(
                "messages", F.lit(0).cast("bigint"), lambda total, m: total + tx.message_tokens(m["content"])
            ),
            "incognito": F.col("incognito"),
        }
    )
    sections = F.transform("messages", lambda m: section(m["role"], m["content"]))
    return F.concat(matter, F.lit("\n\n"), F.array_join(sections, "\n\n"))


def conversation_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.sum(tx.message_tokens(F.col("text"))).cast("bigint").alias("tokens")
    )


def capture_path(conv_ref: Column, tool: Column, ts: Column) -> Column:
    """``{day}/{tool}-{HH}h{MM}m-{last six of id}.md`` below the conversations folder."""
    return F.concat(
        dates.utc_day(ts), F.lit("/"), tool, F.lit("-"), dates.hour_minute(ts), F.lit("-"),
        F.substring(conv_ref, -6, 6), F.lit(".md"),
    )


def parse_conversation_head(content: Column) -> Column:
    """Struct of the front-matter fields; NULL id where there is no front matter."""
    matter = F.regexp_extract(content, FRONT_MATTER, 1)
    return F.struct(
        F.nullif(field(matter, "id"), F.lit("")).alias("id"),
        field(matter, "tool").alias("tool"),
        field(matter, "model").alias("model"),
        field(matter, "timestamp").alias("timestamp"),
        (F.lower(field(matter, "incognito")) == "true").alias("incognito"),
        message_count(content).alias("n_messages"),
    )


def message_count(content: Column) -> Column:
    spoken = "|".join((ROLE_HEADINGS["user"], ROLE_HEADINGS["assistant"]))
    return F.regexp_count(content, F.lit(f"(?m)^(?:{spoken})$")).cast("bigint")


# --- cleaning ---------------------------------------------------------------

SECTION_START = rf"(?m)^(?=(?:{'|'.join(ROLE_HEADINGS.values())})(?![A-Za-z0-9_]))"


def clean_session(content: Column, context_tag: str = tx.CONTEXT_TAG) -> Column:
    """User and assistant sections only, injected tag blocks and empty ones removed."""
    spoken = F.filter(
        F.split(content, SECTION_START), lambda s: s.startswith(ROLE_HEADINGS["user"]) | s.startswith(ROLE_HEADINGS["assistant"])
    )
    stripped = F.transform(spoken, lambda s: tx.strip_injected_tags(s, context_tag))
    filled = F.filter(
        stripped,
        lambda s: F.length(tx.js_trim(F.substring_index(F.concat(s, F.lit("\n")), "\n", 1))) < F.length(tx.js_trim(s)),
    )
    return F.array_join(F.transform(filled, tx.js_trim), "\n\n")


def substantive_sections(cleaned: Column, compat: bool = False) -> Column:
    """Number of user sections of more than twenty characters.

    ``compat`` reproduces a known quirk of older captures' tooling: the last
    section only counts when a literal capital Z ends it.
    """
    end = "Z" if compat else r"\z"
    sections = F.regexp_extract_all(cleaned, F.lit(rf"(?m)^{ROLE_HEADINGS['user']}\n([\s\S]*?)(?=^## |{end})"), F.lit(1))
    return F.size(F.filter(sections, lambda s: F.length(tx.js_trim(s)) > MIN_USER_CHARS)).cast("bigint")


def has_substantive_content(cleaned: Column, compat: bool = False) -> Column:
    return substantive_sections(cleaned, compat) >= MIN_USER_SECTIONS


# --- memory documents -------------------------------------------------------


def render_memory() -> Column:
    matter = front_matter(
        {
            "id": F.col("memory_id"),
            "category": F.col("category"),
            "confidence": F.col("confidence"),
            "source": F.col("source"),
            "createdAt": dates.iso_utc(F.col("created_at")),
            "validFrom": dates.iso_utc(F.col("valid_from")),
            "invalidatedAt": F.coalesce(dates.iso_utc(F.col("invalidated_at")), F.lit("null")),
        }
    )
    return F.concat(matter, F.lit("\n\n"), F.col("text"))


def parse_memories(docs: DataFrame, content: str = "content") -> DataFrame:
    """Front-matter columns and body; ``invalidated_at`` NULL for null or absent."""
    matter = F.col("_matter")
    body = tx.js_trim(F.regexp_extract(F.col(content), r"\A---\n[\s\S]*?\n---\n\n?([\s\S]*)\z", 1))
    ended = F.nullif(F.nullif(field(matter, "invalidatedAt"), F.lit("null")), F.lit(""))
    return (
        docs.filter(F.col(content).rlike(FRONT_MATTER))
        .withColumn("_matter", F.regexp_extract(content, FRONT_MATTER, 1))
        .withColumns(
            {
                "memory_id": field(matter, "id"),
                "category": field(matter, "category"),
                "confidence": field(matter, "confidence"),
                "source": field(matter, "source"),
                "created_at": dates.parse_iso(field(matter, "createdAt")),
                "valid_from": dates.parse_iso(field(matter, "validFrom")),
                "invalidated_at": dates.parse_iso(ended),
                "text": body,
            }
        )
        .drop("_matter")
    )

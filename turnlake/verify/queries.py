"""Registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake import fixtures as fx
from turnlake.functions import dates, redaction
from turnlake.functions import text as tx
from turnlake.config import InjectionConfig, ToolConfig
from turnlake.functions import requests
from turnlake.operators import (
    bm25,
    documents,
    memories,
    packing,
    passages,
    pivots,
    reconcile,
    rerank,
    sessions,
    similarity,
    turns,
    vectors,
)
from turnlake.plans import extraction, search, status
from turnlake.session import cut_lineage, fresh_dir, written
from turnlake.sources import bodies, sinks, wallet, walletsource
from turnlake.streaming import ingest
from turnlake.verify import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


# --- turns ------------------------------------------------------------------


@register("turn_pairs", o.statement("SELECT * FROM pairs", "spoken", "pairs"))
def turn_pairs(spark, sf):
    return turns.turn_pairs(fx.table(spark, sf, "conversations"))


@register(
    "orphan_messages",
    o.statement(
        """SELECT conv_id, turn, role FROM spoken
           WHERE NOT (role = 'user' AND coalesce(next_role = 'assistant', false))
             AND NOT (role = 'assistant' AND coalesce(prev_role = 'user', false))""",
        "spoken",
    ),
)
def orphan_messages(spark, sf):
    return turns.orphan_messages(fx.table(spark, sf, "conversations"))


@register(
    "last_user_message",
    "SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def last_user_message(spark, sf):
    return turns.last_message(fx.table(spark, sf, "conversations"))


@register("message_tokens", f"SELECT conv_id, turn, {o.tokens('text')} AS tokens FROM conversations")
def message_tokens(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.estimate_tokens(F.col("text")).alias("tokens")
    )


@register(
    "conversation_tokens",
    f"SELECT conv_id, CAST(sum(4 + {o.tokens('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
)
def conversation_tokens(spark, sf):
    return documents.conversation_tokens(fx.table(spark, sf, "conversations"))


@register("context_fingerprint", o.statement("SELECT conv_id, fingerprint FROM fx_conv", "fx_conv"))
def context_fingerprint(spark, sf):
    messages = fx.table(spark, sf, "conversations")
    prompt = F.when(F.col("role") == "system", F.struct("turn", "text"))
    first = messages.groupBy("conv_id").agg(F.min(prompt).alias("first"))
    return first.select(
        "conv_id",
        F.coalesce(
            tx.context_fingerprint(F.col("first.text")), F.lit(tx.DEFAULT_FINGERPRINT)
        ).alias("fingerprint"),
    )


@register("context_fingerprint_tagged", ORACLES["context_fingerprint"])
def context_fingerprint_tagged(spark, sf):
    """Prompts that hold an injected block, in front or behind, count as without it."""
    messages = fx.table(spark, sf, "conversations")
    block = F.lit(f"<{tx.CONTEXT_TAG}>\nYou: x\n</{tx.CONTEXT_TAG}>")
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(block, F.lit("\n\n"), "text")).otherwise(F.concat("text", block))
    prompt = F.when(F.col("role") == "system", F.struct("turn", text.alias("text")))
    first = messages.groupBy("conv_id").agg(F.min(prompt).alias("first"))
    own = F.coalesce(tx.context_fingerprint(F.col("first.text")), F.lit(tx.DEFAULT_FINGERPRINT))
    return first.select("conv_id", own.alias("fingerprint"))


@register(
    "content_hash_dedup",
    "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS min_id FROM documents GROUP BY sha256(text)",
)
def content_hash_dedup(spark, sf):
    docs = fx.documents(spark, sf)
    return (
        docs.select("doc_id", tx.content_hash(F.col("text")).alias("hash"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("min_id"))
    )


@register(
    "redact_documents",
    f"""SELECT doc_id, redacted,
               CAST((length(redacted) - length(replace(redacted, '[REDACTED]', ''))) // 10
                  - (length(text) - length(replace(text, '[REDACTED]', ''))) // 10 AS BIGINT) AS n_hits
        FROM (SELECT doc_id, text, {o.redact('text')} AS redacted FROM documents)""",
)
def redact_documents(spark, sf):
    docs = fx.documents(spark, sf)
    return docs.select(
        "doc_id",
        redaction.redact_secrets(F.col("text")).alias("redacted"),
        redaction.redaction_count(F.col("text")).alias("n_hits"),
    )


# --- text index -------------------------------------------------------------


@register(
    "tokenize_terms",
    f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf
        FROM (SELECT doc_id, unnest({o.words('text')}) AS term FROM documents) GROUP BY term""",
)
def tokenize_terms(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return bm25.term_statistics(bm25.postings(docs, F.col("text"), "doc_id"))


@register(
    "postings",
    f"""SELECT doc_id, term, count(*) AS tf
        FROM (SELECT doc_id, unnest({o.words('text')}) AS term FROM documents) GROUP BY ALL""",
)
def postings(spark, sf):
    return bm25.postings(fx.table(spark, sf, "documents"), F.col("text"), "doc_id")


@register(
    "doc_stats",
    f"""SELECT count(*) AS n_docs, CAST(sum(len({o.words('text')})) AS BIGINT) AS total_terms,
               round(sum(len({o.words('text')}))::DOUBLE / count(*), 6) AS avgdl FROM documents""",
)
def doc_stats(spark, sf):
    lengths = bm25.document_lengths(fx.documents(spark, sf), F.col("text"), "doc_id")
    return lengths.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("dl").alias("total_terms"),
        F.round(F.sum("dl") / F.count(F.lit(1)), 6).alias("avgdl"),
    )


# --- search -----------------------------------------------------------------


def wanted_fingerprint(spark: SparkSession, sf: str) -> Column:
    """Context of the earliest conversation with a system prompt, as the asker's."""
    prints = fx.fingerprints(fx.table(spark, sf, "conversations"))
    known = prints.filter(F.col("fingerprint") != tx.DEFAULT_FINGERPRINT)
    return known.agg(F.min_by("fingerprint", "conv_id")).scalar()


@register("bm25_search", o.statement("SELECT * FROM fetched", *o.TURNS, extra=o.search_ctes()))
def bm25_search(spark, sf):
    return search.fetch_turns(fx.stored_turns(spark, sf), fx.QUERY, 8).select("turn_id", "score")


@register(
    "bm25_scores", o.statement("SELECT doc_id, score FROM d_score", extra=o.bm25_ctes("documents", "doc_id", "text", "d"))
)
def bm25_scores(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    return bm25.search(docs, F.col("text"), fx.QUERY, "doc_id").select("doc_id", "score")


@register(
    "search_collections",
    o.statement(
        """SELECT source, id, score FROM (
               (SELECT 'conversations' AS source, conv_id AS id, score FROM c_score ORDER BY score DESC, id LIMIT 20)
               UNION ALL
               (SELECT 'documents', doc_id, score FROM d_score ORDER BY score DESC, doc_id LIMIT 20))
           WHERE score >= 0.3 ORDER BY score DESC, source, id LIMIT 10""",
        extra={
            "whole": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id",
            **o.bm25_ctes("whole", "conv_id", "body", "c"),
            **o.bm25_ctes("documents", "doc_id", "text", "d"),
        },
    ),
)
def search_collections(spark, sf):
    terms = tx.query_terms(fx.QUERY)
    messages = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text")
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    by_message = bm25.count_terms(messages, F.col("text"), terms)
    return search.search_collections(
        {
            "conversations": bm25.merge_counts(by_message, ["id"], terms),
            "documents": bm25.count_terms(docs, F.col("text"), terms).drop("text"),
        },
        fx.QUERY,
    )


@register(
    "recency_boost",
    o.statement(
        f"""SELECT turn_id, round(greatest(0, 1 - (epoch_ms({o.NOW}) - epoch_ms(ts)) / 86400000.0::DOUBLE / 90), 9) AS factor
            FROM fx_turns""",
        *o.TURNS,
    ),
)
def recency_boost(spark, sf):
    factor = F.round(dates.recency_factor(F.col("ts"), fx.now()), 9)
    return fx.stored_turns(spark, sf).select("turn_id", factor.alias("factor"))


@register(
    "context_boost",
    o.statement(
        """SELECT turn_id, CASE WHEN fingerprint = fp THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS factor
           FROM fx_turns, wanted""",
        *o.TURNS,
        extra={"wanted": o.search_ctes()["wanted"]},
    ),
)
def context_boost(spark, sf):
    stored = fx.stored_turns(spark, sf).withColumn("_wanted", wanted_fingerprint(spark, sf))
    return stored.select("turn_id", rerank.context_multiplier(F.col("fingerprint"), F.col("_wanted")).alias("factor"))


@register(
    "word_overlap",
    o.statement(
        f"SELECT turn_id, round({o.overlap('a', 'b')}, 9) AS overlap FROM sets",
        *o.TURNS,
        extra={
            "sets": f"""SELECT turn_id, list_distinct({o.words('user_content')}) AS a,
                               list_distinct({o.words('assistant_content')}) AS b FROM fx_turns"""
        },
    ),
)
def word_overlap(spark, sf):
    sets = fx.stored_turns(spark, sf).select(
        "turn_id", tx.word_set(F.col("user_content")).alias("a"), tx.word_set(F.col("assistant_content")).alias("b")
    )
    return sets.select("turn_id", F.round(tx.word_set_overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


@register(
    "dedup_session",
    o.statement("SELECT turn_id, session_id, score FROM deduped", *o.TURNS, extra=o.search_ctes()),
)
def dedup_session(spark, sf):
    fetched = search.fetch_turns(fx.stored_turns(spark, sf), fx.QUERY, 8)
    final = rerank.boosted(
        F.col("score"), F.col("ts"), fx.now(), 0.3, F.col("fingerprint"), F.col("_wanted")
    )
    boosted = fetched.withColumn("_wanted", wanted_fingerprint(spark, sf)).withColumn("score", rerank.rounded(final))
    return rerank.drop_near_duplicates(boosted, search.compared_text(), "turn_id").select(
        "turn_id", "session_id", "score"
    )


@register("search_turns", o.statement("SELECT * FROM results", *o.TURNS, extra=o.search_ctes()))
def search_turns(spark, sf):
    stored = fx.stored_turns(spark, sf)
    found = search.search_turns(stored, fx.QUERY, fx.now(), fingerprint=wanted_fingerprint(spark, sf))
    return found.select("turn_id", "session_id", "score", "rank")


@register(
    "search_turns_daterange",
    o.statement(
        "SELECT * FROM results",
        *o.TURNS,
        extra={
            "ranged": "SELECT * FROM fx_turns WHERE ts >= TIMESTAMP '2024-02-01' AND ts < TIMESTAMP '2024-04-01'",
            **o.search_ctes("ranged"),
        },
    ),
)
def search_turns_daterange(spark, sf):
    stored = search.in_date_range(
        fx.stored_turns(spark, sf),
        F.to_timestamp(F.lit("2024-02-01 00:00:00")),
        F.to_timestamp(F.lit("2024-04-01 00:00:00")),
    )
    found = search.search_turns(stored, fx.QUERY, fx.now(), fingerprint=wanted_fingerprint(spark, sf))
    return found.select("turn_id", "session_id", "score", "rank")


# --- injection --------------------------------------------------------------


@register(
    "truncate_assistant",
    o.statement(f"SELECT turn_id, {o.truncate('assistant_content')} AS text FROM fx_turns", *o.TURNS),
)
def truncate_assistant(spark, sf):
    return fx.stored_turns(spark, sf).select("turn_id", tx.truncate_assistant(F.col("assistant_content")).alias("text"))


@register(
    "truncate_documents",
    f"SELECT doc_id, {o.truncate('text')} AS text FROM documents",
)
def truncate_documents(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.truncate_assistant(F.col("text")).alias("text"))


@register(
    "format_turn_entry",
    o.statement(
        f"SELECT turn_id, {o.entry('ts', 'user_content', 'assistant_content')} AS text FROM fx_turns", *o.TURNS
    ),
)
def format_turn_entry(spark, sf):
    return packing.turn_entries(fx.stored_turns(spark, sf)).select("turn_id", F.col("entry").alias("text"))


PROFILE = "Prefers short answers.\nWorks on data pipelines."
TIGHT = InjectionConfig(max_tokens=900)


def _search_hits(spark, sf):
    stored = fx.stored_turns(spark, sf)
    return packing.turn_entries(
        search.search_turns(stored, fx.QUERY, fx.now(), fingerprint=wanted_fingerprint(spark, sf))
    )


# The block spelled out: what stands before the entries and what after them.
BLOCK_HEAD = f"<{tx.CONTEXT_TAG}>\n\n## About You\n{PROFILE}\n\n## Relevant Past Conversations"
BLOCK_TAIL = f"\n\n</{tx.CONTEXT_TAG}>"
PACKED = {
    **o.search_ctes(),
    "entries": f"""SELECT turn_id, rank AS position, {o.entry('ts', 'user_content', 'assistant_content')} AS entry
                   FROM results JOIN fx_turns USING (turn_id)""",
    "costs": f"""SELECT *, {o.tokens("(CASE WHEN position > 1 THEN chr(10) || chr(10) ELSE '' END || entry)")} AS cost
                 FROM entries""",
    "running": "SELECT *, CAST(sum(cost) OVER (ORDER BY position) AS BIGINT) AS running_cost FROM costs",
    "packed": f"""SELECT * FROM running WHERE position <= 8
                  AND running_cost <= greatest(0, 900 - {o.tokens(o.quoted(BLOCK_HEAD + BLOCK_TAIL))})""",
}


@register(
    "budget_pack",
    o.statement("SELECT turn_id, position, cost, running_cost FROM packed", *o.TURNS, extra=PACKED),
)
def budget_pack(spark, sf):
    packed = packing.pack(_search_hits(spark, sf), PROFILE, TIGHT)
    return packed.select("turn_id", "position", "cost", "running_cost")


@register(
    "injection_block",
    o.statement(
        f"SELECT text, {o.tokens('text')} AS token_count, memory_count, true AS has_profile FROM block",
        *o.TURNS,
        extra={
            **PACKED,
            "block": f"""SELECT {o.quoted(BLOCK_HEAD)}
                            || coalesce(chr(10) || string_agg(entry, chr(10) || chr(10) ORDER BY position), '')
                            || {o.quoted(BLOCK_TAIL)} AS text,
                            count(*) AS memory_count
                         FROM packed""",
        },
    ),
)
def injection_block(spark, sf):
    return packing.injection_block(_search_hits(spark, sf), PROFILE, TIGHT)


# --- sessions ---------------------------------------------------------------


@register(
    "captures",
    o.statement(f"SELECT * EXCLUDE (ts), {o.iso('ts')} AS captured_at FROM captures", *o.CAPTURES),
)
def captures(spark, sf):
    return fx.captures(spark, sf).withColumn("captured_at", dates.iso_utc(F.col("ts"))).drop("ts")


@register(
    "capture_sessions",
    o.statement("SELECT wallet_id, capture_id, CAST(session_no AS BIGINT) AS session_no FROM sessions", *o.CAPTURES, "sessions"),
)
def capture_sessions(spark, sf):
    numbered = sessions.assign_sessions(fx.captures(spark, sf), fx.INTERNAL_MODEL_MARKER)
    return numbered.select("wallet_id", "capture_id", "session_no")


def _representatives(spark, sf):
    return sessions.representatives(sessions.assign_sessions(fx.captures(spark, sf), fx.INTERNAL_MODEL_MARKER))


@register(
    "session_representatives",
    o.statement("SELECT wallet_id, capture_id, n FROM reps", *o.CAPTURES, "sessions", "reps"),
)
def session_representatives(spark, sf):
    return _representatives(spark, sf).select("wallet_id", "capture_id", "n")


@register(
    "pending_sessions",
    o.statement(
        """SELECT capture_id FROM reps WHERE capture_id NOT IN
           (SELECT capture_id FROM captures WHERE tool = 'alpha')""",
        *o.CAPTURES,
        "sessions",
        "reps",
    ),
)
def pending_sessions(spark, sf):
    processed = fx.captures(spark, sf).filter(F.col("tool") == "alpha").select("capture_id")
    return sessions.pending(_representatives(spark, sf), processed).select("capture_id")


def _conversation_attributes():
    return {**fx.conversation_attributes(F.col("conv_id")), "provider": fx.provider(F.col("conv_id"))}


RENDERED = f"""
    SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER w THEN
           '---' || chr(10) || 'id: conv_' || conv_id || chr(10) || 'tool: ' || tool || chr(10)
           || 'provider: ' || provider || chr(10) || 'model: ' || model || chr(10)
           || 'timestamp: ' || {o.iso('ts')} || chr(10)
           || 'tokenEstimate: ' || CAST(sum(4 + {o.tokens('text')}) OVER w AS BIGINT) || chr(10)
           || 'incognito: ' || incognito || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
           || '## ' || upper(role[1]) || role[2:] || chr(10) || text AS text
    FROM conversations JOIN fx_conv USING (conv_id) WINDOW w AS (PARTITION BY conv_id)"""


@register("render_conversation", o.statement("SELECT * FROM rendered", "fx_conv", extra={"rendered": RENDERED}))
def render_conversation(spark, sf):
    return documents.conversation_sections(fx.table(spark, sf, "conversations"), _conversation_attributes())


@register(
    "conversation_heads",
    o.statement(
        f"""SELECT conv_id, 'conv_' || conv_id AS id, any_value(tool) AS tool, any_value(model) AS model,
                   {o.iso('any_value(ts)')} AS captured_at, any_value(incognito) AS incognito,
                   count(*) FILTER (role <> 'system') AS n_messages
            FROM conversations JOIN fx_conv USING (conv_id) GROUP BY conv_id""",
        "fx_conv",
    ),
)
def conversation_heads(spark, sf):
    sections = documents.conversation_sections(fx.table(spark, sf, "conversations"), _conversation_attributes())
    heads = sections.withColumn("head", documents.parse_conversation_head(F.col("text")))
    # Only the first section holds front matter; fields of the others are empty.
    return heads.groupBy("conv_id").agg(
        *[
            F.max(f"head.{name}").alias(alias)
            for name, alias in (
                ("id", "id"), ("tool", "tool"), ("model", "model"),
                ("timestamp", "captured_at"), ("incognito", "incognito"),
            )
        ],
        F.sum("head.n_messages").alias("n_messages"),
    )


CLEANED = {
    "cleaned": f"""SELECT conv_id, turn, role, {o.clean_section('text')} AS body FROM conversations
                   WHERE role IN ('user', 'assistant')""",
}


@register(
    "clean_session",
    o.statement(
        """SELECT conv_id, turn, CASE role WHEN 'user' THEN '## User' ELSE '## Assistant' END || chr(10) || body AS text
           FROM cleaned WHERE body <> ''""",
        extra=CLEANED,
    ),
)
def clean_session(spark, sf):
    return extraction.clean_sections(fx.table(spark, sf, "conversations"))


@register(
    "clean_session_tagged",
    f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN '## User' ELSE '## Assistant' END || chr(10) || {o.trim("text")} AS text
        FROM conversations WHERE role IN ('user', 'assistant') AND {o.trim("text")} <> ''""",
)
def clean_session_tagged(spark, sf):
    """Every message holds one of the three tag blocks; nothing of it is left."""
    tags = F.array(*[F.lit(tag) for tag in (tx.CONTEXT_TAG, *tx.FOREIGN_TAGS)])
    tag = F.element_at(tags, (F.col("turn") % 3 + 1).cast("int"))
    block = F.concat(F.lit("<"), tag, F.lit(">a\nb</"), tag, F.lit(">"))
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(block, "text")).otherwise(F.concat("text", F.lit("\n"), block))
    return extraction.clean_sections(fx.table(spark, sf, "conversations").withColumn("text", text))


@register(
    "substantive_sessions",
    o.statement(
        """SELECT conv_id, count(*) FILTER (role = 'user' AND length(body) > 20) >= 2 AS substantive
           FROM (SELECT conv_id, turn FROM conversations) LEFT JOIN cleaned USING (conv_id, turn) GROUP BY conv_id""",
        extra=CLEANED,
    ),
)
def substantive_sessions(spark, sf):
    return extraction.substance(fx.table(spark, sf, "conversations"))


# --- turn documents ---------------------------------------------------------


def _turn_documents(spark, sf):
    return fx.stored_turns(spark, sf).select(
        "turn_id", "session_id", "turn_index", "ts", documents.turn_path().alias("path"),
        documents.render_turn().alias("content"),
    )


@register("render_turn", o.statement(f"SELECT turn_id, {o.TURN_DOC} AS content FROM fx_turns", *o.TURNS))
def render_turn(spark, sf):
    return _turn_documents(spark, sf).select("turn_id", "content")


PARSED = f"""SELECT turn_id, session_id, tool, {o.iso('ts')} AS timestamp, turn_index, fingerprint,
                    {o.trim('user_content')} AS user_content, {o.trim('assistant_content')} AS assistant_content
             FROM fx_turns"""


@register("parse_turn_document", o.statement(PARSED, *o.TURNS))
def parse_turn_document(spark, sf):
    docs = _turn_documents(spark, sf).select("content")
    return documents.parse_turns(docs).drop("content")


@register(
    "parse_turn_lenient",
    o.statement(PARSED.replace("fingerprint,", ""), *o.TURNS),
)
def parse_turn_lenient(spark, sf):
    docs = _turn_documents(spark, sf).select("content")
    return documents.parse_turns_lenient(docs).drop("content")


@register(
    "normalize_path",
    o.statement(
        "SELECT turn_id, strftime(ts, '%Y-%m-%d') || '/conv-' || conv_id || '-' || turn_index || '.md' AS path FROM fx_turns",
        *o.TURNS,
    ),
)
def normalize_path(spark, sf):
    return _turn_documents(spark, sf).select("turn_id", tx.normalize_path(F.col("path")).alias("path"))


@register(
    "normalize_document_paths",
    r"""SELECT doc_id, source || '/' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}$]+', '-', 'g'), '-') || '.md' AS path
        FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}$]')""",
)
def normalize_document_paths(spark, sf):
    """Whole texts as file names; separators inside them would be folders or suffixes."""
    docs = fx.documents(spark, sf)
    name = F.translate("text", "/._", "   ")
    path = tx.normalize_path(F.concat("source", F.lit("/"), name, F.lit(".md")))
    row = F.struct("doc_id", path.alias("path"))  # inlined, so that the condition does not compute it again
    return docs.select(F.inline(F.array(row))).filter(F.col("path").isNotNull())


TITLED = """SELECT doc_id, source, 'notes/' || source || '-' || doc_id || '.md' AS path,
                   CASE doc_id % 4 WHEN 0 THEN '# Title of ' || doc_id || ' ' || chr(10) || text
                                   WHEN 1 THEN text || chr(10) || '##  Late ' || doc_id || chr(10) || '# Later'
                                   WHEN 2 THEN '### Deep' || chr(10) || text ELSE text END AS content
            FROM documents"""


@register(
    "extract_title",
    o.statement(
        """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Title of ' || doc_id WHEN 1 THEN 'Late ' || doc_id
                               ELSE source || '-' || doc_id END AS title
           FROM titled WHERE NOT regexp_matches(content, '(?m)^##?[ \t]') OR doc_id % 4 < 2""",
        extra={"titled": TITLED},
    ),
)
def extract_title(spark, sf):
    """Whole texts, some under a heading, some above one, some without."""
    rest = F.col("doc_id") % 4
    content = (
        F.when(rest == 0, F.concat(F.lit("# Title of "), F.col("doc_id"), F.lit(" \n"), F.col("text")))
        .when(rest == 1, F.concat(F.col("text"), F.lit("\n##  Late "), F.col("doc_id"), F.lit("\n# Later")))
        .when(rest == 2, F.concat(F.lit("### Deep\n"), F.col("text")))
        .otherwise(F.col("text"))
    )
    path = F.concat(F.lit("notes/"), "source", F.lit("-"), "doc_id", F.lit(".md"))
    return fx.documents(spark, sf).select("doc_id", tx.extract_title(content, path).alias("title"))


@register(
    "turn_index_rows",
    o.statement(
        f"""SELECT 'turns' AS collection, 'User' AS title, sha256({o.TURN_DOC}) AS hash,
                   strftime(ts, '%Y-%m-%d') || '/conv-' || conv_id || '-' || turn_index || '.md' AS path
            FROM fx_turns""",
        *o.TURNS,
    ),
)
def turn_index_rows(spark, sf):
    docs = _turn_documents(spark, sf)
    return reconcile.described(docs, "turns", F.col("path"), F.col("content")).drop("content")


# --- index maintenance ------------------------------------------------------


def _snapshots(spark, sf):
    """Indexed: all but German documents of other sources than src0. Scanned: redacted, without src0.

    Every document is in at least one of them.
    """
    docs = fx.documents(spark, sf).withColumn("path", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")))
    gone = F.col("source").eqNullSafe(F.lit("src0"))
    indexed = docs.filter(gone | ~F.col("lang").eqNullSafe(F.lit("de")))
    scanned = docs.filter(~gone).withColumn("text", redaction.redact_secrets(F.col("text")))
    describe = lambda df: reconcile.described(df, "documents", F.col("path"), F.col("text"))
    return describe(indexed), describe(scanned)


SNAPSHOTS = {
    "old": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE source = 'src0' OR lang IS DISTINCT FROM 'de'",
    "new": f"SELECT doc_id, sha256({o.redact('text')}) AS hash FROM documents WHERE source IS DISTINCT FROM 'src0'",
    "diff": """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
                      CASE WHEN o.doc_id IS NULL THEN 'indexed' WHEN n.doc_id IS NULL THEN 'removed'
                           WHEN o.hash <> n.hash THEN 'updated' ELSE 'unchanged' END AS status
               FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""",
}


@register(
    "reconcile_diff",
    o.statement("SELECT status, count(*) AS n FROM diff GROUP BY status", extra=SNAPSHOTS),
)
def reconcile_diff(spark, sf):
    return reconcile.counters(reconcile.compare(*_snapshots(spark, sf)))


@register(
    "index_changes",
    o.statement(
        "SELECT 'doc-' || doc_id || '.md' AS path, hash FROM new JOIN diff USING (doc_id) WHERE status IN ('indexed', 'updated')",
        extra=SNAPSHOTS,
    ),
)
def index_changes(spark, sf):
    indexed, scanned = _snapshots(spark, sf)
    return reconcile.changed(scanned, indexed).select("path", "hash")


@register(
    "index_upsert",
    o.statement(
        """SELECT 'doc-' || coalesce(o.doc_id, n.doc_id) || '.md' AS path, coalesce(n.hash, o.hash) AS hash,
                  CASE WHEN o.doc_id IS NULL THEN '2024-05-01' ELSE '2024-01-01' END AS created,
                  CASE WHEN n.hash IS NOT NULL AND n.hash IS DISTINCT FROM o.hash THEN '2024-05-01' ELSE '2024-01-01' END AS modified
           FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""",
        extra=SNAPSHOTS,
    ),
)
def index_upsert(spark, sf):
    indexed, scanned = _snapshots(spark, sf)
    first = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    index = indexed.drop("content").withColumns({"created_at": first, "modified_at": first})
    merged = reconcile.upsert(index, scanned, fx.now())
    return merged.select(
        "path", "hash", dates.utc_day(F.col("created_at")).alias("created"), dates.utc_day(F.col("modified_at")).alias("modified")
    )


@register(
    "content_store",
    o.statement(
        f"""SELECT hash, length(body) AS chars FROM (
                SELECT sha256(body) AS hash, any_value(body) AS body FROM (
                    SELECT {o.redact('text')} AS body FROM documents WHERE source IS DISTINCT FROM 'src0') GROUP BY sha256(body))
            WHERE hash NOT IN (SELECT hash FROM old)""",
        extra={"old": SNAPSHOTS["old"]},
    ),
)
def content_store(spark, sf):
    indexed, scanned = _snapshots(spark, sf)
    added = reconcile.new_contents(scanned, indexed.select("hash").distinct())
    return added.select("hash", F.length("body").cast("bigint").alias("chars"))


# --- memories ---------------------------------------------------------------


def _resolved(spark, sf):
    stored = fx.stored_turns(spark, sf)
    return memories.resolve_actions(fx.facts(stored), fx.memories(stored)), fx.memories(stored)


@register(
    "memory_apply_actions",
    o.statement(
        f"""SELECT memory_id, text, category, confidence, source, {o.iso('created_at')} AS created,
                   {o.iso('valid_from')} AS valid, {o.iso('invalidated_at')} AS invalidated
            FROM (
              SELECT m.* EXCLUDE (wallet_id, invalidated_at),
                     CASE WHEN e.target_id IS NOT NULL THEN coalesce(m.invalidated_at, {o.NOW})
                          ELSE m.invalidated_at END AS invalidated_at
              FROM mem m LEFT JOIN (SELECT DISTINCT target_id FROM acts WHERE applied AND action IN ('UPDATE', 'INVALIDATE')) e
                ON e.target_id = m.memory_id
              UNION ALL BY NAME
              SELECT 'mem_' || substr(sha256(fact_id), 1, 32) AS memory_id, text, category, confidence, source,
                     {o.NOW} AS created_at, valid_from, NULL::TIMESTAMP AS invalidated_at
              FROM acts WHERE applied AND action IN ('ADD', 'UPDATE'))""",
        *o.TURNS,
        extra=o.MEMORY,
    ),
)
def memory_apply_actions(spark, sf):
    resolved, stored = _resolved(spark, sf)
    applied = memories.apply_actions(stored.drop("wallet_id"), resolved, fx.now())
    return applied.select(
        "memory_id", "text", "category", "confidence", "source",
        dates.iso_utc(F.col("created_at")).alias("created"),
        dates.iso_utc(F.col("valid_from")).alias("valid"),
        dates.iso_utc(F.col("invalidated_at")).alias("invalidated"),
    )


@register(
    "action_stats",
    o.statement(
        """SELECT count(*) FILTER (action = 'ADD' AND applied) AS created, count(*) FILTER (action = 'UPDATE' AND applied) AS updated,
                  count(*) FILTER (action = 'INVALIDATE' AND applied) AS invalidated,
                  count(*) FILTER (action = 'NOOP' AND applied) AS noop, count(*) FILTER (NOT applied) AS skipped FROM acts""",
        *o.TURNS,
        extra=o.MEMORY,
    ),
)
def action_stats(spark, sf):
    return memories.action_counts(_resolved(spark, sf)[0])


@register(
    "live_high_memories",
    o.statement(
        f"""SELECT wallet_id, row_number() OVER w AS n, row_number() OVER w || '. ' || {o.trim('text')} AS line
            FROM mem WHERE confidence = 'HIGH' AND invalidated_at IS NULL AND {o.trim('text')} <> ''
            WINDOW w AS (PARTITION BY wallet_id ORDER BY created_at, memory_id)""",
        *o.TURNS,
        extra=o.MEMORY,
    ),
)
def live_high_memories(spark, sf):
    return memories.profile_lines(fx.memories(fx.stored_turns(spark, sf)))


@register(
    "memory_documents",
    o.statement(
        f"""SELECT memory_id, category, confidence, source, {o.iso('created_at')} AS created, {o.iso('invalidated_at')} AS invalidated,
                   {o.trim('text')} AS text FROM mem""",
        *o.TURNS,
        extra=o.MEMORY,
    ),
)
def memory_documents(spark, sf):
    rendered = fx.memories(fx.stored_turns(spark, sf)).select(documents.render_memory().alias("content"))
    parsed = documents.parse_memories(rendered)
    return parsed.select(
        "memory_id", "category", "confidence", "source",
        dates.iso_utc(F.col("created_at")).alias("created"),
        dates.iso_utc(F.col("invalidated_at")).alias("invalidated"),
        "text",
    )


@register(
    "similar_memories_top5",
    o.statement(
        """SELECT fact_id, memory_id, score, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, memory_id) AS rank FROM (
               SELECT fact_id, memory_id, round(raw / (1 + raw), 6) AS score FROM (
                 SELECT fact_id, memory_id,
                        sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                            / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw
                 FROM fact_terms JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (memory_id), n
                 GROUP BY fact_id, memory_id)))
           WHERE rank <= 5""",
        *o.TURNS,
        extra={
            **o.MEMORY,
            "live": "SELECT * FROM mem WHERE invalidated_at IS NULL",
            "fact_terms": f"SELECT DISTINCT fact_id, unnest({o.words('text')}) AS term FROM fact",
            "tf": f"SELECT memory_id, term, count(*) AS tf FROM (SELECT memory_id, unnest({o.words('text')}) AS term FROM live) GROUP BY ALL",
            "df": "SELECT term, count(*) AS df FROM tf GROUP BY term",
            "dl": f"SELECT memory_id, len({o.words('text')}) AS dl FROM live",
            "n": "SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl",
        },
    ),
)
def similar_memories_top5(spark, sf):
    stored = fx.stored_turns(spark, sf)
    live = fx.memories(stored).filter(F.col("invalidated_at").isNull())
    found = similarity.top_k_join(
        fx.facts(stored), "fact_id", F.col("text"), live, "memory_id", F.col("text"), extraction.SIMILAR_MEMORIES
    )
    return found.select("fact_id", "memory_id", "score", "rank")


FENCE = "```"


def _answers(spark, sf):
    """Model answers of every shape, one per fact, spelled from the fact's fields."""
    facts = fx.facts(fx.stored_turns(spark, sf))
    plain = F.to_json(F.struct("action", F.col("target_id").alias("targetId"), F.col("category").alias("reason")))
    fenced = F.concat(F.lit(f"{FENCE}json\n"), plain, F.lit(f"\n{FENCE}"))
    bare = F.to_json(F.struct("action"))
    unknown = F.to_json(F.struct(F.lit("REPLACE").alias("action"), F.col("target_id").alias("targetId")))
    return facts.withColumn(
        "answer",
        F.when(F.col("category") == "IDENTITY", plain)
        .when(F.col("category") == "PREFERENCE", fenced)
        .when(F.col("category") == "CONTEXT", bare)
        .when(F.col("category") == "SKILL", unknown)
        .otherwise(F.when(F.col("confidence") == "LOW", F.col("text")).otherwise(fenced)),
    )


@register(
    "parse_decisions",
    o.statement(
        """SELECT fact_id, action, CASE WHEN action IN ('UPDATE', 'INVALIDATE') THEN target_id END AS target_id,
                  CASE WHEN action = 'NOOP' THEN CASE WHEN bare THEN 'Already captured' ELSE category END END AS reason
           FROM (
             SELECT fact_id, target_id, category, category = 'CONTEXT' AS bare,
                    CASE WHEN category = 'SKILL' OR (category IN ('RELATIONSHIP', 'EVENT') AND confidence = 'LOW') THEN 'ADD'
                         WHEN category = 'CONTEXT' AND action IN ('UPDATE', 'INVALIDATE') THEN 'ADD' ELSE action END AS action
             FROM fact)""",
        *o.TURNS,
        extra=o.MEMORY,
    ),
)
def parse_decisions(spark, sf):
    decided = _answers(spark, sf).select("fact_id", memories.parse_decision(F.col("answer")).alias("d"))
    return decided.select("fact_id", "d.*")


@register(
    "parse_facts",
    o.statement(
        f"""SELECT fact_id, row_number() OVER (PARTITION BY fact_id ORDER BY no) - 1 AS fact_no, text, category, confidence, summary
            FROM (SELECT fact_id, 1 AS no, {o.trim('text')} AS text, category, confidence, source AS summary FROM fact
                  UNION ALL SELECT fact_id, 3, target_id, 'EVENT', 'HIGH', source FROM fact)
            WHERE text <> ''""",
        *o.TURNS,
        extra=o.MEMORY,
    ),
)
def parse_facts(spark, sf):
    """Answers with a valid fact, one of unknown category, a valid one and a blank one."""
    facts = fx.facts(fx.stored_turns(spark, sf))
    item = lambda text, category, confidence: F.struct(
        text.alias("text"), category.alias("category"), confidence.alias("confidence")
    )
    listed = F.array(
        item(F.concat(F.lit("  "), F.col("text"), F.lit("\n")), F.col("category"), F.col("confidence")),
        item(F.col("text"), F.lit("OPINION"), F.lit("HIGH")),
        item(F.col("target_id"), F.lit("EVENT"), F.lit("HIGH")),
        item(F.lit("  "), F.lit("EVENT"), F.lit("HIGH")),
    )
    payload = F.to_json(F.struct(listed.alias("facts"), F.col("source").alias("summary_update")))
    answers = facts.select("fact_id", F.concat(F.lit(f"{FENCE}json\n"), payload, F.lit(f"\n{FENCE}")).alias("content"))
    parsed = memories.parse_facts(answers)
    return parsed.select(
        "fact_id",
        F.col("fact_no"),
        "text",
        "category",
        "confidence",
        F.col("summary_update").alias("summary"),
    )


# --- requests ---------------------------------------------------------------


def _request_bodies(spark, sf):
    """Provider requests holding each conversation, in both wire formats."""
    rows = fx.table(spark, sf, "conversations")
    text_json = requests.json_string(F.col("text"))
    blocks = F.concat(F.lit('[{"type":"text","text":'), text_json, F.lit('},{"type":"image","source":null}]'))
    content = F.when(F.col("role") == "assistant", blocks).otherwise(text_json)
    message = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":'), content, F.lit("}"))
    anthropic = fx.provider(F.col("conv_id")) == "anthropic"
    in_list = ~anthropic | (F.col("role") != "system")
    listed = F.array_sort(F.collect_list(F.when(in_list, F.struct("turn", message.alias("json")))))
    system = F.min(F.when(~in_list, F.struct("turn", text_json.alias("json"))))["json"]
    bodies = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(listed, lambda m: m["json"]), ",").alias("messages"), system.alias("system")
    )
    model = fx.conversation_attributes(F.col("conv_id"))["model"]
    tail = F.when(
        fx.provider(F.col("conv_id")) == "anthropic",
        F.concat(
            F.lit(',"max_tokens":1024'),
            F.coalesce(F.concat(F.lit(',"system":[{"type":"text","text":'), F.col("system"), F.lit("}]")), F.lit("")),
        ),
    ).otherwise(F.lit(',"stream":true'))
    return bodies.select(
        "conv_id",
        fx.provider(F.col("conv_id")).alias("provider"),
        F.concat(
            F.lit('{"model":"'), model, F.lit('","messages":['), F.col("messages"), F.lit("]"), tail, F.lit("}")
        ).alias("body"),
    )


@register(
    "normalize_requests",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text AS content
       FROM conversations WHERE role <> 'system'""",
)
def normalize_requests(spark, sf):
    bodies = _request_bodies(spark, sf)
    parsed = bodies.withColumn("request", requests.normalize(F.col("body"), F.col("provider")))
    listed = parsed.select("conv_id", F.posexplode("request.messages").alias("pos", "m"))
    return listed.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@register(
    "request_heads",
    o.statement(
        """SELECT conv_id, any_value(provider) AS provider, any_value(model) AS model,
                  any_value(provider) = 'openai' AS stream,
                  string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS system_prompt,
                  coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last_user
           FROM conversations JOIN fx_conv USING (conv_id) GROUP BY conv_id""",
        "fx_conv",
    ),
)
def request_heads(spark, sf):
    bodies = _request_bodies(spark, sf)
    parsed = bodies.withColumn("request", requests.normalize(F.col("body"), F.col("provider")))
    return parsed.select(
        "conv_id",
        "request.provider",
        "request.model",
        "request.stream",
        "request.system_prompt",
        requests.last_user_content(F.col("request.messages")).alias("last_user"),
    )


@register(
    "sse_parse",
    "SELECT conv_id, turn, nullif(text, '') AS text FROM conversations WHERE role = 'assistant'",
)
def sse_parse(spark, sf):
    """Answers cut into event-stream chunks at spaces and put together again."""
    answers = fx.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    provider = fx.provider(F.col("conv_id"))

    def event(piece: Column) -> Column:
        quoted = requests.json_string(piece)
        openai = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), quoted, F.lit("}}]}"))
        anthropic = F.concat(
            F.lit('event: content_block_delta\ndata: {"delta":{"type":"text_delta","text":'), quoted, F.lit("}}")
        )
        return F.when(provider == "anthropic", anthropic).otherwise(openai)

    events = F.array_join(F.transform(F.split("text", r"(?<= )"), event), "\n\n")
    stream = F.concat(events, F.lit('\n\ndata: not json\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"x"}}]}\n'))
    return answers.select("conv_id", "turn", requests.assistant_answer(stream, provider).alias("text"))


@register(
    "response_parse",
    "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'",
)
def response_parse(spark, sf):
    answers = fx.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    quoted = requests.json_string(F.col("text"))
    provider = fx.provider(F.col("conv_id"))
    body = F.when(
        provider == "anthropic",
        F.concat(F.lit('{"content":[{"type":"tool_use","id":"t"},{"type":"text","text":'), quoted, F.lit("}]}")),
    ).otherwise(F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":'), quoted, F.lit("}}]}")))
    return answers.select("conv_id", "turn", requests.assistant_answer(body, provider).alias("text"))


TOOLS = (
    ToolConfig("editor", "openai", "key-click", "https://api.example.com/v1"),
    ToolConfig("terminal", "anthropic", "key-view", "https://api.example.org/v1"),
    ToolConfig("second-editor", "openai", "key-click", "https://api.example.net/v1"),
    ToolConfig("unset", "openai", "env:TURNLAKE_UNSET_KEY", "https://api.example.net/v1"),
    ToolConfig("any-openai", "openai", "*", "https://api.example.com/v1"),
)


def _request_log(spark, sf):
    """Events read as a request log: the event type decides path and credentials."""
    log = fx.table(spark, sf, "events").select("event_id", "event_type", "props")
    kind = F.col("event_type")
    auth = F.when(kind.isin("click", "signup"), F.concat(F.lit("bearer  key-"), kind))
    api_key = F.when(kind.isin("view", "error"), F.concat(F.lit("key-"), kind))
    url = (
        F.when(kind == "click", "/v1/chat/completions")
        .when(kind == "purchase", "/v1/messages?beta=true")
        .otherwise("/custom")
    )
    headers = F.map_from_arrays(
        F.array_compact(F.array(F.lit("content-type"), F.when(auth.isNotNull(), F.lit("authorization")), F.when(api_key.isNotNull(), F.lit("x-api-key")))),
        F.array_compact(F.array(F.lit("application/json"), auth, api_key)),
    )
    body = F.when(kind == "error", F.col("props")).otherwise(F.lit('{"messages":[]}'))
    return log.select("event_id", url.alias("url"), headers.alias("headers"), auth.alias("auth"), api_key.alias("api_key"), body.alias("body"))


@register(
    "detect_format",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'openai' WHEN 'purchase' THEN 'anthropic' WHEN 'view' THEN 'anthropic'
              WHEN 'signup' THEN 'openai' ELSE 'unknown' END AS format FROM events""",
)
def detect_format(spark, sf):
    log = _request_log(spark, sf)
    return log.select("event_id", requests.detect_format(F.col("url"), F.col("headers"), F.col("body")).alias("format"))


@register(
    "tool_match",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'editor' WHEN 'view' THEN 'terminal' WHEN 'purchase' THEN NULL
              ELSE 'any-openai' END AS tool FROM events""",
)
def tool_match(spark, sf):
    log = _request_log(spark, sf)
    return log.select("event_id", requests.match_tool(TOOLS, F.col("auth"), F.col("api_key")).alias("tool"))


# --- reporting --------------------------------------------------------------


@register(
    "turn_filter_substring",
    o.statement(
        """SELECT turn_id FROM fx_turns WHERE contains(lower(user_content), 'thing') OR contains(lower(assistant_content), 'thing')
           OR contains(lower(tool), 'thing')""",
        *o.TURNS,
    ),
)
def turn_filter_substring(spark, sf):
    return status.filter_turns(fx.stored_turns(spark, sf), "Thing").select("turn_id")


DAYS = f"date_diff('day', ts::DATE, {o.NOW}::DATE)"
LABEL = f"""CASE WHEN {DAYS} = 0 THEN 'Today' WHEN {DAYS} = 1 THEN 'Yesterday' WHEN {DAYS} < 7 THEN strftime(ts, '%A')
            WHEN {DAYS} < 365 THEN strftime(ts, '%B %-d') ELSE strftime(ts, '%B %-d, %Y') END"""


@register(
    "date_groups",
    o.statement(
        f"SELECT label, count(*) AS n_turns, {o.iso('max(ts)')} AS latest FROM (SELECT ts, {LABEL} AS label FROM fx_turns) GROUP BY label",
        *o.TURNS,
    ),
)
def date_groups(spark, sf):
    return status.date_groups(fx.stored_turns(spark, sf), fx.now())


@register(
    "status_counts",
    o.statement(
        f"""SELECT count(*) AS turn_count, count(DISTINCT session_id) AS session_count, count(DISTINCT tool) AS tool_count,
                   {o.iso('max(ts)')} AS last_capture_at FROM fx_turns""",
        *o.TURNS,
    ),
)
def status_counts(spark, sf):
    return status.status(fx.stored_turns(spark, sf))


@register(
    "relative_times",
    f"""SELECT event_id,
          CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END
               WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
               ELSE (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS words,
          CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
               WHEN s < 2592000 THEN (s // 86400) || 'd ago' ELSE (s // 2592000) || 'mo ago' END AS short,
          s >= 604800 AS idle, '[' || strftime(ts, '%-I:%M %p') || ']' AS clock
        FROM (SELECT event_id, ts, (epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) // 1000 AS s FROM events)""",
)
def relative_times(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    ts = F.col("ts").cast("timestamp")
    return fx.table(spark, sf, "events").select(
        "event_id",
        dates.relative_time_words(ts, now).alias("words"),
        dates.relative_time_short(ts, now).alias("short"),
        dates.is_idle(ts, now).alias("idle"),
        dates.clock(ts).alias("clock"),
    )


CUT = f"rtrim(text[1:120], {o.quoted(tx.WHITESPACE)})"


@register(
    "document_display",
    rf"""SELECT doc_id, CASE WHEN length(text) > 120 THEN {CUT} || '…' ELSE text END AS short,
               regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
                              '(?i)the', '<mark class="hl">\0</mark>', 'g') AS marked,
               replace(text[1:60], chr(10), ' ') AS snippet,
               CASE WHEN n_chars < 1024 THEN n_chars || ' B'
                    ELSE printf('%.1f KB', floor(n_chars / 1024.0::DOUBLE * 10 + 0.5) / 10) END AS size
        FROM documents""",
)
def document_display(spark, sf):
    text = F.col("text")
    return fx.documents(spark, sf).select(
        "doc_id",
        tx.ellipsize(text, 120).alias("short"),
        tx.highlight(text, "the").alias("marked"),
        tx.snippet(text).alias("snippet"),
        tx.format_bytes(F.col("n_chars")).alias("size"),
    )


# --- vectors ----------------------------------------------------------------

DIMENSIONS = 64


def _query_vector(spark, sf):
    """Vector of the lowest id, used as the question."""
    return fx.table(spark, sf, "embeddings").agg(F.min_by("embedding", "vec_id")).scalar()


COSINE = """round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE),
                  (SELECT list_transform(arg_min(embedding, vec_id), lambda x: x::DOUBLE) FROM embeddings)), 6)"""


@register("vector_topk", f"SELECT vec_id AS id, {COSINE} AS score FROM embeddings ORDER BY score DESC, id LIMIT 16")
def vector_topk(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.nearest(rows, "id", "embedding", _query_vector(spark, sf), 16)


@register(
    "vector_topk_join",
    """
    SELECT a.vec_id AS query_id, b.vec_id AS id,
           round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE),
                                        list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b QUALIFY rank <= 10""",
)
def vector_topk_join(spark, sf):
    """The ten nearest vectors of every vector, all queries in one join."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.withColumnRenamed("id", "query_id")
    return pivots.top_k(asked, "query_id", "embedding", pivots.build(rows, "id", "embedding"), "id", 10)


@register(
    "hybrid_rrf",
    o.statement(
        """SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (
             SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r
             FROM (SELECT * FROM d_score ORDER BY score DESC, doc_id LIMIT 16)
             UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM near)
           GROUP BY id ORDER BY score DESC, id LIMIT 8""",
        extra={
            **o.bm25_ctes("documents", "doc_id", "text", "d"),
            "near": f"SELECT vec_id AS id, {COSINE} AS score FROM embeddings ORDER BY score DESC, id LIMIT 16",
        },
    ),
)
def hybrid_rrf(spark, sf):
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    lexical = bm25.search(docs, F.col("text"), fx.QUERY, "id", 16).select("id", "score")
    return vectors.fuse([lexical, vector_topk(spark, sf)], "id", 8, depth=16)


HYBRID = {
    **o.search_ctes(),
    "wanted_terms": "SELECT unnest(['thing', 'from', 'this']) AS term",
    "turn_weights": f"""SELECT turn_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, ln(1 + count(*)::DOUBLE) AS weight
                        FROM (SELECT turn_id, unnest({o.words("user_content || chr(10) || assistant_content")}) AS term FROM fx_turns)
                        GROUP BY ALL""",
    "turn_values": """SELECT turn_id, bucket, (weight / sqrt(sum(weight * weight) OVER (PARTITION BY turn_id)))::FLOAT::DOUBLE AS v
                      FROM turn_weights""",
    "asked_weights": """SELECT ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, ln(1 + count(*)::DOUBLE) AS weight
                        FROM wanted_terms GROUP BY ALL""",
    "asked": "SELECT bucket, (weight / sqrt(sum(weight * weight) OVER ()))::FLOAT::DOUBLE AS v FROM asked_weights",
    "near": """SELECT turn_id, round(coalesce(dot, 0) / (norm * (SELECT sqrt(sum(v * v)) FROM asked)), 6) AS score
               FROM (SELECT turn_id, sqrt(sum(t.v * t.v)) AS norm, sum(t.v * a.v) AS dot
                     FROM turn_values t LEFT JOIN asked a USING (bucket) GROUP BY turn_id)
               ORDER BY score DESC, turn_id LIMIT 16""",
    "fused": """SELECT turn_id, round(sum(1.0::DOUBLE / (60 + r)) * 30.5, 9) AS score FROM (
                  SELECT turn_id, row_number() OVER (ORDER BY score DESC, turn_id) AS r FROM lexical
                  UNION ALL SELECT turn_id, row_number() OVER (ORDER BY score DESC, turn_id) FROM near)
                GROUP BY turn_id ORDER BY score DESC, turn_id LIMIT 16""",
}


def _hybrid_ctes():
    """The lexical statements with the fused list in place of the fetched one."""
    lexical = {name: body for name, body in HYBRID.items() if name.startswith("t_")}
    vector = {n: HYBRID[n] for n in ("wanted_terms", "turn_weights", "turn_values", "asked_weights", "asked", "near")}
    rest = {n: HYBRID[n] for n in ("wanted", "boosted", "listed", "kept", "deduped", "results")}
    return {
        **lexical, "lexical": HYBRID["fetched"], **vector, "fused": HYBRID["fused"], "fetched": "SELECT * FROM fused", **rest
    }


@register("search_turns_hybrid", o.statement("SELECT * FROM results", *o.TURNS, extra=_hybrid_ctes()))
def search_turns_hybrid(spark, sf):
    stored = written(fx.stored_turns(spark, sf), "turns")  # read by each of the three steps
    embedded = vectors.embed(stored, "turn_id", search.turn_text(), DIMENSIONS)
    question = vectors.embed_query(spark, fx.QUERY, DIMENSIONS)
    fetched = search.fetch_turns_hybrid(stored, embedded, fx.QUERY, question, 8)
    found = search.rerank_turns(fetched, fx.now(), fingerprint=wanted_fingerprint(spark, sf))
    return found.select("turn_id", "session_id", "score", "rank")


EMBEDDED = {
    "weights": f"""SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, ln(1 + count(*)::DOUBLE) AS weight
                   FROM (SELECT doc_id, unnest({o.words('text')}) AS term FROM documents
                         WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) GROUP BY ALL""",
    "norms": "SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY doc_id",
}


@register(
    "embed_missing",
    o.statement(
        "SELECT doc_id, bucket, round((weight / norm)::FLOAT::DOUBLE, 4) AS value FROM weights JOIN norms USING (doc_id)", extra=EMBEDDED
    ),
)
def embed_missing(spark, sf):
    """Vectors of documents that have none yet, listed by their non-zero entries."""
    docs = fx.documents(spark, sf).select("doc_id", "text")
    known = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    embedded = vectors.embed(vectors.lacking(docs, known, "doc_id"), "doc_id", F.col("text"), DIMENSIONS)
    entries = embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).filter("v <> 0")
    return entries.select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("v").cast("double"), 4).alias("value")
    )


PASSAGES = {
    "passages": f"""SELECT doc_id, passage, passage * {passages.SIZE - passages.OVERLAP} AS start,
                           substr(text, passage * {passages.SIZE - passages.OVERLAP} + 1, {passages.SIZE}) AS body
                    FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - {passages.SIZE})
                                 / {passages.SIZE - passages.OVERLAP}.0)::BIGINT))) AS passage
                          FROM documents WHERE length(text) > 0)""",
}
PASSAGE_SEARCH = {
    **o.bm25_ctes("documents", "doc_id", "text", "d"),
    **PASSAGES,
    "wanted_terms": HYBRID["wanted_terms"],
    "asked_weights": HYBRID["asked_weights"],
    "asked": HYBRID["asked"],
    "p_weights": f"""SELECT doc_id, passage, start, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket,
                            ln(1 + count(*)::DOUBLE) AS weight
                     FROM (SELECT doc_id, passage, start, unnest({o.words("body")}) AS term FROM passages) GROUP BY ALL""",
    "p_values": """SELECT doc_id, passage, start, bucket,
                          (weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id, passage)))::FLOAT::DOUBLE AS v FROM p_weights""",
    "p_scores": """SELECT doc_id, passage, start, round(coalesce(dot, 0) / (norm * (SELECT sqrt(sum(v * v)) FROM asked)), 6) AS score
                   FROM (SELECT doc_id, passage, start, sqrt(sum(t.v * t.v)) AS norm, sum(t.v * a.v) AS dot
                         FROM p_values t LEFT JOIN asked a USING (bucket) GROUP BY ALL)""",
    "best": """SELECT * FROM p_scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, passage) = 1""",
    "fused": """SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)) * 30.5, 9) AS score FROM (
                  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r
                  FROM (SELECT * FROM d_score ORDER BY score DESC, doc_id LIMIT 20)
                  UNION ALL
                  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)
                  FROM (SELECT * FROM best ORDER BY score DESC, doc_id LIMIT 20))
                GROUP BY doc_id ORDER BY score DESC, doc_id""",
}


def _passage_hits(spark, sf, scorer=None):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    embedded = written(passages.embed(passages.cut(docs, "doc_id", F.col("text")), "doc_id", size=DIMENSIONS), "passages")
    asked = vectors.embed_query(spark, fx.QUERY, DIMENSIONS)
    found = search.search_passages(docs, "doc_id", F.col("text"), embedded, fx.QUERY, asked, scorer=scorer)
    return found.select("doc_id", "score", "best_chunk_pos", F.sha2("best_chunk", 256).alias("best_chunk_sha"))


@register(
    "passage_search",
    o.statement(
        f"""SELECT f.doc_id, f.score, coalesce(b.start, 0) AS best_chunk_pos,
                   sha256(substr(text, coalesce(b.start, 0) + 1, {passages.SIZE})) AS best_chunk_sha
            FROM (SELECT * FROM fused ORDER BY score DESC, doc_id LIMIT 10) f
            JOIN documents USING (doc_id) LEFT JOIN best b USING (doc_id)""",
        extra=PASSAGE_SEARCH,
    ),
)
def passage_search(spark, sf):
    """Hybrid search over passages of all documents."""
    return _passage_hits(spark, sf)


@register(
    "passage_search_reranked",
    o.statement(
        f"""SELECT doc_id, round(100.0::DOUBLE * (length(chunk) - length(replace(chunk, 'th', ''))) / (2 * length(chunk)), 6) AS score,
                   best_chunk_pos, sha256(chunk) AS best_chunk_sha
            FROM (SELECT f.doc_id, coalesce(b.start, 0) AS best_chunk_pos,
                         substr(text, coalesce(b.start, 0) + 1, {passages.SIZE}) AS chunk
                  FROM (SELECT * FROM fused LIMIT 20) f JOIN documents USING (doc_id) LEFT JOIN best b USING (doc_id))
            ORDER BY score DESC, doc_id LIMIT 10""",
        extra=PASSAGE_SEARCH,
    ),
)
def passage_search_reranked(spark, sf):
    """The same, twice the hits ordered anew by a scorer: here the share of a letter pair in the best passage."""
    return _passage_hits(spark, sf, lambda question, texts: [100.0 * t.count("th") / len(t) for t in texts])


def _failing_model(texts):
    """Lengths as vectors; a batch with the word "password" fails as a whole."""
    if any("password" in text for text in texts):
        raise ValueError("refused")
    return [[float(len(text)), 1.0] for text in texts]


@register(
    "embed_passages",
    o.statement(
        """SELECT count(DISTINCT doc_id) AS docs_processed, count(*) FILTER (NOT contains(body, 'password')) AS chunks_embedded,
                  count(*) FILTER (contains(body, 'password')) AS errors FROM passages""",
        extra=PASSAGES,
    ),
)
def embed_passages(spark, sf):
    """Counters of an embedding run with a model that refuses some passages."""
    docs = fx.documents(spark, sf).select("doc_id", "text")
    embedded = passages.embed(passages.cut(docs, "doc_id", F.col("text")), "doc_id", _failing_model)
    return passages.counters(embedded, "doc_id")


@register(
    "search_results",
    o.statement(
        """SELECT 'documents/doc-' || doc_id || '.md' AS file, score, substr(sha256(text), 1, 6) AS docid,
                  length(text) AS body_length, sha256(text) AS body_sha
           FROM d_score JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""",
        extra=o.bm25_ctes("documents", "doc_id", "text", "d"),
    ),
)
def search_results(spark, sf):
    """Hits of a lexical search with the bodies fetched from a content-addressed table."""
    docs = fx.documents(spark, sf).withColumn("path", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")))
    rows = written(reconcile.described(docs, "documents", F.col("path"), F.col("text")), "rows")
    store = fresh_dir(spark, "bodies")
    bodies.add(rows.select("hash", F.col("content").alias("body")), store)
    hits = bm25.search(docs.select("doc_id", "text", F.replace("path", F.lit("_"), F.lit("-")).alias("path")), F.col("text"), fx.QUERY, "doc_id", 10)
    named = cut_lineage(hits.select(F.lit("documents").alias("collection"), "path", "score"))
    found = search.results(named, rows.drop("content").withColumn("modified_at", fx.now()), store)
    return found.select("file", "score", "docid", "body_length", F.sha2("body", 256).alias("body_sha"))


# --- files and streams ------------------------------------------------------


@register(
    "wallet_roundtrip",
    o.statement(PARSED.replace("fingerprint,", ""), *o.TURNS),
)
def wallet_roundtrip(spark, sf):
    """Turn documents written as markdown files and scanned back."""
    root = fresh_dir(spark, "wallet")
    written = sinks.export_markdown(
        _turn_documents(spark, sf).select(F.concat(F.lit("turns/"), F.col("path")).alias("path"), "content"), root
    )
    failures = written.filter(~F.col("ok")).count()
    if failures:
        raise RuntimeError(f"{failures} files could not be written below {root}")
    parsed = documents.parse_turns_lenient(wallet.scan(spark, root, "turns").select("content"))
    return parsed.drop("content")


WALLET = {
    "files": f"""SELECT strftime(ts, '%Y-%m-%d') AS folder, strlen({o.TURN_DOC}) AS bytes FROM fx_turns""",
}


def _exported(spark, sf):
    root = fresh_dir(spark, "wallet")
    docs = _turn_documents(spark, sf).select(F.concat(F.lit("turns/"), F.col("path")).alias("path"), "content")
    docs.write.format("wallet").mode("append").save(root)
    return root


@register(
    "wallet_folders",
    o.statement("SELECT folder, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM files GROUP BY folder", *o.TURNS, extra=WALLET),
)
def wallet_folders(spark, sf):
    """Files and bytes of every day folder, from metadata alone."""
    walletsource.register(spark)
    return wallet.folders(spark, _exported(spark, sf), "turns").drop("newest")


@register(
    "wallet_newest_day",
    o.statement(
        f"""SELECT turn_id, sha256({o.TURN_DOC}) AS content_sha FROM fx_turns
            WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(folder) FROM files)""",
        *o.TURNS,
        extra=WALLET,
    ),
)
def wallet_newest_day(spark, sf):
    """Documents of the newest day, found by its folder's name and read alone."""
    walletsource.register(spark)
    root = _exported(spark, sf)
    newest = wallet.folders(spark, root, "turns").agg(F.max("folder")).first()[0]
    found = documents.parse_turns_lenient(wallet.read_day(spark, root, "turns", newest).select("content"))
    return found.select("turn_id", F.sha2("content", 256).alias("content_sha"))


@register("stream_ingest_turns", o.statement("SELECT * FROM pairs", "spoken", "pairs"))
def stream_ingest_turns(spark, sf):
    """Captures written as files, ingested by a stream in micro-batches."""
    root = fresh_dir(spark, "ingest")
    turns.capture_records(fx.table(spark, sf, "conversations")).write.parquet(f"{root}/captures")
    stream = ingest.capture_stream(spark, f"{root}/captures", files_per_trigger=4)
    query = ingest.start_ingest(stream, f"{root}/out", f"{root}/checkpoint", availableNow=True)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out/turns").select(*ingest.TURN_COLUMNS)


from turnlake.verify import stores  # noqa: E402,F401 - registers its queries

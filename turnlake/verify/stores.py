"""Registered queries over what the engine stores: captures, index, vectors, streams, wallets."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake import fixtures as fx
from turnlake.config import Config, ToolConfig
from turnlake.engine import MemoryEngine
from turnlake.functions import requests
from turnlake.operators import index, turns
from turnlake.plans import search
from turnlake.session import fresh_dir
from turnlake.sources import inline, sinks, wallet
from turnlake.streaming import ingest, late
from turnlake.streaming.sessions import number_sessions
from turnlake.verify import oracle as o
from turnlake.verify import queries as q
from turnlake.verify.queries import ORACLES, register

TOOLS = (ToolConfig("editor", "openai", "key-view", ""), ToolConfig("terminal", "anthropic", "key-click", ""))


def _request_log(spark: SparkSession, sf: str) -> DataFrame:
    """One captured request per conversation, in the wire format of its provider."""
    anthropic = F.col("provider") == "anthropic"
    attributes = fx.conversation_attributes(F.col("conv_id"))
    return q._request_bodies(spark, sf).select(
        F.col("conv_id").cast("string").alias("request_id"),
        F.when(anthropic, "/v1/messages").otherwise("/v1/chat/completions").alias("url"),
        F.when(anthropic, F.create_map(F.lit("x-api-key"), F.lit("key-click")))
        .otherwise(F.create_map(F.lit("authorization"), F.lit("Bearer key-view")))
        .alias("headers"),
        "body",
        F.lit(None).cast("string").alias("response"),
        attributes["ts"].alias("ts"),
        attributes["incognito"].alias("incognito"),
    )


@register(
    "capture_turns",
    o.statement(
        """SELECT 'conv_' || conv_id AS session_id, turn_index, user_content, assistant_content
           FROM pairs JOIN fx_conv USING (conv_id) WHERE NOT incognito""",
        "fx_conv", "spoken", "pairs",
    ),
)
def capture_turns(spark, sf):
    """Requests of both providers captured into a store; incognito ones leave nothing."""
    engine = MemoryEngine(spark, fresh_dir(spark, "capture"), Config(tools=TOOLS))
    engine.capture(_request_log(spark, sf))
    return engine.turns().select("session_id", "turn_index", "user_content", "assistant_content")


def _indexed(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Stored turns by day and their index below a fresh folder."""
    root = fresh_dir(spark, "index")
    sinks.append_by_day(fx.stored_turns(spark, sf), f"{root}/turns")
    stored = spark.read.parquet(f"{root}/turns")
    index.add(stored, "turn_id", search.turn_text(), f"{root}/index", carry=["ts"])
    return root, stored


@register("index_search", ORACLES["bm25_search"])
def index_search(spark, sf):
    root, _ = _indexed(spark, sf)
    return index.search(spark, f"{root}/index", "turn_id", fx.QUERY, 16).select("turn_id", "score")


@register("search_turns_indexed", ORACLES["search_turns"])
def search_turns_indexed(spark, sf):
    """The flagship from the persisted index: search, fetch by day, re-rank."""
    root, stored = _indexed(spark, sf)
    hits = index.search(spark, f"{root}/index", "turn_id", fx.QUERY, 16, carry="ts timestamp")
    dated = hits.select("turn_id", F.to_date("ts").alias("turn_date"), "score")
    fetched = stored.join(F.broadcast(dated), ["turn_date", "turn_id"])  # at most 16 rows; days are pruned
    found = search.rerank_turns(fetched, fx.now(), fingerprint=q.wanted_fingerprint(spark, sf))
    return found.select("turn_id", "session_id", "score", "rank")


@register(
    "index_after_removal",
    o.statement(
        "SELECT * FROM fetched",
        *o.TURNS,
        extra={
            "edited": """SELECT * REPLACE (CASE WHEN conv_id % 7 = 1 THEN 'This thing again. ' || user_content
                                                ELSE user_content END AS user_content)
                         FROM fx_turns WHERE conv_id % 5 <> 0""",
            **{name: sql for name, sql in o.search_ctes("edited").items() if not name.startswith(("wanted", "boosted", "listed", "kept", "dedup", "results"))},
        },
    ),
)
def index_after_removal(spark, sf):
    """Some turns removed, some edited, in the next snapshot with other buckets."""
    root, stored = _indexed(spark, sf)
    base = f"{root}/index"
    edited = stored.filter("conv_id % 7 = 1 AND conv_id % 5 <> 0").withColumn(
        "user_content", F.concat(F.lit("This thing again. "), "user_content")
    )
    gone = stored.filter("conv_id % 7 = 1 OR conv_id % 5 = 0").select("turn_id")
    index.add(edited, "turn_id", search.turn_text(), base, removed=gone, buckets=7, carry=["ts"])
    return index.search(spark, base, "turn_id", fx.QUERY, 16).select("turn_id", "score")


@register(
    "engine_reconcile",
    o.statement(
        """SELECT CASE WHEN conv_id % 5 = 0 THEN 'removed' WHEN conv_id % 7 = 1 THEN 'updated'
                       WHEN conv_id % 11 = 2 THEN 'indexed' ELSE 'unchanged' END AS status, count(*) AS n
           FROM fx_turns GROUP BY 1""",
        *o.TURNS,
    ),
)
def engine_reconcile(spark, sf):
    """What a store finds to do after turns were removed, edited and added behind its back."""
    engine = MemoryEngine(spark, fresh_dir(spark, "reconcile"), Config(tools=TOOLS))
    stored = fx.stored_turns(spark, sf).withColumn("model", F.lit("m"))
    late = (F.col("conv_id") % 11 == 2) & (F.col("conv_id") % 5 != 0) & (F.col("conv_id") % 7 != 1)
    sinks.append_by_day(stored.filter(~late), f"{engine.root}/turns")
    engine.reconcile(embed=False)
    edited = F.when(F.col("conv_id") % 7 == 1, F.concat("user_content", F.lit(" Edited."))).otherwise(F.col("user_content"))
    now = stored.filter("conv_id % 5 <> 0").withColumn("user_content", edited).withColumn("turn_date", F.to_date("ts"))
    moved = MemoryEngine(spark, engine.root, engine.config)
    moved.turns = lambda: now  # the table as it stands now
    counts = moved.reconcile(embed=False)
    rows = [(name, counts[name]) for name in ("indexed", "updated", "removed", "unchanged") if counts[name]]
    return spark.createDataFrame(rows, "status string, n bigint")


@register(
    "stream_resend",
    o.statement(
        """SELECT p.conv_id, turn_index, user_content,
                  CASE WHEN p.conv_id % 3 = 0 THEN assistant_content || ' (again)' ELSE assistant_content END AS assistant_content
           FROM pairs p WHERE p.conv_id % 17 <> 0""",
        "spoken", "pairs",
    ),
)
def stream_resend(spark, sf):
    """Every capture arrives twice, a third of them with another answer; incognito ones not at all."""
    root = fresh_dir(spark, "resend")
    records = turns.capture_records(fx.table(spark, sf, "conversations")).withColumn(
        "incognito", F.col("conv_id") % 17 == 0
    )

    def send(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{root}/captures")
        stream = ingest.capture_stream(spark, f"{root}/captures")
        ingest.start_ingest(stream, f"{root}/out", f"{root}/checkpoint", availableNow=True).awaitTermination()

    again = F.transform(
        "messages",
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when((F.col("conv_id") % 3 == 0) & (m["role"] == "assistant"), F.concat(m["content"], F.lit(" (again)")))
            .otherwise(m["content"])
            .alias("content"),
        ),
    )
    send(records)
    send(records.withColumn("messages", again))
    return ingest.current_turns(spark, f"{root}/out")


@register("streaming_sessions", ORACLES["capture_sessions"])
def streaming_sessions(spark, sf):
    """Session numbers from the state store, captures arriving in time order."""
    root = fresh_dir(spark, "sessions")
    fx.captures(spark, sf).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    numbered = number_sessions(source, fx.INTERNAL_MODEL_MARKER)
    query = (
        numbered.writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("wallet_id", "capture_id", "session_no")


@register("streaming_sessions_late", ORACLES["capture_sessions"])
def streaming_sessions_late(spark, sf):
    """The same from captures in any order: they wait in the state store until nothing older can come."""
    root = fresh_dir(spark, "late")
    rows = fx.captures(spark, sf)
    rows.repartition(4, F.xxhash64("capture_id")).write.parquet(f"{root}/in")
    beat = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields} | {"ts": F.to_timestamp(F.lit("2030-01-01 00:00:00"))}
    spark.range(1).select(*[value.alias(name) for name, value in beat.items()]).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    query = (
        late.number_sessions(source, fx.INTERNAL_MODEL_MARKER, "365 days").writeStream.format("parquet")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("wallet_id", "capture_id", "session_no")


BLOCK = "Known: \"likes\" short answers."


def _system_texts(value: str) -> str:
    return f"""SELECT conv_id, {value} AS system_prompt,
                      coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last_user
               FROM conversations JOIN fx_conv USING (conv_id) GROUP BY conv_id"""


PROMPTS = "string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system')"


@register("inject_body", o.statement(_system_texts(f"coalesce({PROMPTS} || CASE WHEN any_value(provider) = 'openai' THEN chr(10) || chr(10) ELSE chr(10) END, '') || {o.quoted(BLOCK)}"), "fx_conv"))
def inject_body(spark, sf):
    """A block appended to the system prompt of each request body, read back."""
    bodies = q._request_bodies(spark, sf)
    injected = bodies.withColumn("body", requests.inject_system(F.col("body"), F.col("provider"), F.lit(BLOCK)))
    return _heads(injected)


@register("replace_system", o.statement(_system_texts(f"{o.quoted(BLOCK)} || CASE WHEN any_value(provider) = 'anthropic' THEN coalesce(chr(10) || {PROMPTS}, '') ELSE '' END"), "fx_conv"))
def replace_system(spark, sf):
    bodies = q._request_bodies(spark, sf)
    return _heads(bodies.withColumn("body", requests.replace_system(F.col("body"), F.col("provider"), F.lit(BLOCK))))


def _heads(bodies: DataFrame) -> DataFrame:
    parsed = bodies.withColumn("request", requests.normalize(F.col("body"), F.col("provider")))
    return parsed.select(
        "conv_id", "request.system_prompt", requests.last_user_content(F.col("request.messages")).alias("last_user")
    )


@register(
    "gzip_responses",
    "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'",
)
def gzip_responses(spark, sf):
    """Answers of odd turns arrive compressed."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))

    answers = fx.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    odd = F.col("turn") % 2 == 1
    body = F.when(odd, pack(F.when(odd, F.col("text")))).otherwise(F.encode("text", "UTF-8"))
    rows = answers.select("conv_id", "turn", body.alias("body"), F.when(odd, "gzip").alias("encoding"))
    return rows.select("conv_id", "turn", inline.response_text(F.col("body"), F.col("encoding")).alias("text"))


@register(
    "wallet_status",
    o.statement(
        "SELECT count(*) AS turn_count, count(DISTINCT session_id) AS session_count FROM fx_turns",
        *o.TURNS,
    ),
)
def wallet_status(spark, sf):
    root = fresh_dir(spark, "wallet")
    docs = q._turn_documents(spark, sf).select(F.concat(F.lit("turns/"), F.col("path")).alias("path"), "content")
    failures = sinks.export_markdown(docs, root).filter(~F.col("ok")).count()
    if failures:
        raise RuntimeError(f"{failures} files could not be written below {root}")
    return wallet.status(spark, root).select("turn_count", "session_count")

"""User-facing API: one memory store below a folder.

Tables below ``root``: ``turns`` (by day), ``index`` (inverted index of turns),
``vectors`` (optional), ``captures``, ``memories`` and ``processed``
(snapshots). Methods take and return DataFrames; nothing large passes the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from turnlake.config import Config
from turnlake.functions import dates, redaction, requests
from turnlake.functions import text as tx
from turnlake.operators import documents, index, memories, packing, passages, sessions, turns, vectors
from turnlake.plans import extraction, search, status
from turnlake.session import cut_lineage, prepare
from turnlake.sources import inline, sinks

REQUEST_COLUMNS = "request_id string, url string, headers map<string,string>, body string, response string, ts timestamp"
MEMORY_SCHEMA = (
    "memory_id string, text string, category string, confidence string, source string, "
    "created_at timestamp, valid_from timestamp, invalidated_at timestamp"
)
TURN_SCHEMA = (
    "turn_id string, session_id string, turn_index bigint, user_content string, assistant_content string, "
    "tool string, model string, ts timestamp, fingerprint string, turn_date date"
)
INDEX_CARRY = "ts timestamp"  # stored with postings: limits searches by time and names the days to read
VECTOR_SCHEMA = "turn_id string, hash string, embedding array<float>"
PASSAGE_SCHEMA = "turn_id string, hash string, passage bigint, start bigint, embedding array<float>, error string"


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()) -> None:
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.config = config

    # --- reading ------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def turns(self) -> DataFrame:
        return self._table("turns", TURN_SCHEMA)

    def turn(self, turn_id: str) -> DataFrame:
        return self.turns().filter(F.col("turn_id") == turn_id).limit(1)

    def memories(self) -> DataFrame:
        return sinks.read_snapshot(self.spark, f"{self.root}/memories", MEMORY_SCHEMA)

    def profile(self) -> str:
        return sinks.read_text(self.spark, f"{self.root}/profile")

    # --- capturing ----------------------------------------------------------

    def normalize(self, captured: DataFrame) -> DataFrame:
        """Captured requests as (request_id, tool, provider, model, messages, ...).

        ``captured`` has request_id, url, headers, body, response and ts. The
        response is text, or bytes that ``response_encoding`` (gzip, deflate)
        says how to unpack. A boolean ``incognito`` column marks single rows.
        Invalid requests keep a row with ``error`` set.
        """
        if captured.schema["response"].dataType == BinaryType():
            encoding = F.col("response_encoding") if "response_encoding" in captured.columns else F.lit(None)
            captured = captured.withColumn("response", inline.response_text(F.col("response"), encoding))
        marked = F.col("incognito") if "incognito" in captured.columns else F.lit(False)
        incognito = F.coalesce(marked, F.lit(False)) | F.lit(self.config.incognito)
        captured = captured.withColumn("incognito", incognito)
        incognito = F.col("incognito")
        header = lambda name: F.col("headers")[name]
        detected = captured.withColumns(
            {
                "format": requests.detect_format(F.col("url"), F.col("headers"), F.col("body")),
                "tool": requests.match_tool(self.config.tools, header("authorization"), header("x-api-key")),
            }
        ).withColumn("request", requests.normalize(F.col("body"), F.col("format")))
        answer = requests.assistant_answer(F.col("response"), F.col("request.provider"))
        listed = requests.with_answer(
            requests.with_system_first(F.col("request.system_prompt"), F.col("request.messages")), answer
        )
        error = F.when(F.col("tool").isNull(), F.lit("no tool matches the credentials")).otherwise(F.col("request.error"))
        return detected.select(
            "request_id",
            "tool",
            "ts",
            F.col("request.provider").alias("provider"),
            F.col("request.model").alias("model"),
            F.col("request.system_prompt").alias("system_prompt"),
            listed.alias("messages"),
            F.coalesce(
                tx.context_fingerprint(F.col("request.system_prompt"), self.config.context_tag),
                F.lit(tx.DEFAULT_FINGERPRINT),
            ).alias("fingerprint"),
            incognito.alias("incognito"),
            error.alias("error"),
        )

    def capture(self, captured: DataFrame) -> None:
        """Store conversations and turn pairs of captured requests and index the turns.

        Ids derive from the request, so capturing a request twice adds nothing.
        Turns stored by a run that failed before indexing them are left to
        ``reconcile``. Incognito leaves nothing behind: with the setting on
        nothing is written, and rows marked so are dropped first.
        """
        if self.config.incognito:
            return
        good = self.normalize(captured).filter(F.col("error").isNull() & ~F.col("incognito"))
        conversations = good.select(
            F.concat(F.lit("conv_"), "request_id").alias("capture_id"),
            "tool", "provider", "model", "ts", "incognito", "fingerprint",
            F.transform(
                "messages", lambda m: F.struct(m["role"].alias("role"), redaction.redact_secrets(m["content"]).alias("content"))
            ).alias("messages"),
        )
        fresh = cut_lineage(
            conversations.dropDuplicates(["capture_id"]).join(
                self._table("captures", f"{self._capture_schema()}, turn_date date").select("capture_id"),
                "capture_id",
                "left_anti",
            )
        )
        pairs = fresh.select(
            "capture_id", "tool", "model", "ts", "fingerprint", F.inline(turns.pairs_in_array(F.col("messages")))
        ).select(
            F.concat_ws("_", F.lit("turn"), "capture_id", "turn_index").alias("turn_id"),
            F.col("capture_id").alias("session_id"),
            "turn_index", "user_content", "assistant_content", "tool", "model", "ts", "fingerprint",
        )
        # The day is a partition column: only the days captured now are looked at.
        known = self.turns().select(F.col("turn_date").alias("_day"), F.col("turn_id").alias("_id"))
        new = (F.col("turn_id") == F.col("_id")) & (F.to_date("ts") == F.col("_day"))
        pairs = cut_lineage(pairs.join(known, new, "left_anti"))
        sinks.append_by_day(pairs, f"{self.root}/turns")
        self._index(pairs)
        # Captures are written last: a run that failed before this point is repeated in full.
        sinks.append_by_day(fresh, f"{self.root}/captures")

    def _index(self, rows: DataFrame, removed: DataFrame | None = None) -> None:
        index.add(
            rows, "turn_id", search.turn_text(), f"{self.root}/index", removed, self.config.index_buckets, carry=["ts"]
        )

    @staticmethod
    def _capture_schema() -> str:
        return (
            "capture_id string, tool string, provider string, model string, ts timestamp, incognito boolean, "
            "fingerprint string, messages array<struct<role:string,content:string>>"
        )

    def captures(self) -> DataFrame:
        return self._table("captures", f"{self._capture_schema()}, turn_date date")

    # --- retrieval ----------------------------------------------------------

    def search_turns(
        self,
        query: str,
        now: Column,
        limit: int | None = None,
        fingerprint: str | None = None,
        query_vector: Sequence[float] | None = None,
        after: Column | None = None,
        before: Column | None = None,
    ) -> DataFrame:
        """Ranked turns for a query, from the index; bodies are read for the hits only.

        ``after`` <= ts < ``before`` limits the turns searched. With a query
        vector and stored vectors the lexical and vector lists are fused;
        without either the lexical list is used alone.
        """
        injection = self.config.injection
        limit = injection.max_turns if limit is None else limit
        hits = index.search(
            self.spark, f"{self.root}/index", "turn_id", query, 2 * limit, carry=INDEX_CARRY,
            where=search.between(after, before),
        )
        if query_vector is not None:
            stored = self.stored_vectors()
            if after is not None or before is not None:
                inside = search.in_date_range(self.turns(), after, before).select("turn_id")
                stored = stored.join(inside, "turn_id", "left_semi")
            if not stored.isEmpty():
                near = vectors.nearest(stored, "turn_id", "embedding", F.lit(list(query_vector)), 2 * limit)
                hits = vectors.fuse([hits.select("turn_id", "score"), near], "turn_id", 2 * limit, depth=2 * limit, unit=True)
                # At most 2 * limit hits are broadcast; days are unknown for hits by vector.
                return self._ranked(self.turns().join(F.broadcast(hits), "turn_id"), now, limit, fingerprint)
        return self._ranked(self._fetched(hits), now, limit, fingerprint)

    def _fetched(self, hits: DataFrame) -> DataFrame:
        """Turns of a hit list with ts: the hits, a bounded number, name the days and ids to read."""
        rows = hits.select("turn_id", F.to_date("ts").alias("day"), "score").collect()
        if not rows:
            return self.turns().withColumn("score", F.lit(0.0)).limit(0)
        days = sorted({row.day for row in rows if row.day is not None})
        ids = [row.turn_id for row in rows]
        found = self.turns().filter(F.col("turn_date").isin(days) & F.col("turn_id").isin(ids))
        scores = self.spark.createDataFrame([(row.turn_id, row.score) for row in rows], "turn_id string, score double")
        return found.join(F.broadcast(scores), "turn_id")

    def _ranked(self, fetched: DataFrame, now: Column, limit: int, fingerprint: str | None) -> DataFrame:
        injection = self.config.injection
        return search.rerank_turns(
            fetched, now, limit, injection.min_relevance_score, injection.recency_boost,
            None if fingerprint is None else F.lit(fingerprint),
        )

    def inject(self, query: str, now: Column, system_prompt: str | None = None) -> DataFrame:
        """One row: the context block for a question and the system prompt with it in front."""
        if self.config.incognito or not query:
            return self.spark.createDataFrame([("", 0, 0, False, system_prompt or "")], self._block_schema())
        prompt = F.lit(system_prompt).cast("string")
        wanted = self.spark.range(1).select(tx.context_fingerprint(prompt, self.config.context_tag)).first()[0]
        hits = packing.turn_entries(self.search_turns(query, now, fingerprint=wanted))
        block = packing.injection_block(hits, self.profile(), self.config.injection, self.config.context_tag)
        return block.withColumn("system_prompt", packing.into_system_prompt(prompt, F.col("text")))

    def inject_request(self, request: DataFrame, now: Column) -> DataFrame:
        """A request (one row: request_id, url, headers, body) with the context block in its system prompt.

        Requests that are not understood, and those without a fitting memory,
        come back as they are.
        """
        empty = {"response": F.lit(None).cast("string"), "ts": now}
        normal = self.normalize(request.withColumns(empty)).withColumn(
            "question", requests.last_user_content(F.col("messages"))
        ).first()
        if normal is None or normal.error is not None:
            return request
        block = self.inject(normal.question, now, normal.system_prompt).first().text
        if not block:
            return request
        return request.withColumn("body", requests.inject_system(F.col("body"), F.lit(normal.provider), F.lit(block)))

    @staticmethod
    def _block_schema() -> str:
        return "text string, token_count bigint, memory_count bigint, has_profile boolean, system_prompt string"

    def search_memories(self, query: str, limit: int = 10, min_score: float = 0.3, live_only: bool = True) -> DataFrame:
        """(source, id, score) over conversations and memories."""
        from turnlake.operators import bm25

        terms = tx.query_terms(query)
        spoken = self.captures().select(F.col("capture_id").alias("id"), F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("t"))
        stored = self.memories()
        if live_only:
            stored = stored.filter(F.col("invalidated_at").isNull())
        facts = stored.select(F.col("memory_id").alias("id"), F.col("text").alias("t"))
        return search.search_collections(
            {
                "conversations": bm25.count_terms(spoken, F.col("t"), terms).drop("t"),
                "memories": bm25.count_terms(facts, F.col("t"), terms).drop("t"),
            },
            query, limit, min_score,
        )

    # --- maintenance --------------------------------------------------------

    def stored_vectors(self) -> DataFrame:
        """(turn_id, embedding) of turns as they are; those of removed or edited texts are left out."""
        now = self.turns().select("turn_id", index.body_hash(search.turn_text()).alias("hash"))
        stored = self._table("vectors", VECTOR_SCHEMA)
        return stored.join(now, ["turn_id", "hash"], "left_semi").select("turn_id", "embedding")

    def reconcile(self, embed: bool = True, embedder=vectors.embed) -> dict[str, int]:
        """Bring index and vectors in line with the stored turns, by key and hash of the text.

        New turns are indexed, edited ones indexed anew, vanished ones dropped.
        A vector counts for the text it was made of, and turns without one get
        one. ``embedder(docs, key, text)`` returns (key, embedding); a model
        goes here.
        """
        base = f"{self.root}/index"
        indexed = index.keys(self.spark, base, "turn_id").withColumnRenamed("hash", "_old")
        stored = self.turns().select("turn_id", index.body_hash(search.turn_text()).alias("_new"))
        status = (
            F.when(F.col("_old").isNull(), "indexed")
            .when(F.col("_new").isNull(), "removed")
            .when(F.col("_old") != F.col("_new"), "updated")
            .otherwise("unchanged")
        )
        compared = cut_lineage(stored.join(indexed, "turn_id", "full_outer").select("turn_id", status.alias("status")))
        counts = dict.fromkeys(("indexed", "updated", "unchanged", "removed"), 0)
        counts |= {row.status: row["count"] for row in compared.groupBy("status").count().collect()}
        counts["embedded"] = 0
        superseded = compared.filter(F.col("status").isin("removed", "updated")).select("turn_id")
        if counts["indexed"] or counts["updated"] or counts["removed"]:
            fresh = compared.filter(F.col("status").isin("indexed", "updated")).select("turn_id")
            rows = self.turns().join(fresh, "turn_id", "left_semi")
            self._index(rows, superseded if counts["updated"] or counts["removed"] else None)
        if embed:
            lacking = vectors.lacking(self.turns(), self.stored_vectors(), "turn_id")
            new = cut_lineage(embedder(lacking, "turn_id", search.turn_text()))
            counts["embedded"] = new.count()
            if counts["embedded"]:
                hashes = lacking.select("turn_id", index.body_hash(search.turn_text()).alias("hash"))
                named = new.select("turn_id", "embedding").join(hashes, "turn_id").select("turn_id", "hash", "embedding")
                named.write.mode("append").parquet(f"{self.root}/vectors")
        return counts

    def passages(self) -> DataFrame:
        """(turn_id, passage, start, embedding) of turns as they are; those of removed or edited texts are left out."""
        now = self.turns().select("turn_id", index.body_hash(search.turn_text()).alias("hash"))
        stored = self._table("passages", PASSAGE_SCHEMA).filter("error IS NULL")
        return stored.join(now, ["turn_id", "hash"], "left_semi").select("turn_id", "passage", "start", "embedding")

    def embed_passages(self, model: passages.Model | None = None) -> dict[str, int]:
        """Give every passage of every turn that has no vector yet one; failed ones are tried again by the next run.

        Returns docs_processed, chunks_embedded and errors of this run.
        """
        key = F.struct("turn_id", index.body_hash(search.turn_text()).alias("hash")).alias("turn")
        pieces = passages.cut(self.turns().select(key, search.turn_text().alias("text")), "turn", F.col("text"))
        done = self._table("passages", PASSAGE_SCHEMA).filter("error IS NULL")
        lacking = pieces.join(done.select(F.struct("turn_id", "hash").alias("turn"), "passage"), ["turn", "passage"], "left_anti")
        new = cut_lineage(passages.embed(lacking, "turn", model))
        counts = passages.counters(new, "turn").first().asDict()
        if counts["docs_processed"]:
            new.select("turn.*", "passage", "start", "embedding", "error").write.mode("append").parquet(f"{self.root}/passages")
        return counts

    def search_passages(
        self, query: str, query_vector: Sequence[float], limit: int = 10, scorer: passages.Scorer | None = None
    ) -> DataFrame:
        """(turn_id, score, best_chunk, best_chunk_pos): hybrid search over passages, re-ranked by ``scorer`` if given."""
        return search.search_passages(
            self.turns(), "turn_id", search.turn_text(), self.passages(), query, query_vector, limit, scorer
        )

    # --- extraction ---------------------------------------------------------

    def sessions(self, marker: str = "haiku") -> DataFrame:
        """Representative captures."""
        counted = self.captures().withColumns(
            {
                "n": F.size(F.filter("messages", lambda m: m["role"] != F.lit("system"))).cast("bigint"),
                "wallet_id": F.lit(self.root),
            }
        )
        narrow = counted.select("wallet_id", "capture_id", "tool", "model", "ts", "incognito", "n")
        return sessions.representatives(sessions.assign_sessions(narrow, marker))

    def extract(self, extractor, decider, now: Column, prompts: extraction.Prompts = extraction.Prompts()) -> DataFrame:
        """Run extraction over pending sessions and store the new snapshots; returns the statistics."""
        # A capture is its own conversation here; its messages keep their positions.
        found = self.sessions()
        rows = self.captures().join(found.select("capture_id"), "capture_id", "left_semi")
        messages = rows.select("capture_id", F.posexplode("messages").alias("turn", "m")).select(
            F.col("capture_id").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
            F.col("m.role").alias("role"), F.col("m.content").alias("text"),
        )
        processed = sinks.read_snapshot(self.spark, f"{self.root}/processed", "capture_id string")
        sessions_df = found.withColumns({"conv_id": F.col("capture_id"), "end_turn": F.lit(2**31 - 1)})
        run = extraction.run_extraction(
            sessions_df, messages, processed, self.memories(), extractor, decider, now,
            self.profile(), self._summary(), prompts,
        )
        stats = cut_lineage(run["stats"])
        sinks.write_snapshot(run["memories"], f"{self.root}/memories")
        sinks.write_snapshot(run["processed"], f"{self.root}/processed")
        last = run["actions"].agg(F.max_by("summary_update", F.struct("valid_from", "fact_id"))).first()[0]
        if last is not None:
            sinks.write_text(self.spark, f"{self.root}/summary", last)
        return stats

    def _summary(self) -> str:
        return sinks.read_text(self.spark, f"{self.root}/summary")

    def profile_lines(self) -> DataFrame:
        """Numbered lines of the live high-confidence memories."""
        return memories.profile_lines(self.memories().withColumn("wallet_id", F.lit(self.root)))

    def regenerate_profile(self, model) -> str:
        """Profile text from the live high-confidence memories; empty when there are none.

        The model sees 4096 memories at a time. Its answers are summarised in
        the same way until one is left, so one text reaches the driver.
        """
        lines = self.profile_lines()
        profile = ""
        while not lines.isEmpty():
            parts = extraction.profile_prompt_parts(lines).select(F.col("part").cast("string").alias("part"), "prompt")
            answers = extraction.ask(parts, "part", model)
            failed = answers.filter(F.col("error").isNotNull())
            if not failed.isEmpty():
                raise RuntimeError(f"profile not regenerated: {failed.first().error}")
            if answers.count() == 1:
                profile = answers.first().content.strip(tx.WHITESPACE)
                break
            number = F.col("part").cast("bigint") + 1
            lines = answers.select(
                F.lit(self.root).alias("wallet_id"), number.alias("n"), F.concat(number, F.lit(". "), "content").alias("line")
            )
        sinks.write_text(self.spark, f"{self.root}/profile", profile)
        return profile

    # --- reporting ----------------------------------------------------------

    def status(self) -> DataFrame:
        return status.status(self.turns())

    def list_turns(self, needle: str = "") -> DataFrame:
        """Turns holding a substring, newest first."""
        return status.filter_turns(self.turns(), needle).orderBy(F.desc("ts"), "turn_id")

    def date_groups(self, now: Column) -> DataFrame:
        return status.date_groups(self.turns(), now)

    def export_markdown(self, folder: str) -> DataFrame:
        """Conversations, turns and memories as markdown files of a file-based wallet."""
        capture_docs = self.captures().select(
            F.concat(
                F.lit("conversations/"), documents.capture_path(F.col("capture_id"), F.col("tool"), F.col("ts"))
            ).alias("path"),
            documents.render_capture().alias("content"),
        )
        turn_docs = self.turns().select(
            F.concat(F.lit("turns/"), documents.turn_path()).alias("path"), documents.render_turn().alias("content")
        )
        memory_docs = self.memories().select(
            F.concat(F.lit("memories/"), "memory_id", F.lit(".md")).alias("path"),
            documents.render_memory().alias("content"),
        )
        return sinks.export_markdown(capture_docs.unionByName(turn_docs).unionByName(memory_docs), folder)

    @property
    def last_capture_day(self) -> str | None:
        newest = self.turns().agg(dates.utc_day(F.max("ts"))).first()
        return newest[0] if newest else None

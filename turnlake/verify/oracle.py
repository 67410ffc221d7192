"""DuckDB statements computing the same results from the same tables.

Plain windows, explicit joins and RE2-compatible patterns, with no slicing or
pruning. Fixed values (redaction rules, tags, white space) are shared with the
Spark code; the logic around them is not.
"""

from __future__ import annotations

from turnlake import fixtures
from turnlake.functions.redaction import RULES
from turnlake.functions.text import CONTEXT_TAG, FOREIGN_TAGS, WHITESPACE, WS

NOW = f"TIMESTAMP '{fixtures.NOW}'"
QUERY_TERMS = "('thing','from','this')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim(expr: str) -> str:
    return f"trim({expr}, {quoted(WHITESPACE)})"


def redact(expr: str) -> str:
    for pattern, replacement in RULES:
        target = replacement.replace("$1", "\\1")
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(target)}, 'g')"
    return expr


def words(expr: str) -> str:
    return rf"list_filter(string_split_regex(lower({expr}), '[^0-9A-Za-z_]+'), lambda w: w <> '')"


def units(expr: str) -> str:
    return rf"(length({expr}) + length(regexp_replace({expr}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def tokens(expr: str) -> str:
    return f"CAST((({units(expr)}) + 3) // 4 AS BIGINT)"


def strip_tags(expr: str, *tags: str) -> str:
    for tag in tags:
        expr = rf"regexp_replace({expr}, '<{tag}>(?s:.*?)</{tag}>', '', 'g')"
    return expr


def fingerprint(expr: str) -> str:
    cleaned = trim(strip_tags(expr, CONTEXT_TAG))
    return (
        f"CASE WHEN {expr} IS NULL OR {cleaned} = '' THEN 'default' "
        f"ELSE substr(sha256(substr({cleaned}, 1, 2048)), 1, 12) END"
    )


def overlap(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
        f"ELSE len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b})) END"
    )


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


TS = "(TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 120 AS INTEGER)) + to_minutes(conv_id))"

CTES = {
    "fx_conv": f"""
        SELECT conv_id, conv_id % 4 AS wallet_id, {TS} AS ts,
               ['alpha','beta','gamma'][CAST(conv_id % 3 AS INTEGER) + 1] AS tool,
               CASE WHEN conv_id % 3 = 1 THEN 'anthropic' ELSE 'openai' END AS provider,
               CASE WHEN conv_id % 10 = 0 THEN 'small-haiku' ELSE 'large-general' END AS model,
               conv_id % 17 = 0 AS incognito,
               {fingerprint("system_text")} AS fingerprint
        FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS system_text
              FROM conversations GROUP BY conv_id)""",
    "spoken": """
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lag(role) OVER w AS prev_role,
               count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS n
        FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "pairs": f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index,
               {redact("text")} AS user_content, {redact("next_text")} AS assistant_content
        FROM spoken WHERE role = 'user' AND next_role = 'assistant'""",
    "fx_turns": """
        SELECT 'turn_' || conv_id || '_' || turn_index AS turn_id, 'conv_' || conv_id AS session_id, p.*,
               c.* EXCLUDE (conv_id)
        FROM pairs p JOIN fx_conv c USING (conv_id)""",
    "captures": """
        SELECT 'cap_' || e.conv_id || '_' || e.k AS capture_id, e.conv_id, e.k, e.n, e.end_turn,
               c.wallet_id, c.ts + to_minutes(e.k) AS ts, c.tool, c.model, c.incognito
        FROM (SELECT conv_id, n, turn AS end_turn,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
              FROM spoken WHERE role = 'assistant' AND prev_role = 'user') e
        JOIN fx_conv c USING (conv_id)""",
    "sessions": """
        SELECT *, sum(is_start) OVER (PARTITION BY wallet_id ORDER BY ts, capture_id) AS session_no
        FROM (SELECT *, CASE WHEN tool = lag(tool) OVER w AND n > lag(n) OVER w THEN 0 ELSE 1 END AS is_start
              FROM captures WHERE NOT incognito AND NOT (contains(model, 'haiku') AND n <= 2)
              WINDOW w AS (PARTITION BY wallet_id ORDER BY ts, capture_id))""",
    "reps": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY wallet_id, session_no ORDER BY ts DESC, capture_id DESC) AS rn
            FROM sessions) WHERE rn = 1 AND n >= 3""",
}


def bm25_ctes(source: str, key: str, body: str, prefix: str, terms: str = QUERY_TERMS) -> dict[str, str]:
    """Okapi BM25 over exploded tokens; last CTE is ``{prefix}_score(key, score)``."""
    return {
        f"{prefix}_tok": f"SELECT {key}, unnest({words(body)}) AS term FROM {source}",
        f"{prefix}_len": f"SELECT {key}, len({words(body)}) AS dl FROM {source}",
        f"{prefix}_tf": f"SELECT {key}, term, count(*) AS tf FROM {prefix}_tok WHERE term IN {terms} GROUP BY ALL",
        f"{prefix}_df": f"SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term",
        f"{prefix}_n": f"SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM {prefix}_len",
        f"{prefix}_raw": f"""
            SELECT {key}, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                   / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw
            FROM {prefix}_tf JOIN {prefix}_df USING (term) JOIN {prefix}_len USING ({key}), {prefix}_n
            GROUP BY {key}""",
        f"{prefix}_score": f"SELECT {key}, round(raw / (1 + raw), 6) AS score FROM {prefix}_raw",
    }


TURN_BM25 = bm25_ctes("fx_turns", "turn_id", "user_content || chr(10) || assistant_content", "t")


def search_ctes(source: str = "fx_turns", prefix: str = "t") -> dict[str, str]:
    body = "user_content || chr(10) || assistant_content"
    compared = "list_distinct(" + words("user_content || ' ' || assistant_content") + ")"
    return {
        **bm25_ctes(source, "turn_id", body, prefix),
        "fetched": f"SELECT * FROM {prefix}_score ORDER BY score DESC, turn_id LIMIT 16",
        "wanted": "SELECT arg_min(fingerprint, conv_id) AS fp FROM fx_conv WHERE fingerprint <> 'default'",
        "boosted": f"""
            SELECT turn_id, session_id, {compared} AS ws,
                   round(score * (1 + 0.3::DOUBLE * greatest(0, 1 - (epoch_ms({NOW}) - epoch_ms(ts)) / 86400000.0::DOUBLE / 90))
                         * CASE WHEN fingerprint = fp THEN 1.5::DOUBLE ELSE 1 END, 6) AS score
            FROM fetched JOIN {source} USING (turn_id), wanted""",
        "listed": """
            SELECT session_id, list({'s': score, 'id': turn_id, 'ws': ws} ORDER BY score DESC, turn_id) AS l
            FROM boosted GROUP BY session_id""",
        "kept": f"""
            SELECT unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
                CASE WHEN len(list_filter(acc, lambda k: {overlap("k.ws", "x[1].ws")} > 0.9)) > 0
                     THEN acc ELSE list_concat(acc, x) END)) AS k, session_id FROM listed""",
        "deduped": "SELECT k.id AS turn_id, session_id, k.s AS score FROM kept",
        "results": """
            SELECT turn_id, session_id, score, row_number() OVER (ORDER BY score DESC, turn_id) AS rank
            FROM deduped WHERE score >= 0.3 ORDER BY score DESC, turn_id LIMIT 8""",
    }


def statement(select: str, *names: str, extra: dict[str, str] | None = None, before: dict[str, str] | None = None) -> str:
    """A SELECT with the named shared CTEs (in dependency order) and local ones."""
    wanted = {name: CTES[name] for name in CTES if name in names}
    parts = {**(before or {}), **wanted, **(extra or {})}
    if not parts:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items()) + "\n" + select


TURNS = ("fx_conv", "spoken", "pairs", "fx_turns")
CAPTURES = ("fx_conv", "spoken", "captures")


def first_sentences(expr: str, count: int = 3) -> str:
    marked = rf"regexp_replace({expr}, '([.!?]){WS}+([A-Z0-9\-`*])', '\1' || chr(1) || '\2', 'g')"
    parts = f"list_slice(string_split({marked}, chr(1)), 1, {count})"
    return f"array_to_string(list_transform({parts}, lambda s: rtrim(s, {quoted(WHITESPACE)})), ' ')"


def truncate(expr: str) -> str:
    return f"CASE WHEN {tokens(expr)} <= 200 THEN {expr} ELSE {first_sentences(expr)} END"


def entry(ts: str, user: str, assistant: str) -> str:
    question = trim(rf"regexp_replace({user}, '\n+', ' ', 'g')")
    return f"'[' || strftime({ts}, '%Y-%m-%d') || '] You: ' || {question} || chr(10) || '→ ' || {truncate(assistant)}"


def clean_section(expr: str) -> str:
    return trim(strip_tags(expr, FOREIGN_TAGS[0], CONTEXT_TAG, FOREIGN_TAGS[1]))


TURN_DOC = f"""'---' || chr(10) || 'id: ' || turn_id || chr(10) || 'sessionId: ' || session_id || chr(10)
    || 'tool: ' || tool || chr(10) || 'timestamp: ' || {iso('ts')} || chr(10) || 'turnIndex: ' || turn_index || chr(10)
    || 'contextFingerprint: ' || fingerprint || chr(10) || '---' || chr(10) || chr(10) || '## User' || chr(10)
    || user_content || chr(10) || chr(10) || '## Assistant' || chr(10) || assistant_content || chr(10)"""

CATEGORY = "['IDENTITY','PREFERENCE','CONTEXT','RELATIONSHIP','SKILL','EVENT'][CAST((conv_id + turn_index) % 6 AS INTEGER) + 1]"
CONFIDENCE = "['HIGH','MEDIUM','LOW'][CAST((conv_id + turn_index) % 3 AS INTEGER) + 1]"
ACTION = "['ADD','UPDATE','INVALIDATE','NOOP'][CAST((conv_id + turn_index) % 4 AS INTEGER) + 1]"

MEMORY = {
    "mem": f"""
        SELECT 'mem_' || conv_id || '_' || turn_index AS memory_id, wallet_id, assistant_content AS text,
               {CATEGORY} AS category, {CONFIDENCE} AS confidence, session_id AS source, ts AS created_at,
               ts AS valid_from, CASE WHEN tool = 'gamma' THEN ts + INTERVAL 30 DAY END AS invalidated_at
        FROM fx_turns""",
    "fact": f"""
        SELECT 'fact_' || conv_id || '_' || turn_index AS fact_id, user_content AS text, {CATEGORY} AS category,
               {CONFIDENCE} AS confidence, session_id AS source, ts AS valid_from, {ACTION} AS action,
               'mem_' || conv_id || '_' || (turn_index + 1) AS target_id
        FROM fx_turns""",
    "acts": """
        SELECT f.*, f.action NOT IN ('UPDATE', 'INVALIDATE') OR m.memory_id IS NOT NULL AS applied
        FROM fact f LEFT JOIN mem m ON m.memory_id = f.target_id""",
}

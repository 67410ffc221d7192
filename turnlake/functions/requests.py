"""Captured provider requests and responses as VARIANT expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.config import ToolConfig, resolve_key
from turnlake.functions.text import bind, js_trim, strip_bearer

# --- fixed values -----------------------------------------------------------
OPENAI_ROLES = ("system", "user", "assistant", "tool", "function")
ANTHROPIC_ROLES = ("user", "assistant")
SSE_PREFIX = "data: "
SSE_END = "[DONE]"
# ----------------------------------------------------------------------------

NORMALIZED = (
    "struct<provider:string,model:string,messages:array<struct<role:string,content:string>>,"
    "system_prompt:string,stream:boolean,error:string>"
)


def kind(value: Column) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...>, VOID, ... or NULL when absent."""
    return F.schema_of_variant(value)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def string_at(value: Column, path: str) -> Column:
    """The string at a path; NULL for any other JSON type."""
    return bind(at(value, path), lambda found: F.when(kind(found) == "STRING", found.try_cast("string")))


def array_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _is_number(value: Column) -> Column:
    return F.coalesce(kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def text_parts(parts: Column, separator: str) -> Column:
    """Texts of the ``type = text`` blocks of a content array."""
    texts = F.filter(parts, lambda p: string_at(p, "$.type") == F.lit("text"))
    return F.array_join(F.transform(texts, lambda p: F.coalesce(string_at(p, "$.text"), F.lit(""))), separator)


def content_text(message: Column) -> Column:
    """Plain text of a message: a string, or the text blocks of an array, else ''."""
    return F.coalesce(
        string_at(message, "$.content"), text_parts(array_at(message, "$.content"), ""), F.lit("")
    )


def _plain(messages: Column) -> Column:
    return F.transform(
        messages, lambda m: F.struct(string_at(m, "$.role").alias("role"), content_text(m).alias("content"))
    )


def _all_roles_in(messages: Column, roles: Sequence[str]) -> Column:
    return F.forall(messages, lambda m: F.coalesce(string_at(m, "$.role").isin(list(roles)), F.lit(False)))


def _spoken(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant"))


def normalize_openai(body: Column) -> Column:
    messages = array_at(body, "$.messages")
    plain = _plain(messages)
    system = F.filter(plain, lambda m: m["role"] == F.lit("system"))
    valid = (
        string_at(body, "$.model").isNotNull() & messages.isNotNull() & _all_roles_in(messages, OPENAI_ROLES)
    )
    prompt = F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda m: m["content"]), "\n"))
    return _normalized("openai", valid, body, _spoken(plain), prompt, "missing model or messages")


def normalize_anthropic(body: Column) -> Column:
    messages = array_at(body, "$.messages")
    valid = (
        string_at(body, "$.model").isNotNull()
        & messages.isNotNull()
        & _is_number(at(body, "$.max_tokens"))
        & _all_roles_in(messages, ANTHROPIC_ROLES)
    )
    prompt = F.coalesce(string_at(body, "$.system"), text_parts(array_at(body, "$.system"), "\n"))
    return _normalized(
        "anthropic", valid, body, _plain(messages), F.nullif(prompt, F.lit("")), "missing model, messages or max_tokens"
    )


def _normalized(provider: str, valid: Column, body: Column, messages: Column, prompt: Column, problem: str) -> Column:
    good = F.struct(
        F.lit(provider).alias("provider"),
        string_at(body, "$.model").alias("model"),
        messages.alias("messages"),
        prompt.alias("system_prompt"),
        F.coalesce(F.try_variant_get(body, "$.stream", "boolean"), F.lit(False)).alias("stream"),
        F.lit(None).cast("string").alias("error"),
    ).cast(NORMALIZED)
    bad = F.struct(
        F.lit(provider).alias("provider"),
        F.lit(None).alias("model"),
        F.lit(None).alias("messages"),
        F.lit(None).alias("system_prompt"),
        F.lit(None).alias("stream"),
        F.lit(f"invalid {provider} request: {problem}").alias("error"),
    ).cast(NORMALIZED)
    return F.when(F.coalesce(valid, F.lit(False)), good).otherwise(bad)


def normalize(body_json: Column, request_format: Column) -> Column:
    """Normalised request; formats other than openai are read as anthropic."""
    body = F.try_parse_json(body_json)
    return F.when(request_format == "openai", normalize_openai(body)).otherwise(normalize_anthropic(body))


def with_system_first(system_prompt: Column, messages: Column) -> Column:
    """Message list with the system prompt, where there is one, in front."""
    head = F.struct(F.lit("system").alias("role"), system_prompt.alias("content"))
    return F.when(system_prompt.isNotNull(), F.concat(F.array(head), messages)).otherwise(messages)


def with_answer(messages: Column, answer: Column) -> Column:
    tail = F.struct(F.lit("assistant").alias("role"), answer.alias("content"))
    return F.when(F.length(answer) > 0, F.concat(messages, F.array(tail))).otherwise(messages)


def last_user_content(messages: Column) -> Column:
    asked = F.filter(messages, lambda m: m["role"] == F.lit("user"))
    return F.coalesce(F.get(asked, F.size(asked) - 1)["content"], F.lit(""))


def detect_format(url: Column, headers: Column, body_json: Column) -> Column:
    """openai, anthropic or unknown; path before headers before body shape."""
    has = lambda name: F.map_contains_key(headers, name)
    has_messages = F.coalesce(kind(at(F.try_parse_json(body_json), "$.messages")).isNotNull(), F.lit(False))
    return (
        F.when(url.startswith("/v1/messages"), "anthropic")
        .when(url.startswith("/v1/chat/") | url.startswith("/v1/completions"), "openai")
        .when(has("anthropic-version"), "anthropic")
        .when(has_messages & has("x-api-key"), "anthropic")
        .when(has_messages & has("authorization"), "openai")
        .otherwise("unknown")
    )


def match_tool(tools: Sequence[ToolConfig], authorization: Column, api_key: Column) -> Column:
    """Name of the first configured tool the credentials fit, else NULL.

    The list is configuration, so it becomes a CASE chain in list order.
    """
    bearer = strip_bearer(authorization)
    given = F.coalesce(F.length(bearer) > 0, F.lit(False)) | F.coalesce(F.length(api_key) > 0, F.lit(False))
    matches = []
    for tool in tools:
        if tool.api_key == "*":
            fits = given
        else:
            try:
                wanted = resolve_key(tool.api_key, unset="raise")
            except KeyError:
                continue
            fits = (bearer if tool.provider == "openai" else api_key) == wanted
        matches.append((F.coalesce(fits, F.lit(False)), tool.name))
    if not matches:
        return F.lit(None).cast("string")
    return reduce(lambda chain, match: chain.when(*match), matches[1:], F.when(*matches[0]))


def _json_answer(body: Column, provider: Column) -> Column:
    blocks = F.filter(
        array_at(body, "$.content"),
        lambda c: (string_at(c, "$.type") == F.lit("text")) & string_at(c, "$.text").isNotNull(),
    )
    joined = F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, lambda c: string_at(c, "$.text")), "\n"))
    return F.when(provider == "anthropic", joined).otherwise(string_at(body, "$.choices[0].message.content"))


SSE_CHUNK = "delta struct<type:string,text:string>, choices array<struct<delta:struct<content:string>>>"


def _sse_answer(text: Column, provider: Column) -> Column:
    marked = F.filter(F.split(text, "\n"), lambda line: line.startswith(SSE_PREFIX))
    payloads = F.transform(marked, lambda line: js_trim(F.substring(line, len(SSE_PREFIX) + 1, 2**31 - 1)))

    def up_to_end(lines: Column) -> Column:
        end = F.array_position(lines, SSE_END)
        return F.when(end > 0, F.slice(lines, F.lit(1), end.cast("int") - 1)).otherwise(lines)

    def delta(payload: Column) -> Column:
        chunk = F.from_json(payload, SSE_CHUNK)
        spoken = F.when(chunk["delta"]["type"] == "text_delta", chunk["delta"]["text"])
        return F.when(provider == "anthropic", spoken).otherwise(F.get(chunk["choices"], F.lit(0))["delta"]["content"])

    deltas = F.transform(bind(payloads, up_to_end), lambda payload: bind(payload, delta))
    return F.nullif(F.array_join(deltas, ""), F.lit(""))


def assistant_answer(response: Column, provider: Column) -> Column:
    """Answer text of a JSON or event-stream response body; NULL when there is none."""
    def answer(text: Column) -> Column:
        return bind(
            F.try_parse_json(text),
            lambda body: F.when(body.isNotNull(), _json_answer(body, provider)).otherwise(_sse_answer(text, provider)),
        )

    return bind(response, answer)


def json_string(text: Column) -> Column:
    """Text as a quoted JSON string."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def replace_system(body_json: Column, request_format: Column, prompt: Column) -> Column:
    """Request body rebuilt with a given system prompt, other fields kept.

    For openai the prompt replaces all system messages. For anthropic it goes in
    front of the existing ``system``; a NULL prompt removes either.
    """
    fields = F.from_json(body_json, "map<string,variant>")
    body = F.try_parse_json(body_json)
    message = F.concat(F.lit('{"role":"system","content":'), json_string(prompt), F.lit("}"))
    others = F.filter(array_at(body, "$.messages"), lambda m: string_at(m, "$.role") != F.lit("system"))
    rest = F.transform(others, lambda m: F.to_json(m))
    listed = F.when(prompt.isNull(), rest).otherwise(F.concat(F.array(message), rest))

    block = F.concat(F.lit('{"type":"text","text":'), json_string(prompt), F.lit("}"))
    blocks = F.concat(F.array(block), F.transform(array_at(body, "$.system"), lambda b: F.to_json(b)))
    system = (
        F.when(array_at(body, "$.system").isNotNull(), F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")))
        .when(string_at(body, "$.system").isNotNull(), json_string(F.concat_ws("\n\n", prompt, string_at(body, "$.system"))))
        .otherwise(json_string(prompt))
    )
    anthropic = request_format == "anthropic"
    target = F.when(anthropic, F.lit("system")).otherwise(F.lit("messages"))
    value = F.when(anthropic, system).otherwise(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
    kept = F.map_filter(fields, lambda k, _: k != target)
    rebuilt = F.map_concat(kept, F.create_map(target, F.try_parse_json(value)))
    return F.to_json(F.when(anthropic & prompt.isNull(), kept).otherwise(rebuilt))


def inject_system(body_json: Column, request_format: Column, block: Column) -> Column:
    """Request body with a block appended to the system prompt, other fields kept.

    The body is read as a map of raw JSON values, so unknown fields pass through.
    """
    fields = F.from_json(body_json, "map<string,variant>")
    body = F.try_parse_json(body_json)
    part = F.concat(F.lit('{"type":"text","text":'), json_string(block), F.lit("}"))

    old = F.get(F.array(at(body, "$.system")), 0)
    old_array = array_at(body, "$.system")
    system = (
        F.when(string_at(body, "$.system").isNotNull(), json_string(F.concat_ws("\n\n", string_at(body, "$.system"), block)))
        .when(
            old_array.isNotNull(),
            F.concat(F.lit("["), F.array_join(F.concat(F.transform(old_array, lambda block: F.to_json(block)), F.array(part)), ","), F.lit("]")),
        )
        .when(old.isNull(), json_string(block))
        .otherwise(F.to_json(old))
    )

    messages = array_at(body, "$.messages")
    flags = F.transform(messages, lambda m: string_at(m, "$.role") == F.lit("system"))
    last = F.size(messages) - F.array_position(F.reverse(flags), True).cast("int")

    def appended(message: Column, i: Column) -> Column:
        longer = F.concat_ws("\n\n", F.coalesce(string_at(message, "$.content"), content_text(message)), block)
        changed = F.map_concat(
            F.map_filter(F.from_json(F.to_json(message), "map<string,variant>"), lambda k, _: k != F.lit("content")),
            F.create_map(F.lit("content"), F.parse_json(json_string(longer))),
        )
        return F.when(i == last, F.to_json(changed)).otherwise(F.to_json(message))

    in_front = F.concat(F.lit('{"role":"system","content":'), json_string(block), F.lit("}"))
    listed = F.when(F.array_contains(flags, True), F.transform(messages, appended)).otherwise(
        F.concat(F.array(in_front), F.transform(messages, lambda m: F.to_json(m)))
    )
    new_messages = F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))

    target = F.when(request_format == "anthropic", F.lit("system")).otherwise(F.lit("messages"))
    value = F.when(request_format == "anthropic", system).otherwise(new_messages)
    kept = F.map_filter(fields, lambda k, _: k != target)
    return F.to_json(F.map_concat(kept, F.create_map(target, F.try_parse_json(value))))

"""Provider requests and responses."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from turnlake.config import ToolConfig
from turnlake.functions import requests as rq
from turnlake.sources.inline import response_text


def normalized(value, body, request_format):
    row = value(lambda c: rq.normalize(c, F.lit(request_format)), body if isinstance(body, str) else json.dumps(body))
    return row.asDict(recursive=True)


def test_openai(value):
    body = {
        "model": "m",
        "stream": True,
        "messages": [
            {"role": "system", "content": "one"},
            {"role": "system", "content": [{"type": "text", "text": "two"}]},
            {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url"}, {"type": "text", "text": "b"}]},
            {"role": "assistant", "content": None},
            {"role": "tool", "content": "result"},
        ],
    }
    got = normalized(value, body, "openai")
    assert got["system_prompt"] == "one\ntwo"
    assert got["messages"] == [{"role": "user", "content": "ab"}, {"role": "assistant", "content": ""}]
    assert (got["model"], got["stream"], got["error"]) == ("m", True, None)


@pytest.mark.parametrize(
    "system, prompt",
    [("be kind", "be kind"), ([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "a\nb"), ("", None), (None, None)],
)
def test_anthropic(value, system, prompt):
    body = {"model": "m", "max_tokens": 10, "messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "tool_result"}]}]}
    if system is not None:
        body["system"] = system
    got = normalized(value, body, "anthropic")
    assert got["system_prompt"] == prompt
    assert got["messages"] == [{"role": "user", "content": "x"}]
    assert got["stream"] is False


@pytest.mark.parametrize(
    "body, request_format",
    [
        ("not json", "openai"),
        ("[1]", "openai"),
        ({"messages": []}, "openai"),
        ({"model": "m"}, "openai"),
        ({"model": "m", "messages": [{"role": "robot"}]}, "openai"),
        ({"model": "m", "messages": []}, "anthropic"),
        ({"model": "m", "max_tokens": "10", "messages": []}, "anthropic"),
        ({"model": "m", "max_tokens": 10, "messages": [{"role": "system"}]}, "anthropic"),
        ({"model": "m", "messages": []}, "unknown"),
    ],
)
def test_invalid_requests_give_an_error_value(value, body, request_format):
    got = normalized(value, body, request_format)
    assert got["error"] and got["messages"] is None


@pytest.mark.parametrize(
    "url, headers, body, expected",
    [
        ("/v1/messages", {}, "{}", "anthropic"),
        ("/v1/chat/completions", {"anthropic-version": "1"}, "{}", "openai"),
        ("/v1/completions", {}, None, "openai"),
        ("/x", {"anthropic-version": "1"}, None, "anthropic"),
        ("/x", {"x-api-key": "k", "authorization": "b"}, '{"messages":[]}', "anthropic"),
        ("/x", {"authorization": "b"}, '{"messages":[]}', "openai"),
        ("/x", {"authorization": "b"}, "{}", "unknown"),
        ("/x", {}, "[]", "unknown"),
    ],
)
def test_detect_format(spark, url, headers, body, expected):
    df = spark.createDataFrame([(url, headers, body)], "u string, h map<string,string>, b string")
    assert df.select(rq.detect_format(F.col("u"), F.col("h"), F.col("b"))).first()[0] == expected


TOOLS = (
    ToolConfig("a", "openai", "k1", ""),
    ToolConfig("b", "anthropic", "k2", ""),
    ToolConfig("c", "openai", "env:TURNLAKE_TEST_KEY", ""),
    ToolConfig("d", "anthropic", "*", ""),
)


@pytest.mark.parametrize(
    "auth, key, tool",
    [("Bearer k1", None, "a"), (None, "k2", "b"), ("bearer secret", None, "c"), ("Bearer k2", None, "d"), (None, "zz", "d"), (None, None, None), ("Bearer ", "", None)],
)
def test_match_tool(spark, monkeypatch, auth, key, tool):
    monkeypatch.setenv("TURNLAKE_TEST_KEY", "secret")
    df = spark.createDataFrame([(auth, key)], "a string, k string")
    assert df.select(rq.match_tool(TOOLS, F.col("a"), F.col("k"))).first()[0] == tool


def test_match_tool_skips_unset_keys(spark):
    df = spark.createDataFrame([("Bearer x", None)], "a string, k string")
    assert df.select(rq.match_tool((TOOLS[2],), F.col("a"), F.col("k"))).first()[0] is None


def sse(*chunks, end=True):
    lines = [f"data: {c if isinstance(c, str) else json.dumps(c)}" for c in chunks]
    return "\n\n".join(lines + (["data: [DONE]"] if end else []))


def openai(text):
    return {"choices": [{"delta": {"content": text}}]}


@pytest.mark.parametrize(
    "body, provider, text",
    [
        (json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}), "anthropic", "a\nb"),
        (json.dumps({"content": []}), "anthropic", None),
        (json.dumps({"choices": [{"message": {"content": "hi"}}]}), "openai", "hi"),
        (json.dumps({"choices": []}), "openai", None),
        (json.dumps({"choices": [{"message": {"content": 5}}]}), "openai", None),
        (sse(openai("He"), "broken{", {"choices": []}, openai("llo")), "openai", "Hello"),
        (sse(openai("a")) + "\n\n" + sse(openai("b")), "openai", "a"),
        (sse(openai("a"), end=False), "openai", "a"),
        ("event: x\n" + sse({"delta": {"type": "text_delta", "text": "A"}}, {"delta": {"type": "other", "text": "B"}}), "anthropic", "A"),
        ("nothing here", "openai", None),
        (sse(), "openai", None),
    ],
)
def test_assistant_answer(value, body, provider, text):
    assert value(lambda c: rq.assistant_answer(c, F.lit(provider)), body) == text


def test_compressed_bodies(spark):
    rows = [(gzip.compress("héllo".encode()), "gzip"), (b"plain", None), (b"not gzip", "gzip"), (b"br", "br")]
    df = spark.createDataFrame(rows, "b binary, e string")
    got = [r[0] for r in df.select(response_text(F.col("b"), F.col("e"))).collect()]
    assert got == ["héllo", "plain", "not gzip", "br"]


@pytest.mark.parametrize(
    "system, expected",
    [
        (None, "BLOCK"),
        ("base", "base\n\nBLOCK"),
        ([{"type": "text", "text": "base", "cache": {"k": 1}}], [{"type": "text", "text": "base", "cache": {"k": 1}}, {"type": "text", "text": "BLOCK"}]),
    ],
)
def test_inject_anthropic(value, system, expected):
    body = {"model": "m", "max_tokens": 5, "beta": {"x": [1, 2]}, "messages": [{"role": "user", "content": "q"}]}
    if system is not None:
        body["system"] = system
    got = json.loads(value(lambda c: rq.inject_system(c, F.lit("anthropic"), F.lit("BLOCK")), json.dumps(body)))
    assert got == {**body, "system": expected}


def test_inject_openai(value):
    inject = lambda body: json.loads(
        value(lambda c: rq.inject_system(c, F.lit("openai"), F.lit('B"L')), json.dumps(body))
    )
    plain = {"model": "m", "messages": [{"role": "user", "content": "q"}], "extra": None}
    assert inject(plain) == {**plain, "messages": [{"role": "system", "content": 'B"L'}, *plain["messages"]]}
    two = {"model": "m", "messages": [{"role": "system", "content": "s1"}, {"role": "system", "content": "s2", "name": "n"}, {"role": "user", "content": "q"}]}
    got = inject(two)["messages"]
    assert got[0] == {"role": "system", "content": "s1"}
    assert got[1] == {"role": "system", "content": 's2\n\nB"L', "name": "n"}
    assert got[2] == {"role": "user", "content": "q"}


def test_message_lists(spark):
    df = spark.sql("SELECT array(named_struct('role','user','content','q')) AS m")
    with_both = df.select(rq.with_answer(rq.with_system_first(F.lit("s"), F.col("m")), F.lit("a")).alias("m"))
    assert [r.role for r in with_both.first().m] == ["system", "user", "assistant"]
    unchanged = df.select(rq.with_answer(rq.with_system_first(F.lit(None).cast("string"), F.col("m")), F.lit(None).cast("string")).alias("m"))
    assert [r.role for r in unchanged.first().m] == ["user"]
    assert with_both.select(rq.last_user_content(F.col("m"))).first()[0] == "q"


def test_replace_system(value):
    rebuild = lambda body, form, prompt: json.loads(
        value(lambda c, p: rq.replace_system(c, F.lit(form), p), json.dumps(body), prompt)
    )
    user = {"role": "user", "content": "q"}
    body = {"model": "m", "x": [1], "messages": [{"role": "system", "content": "old"}, user]}
    assert rebuild(body, "openai", "new") == {**body, "messages": [{"role": "system", "content": "new"}, user]}
    assert rebuild(body, "openai", None) == {**body, "messages": [user]}
    plain = {"model": "m", "max_tokens": 1, "messages": [user]}
    assert rebuild(plain, "anthropic", "new") == {**plain, "system": "new"}
    assert rebuild({**plain, "system": "old"}, "anthropic", "new")["system"] == "new\n\nold"
    assert rebuild({**plain, "system": [{"type": "text", "text": "o"}]}, "anthropic", "n")["system"][0] == {"type": "text", "text": "n"}
    assert rebuild({**plain, "system": "old"}, "anthropic", None) == plain

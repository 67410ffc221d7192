"""The corpus pipeline stage by stage against plain Python, and as a whole."""

from __future__ import annotations

import base64
import collections
import hashlib
import os
import re
import sys

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from turnlake.llm import mixing  # noqa: E402
from turnlake.llm.common import stored, table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET = "token = 'q8Zk2LpX9vTr4WmB7nYc'"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the smallest table and some awkward rows."""
    docs = table(spark, SF_DIR, "documents").select(*COLUMNS)
    top = docs.agg({"doc_id": "max"}).first()[0] + 1
    text = "An ordinary sentence about the weather and the sea, written for this test alone. " * 3
    more = [(top, None, "en", "src0", None), (top + 1, "", "en", None, 0), (top + 2, "12 34 !", "de", "src1", 7)]
    more += [(top + 3, text + SECRET, "en", "src0", 1), (top + 4, text + SECRET, "en", "src0", 1), (top + 4, text + SECRET, "en", "src0", 1)]
    docs = stored(docs.union(spark.createDataFrame(more, docs.schema)), "documents")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), name)
        found[name] = (docs, out)
        docs = out
    return found


def rows_of(frame):
    return [tuple(r) for r in frame.select(*COLUMNS).collect()]


def test_stages_keep_the_columns_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (_, out) in list(stages.items())[:-1]:
        assert out.columns == COLUMNS, name


def test_language_rejects_what_has_no_language(stages):
    before, after = map(rows_of, stages["language_id"])
    kept = collections.Counter(after)
    assert not kept - collections.Counter(before)
    letters = [r for r in before if r[1] and any(map(str.isalpha, r[1]))]
    assert all(r[1] and any(map(str.isalpha, r[1])) for r in after)
    assert len(after) > 0.95 * len(letters)


def test_one_document_of_each_group_stays(stages):
    before, after = map(rows_of, stages["ngram_jaccard"])

    def shingles(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        width = min(corpus_pipeline.SHINGLE_WORDS, len(words))
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))

    sets = {r[0]: shingles(r[1]) for r in before}
    component = {}
    for start in sorted(sets):
        todo = [start]
        while todo:
            node = todo.pop()
            if node in component:
                continue
            component[node] = start
            own = sets[node]
            percent = corpus_pipeline.SIMILAR_PERCENT
            todo += [
                other
                for other, more in sets.items()
                if other not in component
                and percent * max(len(own), len(more)) <= 100 * min(len(own), len(more))
                and 100 * len(own & more) >= percent * len(own | more)
            ]
    want = [r for r in before if component[r[0]] == r[0]]
    assert collections.Counter(after) == collections.Counter(want)
    assert len(after) < len(before)


def test_secrets_are_masked_and_nothing_else_is_lost(stages):
    before, after = map(rows_of, stages["secret_scan"])
    assert sorted((r[0], r[2], r[3]) for r in before) == sorted((r[0], r[2], r[3]) for r in after)
    texts = {r[0]: r[1] for r in after}
    masked = 0
    for doc_id, text, *_ in before:
        counts, _, _ = brute.spans_of(text, brute.SECRETS)
        left, _, _ = brute.spans_of(re.sub(r"\[(ASSIGN|ACCESS|HEX|MARKOV)\]", " ", texts[doc_id]), brute.SECRETS)
        assert sum(left) == 0
        masked += sum(counts) > 0
        assert (texts[doc_id] == text) or re.search(r"\[(ASSIGN|ACCESS|HEX|MARKOV)\]", texts[doc_id])
    assert masked > 0 and all(r[4] == len(r[1]) for r in after)


def test_mix_comes_near_its_targets(stages):
    before, after = map(rows_of, stages["source_mixing"])
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    own, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        own[r[3]] += size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    for r in after:
        taken[r[3]] += size(r)
    for source, target in mixing.targets(dict(own), sum(own.values())).items():
        assert abs(taken[source] - target) <= largest[source]
    once = collections.Counter(before)
    assert all(n <= mixing.MAX_REPEATS * once[r] for r, n in collections.Counter(after).items())


def test_tokens_are_those_of_the_library(stages):
    before, after = stages["byte_bpe"]
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for doc_id, text, _, source, _ in rows_of(before):
        ids = library.encode_ordinary(text or "")
        written = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[doc_id, source, len(ids), written, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    names = ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(tuple(r[n] for n in names) for r in after.collect()) == want


def test_the_whole_is_its_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert whole.columns == docs.columns
    assert collections.Counter(map(tuple, whole.collect())) == collections.Counter(map(tuple, docs.collect()))

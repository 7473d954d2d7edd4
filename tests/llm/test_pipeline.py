"""The pipeline against a plain version, stage by stage."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from cohortlake.llm import pii, quality  # noqa: E402
from cohortlake.llm.common import made, staged  # noqa: E402

from .conftest import CLASHES, ODD  # noqa: E402
from .test_mixing import plain_targets, size  # noqa: E402
from .test_simhash import classes_of  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, the documents first."""
    out = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], DIR), "test"))
    return [df.collect() for df in out]


def test_quality(spark, stages):
    model = quality.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    scores = model.scores(quality.lines_of(pa.array([r["text"] for r in stages[0]])), len(stages[0]))
    assert sorted(stages[1]) == sorted(r for r, s in zip(stages[0], scores) if s >= 0.3)
    assert 0 < len(stages[1]) < len(stages[0])


def test_near_dedup(stages):
    kept = {c for _, _, c in classes_of([(r["doc_id"], r["text"]) for r in stages[1]])}
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r["doc_id"] in kept)
    assert len(stages[2]) < len(stages[1])


def test_personal_data(stages):
    before = {r["doc_id"]: r for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        old = before[r["doc_id"]]
        assert r["text"] == pii.redact(old["text"], pii.spans_of(old["text"], pii.field())[1]) and r["n_chars"] == len(r["text"])
        assert pii.base(r["text"]) == [] and (r["lang"], r["source"]) == (old["lang"], old["source"])


def test_mixing(stages):
    want, sizes = plain_targets([(r["doc_id"], r["text"], r["source"]) for r in stages[3]])
    texts = {r["doc_id"]: r for r in stages[3]}
    times = Counter(r["doc_id"] for r in stages[4])
    assert all(tuple(r) == tuple(texts[r["doc_id"]]) for r in stages[4]) and max(times.values()) <= 2
    for s, target in want.items():
        got = sum(n * size(texts[i]["text"]) for i, n in times.items() if texts[i]["source"] == s)
        longest = max(size(r["text"]) for r in stages[3] if r["source"] == s)
        assert abs(got - target) <= longest  # whole rows: at most one is cut at the target


def test_packing(stages):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4]:
        ids = np.array([*tk.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[r["doc_id"], k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5]) == want
    total = sum(r["length"] for r in stages[5])
    assert len({r["sequence_id"] for r in stages[5]}) <= -(-total // 2048) + 2


def test_run_is_the_stages(spark, stages):
    since = made()
    got = corpus_pipeline.run(spark, DIR).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r)[:5] for r in stages[5])
    assert made() <= since + 2  # the last stage's documents and pieces
    columns = stages[0][0].__fields__
    assert all(list(s[0].__fields__) == list(columns) for s in stages[:5])


def test_stages_on_odd_tables(spark, docs):
    """Nulls, empty and very long texts, repeated rows, a missing id and clashing names go through all stages; an empty table stays empty."""
    more = [(50, "mail a@b.co or call +1 (377) 555-0271 now.", None), (51, "x " * 3000, ""), (52, "x " * 3000, "b")]
    for rows in (ODD + more, []):
        data = docs(rows, clash=True)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, data, DIR), "odd")
            assert out.columns == data.columns and set(CLASHES) <= set(out.columns)
            data = out
        texts = Counter((r["doc_id"], r["text"]) for r in data.collect())
        got = corpus_pipeline.STAGES[-1][1](spark, data, DIR).collect()
        assert sum(r["piece"] == 0 for r in got) == sum(texts.values())
        assert all(not pii.base(t or "") for _, t in texts)
        assert bool(got) == bool(rows)

from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from cohortlake.llm import quality

from .conftest import ODD


def good(r):
    return "\n".join(" ".join(r.choice(["river", "stone", "walks", "under", "the", "quiet", "and", "green", "hill"]) for _ in range(r.randint(6, 14))).capitalize() + "." for _ in range(r.randint(1, 9)))


def bad(r):
    kind = r.randrange(3)
    if kind == 0:
        return "\n".join(" | ".join("xyz" for _ in range(8)) for _ in range(r.randint(1, 6)))
    if kind == 1:
        return "\n".join(" ".join("buy$$$" for _ in range(9)) for _ in range(r.randint(1, 6)))
    return "\n".join("NOW!! " * 9 for _ in range(r.randint(1, 6)))


def corpus(n, seed):
    r = random.Random(seed)
    return [(k, (good if k % 3 else bad)(r)) for k in range(n)]


def labels(spark, rows):
    return spark.createDataFrame([(i, None if i is None else int(i % 3 > 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    unary, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    got, pairs = quality.marginals(unary, pair, quality.chains(doc), True)
    want, expected = np.zeros(7), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total = 0
        chance, joint = np.zeros(len(at)), np.zeros((2, 2))
        for y in product((0, 1), repeat=len(at)):
            s = np.exp(sum(unary[at] * y) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += s
            chance += s * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += s
        want[at] = chance / total
        expected += joint / total
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_lines_and_features():
    found = quality.lines_of(pa.array(["ab\n\ncd cd cd\n", None, "", "é|é", "x" * 5]))
    assert found.doc.tolist() == [0, 0, 3, 4]
    assert list(zip(found.start.tolist(), found.end.tolist())) == [(0, 2), (4, 12), (0, 5), (0, 5)]
    assert found.features[1, quality.OWN - 3] == 1  # all words repeat the one before
    assert (found.features[0, 2 * quality.OWN : 3 * quality.OWN] == found.features[1, : quality.OWN]).all()
    sliced = quality.lines_of(pa.array(["zz", "ab\n\ncd cd cd\n", None]).slice(1))
    assert (sliced.features == found.features[:2]).all()
    assert len(quality.lines_of(pa.array([], pa.string())).doc) == 0


def test_long_lines_count_alike():
    text = ("ab1 |" * 500_000)
    data = np.frombuffer(text.encode(), np.uint8)
    one = quality._counted(data, np.array([0]), np.array([len(data)]))
    assert one[0].tolist() == [k[data].sum() for k in quality.KINDS]


def test_classifier_on_held_out(spark, docs):
    rows = corpus(600, 1)
    got = quality.classified(docs(rows, clash=True), labels(spark, rows)).collect()
    assert len(got) == 600
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 60 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)


def test_long_documents_are_fitted_whole(docs, spark, monkeypatch):
    rows = [(k, "\n".join(["a plain line of words"] * 60 + ["BUY NOW !!! $$$"] * 40)) for k in range(30)]
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda lines, given: (seen.append((lines, len(given))), fit(lines, given))[1])
    quality.train(docs(rows), labels(spark, rows))
    ((lines, n),) = seen
    assert np.bincount(lines.doc).tolist() == [100] * n and lines.length.sum() == n * (60 * 21 + 40 * 15)


def test_held_out_labels_are_not_used(spark, docs):
    rows = corpus(200, 2)
    wrong = labels(spark, rows).selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a = quality.classified(docs(rows), labels(spark, rows)).collect()
    b = quality.classified(docs(rows), wrong).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows_and_labels(spark, docs):
    rows = corpus(120, 3)
    odd = [(1000 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, "x"), (1000, "twice")]
    given = labels(spark, rows).unionByName(spark.createDataFrame([(3, 0, 0), (None, 1, 0), (5, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int"))
    got = quality.classified(docs(rows + odd), given).collect()
    assert len(got) == len(rows + odd) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classified(docs([]), given).count() == 0


@pytest.mark.parametrize("value", [0, 1])
def test_one_kind_of_label(spark, docs, value):
    rows = corpus(30, 4)
    given = spark.createDataFrame([(i, value, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in quality.classified(docs(rows), given).collect()} == {value}
    assert {r["score"] for r in quality.classified(docs(rows), given.limit(0)).collect()} == {0.5}


def test_accepted_keeps_columns(spark, docs):
    rows = corpus(200, 5)
    df = docs(rows, clash=True)
    kept = quality.accepted(df, labels(spark, rows))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i % 3}


def plain_lines(text):
    """(length, own features) of every line, byte by byte."""
    out, lines = [], [x for x in (text or "").encode().split(b"\n") if x]
    for line in lines:
        n, words = len(line), line.split()
        count = lambda chars: sum(c in chars for c in line)  # noqa: E731, B023
        upper, letters = count(range(65, 91)), sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in line)
        kinds = [count(b" \t\n\v\f\r"), upper, letters, count(b"0123456789"), count(b".,;:'\"-()"), count(b"!?"), count(b"#$%&*+=@^_~"), count(b"|<>[]{}\\/`"), sum(c >= 192 for c in line)]
        own = [k / n for k in kinds]
        own[1] = upper / max(letters, 1)
        again = sum(a == b for a, b in zip(words, words[1:])) / max(len(words) - 1, 1)
        out.append((n, [*own, np.log1p(n) / 5, letters / max(len(words), 1) / 10, again, min(lines.count(line) - 1, 3) / 3, float(line[-1:] in (b".", b"!", b"?", b'"', b")"))]))
    return out


def plain_score(text, model):
    """The score by summing over all labellings of the lines."""
    lines, none = plain_lines(text), [0.0] * quality.OWN
    if not lines:
        return model.prior
    odds = []
    for k, (_, own) in enumerate(lines):
        x = [*own, *(lines[k - 1][1] if k else none), *(lines[k + 1][1] if k + 1 < len(lines) else none), 1.0, float(k > 0), float(k + 1 < len(lines))]
        odds.append(sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weights)))
    total, good = 0.0, [0.0] * len(lines)
    for labels in product((0, 1), repeat=len(lines)):
        weight = np.exp(sum(o for o, y in zip(odds, labels) if y) + sum(model.pair[a][b] for a, b in zip(labels, labels[1:])))
        total += weight
        good = [g + weight * y for g, y in zip(good, labels)]
    share = sum(n * g / total for (n, _), g in zip(lines, good)) / sum(n for n, _ in lines)
    share = min(max(share, 1e-4), 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.shift)))


def test_scores_against_a_plain_version():
    r = random.Random(12)
    bits = ["the", "the", "THE", "é", "12", "a.b", "!!", "{x}", "<a>", "word", "ünï", "#$%", "(", '"', "end."]
    texts = [None, "", "\n\n", " ", "one line", "a a a\na a a\na a a\nb", "Ünï\n\nÜnï!\r\n x  x\t x"] + [
        "\n".join(r.choice([" ", "  ", "\t"]).join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 8))) for _ in range(60)
    ]
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.WIDTH) / 5, rng.random(quality.WIDTH) + 0.5, rng.normal(size=quality.WIDTH) / 3, rng.normal(size=(2, 2)), 1.7, -0.3, 0.42)
    got = model.scores(quality.lines_of(pa.array(texts, pa.string())), len(texts))
    for text, score in zip(texts, got):
        assert score == pytest.approx(plain_score(text, model), rel=1e-4), text

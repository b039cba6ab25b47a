import random
import re
import time

import pytest

from wallscope.llm import op7_license, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(text):
    words = WORD.findall(lower(text or ""))
    hits = [
        (i, label)
        for phrase, label in op7_license.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def evidence(text):
    """Labels of all phrases, and the share of words that belong to one."""
    words = WORD.findall(lower(text or ""))
    labels, covered = set(), set()
    for phrase, label in {**op7_license.BASE, **op7_license.NOTICES}.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                labels.add(label)
                covered |= set(range(i, i + len(parts)))
    return ",".join(sorted(labels)), len(covered) / max(len(words), 1)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op7_license"](spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        r = got[row.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(row.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if not r.expressions:
            labels, score = evidence(row.text)
            assert (r.labels, r.score) == (labels, pytest.approx(score))


@pytest.mark.parametrize(
    "text,labels,permitted",
    [
        ("SPDX-License-Identifier: MIT OR GPL-2.0-only", "gpl-2.0-only,mit", True),
        ("x\n// spdx-license-identifier: (MIT AND GPL-2.0-only) or Apache-2.0 */", "apache-2.0,gpl-2.0-only,mit", True),
        ("SPDX-License-Identifier: MIT AND GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only,mit", False),
        ("License-Expression: ISC", "isc", True),
        ("xSPDX-License-Identifier: MIT", "", None),
        ("xSPDX-License-Identifier: MIT spdx license identifier", "", None),
        ("a-spdx-license-identifier: MIT\r\nSPDX-License-Identifier:ISC\rSPDX-License-Identifier: 0BSD", "0bsd,isc,mit", True),
        ("SPDX-License-Identifier: OR MIT", "", None),
        ("SPDX-License-Identifier: (MIT", "", None),
        ("MIT licENSE, apache\nlicense general-public-license ünmit license", "apache,gpl,mit", None),
        (None, "", None),
        ("", "", None),
        ("mit license " * 50_000, "mit", None),
    ],
)
def test_labels(spark, text, labels, permitted):
    docs = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, labels string")
    row = op7_license.scan(docs).first()
    assert (row.labels, row.permitted) == (labels, permitted)
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == expected(text)


def test_every_notice_is_found_and_scored():
    draw = random.Random(1)
    phrases = [*op7_license.BASE, *op7_license.NOTICES]
    for phrase in phrases:
        assert op7_license.scan_text(f"x {phrase.upper()} y".encode(), frozenset())[5] == evidence(phrase)[0] != ""
    for _ in range(60):
        parts = [draw.choice([*phrases, "by", "license", "cc", "gnu general", "words"]) for _ in range(draw.randrange(12))]
        text = draw.choice([" ", ". ", "\n"]).join(parts)
        found = op7_license.scan_text(text.encode(), frozenset())
        assert (found[5], found[6]) == (evidence(text)[0], pytest.approx(evidence(text)[1]))
        assert found[:5] == expected(text)


def test_time_grows_with_the_text():
    def seconds(n):
        raw, start = b"mit license " * n, time.perf_counter()
        assert op7_license.scan_text(raw, frozenset())[1] == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(160_000) < 40 * max(seconds(20_000), 0.01)


def test_contract_columns_come_first(spark):
    names = op7_license.scan(spark.createDataFrame([], "doc_id long, text string")).columns
    assert names[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_empty_table(spark):
    assert op7_license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Operators 1 and 2 on hand-written lines whose templates, names and formats training never saw."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from weftline.llm import labelled, pii, secrets


def test_parts_share_no_template():
    for rows in (labelled.pii_rows, labelled.secret_rows):
        texts = [{r[0] for r in rows(p)} for p in ("train", "calibrate", "test")]
        assert all(texts) and not (texts[0] & texts[1] or texts[0] & texts[2] or texts[1] & texts[2])
    for text, spans in labelled.pii_rows("test"):
        assert all(text[a:b].strip() == text[a:b] != "" for _, a, b in spans)


@pytest.fixture(scope="module")
def field():
    return pii.Field(*pii.default_field())


def test_field(field):
    """Of 20 people, 16 phone numbers, 12 addresses, 8 national numbers and 8 mail addresses; the README has the figures."""
    rows = labelled.pii_rows("test")
    gold, exact, touched, found = Counter(), Counter(), Counter(), Counter()
    for (_, want), got in zip(rows, pii.added_spans([t for t, _ in rows], field), strict=True):
        found.update(k for k, _, _ in got)
        for k, a, b in want:
            gold[k] += 1
            exact[k] += (k, a, b) in got
            touched[k] += any(k == k2 and x < b and a < y for k2, x, y in got)
    assert all(touched[k] >= 0.85 * n for k, n in gold.items())
    assert all(exact[k] >= {"email": 0.8, "person": 0.75}.get(k, 0.9) * n for k, n in gold.items())
    assert sum(exact.values()) >= 0.8 * sum(found.values())


def test_no_false_spans_on_the_corpus(field):
    """The thousand documents hold no people, addresses or written-out mail; the phone numbers that may be found are real ones."""
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    found = [(k, t[a:b]) for t, spans in zip(texts, pii.added_spans(texts, field), strict=True) for k, a, b in spans if not any(x < b and a < y for _, x, y in pii.base_spans(t))]
    assert all(k == "phone" and sum(c.isdigit() for c in v) >= 7 for k, v in found) and len(found) <= 5


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("My name is John Smith and I like tea.", "person", "John Smith"),
    ("Contact: Alice Brown", "person", "Alice Brown"),
    ("call 020 7946 0958 today", "phone", "020 7946 0958"),
    ("john dot doe at gmail dot com", "email", "john dot doe at gmail dot com"),
])
def test_single_lines(field, text, kind, value):
    assert [(k, text[a:b]) for k, a, b in pii.added_spans([text], field)[0]] == [(kind, value)]


def test_net():
    rows, net = labelled.secret_rows("test", 20), secrets.default_net()
    p, gold = net.probability([r[:3] for r in rows]), np.array([r[3] for r in rows])
    assert (p[gold > 0] >= net.threshold).mean() >= 0.9
    assert (p[gold == 0] >= net.threshold).mean() <= 0.25

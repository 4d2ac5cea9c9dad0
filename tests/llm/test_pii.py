import hashlib
import re

import numpy as np
import pytest

from portvigil.llm import pii

TEXTS = [
    "mail a.b(at)host.example.com now tel 052-555-0934 ssn 123-45-6789 x",
    "x@y.z.@d.e @@ a@b +1 (052) 555-0934 card 4417 7442 8035 1547",
    "iban DE89 3704 0044 0532 0130 00",
    "1.2.3.4.5.6.7.8 999.1.1.1 00000255.1.2.3 4417744280351547",
    "order 7893477555515722 and 5968934694866817",
    "9" * 3000,
    "a" * 50_000 + "@b.c",
    "1." * 20_000,
    "+" + "1 " * 20_000 + "+1+2+3 +49 30 123456",
    "é🙂 a@b.c 10.0.0.1",
    None,
    "",
    "nothing here",
]


def base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "clash", 1), (None, TEXTS[2], "clash", 1)]
    # enough ordinary findings for the labelers to agree on
    rows += [(100 + i, f"words u{i}@mail{i % 7}.example.com, {i}.2.3.4 and +1 (0{i % 90 + 10}) 555-{1000 + i} order {10**15 + 7 * i}", "clash", 1) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int")


def test_base_spans(spark, docs):
    rows = pii.detect(docs).collect()
    assert len(rows) == len(TEXTS) + 202
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        if r.doc_id == 6:
            assert r.spans == "email:0:50004"
            continue
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listing(want).encode()).hexdigest(), texts[r.doc_id][:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)]
        assert not want or set(pii.listing(want).split(",")) <= set(r.spans.split(","))
    assert pii.detect(docs.limit(0)).count() == 0


def test_more_spans_and_none_for_plain_numbers(spark, docs):
    by_id = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert by_id[0] == "spelled:5:28,local:37:49,ssn:54:65"
    assert by_id[2] == "iban:5:32"
    assert by_id[4] == ""
    assert by_id[12] == ""


def test_redaction(spark, docs):
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[2].text == "iban [IBAN]" and rows[2].spans == "clash"
    assert rows[9].text == "é🙂 [EMAIL] [IP]"
    assert rows[10].text is None and rows[12].text == "nothing here"
    assert pii.masked("abcdef", [(0, 0, 3), (1, 3, 4)]) == "[EMAIL]ef"


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.5
    right = [0.95, 0.9, 0.8, 0.7, 0.9, 0.6, 0.85, 0.75]
    votes = np.zeros(len(truth), dtype=np.int64)
    for i, p in enumerate(right):
        said = np.where(rng.random(len(truth)) < p, truth, ~truth)
        votes += np.where(rng.random(len(truth)) < 0.3, 0, np.where(said, 1, 2)) * 3**i
    patterns, which, counts = np.unique(votes, return_inverse=True, return_counts=True)
    p, belief = pii.reliabilities(np.zeros(len(patterns), dtype=np.int64), patterns, counts.astype(float))
    found = p[:, 1, 1] / p[:, 1, 1:].sum(axis=1)
    assert np.allclose(found, right, atol=0.05)
    assert ((belief > 0.5)[which] == truth).mean() > 0.95


@pytest.mark.parametrize("rest", ["", " (x (at) y", " and more dot text", " look at this. Then [at] dot"])
def test_candidates_depend_on_their_own_context_only(rest):
    # spans as text, for addresses spelled out in several ways
    for address in ("john at example.com", "a.b(at)host.example.com", "a [at] host [dot] org", "jane at mail.x dot org"):
        text = f"words {address} words{rest}"
        found = [text[a:b] for a, k, b in pii.findings(text)[1] if pii.KINDS[k] == "spelled"]
        assert found == [address], text
    text = "we look at this. The cat sat at noon. Dogs" + rest
    assert [text[a:b] for a, k, b in pii.findings(text)[1]] == []


def test_gazetteers_vote():
    flag = 1 << pii.FLAGS.index("name near")
    for text, near in (("ask Maria Rossi 052-555-0934", True), ("office in Vienna 052-555-0934", True), ("dr who 052-555-0934", True), ("the mark 052-555-0934", False)):
        ((start, kind, end),) = pii.findings(text)[1]
        assert bool(pii.describe(text, start, kind, end)[1] & flag) == near, text


def test_long_texts_of_marks_take_linear_time():
    for text in ("x at " * 100_000, "a" * 500_000 + " at ", "x at y dot " * 50_000, "a at " + "b." * 200_000):
        assert pii.findings(text) == ([], [])

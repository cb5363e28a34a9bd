from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import filter_audit
from tessera.llm.filter_audit import audit_filters, scan_texts, text_counts
from tessera.llm.queries import op11_filter_audit

SF = "/root/testdata/sf0.001"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_counts(text):
    words = text.encode().split()
    return [len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(words), len(set(words))]


def counts_of(texts, **more):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return text_counts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, **more).T.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAb é語🙂\t\n\x0b\x1c\xa0#|")), max_size=40), min_size=1, max_size=6), st.integers(1, 30))
def test_any_texts_in_any_blocks(texts, block):
    assert counts_of(texts, block=block) == [plain_counts(t) for t in texts]


def test_long_texts():
    texts = ["", "word " * 400_000, "A" * 3_000_000, " ".join(f"w{k % 5000}" for k in range(300_000)), ""]
    assert counts_of(texts) == [plain_counts(t) for t in texts]


def test_equal_hashes_are_compared(monkeypatch):
    """Even where every word has the same hash the counts are right."""
    monkeypatch.setattr(filter_audit, "_powers", lambda n: (np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)))
    texts = ["one two one three", "aa bb aa", "a bb ccc", "x x x"]
    assert counts_of(texts) == [plain_counts(t) for t in texts]


def brute(rows, labels):
    """All 120 orders, document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    masks = []
    for i, text, lang in rows:
        chars, capitals, symbols, words, distinct = plain_counts(text or "")
        failed = {f for f, x in zip("ABCD", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * chars, symbols > 0), strict=True) if x}
        masks.append((lang or "", failed | ({"E"} if i is not None and i > least[text or ""] else set()), i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine, total = [m for m in masks if m[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[1]]
                total[f] += len(gone)
                failing = sum(f in m[1] for m in mine)
                alive = [m for m in alive if f not in m[1]]
                only = sum(m[1] == {f} for m in mine)
                out[part, order, step] = [len(alive), len(gone), failing - len(gone), only, sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_query_equals_every_order_walked(spark, seed):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    if seed == 0:
        found = op11_filter_audit(spark, SF)
    else:  # odd rows: repeated and missing ids, copies across parts, labels that repeat or lack a value
        rows = [(i if k % 7 else None, t if k % 5 else rows[0][1], x if k % 3 else None) for k, (i, t, x) in enumerate(rows)] + rows[:20]
        labels = labels + labels[:5] + [(None, 1, 1), (rows[3][0], None, 1)]
        found = audit_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r[c] for c in COLUMNS) for r in found.collect()} == brute(rows, labels)


def test_odd_rows(spark, documents, empty):
    labels = spark.createDataFrame([(5, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    assert {tuple(r[c] for c in COLUMNS) for r in audit_filters(documents, labels).collect()} == brute(rows, [(5, 1, 0), (3, 1, 1)])
    assert audit_filters(empty, labels).count() == 0
    assert scan_texts(empty).count() == 0
    assert audit_filters(documents, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0

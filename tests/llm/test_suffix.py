"""op9 against every 100-byte string of a small corpus."""

import hashlib
import random

import pytest
from tests.llm.helpers import corpus, documents, prose

from lodestar.llm import suffix
from lodestar.llm.q_suffix import op9_induced_sorting_repeats
from lodestar.llm.suffix import remove_repeats


def brute(rows):
    """(doc_id, text) in any order -> doc_id -> (n_bytes, spans, kept)."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            x = b[p : p + 100]
            if x in seen:
                gone[p : p + 100] = b"\x01" * 100
            else:
                seen.add(x)
        spans, p = [], 0
        while p < len(b):
            if gone[p]:
                s = p
                while p < len(b) and gone[p]:
                    p += 1
                spans.append((s, p))
            else:
                p += 1
        out[i] = (len(b), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def check(spark, rows):
    texts = [t for _, t in rows]
    got = remove_repeats(documents(spark, texts, ids=[i for i, _ in rows]).repartition(5)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert r["n_bytes"] == n
        assert [(s["start"], s["end"]) for s in r["spans"]] == spans, r["doc_id"]
        assert bytes(r["kept"]) == kept


def test_corpus(spark):
    check(spark, list(enumerate(corpus())))


def test_repeats_in_many_places(spark):
    rng = random.Random(11)
    passages = [prose(rng, rng.randrange(15, 60), 50) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 40), 50) for _ in range(rng.randrange(1, 8))]
        text = " ".join(parts)
        cut = rng.randrange(0, max(1, len(text) // 3))
        rows.append((1000 - i, text[cut:]))
    rows += [(2000, "x" * 99), (2001, "x" * 100), (2002, "x" * 101), (None, passages[0] * 2), (2003, passages[0] * 3)]
    check(spark, rows)


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(5)
    a, b = prose(rng, 80), prose(rng, 80)
    check(spark, [(1, a), (1, a), (2, a + b), (3, b), (2, a + b)])


def test_small_blocks_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 512)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 2000)
    check(spark, list(enumerate(corpus(seed=8, n=40))))


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    got = op9_induced_sorting_repeats(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            n,
            sum(e - s for s, e in spans),
            len(spans),
            hashlib.sha256(kept).hexdigest(),
        )

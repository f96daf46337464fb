"""op11: descriptors, cuts and round trips against plain string work."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import corpus, documents

from lodestar.llm.fim import MARKS, SENTINELS, TEXT, PieceTable, restore, restored, transform, transformed, unit_starts

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_way(key, text):
    """The contract, word by word."""
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = st.text(alphabet=st.sampled_from("aZ b\n<>PSMé東\U0001f600_@[`{"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(-5, 10**12))
def test_equals_string_work(text, key):
    assert unit_starts(text).tolist() == [m.start() for m in UNITS.finditer(text)]
    table, form, n, prefix, middle = transformed(text, str(key))
    assert (n, form, prefix, middle, table.text()) == plain_way(key, text)
    assert table.sha256() == hashlib.sha256(table.text().encode()).hexdigest()
    back = restored(table.text(), form)
    assert back.text() == text and back.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_cuts_split_descriptors():
    rng = random.Random(2)
    text = "abcdefghij" * 3
    table = PieceTable(text)
    for k in range(1, 20):
        table.cut(rng.randrange(len(text) + 1))
        assert len(table.pieces) == k + 1 and table.text() == text
    assert sum(n for _, _, n in table.pieces) == len(text)
    order = list(range(len(table.pieces)))
    rng.shuffle(order)
    table.arrange(tuple(order))
    table.arrange(tuple(sorted(range(len(order)), key=order.__getitem__)))
    assert table.text() == text and table.buffers == (text, SENTINELS)


def test_table(spark):
    texts = corpus(n=20) + ["has <P> mark", "has <S>", "<M>", "<P", "é" * 300_000 + "a b", "x" * 200_000]
    ids = [None, *range(1, len(texts))]
    docs = documents(spark, texts, ids=ids).withColumn("output", F.lit("clash")).withColumn("row", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    back = restore(transform(docs.repartition(3)))
    rows = back.select("row.*", "restored", "restored_sha256").collect()
    assert len(rows) == len(texts) + 1
    want = {i: (t, plain_way("null" if i is None else i, t)) for i, t in zip(ids, texts)}
    forms = set()
    for r in rows:
        text, (n, form, prefix, middle, output) = want[r["row"]["doc_id"]]
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, prefix, middle, output)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored"] == (text or "")
        buffers = {TEXT: text or "", MARKS: SENTINELS}
        assert "".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r["pieces"]) == output
        assert r["row"]["output"] == "clash"
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    whole = transform(docs, carry=["doc_id"], fim_percent=0).where("form <> 'plain'")
    assert whole.count() == 0


def test_empty_table(spark):
    assert restore(transform(documents(spark, []))).collect() == []

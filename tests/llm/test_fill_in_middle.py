"""Fill-in-middle rewriting: exact round trips and a plain version of the rule."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aquifer.llm import fill_in_middle as fim
from aquifer.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_rule(doc_id, text, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) with strings alone."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TRICKY = ["<", "<S", "<P\n>", "a<\nS>b\n", "\n", "\n\n\n", "no end", "end\n", "ÉTÉ\n日本\n\U0001f600 x\n", "<M\n<M\n", "has <P> in it",
          "\r\nx\r\n", "long " * 200_000 + "\n" + "line\n" * 5_000, "", None, "\x00\n\x00", "x y\u0085z\n"]


def test_against_the_plain_rule(spark):
    rows = [(k, t) for k in range(-3, 30) for t in TRICKY[:13 if k == 0 else 12]] + [(k, t) for k in (None, 5) for t in TRICKY]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "__x")})
    out = fim.restore(fim.rearrange(docs.repartition(5), seed=7)).collect()
    want = sorted(map(repr, ((i, *plain_rule(i, t), t or "") for i, t in rows)))
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, o, r.restored_text) for r in out
                             for o in [plain_rule(r.doc_id, r.restored_text)[-1]]))) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r.output_sha256 == sha(plain_rule(r.doc_id, r.restored_text)[-1]) and r.restored_sha256 == sha(r.restored_text)
               for r in out)


@settings(max_examples=300, deadline=None)
@given(st.integers(), st.text(st.sampled_from("<>PSM\nax é"), max_size=40), st.sampled_from((0, 50, 100)))
def test_round_trip_of_any_text(doc_id, text, spm):
    n, form, prefix, middle, table = fim.arranged(text.encode(), doc_id, 7, 100, spm)
    assert (n, form, prefix, middle, table.gather().decode()) == plain_rule(doc_id, text, spm=spm)
    back = fim.restored(table.gather(), form)
    assert back.gather().decode() == text and back.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_rates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forms = {p: {r.form for r in fim.rearrange(docs, fim_percent=p).select("form").collect()} for p in (0, 50)}
    assert forms[0] == {"plain"} and forms[50] == {"plain", "psm", "spm"}


def test_kept_columns_and_empty_table(spark, edge_docs, no_docs):
    out = fim.rearrange(edge_docs, keep=["doc_id", "lang", "start", "n_chars"])
    assert out.columns[:4] == ["doc_id", "lang", "start", "n_chars"] and out.count() == edge_docs.count()
    assert QUERIES["op12_fill_in_middle"](spark, SF).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fim.round_trip(no_docs).count() == 0
    with pytest.raises(ValueError):
        fim.rearrange(edge_docs, keep=["n"])

"""The registered queries themselves: columns, folds and figures on the smallest tables."""

import hashlib
import os
import re
import zlib

import pytest

from granary.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def rows_of(spark, name, columns):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(columns)] == columns
    return df.collect()


def test_language_id(spark, texts):
    rows = rows_of(spark, "op1_language_id", ["doc_id", "held_out", "lang_pred", "score"])
    langs = {r.lang for r in texts.values() if r.lang is not None and fold(r.doc_id, 3) != 1}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id].text
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.lang_pred in langs | {"und"}
    judged = [(r.lang_pred, texts[r.doc_id].lang) for r in rows if r.held_out and texts[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_near_dedup(spark, texts):
    rows = rows_of(spark, "op3_minhash_near_dedup", ["doc_id", "n_shingles", "component_id", "kept"])
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(texts[r.doc_id].text))
        assert r.n_shingles == (len({*zip(w, w[1:])}) if len(w) > 1 else len(w)) and r.kept == (r.doc_id == r.component_id)


def test_suffix_dedup(spark, texts):
    rows = rows_of(spark, "op5_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    seen, want = {}, {}
    for i in sorted(texts):
        raw = (texts[i].text or "").encode()
        gone = bytearray(len(raw))
        own = {raw[k : k + 50] for k in range(len(raw) - 49)}
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        for s in own:
            seen.setdefault(s, i)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[i] = (i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert sorted(tuple(r) for r in rows) == [want[i] for i in sorted(want)]


def test_token_counts(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in rows_of(spark, "op6_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]):
        n = len(t.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id].text or "").encode()), n > 1024)


def test_mixing(spark, texts):
    from granary.llm.mixing import TARGETS

    rows = rows_of(spark, "op7_mix_sources", ["doc_id", "source", "n_tokens", "p_good", "p_poor", "p_toxic", "rate", "copies"])
    total = sum(r.n_tokens for r in rows)
    reached = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total for d in TARGETS}
    gap = sum((reached[d] - x) ** 2 for d, x in TARGETS.items()) ** 0.5
    assert len(rows) == len(texts) and gap == pytest.approx(rows[0].residual, abs=1e-9)


def test_hmm_score(spark, texts):
    rows = rows_of(spark, "op8_hmm_score", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", low(r.text))) + 1 for i, r in texts.items()}
    assert {r.train_tokens for r in rows} == {sum(k for i, k in n.items() if fold(i, 7) != 2)}
    assert all(r.n_tokens == n[r.doc_id] and r.held_out == (fold(r.doc_id, 7) == 2) and r.score < 0 for r in rows)
    # Over held-out texts the states beat the base model.
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_html_extract(spark):
    rows = rows_of(spark, "op9_html_extract", ["page_id", "url", "text", "n_chars"])
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(len(r.text) == r.n_chars and not re.search(r"<(?:p|div|nav|a|script)\b|[\t\r]|  ", r.text) for r in rows)


def test_quality(spark, texts):
    rows = rows_of(spark, "op10_quality", ["doc_id", "expected_grade", "tail_prob", "kept"])
    assert len(rows) == len(texts) and all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.tail_prob >= 0.5) for r in rows)

"""PII, token counts and packing against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import packing, pii, token_count

ODD = [None, "", " ", "\n", "a", "  a  b\n\n c ▁x  ", "<s> hello </s>", "日本語 テスト 🎉", "\x00 a", "a\tb  \t c", "<|endoftext|> x <| a", "it's 12's  x", "word " * 3000, "a", "a"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    def digits(s):
        return [c for c in s if c in "0123456789"]

    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn("".join(digits(m))),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return {k: [m.span() for m in r.finditer(text) if ok[k](m.group())] for k, r in BASE.items()}


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("01.@+- ()ab9") for _ in range(rng.randrange(80)))
        found = pii.find_spans(t)
        assert {k: found[k] for k in BASE} == base_spans(t), t


def test_added_spans_and_redaction():
    t = 'see https://a.example/x?y=1, IBAN GB82 WEST 1234 5698 7654 32 and token = "abcdef123456" account no. 12345678'
    f = pii.find_spans(t)
    assert [t[s:e] for s, e in f["url"]] == ["https://a.example/x?y=1"]
    assert [t[s:e] for s, e in f["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [t[s:e] for s, e in f["secret"]] == ["abcdef123456"]
    assert [t[s:e] for s, e in f["account"]] == ["12345678"]
    assert pii.redact("mail a.b@c.org now") == "mail <email> now"


def test_pii_query(spark):
    texts = [*ODD, "x@y.zz 4111111111111111 +1 (555) 123-4567 10.0.0.1 999.1.1.1"]
    rows = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in want[k])
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert rows[i].n_email == len(want["email"]) and rows[i].n_card == len(want["card"])
    assert pii.report(frame(spark, [])).count() == 0
    out = pii.scrub(frame(spark, [None, "x@y.zz"])).orderBy("doc_id").collect()
    assert [r.text for r in out] == [None, "<email>"] and out[0].spans == "x"


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [*ODD, *(r.text for r in docs.collect())]
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_count.token_counts(frame(spark, texts), path, 4096).collect()}
    for i, t in enumerate(texts):
        n = len(m.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)


def test_packing_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [*ODD, *(r.text for r in docs.collect())]
    rows = packing.pack_documents(frame(spark, texts)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or all(r.length == 1024 for r in pieces[1:]))
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_seq) <= total / 1024 * 1.01 + 2 * len({r.sequence_id >> 40 for r in rows})


@pytest.mark.parametrize("open_bins", [1, 3, 1000])
def test_best_fit_takes_the_tightest_bin(open_bins):
    rng = random.Random(open_bins)
    b, state, made = packing.BestFit(50, open_bins), {}, 0
    for _ in range(500):
        n = rng.randrange(1, 51)
        fits = [f for f in state.values() if f >= n]
        bin_, offset = b.place(n)
        if fits:
            assert 50 - offset == min(fits) and state[bin_] == min(fits)
        else:
            if len(state) == open_bins:
                low = min(state.values())
                open_ = [k for k in state if state[k] == low]
                del state[next(k for k in open_ if k not in b.bins[low])]
            state[bin_] = 50
            made += 1
        state[bin_] -= n
        if not state[bin_]:
            del state[bin_]
    assert b.made == made


def test_cues_and_time_of_pii():
    found = pii.find_spans("Login: kim_92, IBAN without cue DE89370400440532013000 and XDE89370400440532013000, DE89370400440532013001")
    assert [len(found[k]) for k in ("login", "iban")] == [1, 1]
    for unit in ("account", "a@", "http://", "+1 ", "1.", "iban ", "token=", "GB29 "):
        began = time.time()
        pii.find_spans(unit * 60_000)
        assert time.time() - began < 3, unit


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, piece string, n_tokens string")
    assert not packing.pack_documents(docs).count() and not token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096).count() and not pii.report(docs).count()


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "a b", 2), (2, "word " * 5000, 3)], "doc_id long, text string, start int")
    rows = packing.pack_documents(docs).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert max(r.length for r in rows) == 1024 and [r.start for r in sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.piece)][0] == 0
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) <= 1024 for v in place.values())

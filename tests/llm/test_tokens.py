import base64
import gc
import hashlib
import tracemalloc
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quaestor.llm import ans, packing, piece_bpe, subword
from tests.llm.data import documents, frame

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library_ids(texts):
    t = Tokenizer.from_file(JSON)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def rank_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ADDED = [t.content for t in Tokenizer.from_file(JSON).get_added_tokens_decoder().values()]
PLAIN = st.text(st.one_of(st.sampled_from(list("ab the's 'll\n\t  .,!1é\x85 　 ×à中<|>")), st.characters(exclude_categories=["Cs"])), max_size=25)
WITH_ADDED = st.lists(st.one_of(PLAIN, st.sampled_from([*ADDED, "<|end", "oftext|>", " ", "\n"])), max_size=7).map("".join)
TEXTS = st.lists(st.one_of(PLAIN, WITH_ADDED), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_remembered_pieces_encode_as_the_libraries_do(texts):
    encode = subword.encoder(subword.read_tokenizer(JSON))
    coder = piece_bpe.coder(piece_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, "test")
    tik = rank_encoding() if not hasattr(test_remembered_pieces_encode_as_the_libraries_do, "tik") else test_remembered_pieces_encode_as_the_libraries_do.tik
    test_remembered_pieces_encode_as_the_libraries_do.tik = tik
    for run, want in ((encode, library_ids(texts)), (coder.encode, tik.encode_ordinary_batch(texts))):
        got = [ids[a:b].tolist() for _, ids, at in run(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]
        assert got == want
    for text in texts:
        assert coder.decode(np.array(tik.encode_ordinary(text), "<u4")) == text.encode()


def test_words_go_straight_to_the_model(monkeypatch):
    encode = subword.Encoder(subword.read_tokenizer(JSON))
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    words = [" " + "".join(letters[i : i + 3]) + x for i in range(len(letters) - 2) for x in ("", "ing", "ß" * 30)]
    given = []
    monkeypatch.setattr(encode, "_batch", lambda pieces: given.extend(pieces) or [])
    assert [i.tolist() for i in encode._encode(words)] == library_ids(words)
    assert not given


def test_a_tokenizer_that_does_more_than_byte_level_pieces_is_asked_as_a_whole():
    t = Tokenizer.from_file(JSON)
    t.add_tokens(["ing"])
    texts = ["sing ing inging", "a ing", "nothing"]
    encode = subword.Encoder(t.to_str())
    got = [ids[a:b].tolist() for _, ids, at in encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_the_encoder_does_not_follow_the_column():
    encode = subword.Encoder(subword.read_tokenizer(JSON))
    column = pa.array(["some words " * 100] * 4000)
    for _ in encode(pa.array(["some words " * 100])):  # tables that stay
        pass
    tracemalloc.start()
    for _ in encode(column):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_a_released_encoder_is_gone():
    encode = subword.encoder(subword.read_tokenizer(JSON))
    for _ in encode(pa.array(["some words"])):
        pass
    seen = weakref.ref(encode)
    gc.disable()
    try:
        del encode
        subword.release()
        assert seen() is None
    finally:
        gc.enable()


def test_added_tokens_are_single_ids():
    texts = [f"a {ADDED[0]}b", ADDED[0] * 3, f"x\n\n{ADDED[0]}  y", ADDED[0][:-1], f"é{ADDED[0]}é " + "word " * 50 + ADDED[0]]
    encode = subword.encoder(subword.read_tokenizer(JSON))
    got = [ids[a:b].tolist() for _, ids, at in encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert got == library_ids(texts) and len(got[1]) == 3


@pytest.mark.parametrize("n", [1, 31, 33, 1000, 8192, 65537, 150_000])
def test_ans_round_trip_spans_and_checksums(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype("<u4")
    row = ans.encode(ids, block=1 << 14, lanes=32, every=64)
    shape = {"block": 1 << 14, "lanes": 32, "every": 64}
    assert (ans.decode(row, n, **shape) == ids).all()
    one = ans.decode(row, n, spans_wanted=[0], **shape)
    assert (one[: min(n, 2048)] == ids[:2048]).all() and not one[2048:].any()
    broken = bytearray(row["words"] or b"\0\0\0\0")
    broken[-1] ^= 255
    if row["words"]:
        with pytest.raises(ValueError):
            ans.decode(row | {"words": bytes(broken)}, n, **shape)


def test_token_files(spark):
    rows = documents()
    got = ans.round_trip(frame(spark, rows), JSON, end_id=0).collect()
    want = {}
    for r, ids in zip(rows, library_ids([r[1] for r in rows])):
        want.setdefault(r[0], []).append(np.array(ids + [0], "<u4"))
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert r.ids_crc32 in [zlib.crc32(x.tobytes()) for x in want[r.doc_id]]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    assert ans.round_trip(frame(spark, []), JSON).count() == 0


def test_piece_bpe(spark):
    rows, tik = documents(), rank_encoding()
    got = piece_bpe.encode_documents(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    digest = lambda b: hashlib.sha256(bytes(b)).hexdigest()
    want = sorted((r[0] is None, r[0] or 0, digest(np.array(tik.encode_ordinary(r[1] or ""), "<u4").tobytes()), digest((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, digest(r.ids), digest(r.decoded)) for r in got) == want
    assert piece_bpe.encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_plan(at, penalty, length):
    best = {0: (0.0, [])}
    for i, p in enumerate(at):
        options = [(best[q][0] + length - (p - q) + penalty[i], best[q][1] + [p]) for q in best if p - q <= length]
        best[p] = min(options)
    return best[at[-1]][0]


def test_plan_is_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        at = np.cumsum(rng.integers(1, 9, 12))
        penalty = rng.choice([0.0, 2.0, 12.0], 12)
        penalty[-1] = 0
        cuts = packing.plan(at, penalty, 16)
        cost = sum(16 - (b - a) for a, b in zip([0, *cuts[:-1]], cuts)) + sum(penalty[list(at).index(c)] for c in cuts)
        assert abs(cost - brute_plan(at.tolist(), penalty, 16)) < 1e-9


def test_packing(spark, monkeypatch):
    rows = documents()
    monkeypatch.setattr(packing, "STRETCH", 1 << 14)
    got = packing.pack(frame(spark, rows), JSON, end_id=1).toPandas()
    want = {}
    for r, ids in zip(rows, library_ids([r[1] for r in rows])):
        want.setdefault(r[0], []).append(np.array(ids + [1], "<u4"))
    for doc_id, pieces in got[got.doc_id.notna()].groupby("doc_id"):
        ids = want[int(doc_id)][0]
        assert pieces.length.sum() == len(ids) * len(want[int(doc_id)])
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
    assert got[got.doc_id.isna()].length.sum() == sum(map(len, want[None]))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and (s.offset.values == np.cumsum(s.length.values) - s.length.values).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(frame(spark, []), JSON).count() == 0
    assert F  # the session is alive


def test_pipeline_keeps_no_encoder(spark, monkeypatch):
    """An encoder holds a million pieces; other stages that follow in the same worker need the room."""
    with open(JSON, encoding="utf-8") as f:
        content = f.read()
    first = [ids.tolist() for _, ids, _ in subword.encoder(content)(pa.array(["one two", "three"]))]
    assert subword._encoders
    subword.release()
    assert not subword._encoders
    assert [ids.tolist() for _, ids, _ in subword.encoder(content)(pa.array(["one two", "three"]))] == first
    rows = [(k, f"word {k} and more. " * 30) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, gone = (sorted(map(tuple, packing.pack(docs, JSON, keep=keep).drop("sequence_id").collect())) for keep in (True, False))
    assert kept == gone
    called = {}
    monkeypatch.setattr(packing, "pack", lambda *_, **named: called.update(named))
    corpus_pipeline.pack(None, None, "")
    assert called["keep"] is False

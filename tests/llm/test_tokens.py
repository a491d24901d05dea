"""Token counts and packed ids against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thornweave.llm import packed_ids, token_counts
from thornweave.llm.common import fresh_path
from thornweave.llm.tokenizer import Encoder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "\n\n", "a  b", "a \n b\t\tc ", "x <|endoftext|> y", "\n\n<|endoftext|>", "tab\x1cb\x85c d", "don't  we'LL ’s", "é Ç̧ 한글 ﬁ", "1234 5.6", "日本 語, ok.", "İstanbul ΣΑΣ, Ωmega.", "été, Ñandú; ªº² x². ǅ ŉ straße! ſ Ⅷ, e\u0301t\u0301. ɐb, ½.", "a" * 5000, "The the. " * 3000, "<|startoftext|>a", "<|STARTOFTEXT|> b", "it's. x,y z.. w.", "A.B c; d! e?f"]


@pytest.fixture(scope="module")
def encoders():
    return {p: (Encoder(p), Tokenizer.from_file(p)) for p in (BYTE, WORD)}


def same(pair, texts):
    own, library = pair
    want = [np.asarray(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_odd_texts(encoders, path):
    same(encoders[path], ODD)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85  .,'sabTéÑßİſª²½\u0301!?;|<>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_texts(encoders, path, texts):
    same(encoders[path], texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_documents(encoders, spark, sf, path):
    same(encoders[path], [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])


def frame(spark):
    rows = [(i, t, "zz", None) for i, t in enumerate(ODD)] + [(None, "no id", None, 1), (3, "a  b", "again", 2), (3, "a  b", "again", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, content long")


def test_counts(spark):
    cache, library = fresh_path(spark, "test-cache"), Tokenizer.from_file(BYTE)
    docs = frame(spark)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
    got = token_counts.token_counts(docs, BYTE, cache, limit=3).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    stored = spark.read.parquet(cache).count()
    assert stored == len({r.text or "" for r in docs.collect()})
    again = token_counts.token_counts(docs, BYTE, cache, limit=3).collect()  # all are hits now
    assert sorted(map(str, again)) == sorted(map(str, got)) and spark.read.parquet(cache).count() == stored
    token_counts.token_counts(docs, WORD, cache).count()  # another version meets none of these counts
    assert spark.read.parquet(cache).count() == 2 * stored


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(frame(spark).limit(0), BYTE, fresh_path(spark, "test-cache")).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype="u8").astype("<u4")
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (packed_ids.unpack(data, bits, len(ids)) == ids).all()


def test_fewest_bits():
    assert [packed_ids.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 8191, n, dtype="u8").astype("<u4") for n in (0, 1, 100, 0, 5000, 3, 64, 64)]
    writer = packed_ids.ShardWriter(13, block=64)
    for k, d in enumerate(docs):
        writer.add(None if k == 0 else k, d)
    path = tmp_path / "x.ids"
    path.write_bytes(b"".join(writer.parts()))
    shard = packed_ids.Shard(f"file://{path}")
    assert shard.doc_ids == [None, *range(1, 8)] and shard.bits == 13
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert all((shard.ids(a, b) == whole[a:b]).all() for a, b in ((0, 1), (63, 65), (64, 128), (100, 5232), (5000, 5001), (7, 7)))
    assert all((ids == docs[k]).all() for k, ids in shard.spans(most=70))


def brute(docs, library):
    start, out = 0, []
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_output(spark, sf):
    library = Tokenizer.from_file(WORD)
    assert sorted(map(tuple, packed_ids.query(spark, sf).collect()), key=str) == brute(spark.read.parquet(f"{sf}/documents.parquet").collect(), library)
    docs = frame(spark)
    shards = packed_ids.write_packed(docs, fresh_path(spark, "test-ids"), WORD, 2, shard_ids=2000)  # several shards to a task
    assert sorted(map(tuple, packed_ids.read_packed(spark, shards).collect()), key=str) == brute(docs.collect(), library)
    assert packed_ids.token_output(docs.limit(0), fresh_path(spark, "test-ids"), WORD, 2).collect() == []

"""Records, counts and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import common, packing, queries, records, token_counts, tokens


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in (tokens.WORD_BPE, tokens.BYTE_BPE)}


def strings(n=400):
    r = random.Random(1)
    alphabet = "abcdefghijklmnoprstvlmde'' '  \n!?12éü€日\tÉİς\xa0"
    return ["", "'", "'r", "it's we're 'LL ''ve", "a\x00b", "x" * 3000, "é", *("".join(r.choice(alphabet) for _ in range(r.randint(1, 150))) for _ in range(n))]


def ids_of(library, name, text, end=2):
    return np.append(np.array(library[name].encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(end)).astype("<u4")


def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", [tokens.WORD_BPE, tokens.BYTE_BPE])
def test_encoder_is_the_library(library, name):
    for text in strings():
        assert np.frombuffer(tokens.encoder(name).ids(text), "<u2").tolist() == library[name].encode(text, add_special_tokens=False).ids


def test_encoder_memory_is_bounded(library):
    e = tokens.MemoEncoder(public_tokenizers.path(tokens.WORD_BPE), keep=50)
    for text in strings(100):
        assert np.frombuffer(e.ids(text), "<u2").tolist() == library[tokens.WORD_BPE].encode(text, add_special_tokens=False).ids


def test_counter_is_the_library(library):
    c = token_counts.counter(public_tokenizers.path(tokens.WORD_BPE))
    docs = strings() + ["a <|endoftext|> b"]
    assert c.counts(docs).tolist() == [len(library[tokens.WORD_BPE].encode(t, add_special_tokens=False).ids) for t in docs]


def test_counter_with_few_states(library):
    c = token_counts.Counter(public_tokenizers.path(tokens.WORD_BPE))
    c.transducer.most_states = 100
    for t in strings(60):
        assert c.counts([t])[0] == len(library[tokens.WORD_BPE].encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_word_starts_do_not_depend_on_chunks(chunk):
    kinds = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint8)
    kinds[-1] = token_counts.SPACE
    assert (token_counts.word_starts(kinds, chunk) == token_counts.word_starts(kinds, 500)).all()


def test_op5(spark, sf, library):
    got = queries.op5_token_counts(spark, sf).toPandas().set_index("doc_id")
    for i, t in documents(sf)[["doc_id", "text"]].values:
        n = len(library[tokens.WORD_BPE].encode(t, add_special_tokens=False).ids)
        assert tuple(got.loc[i]) == (len(t.encode()), n, n > 2048)


def test_op5_odd(odd, none):
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (1, 2, 5)} == {0}
    assert token_counts.token_counts(none).count() == 0


def test_op2(spark, sf, library):
    got = queries.op2_binary_records(spark, sf).toPandas().sort_values("doc_id")
    start = 0
    for row, (i, t) in zip(got.itertuples(), documents(sf).sort_values("doc_id")[["doc_id", "text"]].values, strict=True):
        ids = ids_of(library, tokens.WORD_BPE, t)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2_odd(odd, none):
    rows = sorted(records.round_trip(odd).collect(), key=lambda r: r.start)
    assert len(rows) == 10 and rows[0].doc_id is None
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])[:-1])).tolist()
    assert records.round_trip(none).count() == 0


def test_records_notice_damage():
    record = bytearray(records.frame(records.pack(7, np.array([1, 70000, 3]))))
    payload, end = records.unframe(bytes(record), 0)
    assert end == len(record) and records.unpack(payload)[0] == 7 and records.unpack(payload)[1].tolist() == [1, 70000, 3]
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


def check_packing(rows, capacity):
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seen)


def test_op7(spark, sf, library):
    rows = queries.op7_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, 1024)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, t in documents(sf)[["doc_id", "text"]].values:
        ids, at = ids_of(library, tokens.BYTE_BPE, t), 0
        own = sorted(by[i], key=lambda r: r.piece)
        assert len(own) == -(-len(ids) // 1024)
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    assert n <= 1.02 * -(-total // 1024) + 1


def test_op7_odd(odd, none):
    rows = packing.best_fit_packing(odd, 64).collect()
    check_packing(rows, 64)
    assert sum(r.piece == 0 for r in rows) == 10
    assert packing.best_fit_packing(none).count() == 0


@pytest.mark.parametrize("capacity", [3, 10, 64, 1024])
def test_plan_fills_every_rank_once(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 7, 500, 20000):
        lengths = np.minimum(capacity, 1 + rng.exponential(capacity / rng.uniform(0.5, 6), n).astype(int))
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        rows = packing.plan(counts, capacity)
        for length, count in counts.items():
            own = sorted((r[1], r[2]) for r in rows if r[0] == length)
            assert [a for a, _ in own] == np.concatenate(([0], np.cumsum([b for _, b in own])[:-1])).tolist() and sum(b for _, b in own) == count


def test_shuffled_reads_by_the_index(spark, odd, none):
    """Records read at their offsets in any order, some twice, equal those read in sequence; null ids are told from zero."""
    docs = odd.unionByName(spark.createDataFrame([(0, "zero has an id")], "doc_id long, text string"), allowMissingColumns=True)
    path = common.new_path(spark, "records")
    manifest = records.write_records(docs, path)
    index = records.read_index(spark, path, manifest)
    order = index.unionByName(index.where("doc_id = 7")).orderBy(F.rand(3)).repartition(3, "offset")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in records.read_at(order, path).collect())
    whole = [(str(r.doc_id), r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in records.read_records(spark, path, manifest).collect()]
    assert got == sorted(whole + [x for x in whole if x[0] == "7"])
    assert {r.doc_id for r in index.collect()} == {r.doc_id for r in docs.collect()}
    with pytest.raises(Exception, match="does not fit|differs"):
        records.read_at(index.where("doc_id = 7").withColumn("offset", F.col("offset") + 1), path).collect()
    empty = common.new_path(spark, "records")
    assert records.read_at(records.read_index(spark, empty, records.write_records(none, empty)), empty).count() == 0


def test_long_texts_in_parts(sf):
    """Ids and counts of texts that are cut, against the library on the whole texts."""
    r = random.Random(2)
    words = ["don't", "we'll", "é", "Ünï", "12", "...", "<|endoftext|>", "日本", "x" * 50, "İ", "a\tb", "\n\n", "  ", " \n"]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", ""]) for _ in range(400)) for _ in range(6)] + ["", "x" * 500, " " * 300]
    for name in (tokens.WORD_BPE, tokens.BYTE_BPE):
        library, encode = Tokenizer.from_file(public_tokenizers.path(name)), tokens.encoder(name)
        for t in texts:
            for part in (20, 333):
                assert np.frombuffer(encode.ids(t, part), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    library, count = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_BPE)), token_counts.counter(public_tokenizers.path(tokens.WORD_BPE))
    for t in texts:
        for part in (20, 333):
            assert count.long(t.encode(), part).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]

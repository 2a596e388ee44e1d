"""The pipeline against a brute-force version that uses no Spark beyond fitting the classifier."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import quality, tokens

from .test_models import SF, plain
from .test_near import brute_simhash, brute_spans, classes
from .test_tokens import check_packing


def blank(text):
    out, at = "", 0
    for a, _, b in brute_spans(text):
        if b > at:
            out += text[at:a] + "[SECRET]" if a >= at else ""
            at = b
    return out + text[at:]


def test_pipeline(spark):
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scores([t.encode() for t in docs.text])
    rows = sorted(docs[["doc_id", "text"]].values[score >= quality.ACCEPT].tolist())
    bits = [brute_simhash(t) for _, t in rows]
    label = classes(len(rows), [(a, b) for a in range(len(bits)) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= 4])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    leaked = [f" {plain(x)} " for x in items.text]
    rows = [(i, blank(t)) for i, t in rows if not any(x in f" {plain(t)} " for x in leaked)]
    library = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_packing(got, 1024)


def test_odd_rows_pass_all_stages(spark, odd, none):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
        ids = lambda rows: sorted(str(r.doc_id) for r in rows)
        assert ids(r for r in pieces if r.piece == 0) == ids(docs.collect())

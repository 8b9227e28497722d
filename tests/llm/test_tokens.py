import random

import numpy as np
import pyarrow as pa
import pytest
from sedimenta.llm import queries, token_counts
from sedimenta.llm.textvec import buffers

from .helpers import FOLDER, odd_documents, table

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer("piece_bpe_32k.model")


def test_counts_are_the_librarys(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(1)
    odd = ["", " ", "  ", "a ", " a", "a\nb", "\n", " \n \n", "<s>", "</s> <unk>", "ﬁ", "　x", "a\t b", "\x00a", "▁", "a▁b", "▁" * 40, "a" * 5000, "🙂 🙂x\r\n y", "x" * 70 + " " + "y" * 70]
    texts = odd + ["".join(r.choice("a b\n▁🙂é.<s>the  ") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    want = [len(x) for x in library.encode(texts)]
    words = "the of a\nb".split(" ")
    data, off = buffers(pa.array([" ".join(words)]))
    wide, starts, ends, _ = token_counts.pre_tokens(data, off)
    hashes = token_counts.pre_token_hashes(wide, starts, ends)
    order = np.argsort(hashes)
    plain = token_counts.Pieces(model)
    lengths = plain.encoded_all([wide[x:y].tobytes().decode().replace(" ", "▁") for x, y in zip(starts, ends, strict=True)])
    pieces = token_counts.Pieces(model, (hashes[order], np.array(lengths, np.uint8)[order]), cache=100)
    assert [plain.count(t) for t in texts] == want
    for p in (plain, pieces, pieces):
        assert p.counts(*buffers(pa.array(texts))).tolist() == want and len(p.cache) <= p.most
        assert [p.counts(*buffers(pa.array([t])))[0] for t in texts] == want
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in queries.QUERIES["op8_token_counts"](spark, FOLDER).collect()}
    for x in docs.collect():
        n = len(library.encode(x.text))
        assert got[x.doc_id] == (len(x.text.encode()), n, n > 4096)


def test_odd_rows(spark, model):
    docs = odd_documents(spark)
    rows = token_counts.token_counts(docs, model).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].n_tokens == 0 and by[3][0].n_bytes == 0 and by[6][0].over_limit and by[1][0] == by[1][1]
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    n = len(library.encode("a null id"))
    assert sorted((r.n_bytes, r.n_tokens) for r in by[None]) == [(0, 0), (9, n)] and by[7][0].n_tokens == len(library.encode("x" * 100_000))
    assert token_counts.token_counts(docs.limit(0), model).count() == 0
    for options in ({"table": 5}, {"sample": 1}, {"table": 0}):
        assert sorted(token_counts.token_counts(docs, model, **options).collect(), key=repr) == sorted(rows, key=repr)


def test_the_frequent_ones_are_in_the_table(spark, model):
    docs = table(spark, [(i, "often often often seldom" + str(i) + "\nnow", "s", "en", 0) for i in range(50)]).coalesce(1)
    spark.sparkContext.addFile(model)
    hashes, lengths = token_counts.frequent(docs, model.rsplit("/", 1)[-1], 2, 100)
    data, off = buffers(pa.array(["often"]))
    wide, starts, ends, _ = token_counts.pre_tokens(data, off)
    assert len(hashes) == 2 and token_counts.pre_token_hashes(wide, starts, ends)[0] in hashes and len(lengths) == 2


def test_a_model_of_another_kind_is_refused():
    with pytest.raises(Exception):  # noqa: B017 - the library's own error
        token_counts.Pieces(queries.tokenizer("byte_bpe_50k.json"))

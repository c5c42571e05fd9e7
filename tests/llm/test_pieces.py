"""SentencePiece encoding and decoding against the library, with odd rows among them."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandfold.llm import pieces
from strandfold.llm import queries as Q

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " \n ", "▁", " ▁ ▁x", "a\x00b", "<s>", "<unk> <0x41>", "日本語テキスト", "😀 👍🏽", "\r\n\t x", "a" * 300, " " * 40 + "x", "ab\x7f", "½" * 70, ");\r x", "2024-11 3.5"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return pieces.Pieces(file.read())


def strings(n, most, seed=4):
    rng = random.Random(seed)
    letters = "ab▁ \n\r\t;<>0xE日é😀\x00the iner"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, most))) for _ in range(n)]


def test_encodes_and_decodes_as_the_library(vocabulary, library):
    encoder = pieces.Encoder(vocabulary)
    for text in ODD + strings(2000, 200) + strings(20, 4000):
        ids = encoder.encode(text)
        assert ids == library.encode(text)
        assert vocabulary.decode(ids) == library.decode(ids)
    encoder.check(library)
    assert not encoder.new


def test_decodes_any_ids_as_the_library(vocabulary, library):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 29871, 259, *range(3, 259), *range(300, 320)]) for _ in range(rng.randrange(8))]
        assert vocabulary.decode(ids) == library.decode(ids)


def test_both_agendas_agree_and_cuts_lose_no_merge(vocabulary):
    for segment in strings(500, 60, 6):
        segment = segment.replace(" ", pieces.BLANK)
        assert vocabulary.merged(segment) == vocabulary.merged_long(segment)
        assert [s for part in vocabulary.parts(segment) for s in vocabulary.merged(part)] == vocabulary.merged(segment)


def test_a_difference_from_the_library_is_an_error(vocabulary, library):
    encoder = pieces.Encoder(vocabulary)
    encoder.encode("some words")
    encoder.new["▁words"] = [5]
    with pytest.raises(ValueError, match="words"):
        encoder.check(library)


def test_old_segments_go(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_SEGMENTS", 3)
    encoder = pieces.Encoder(vocabulary)
    for text in ["a b c d e f g", "g f e d c b a", "a a a"]:
        assert encoder.encode(text) == library.encode(text)
    assert len(encoder) <= 3


def test_rows(spark, library):
    rows = [(k, t, 7, 0) for k, t in enumerate([*ODD, None, "One two", "One two", "é二 " * 60000])] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int, n_tokens int")
    coded = pieces.encode(df.repartition(3), PATH, decoded="decoded")
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in coded.collect():
        text = r.text or ""
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
    back = pieces.decode(coded.select("doc_id", F.when(F.col("doc_id") > 0, F.col("ids")).alias("ids")), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()} == {k: "" if not k else library.decode(library.encode(t or "")) for k, t, *_ in rows}
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_query(spark, library):
    found = {r.doc_id: r for r in Q.op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d.text or "")
        assert found[d.doc_id][1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))

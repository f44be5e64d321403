"""Counts of the shipped vocabulary are those of the library in unigram mode over the same scores."""

import random

import pytest

from tests.conftest import SMALL
from tideline.llm import queries, token_counts


def library(path):
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = [p for p in proto.pieces if p.type == model.ModelProto.SentencePiece.NORMAL]
    scores = token_counts.zipf_scores([p.piece for p in normal])
    for p in normal:
        p.score = scores[p.piece] / token_counts.UNITS
    proto.trainer_spec.model_type = model.TrainerSpec.UNIGRAM
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_every_text_counts_as_the_library_does(spark):
    path = queries.COUNTING_VOCABULARY
    sp, counter = library(path), token_counts.PieceCounter.from_file(path)
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    r = random.Random(9)
    texts += ["".join(r.choice("the aßé汉字😀 \n\t.,19▁") for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "     ", "the " * 20_000, "x" * 3000, "▁a ▁▁b"]
    assert counter.count(texts).tolist() == [len(x) for x in sp.encode(texts)]


def test_scores_are_log_probabilities():
    scores = token_counts.zipf_scores([str(i) for i in range(30_000)])
    assert abs(sum(2.718281828459045 ** (s / token_counts.UNITS) for s in scores.values()) - 1) < 0.02
    assert sorted(scores.values(), reverse=True) == list(scores.values())

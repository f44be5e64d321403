"""Words are cut into pre-tokens by one search over all of them, with the tokenizer's own ids."""

import numpy as np

from tideline.llm import packing, queries


class Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)


def test_one_search_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "PRE_TOKEN", counted := Counted(packing.PRE_TOKEN))
    encoder = packing.WordEncoder(queries.PACKING_TOKENIZER)
    texts = ["It's A-1, don't!", "", "<|startoftext|>x a<|endoftext|> <|y", "İstanbul ÀÉ ªº ½", "a\x01b \x7f 日本語 12 3.4", "one\ntwo\tthree's"]
    ids, starts = encoder.encode(texts)
    assert counted.calls == 1
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    again, _ = encoder.encode(texts)
    assert counted.calls == 1 and np.array_equal(again, ids)

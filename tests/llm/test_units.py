"""Encoding by units does no work on words that it doesn't need."""

import public_tokenizers
import pyarrow as pa

from pathlens.llm import tokens, words


def test_units_are_encoded_without_names(monkeypatch):
    monkeypatch.setattr(words, "span_names", lambda *_: 1 / 0)
    texts = ["Some words, some İstanbul Ⅳ x9 " + "long" * 100, "", "words again 12.5"]
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokens.UnitEncoder(path, False)
    for _ in range(2):  # the second time from what is remembered
        ids, rows = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == [own.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert own.known and max(map(len, own.known)) <= tokens.LONGEST

"""The word cache of the packing encoder when it turns over."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.columns import utf8


def test_turned_caches_give_the_same_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(3)
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    enc, turned = packing.WordEncoder(path), 0
    for _ in range(30):
        texts = [" ".join(f"word{n} thé" for n in rng.integers(0, 120, 12)) for _ in range(2)] + ["", "the end."]
        before = enc.before
        got = enc(*utf8(pa.array(texts)))
        turned += enc.before is not before
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert turned > 3

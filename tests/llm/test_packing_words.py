"""Words of one slice of texts are known to the next."""

import numpy as np
import pyarrow as pa
import public_tokenizers

from originflow.llm import packing

TEXTS = ["The cat, the CAT sat.", None, "", "naïve Ünï—code 123,456 don't!!", "cat sat? the cat; İstanbul ﬁne 東京 x" * 3]


def test_words_of_earlier_slices_are_not_tokenized_again(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words, asked = packing.WordIds(path), []
    each = words._table
    monkeypatch.setattr(words, "_table", lambda w: asked.extend(w.to_pylist()) or each(w))
    want = [e.ids for e in words.tokenizer.encode_batch_fast([t or "" for t in TEXTS], add_special_tokens=False)]
    for limit in (packing.KEPT_WORDS, 5):  # all words kept, or forgotten again and again
        monkeypatch.setattr(packing, "KEPT_WORDS", limit)
        for _ in range(2):
            for i in range(0, len(TEXTS), 2):
                got = words.texts(pa.array(TEXTS[i:i + 2], pa.string()))
                assert [g.tolist() for g in got] == want[i:i + 2]
        if limit == packing.KEPT_WORDS and limit > 5:
            assert len(asked) == len(set(asked)) > 10

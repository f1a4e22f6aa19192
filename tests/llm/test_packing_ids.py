"""Token ids of whole batches: equal to the tokenizer's, with each word tokenised once."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from mnemospark.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_a_word_is_tokenised_once_whatever_follows_it():
    ids, seen = packing.Ids(PATH), []
    tokenize = ids.model.tokenize
    ids.model = SimpleNamespace(tokenize=lambda w: seen.append(w) or tokenize(w))
    for text in ("thwinan, thwinan. Thwinan", "(thwinan) thwinan.", "thwinan,,"):
        ids.of(text)
    assert seen.count("thwinan") == 1


def test_a_batch_equals_the_tokenizer_text_by_text():
    texts = ["The end, the end. THE END.. it's, 's. 3. ½, a", None, "", " \t\n", "日本語 text, here", "ÀÉß×÷ÿ µ.", "plain again, the end", "x <|endoftext|> y", "a\x1cb", "..", "é, é."]
    t = Tokenizer.from_file(PATH)
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for most in (300_000, 3, 0):
        assert list(packing.Ids(PATH, most).of_all(pa.array(texts))) == want
    ids = packing.Ids(PATH)
    assert list(ids.of_all(pa.array(texts).slice(3, 5))) == want[3:8] and list(ids.of_all(pa.array([], pa.string()))) == []
    assert list(ids.of_all(pa.array(texts, pa.large_string()))) == want

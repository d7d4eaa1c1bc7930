"""Added tokens as text have the ids of the plain library call."""

import pyarrow as pa
from tokenizers import Tokenizer

from tallywing.llm import tokens


def test_added_tokens_as_text_equal_the_plain_library():
    fresh = Tokenizer.from_file(tokens.default_path())
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|>", "<|EndOfText|> x", "<|endoftext|", "é<|endoftext|>字", None, "plain", "<|endoftext|>" * 30]
    ids, off = tokens.Encoder(tokens.default_path()).encode(pa.array(texts, pa.string()), 1)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*fresh.encode(t or "", add_special_tokens=False).ids, 1], t
    assert ids[: off[1]].tolist() == [3306, 49407, 1002, 1]

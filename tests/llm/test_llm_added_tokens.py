import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plainspeak.llm import packing


def test_spelling_of_an_added_token_is_that_token(spark):
    """The ids are those of ``tokenizers`` in its default setting, without added special tokens."""
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x" * 9 + "<|endoftext|>\n", "<|endoftext", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs, with_ids=True).collect()}
    assert found == {i: [*model.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert found[0] == [64, 220, 50256, 275, 2]

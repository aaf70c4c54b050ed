"""Token ids of whole texts, by a public byte-pair vocabulary.

The vocabulary comes as a ``tokenizers`` file and as ranks for ``tiktoken``; both give the same ids.
The second is four times as fast and does the work; texts that hold the spelling of an added token
(such as ``<|endoftext|>``, one id unless it is read as ordinary text), texts that the second gives up on (runs of
millions of equal characters) and vocabularies without ranks are encoded by the first.
"""

from __future__ import annotations

import base64
import json
import os
from array import array

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


class Encoder:
    """Texts to native unsigned 32-bit ids. ``path``: a ``tokenizers`` file instead of the installed one.
    ``added``: the spelling of an added token is that token, as in the default setting of ``tokenizers``;
    otherwise it is ordinary text."""

    def __init__(self, path: str | None = None, added: bool = False):
        self.path, self.slow, self.fast, self.added, self.spellings = path, None, None, added, []
        if path is None:
            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(RANKS), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.path = public_tokenizers.path(VOCABULARY)
            if added:
                with open(self.path, encoding="utf-8") as file:
                    self.spellings = [x["content"] for x in json.load(file).get("added_tokens") or []]
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> array:
        if self.fast is not None and not any(x in text for x in self.spellings):
            try:
                return array("I", self.fast.encode_ordinary(text))
            except BaseException as error:  # a panic of the library is no Exception
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.added
        return array("I", self.slow.encode(text, add_special_tokens=False).ids)

import numpy as np
import public_tokenizers
from test_codecs import EDGE
from tokenizers import Tokenizer

from leafmill.llm import pieces


def test_edges_and_added_tokens_as_library():
    texts = EDGE + ["a <|endoftext|> hi", "a<|endoftext|>b c", "<|startoftext|>x <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "a b c", "x\n<|endoftext|>\n\ny"]
    for name, keep_space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), pieces.library_encoder.__wrapped__(path, keep_space)
        for _ in range(2):  # the second time from memory
            got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
            assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]

"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the public vocabulary files lie, and the one that is used.
FOLDER, VOCABULARY = "/opt/tokenizers", "piece_bpe_32k.model"


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by the kind of file; every executor needs the file."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary file {path} on this machine; name its folder in token_count()")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]


def token_count(text: Column | str, vocabulary: str = VOCABULARY, folder: str = FOLDER) -> Column:
    """Tokens of a text; null for null. The whole text counts."""
    path = f"{folder}/{vocabulary}"

    def count(texts: pa.Array) -> pa.Array:
        count_all, out = counter(path), []
        for start in range(0, len(texts), 64):
            part = texts[start : start + 64].to_pylist()
            known = iter(count_all([x for x in part if x is not None]))
            out += [None if x is None else next(known) for x in part]
        return pa.array(out, pa.int64())

    return F.arrow_udf(count, "bigint")(text)

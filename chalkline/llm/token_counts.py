"""Token counts from the piece counts of distinct pre-tokens.

Every block of documents is reduced to its distinct pre-tokens, those are encoded once (a worker
remembers them over blocks and tasks, up to a bound), and the counts are joined back to the
documents' pre-tokens and summed. Ids of documents are never built. The join stays inside a task: a
corpus-wide join would send one row for every distinct pre-token of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from chalkline.llm.batches import with_text_columns
from chalkline.llm.pieces import resolve, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


class _Sentencepiece:
    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=resolve(name))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


def with_token_counts(
    docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, text: str = "text"
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``tokenizer`` is a path or the name of a public tokenizer; begin and end tokens are not added,
    and strings of special tokens inside a text count as the library reads them by default.
    A null text counts as empty: 0 bytes, 0 tokens. Rows are never dropped or merged; repeated
    rows stay. Existing columns of these three names are replaced. A SentencePiece model does not cut
    texts at spaces, so its pieces are counted on whole texts.
    """
    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]

    def make():
        counter = _Sentencepiece(tokenizer) if tokenizer.endswith(".model") else table(tokenizer)

        def work(texts: list[str]):
            tokens = counter.counts(texts)
            return [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]

        return work

    return with_text_columns(docs, fields, make, text)

"""Token counts of whole texts by the tokenizers' own libraries; only lengths leave the Arrow functions.

Long and short texts are taken in batches of about equal bytes. Where the tokenizer is byte-level, texts are split at boundaries that
no token can cross (``common.segments``), so the longest text costs no more memory than a short one, and a segment that
comes again is counted from memory. Other kinds of tokenizer get whole texts, as nothing is known about their boundaries.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.llm.common import Memo, append_columns, col, field, segments, without

BATCH_BYTES = 256 << 10
_LOADED: dict[str, object] = {}


class JsonCounter:
    """Counts of the tokenizers library, without added tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        state = self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer else b""
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.splits = b'"ByteLevel"' in state and b'"use_regex":true' in state and b'"add_prefix_space":false' in state and self.tokenizer.normalizer is None
        self.splits &= not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in added)
        self.memo = Memo(lambda part: self.lengths([" " + part])[0])

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.lengths(texts)
        cut = [segments(t) for t in texts]
        new = list({p for _, rest in cut for p in rest if p not in self.memo and p not in self.memo.old})
        batch, size = [], 0
        for i, part in enumerate(new):
            batch.append(part)
            size += len(part)
            if size >= BATCH_BYTES or i == len(new) - 1:
                counts = self.lengths([" " + p for p in batch])
                self.memo.learn(batch, counts)
                batch, size = [], 0
        heads = self.lengths([head for head, _ in cut])
        return [n + sum(map(self.memo.__getitem__, rest)) for n, (_, rest) in zip(heads, cut)]


class ModelCounter:
    """Counts of sentencepiece over whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]


def load(path: str):
    if path not in _LOADED:
        _LOADED[path] = (ModelCounter if path.endswith(".model") else JsonCounter)(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as the empty one: 0 bytes, 0 tokens. Repeated rows repeat their result; columns of ``docs``
    with the new names are replaced. The file must be at the same path on every executor.
    """

    def make():
        counter = load(path)

        def run(texts):
            counts: list[int] = []
            start = size = 0
            for i, t in enumerate(texts):  # about as many bytes in each batch
                size += len(t)
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    counts += counter(texts[start:i + 1])
                    start, size = i + 1, 0
            return [pa.array(counts, type=pa.int64())]

        return run

    counted = append_columns(docs.withColumn("n_bytes", F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long")), text,
                             [field("n_tokens", "long")], make, keep=None if keep is None else [*keep, "n_bytes"])
    return counted.select(*[col(c) for c in without(counted, ["over_limit"])], (F.col("n_tokens") > limit).alias("over_limit"))

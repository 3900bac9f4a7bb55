"""Token counts with a public tokenizer.

Texts are cut at ASCII white space, which no pre-token of the tokenizer crosses, so a
text's count is the sum over its pieces and a long text is never encoded whole. A
white-space-free piece longer than ``LONG`` bytes is cut again, if ``classes_apart`` says
that the tokenizer keeps classes of characters apart: beside ASCII digits, and where a letter
meets punctuation, but not within a special string. What is left, a run of letters or of
signs alone, is one pre-token and has no safe boundary. Within a block of texts each
distinct piece is encoded once, in batches of about equal bytes; only lengths are kept,
and from one block to the next only those of ``KEPT_PIECES`` pieces of ``KEPT_BYTES`` at most.

A null or empty text has no tokens. Special strings inside texts count as the
library counts them by default. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veldgraph.llm.tokens import blocks

LIMIT = 2048
LONG = 4096
BATCH_BYTES = 256 << 10
KEPT_PIECES = 400_000
KEPT_BYTES = 64
#: Between a letter, of ASCII or an ideograph, and a sign that neither a special string nor a contraction holds.
CLASSES = re.compile(rb"(?<=[A-Za-z])(?=[!\"#$%&()*+,\-./:;=?@\[\]^_`{}~])|(?<=[\xe5-\xe9][\x80-\xbf][\x80-\xbf])(?=\xe3\x80[\x81\x82])|(\d)")

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _loaded[path] = (t, {})
    return _loaded[path]


def _cut(piece: bytes, classes_apart: bool) -> list[bytes]:
    if len(piece) <= LONG or not classes_apart:
        return [piece]
    out, begin = [], 0
    for m in CLASSES.finditer(piece):
        # A digit is a boundary at both of its ends.
        for at in (m.start(), m.end()):
            if at - begin >= LONG:
                out.append(piece[begin:at])
                begin = at
    return [*out, piece[begin:]]


def _learn(tokenizer, lengths: dict[bytes, int], pieces: list[bytes]) -> None:
    """Encodes pieces in batches of about BATCH_BYTES."""
    batch, size = [], 0
    for i, piece in enumerate(pieces):
        batch.append(piece)
        size += len(piece) + 16
        if size >= BATCH_BYTES or i == len(pieces) - 1:
            for p, e in zip(batch, tokenizer.encode_batch_fast([p.decode() for p in batch], add_special_tokens=False), strict=True):
                lengths[p] = len(e)
            batch, size = [], 0


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, classes_apart: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. The file must be at that path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = _tokenizer(tokenizer_path)
        for batch in blocks(batches, "text", 4 << 20):
            texts = pc.fill_null(batch.column("text"), "")
            parts = [[q for p in t.split() for q in (_cut(p, classes_apart) if len(p) > LONG else (p,))] for t in texts.cast(pa.large_binary()).to_pylist()]
            fresh: dict[bytes, int] = {}
            _learn(tokenizer, fresh, [p for p in set().union(*parts) if p not in lengths])
            known = lambda p: lengths[p] if p in lengths else fresh[p]
            counts = np.array([sum(map(known, p)) for p in parts], dtype=np.int64)
            if len(lengths) + len(fresh) > KEPT_PIECES:
                lengths.clear()
            lengths.update(itertools.islice(((p, n) for p, n in fresh.items() if len(p) <= KEPT_BYTES), KEPT_PIECES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

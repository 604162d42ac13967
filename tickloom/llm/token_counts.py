"""Token counts with a SentencePiece model.

An Arrow function reads texts and returns lengths only. Inside a record batch a
long text is cut at safe boundaries and the parts go to the library in calls
of about ``call_bytes`` bytes, so no call depends on how many rows a batch has.

A boundary is safe where one space stands between two characters that are not
spaces: no piece of the vocabulary has its space mark after another character,
so no merge crosses that place, and the library puts the space mark that it
replaces in front of the part that follows. ``check_model`` proves both for the
model at hand; a model that fails is given whole texts.

Defined results: null and empty texts have 0 tokens; an empty table gives no
rows; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_path

PART_CHARS = 8192
CALL_BYTES = 1 << 19
SPACES = " ▁"


def check_model(model) -> bool:
    """Whether texts may be cut at single spaces."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    inner = any("▁" in p.lstrip("▁") for p in pieces)
    probe = ["a b", "a b c", "x\n y", "a\tb  c d"]
    joined = all(model.encode(p) == [i for part in cut_text(p, 1) for i in model.encode(part)] for p in probe)
    return joined and not inner


def cut_text(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` in parts of at least ``most`` characters, cut at safe boundaries."""
    parts, start, at = [], 0, most
    while (at := text.find(" ", at)) != -1:
        if at > start and at + 1 < len(text) and text[at - 1] not in SPACES and text[at + 1] not in SPACES:
            parts.append(text[start:at])
            start, at = at + 1, at + 1 + most
        else:
            at += 1
    return [*parts, text[start:]]


def count_batch(model, texts: list[str], call_bytes: int = CALL_BYTES, cuts: bool = True) -> np.ndarray:
    """Tokens of each text."""
    counts = np.zeros(len(texts), dtype=np.int64)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        if parts:
            lengths = [len(ids) for ids in model.encode(parts, num_threads=1)]
            np.add.at(counts, owners, lengths)
            parts.clear()
            owners.clear()

    for row, text in enumerate(texts):
        for part in cut_text(text) if cuts and len(text) > PART_CHARS else [text]:
            parts.append(part)
            owners.append(row)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= call_bytes:
                flush()
                held = 0
    flush()
    return counts


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        cuts = check_model(loaded)
        for batch in batches:
            tokens = count_batch(loaded, batch.column("text").to_pylist(), cuts=cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

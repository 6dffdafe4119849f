"""Token counts: whole texts encoded in Arrow batches; only lengths come back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import sliced

#: A blank between two characters that aren't white space: the pre-tokenizer always begins a new piece there.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_pieces(text: str, most: int) -> list[str]:
    """Cut text into pieces of about `most` characters, only at blanks between two non-blank characters.

    A byte-level tokenizer's pieces never cross such a blank (it opens the next piece), so the pieces' token counts
    add up to the text's. A stretch without such a blank stays whole.
    """
    pieces, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most - 1)
        if not cut:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def batches_of(texts: list[str], piece_chars: int, most_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The texts' pieces in batches that end once they have most_bytes of UTF-8, and the text of each piece."""
    pieces: list[str] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in safe_pieces(text, piece_chars):
            pieces.append(piece)
            owners.append(k)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= most_bytes:
                yield owners, pieces
                pieces, owners, size = [], [], 0
    if pieces:
        yield owners, pieces


def _load(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 50_000, batch_bytes: int = 200_000, batch_chars: int | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row; a null text counts as empty, equal rows each give a row.

    tokenizer: path of a tokenizers .json or sentencepiece .model, there on every worker. Texts longer than
    piece_chars are split at safe boundaries (.json only; sentencepiece has no such boundary, its texts stay whole), and
    pieces are encoded in batches of about batch_bytes of UTF-8, so a batch costs about the same whatever its texts and their
    script (batch_chars is the former name). An empty table gives an empty one.
    No shuffle; memory is bounded by an Arrow batch and the longest text.
    """
    full = batch_bytes if batch_chars is None else batch_chars
    most = piece_chars if tokenizer.endswith(".json") else 1 << 60
    kinds = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _load(tokenizer)
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            totals = [0] * len(texts)
            for owners, pieces in batches_of(texts, most, full):
                for o, n in zip(owners, lengths(pieces)):
                    totals[o] += n
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, f"id {kinds}, n_bytes long, n_tokens long")

"""Token counts: batch encoding in Arrow functions that return lengths only.

Each task gathers pieces of texts into batches of about ``batch_bytes`` and encodes a batch
at a time, so that neither many short texts nor one very long text sets the memory. A text of
more than ``piece_chars`` is cut at safe boundaries: a single space between two ASCII
characters that are no white space. No vocabulary piece of a SentencePiece model with
white-space prefixes goes on past such a space, and the model itself puts the prefix back
before the next piece, so the counts of the pieces add up to the count of the whole text.
A text without such a place is encoded whole.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids
stay as they are, a row each; columns other than the two named ones are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pitpanel.llm.common import map_rows

#: A space that may be left out between two pieces.
SAFE_SPACE = re.compile(r"(?<=[!-~]) (?=[!-~])")


def safe_pieces(text: str, piece_chars: int) -> list[str]:
    """Cut ``text`` at safe spaces, each piece as long as ``piece_chars`` or a little longer."""
    pieces, at = [], 0
    while len(text) - at > piece_chars:
        found = SAFE_SPACE.search(text, at + piece_chars)
        if found is None:
            break
        pieces.append(text[at:found.start()])
        at = found.end()
    return [*pieces, text[at:]]


def byte_batches(texts: list[str], batch_bytes: int, piece_chars: int):
    """Batches of (row, piece) with about ``batch_bytes`` bytes each."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        for piece in safe_pieces(text, piece_chars) if len(text) > piece_chars else (text,):
            batch.append((row, piece))
            size += len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def count_tokens(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, batch_bytes: int = 1 << 18, piece_chars: int = 1 << 15) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text, by the SentencePiece ``model_file``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def step(columns):
            ids, texts = columns[0], [text or "" for text in columns[1]]
            counts = [0] * len(texts)
            for batch in byte_batches(texts, batch_bytes, piece_chars):
                for (row, _), tokens in zip(batch, model.encode([p for _, p in batch], num_threads=1), strict=True):
                    counts[row] += len(tokens)
            sizes = [len(text.encode("utf-8")) for text in texts]
            return [ids, sizes, counts, [n > limit for n in counts]]

        return step

    return map_rows(docs, [id_col, text_col],
                    f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", start)

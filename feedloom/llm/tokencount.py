"""Token counts under a unigram vocabulary, without making the tokens.

The Viterbi pass over a text runs from left to right. An Aho-Corasick automaton lists the pieces
that end at each place; the pass carries the best score and its piece count only. Tie rule of the
tokenizer: of equal scores the piece that begins first wins (a later candidate must be better). A
character that no single-character piece covers may be unknown, at the lowest score of the
vocabulary less ``UNKNOWN_LOSS``, and counts as its UTF-8 bytes (byte fallback).

White space is the mark U+2581, and one precedes the text. A piece holds marks only at its start,
so the best path can't cross from another character to a mark: the text is cut there, and each
distinct cut piece of text is solved once in a batch of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_LOSS = 10.0
#: Solved cuts that a task remembers; beyond that it starts anew.
REMEMBERED = 200_000


class Vocabulary:
    """Pieces and scores, with the automaton and the pattern of the cuts."""

    def __init__(self, pieces: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_LOSS
        marks_lead = all(MARK not in p.lstrip(MARK) for p in pieces)
        if not marks_lead:
            self.cut = re.compile(r"(?s).+")
        elif any("\n" in p for p in pieces):
            self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def cuts(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def solve(self, text: str) -> tuple[int, float]:
        """(pieces of the best path, its score)."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end, found in enumerate(ends):
            top, pieces, single = None, 0, False
            for size, score in found:
                value = best[end + 1 - size] + score
                if top is None or value > top:
                    top, pieces = value, count[end + 1 - size] + 1
                single = single or size == 1
            if not single:
                value = best[end] + self.unknown
                if top is None or value > top:
                    top, pieces = value, count[end] + len(text[end].encode())
            best[end + 1], count[end + 1] = top, pieces
        return count[n], best[n]


def read_pieces(path: str) -> dict[str, float]:
    """The ordinary pieces of a model file with their stored scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in ids}


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        known: dict[str, int] = {}
        for batch in batches:
            counts: list[int] = []
            pending: list[list[str]] = []
            held = 0

            def flush(pending=pending, counts=counts):
                if len(known) > REMEMBERED:
                    known.clear()
                for cut in set(chain.from_iterable(pending)) - known.keys():
                    known[cut] = vocabulary.solve(cut)[0]
                counts.extend(sum(map(known.__getitem__, cuts)) for cuts in pending)
                pending.clear()

            for text in batch.column("text"):
                text = text.as_py() or ""
                pending.append(vocabulary.cuts(text) if text else [])
                held += len(text)
                if held > 1 << 20:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have no tokens.

    Rows stay as they are, repeated ones too; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long"
    return rows.mapInArrow(_counted(docs.sparkSession.sparkContext.broadcast(pieces)), schema)

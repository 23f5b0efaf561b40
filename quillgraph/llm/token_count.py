"""Token counts of a unigram vocabulary without the tokens: a count-only Viterbi search.

A text's words, each behind the word mark, are tokenised apart. In a word an Aho-Corasick automaton names every piece that ends
at a character, longest first; the best score up to there and its number of pieces go on. A piece replaces the best so far only if
its score is higher, so on a tie the longest last piece stays, as in the tokenizer library. A character that is no piece by
itself may be read as its UTF-8 bytes at ten below the lowest score, and counts a token for each byte. Control, unknown and byte
pieces are never matched in a text, as a tokenizer does not: ``<s>`` or ``<0x41>`` written out are characters like others.

Each distinct word of a block is searched once and counted as often as it occurs; the score of a text is summed over its own words
in order, whatever texts are around it. Null and empty texts have no tokens. Very long words cost their length, very long texts
are whole. Repeated rows give repeated results, an empty table an empty one. Extra columns, whatever their names, are not read.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import text_kernel as K
from .runtime import narrowed, pieces, prepare

#: The mark before a word, and how far below the lowest score an unknown character is.
MARK, PENALTY = "▁", 10.0
#: Bytes of text in a block, distinct words whose counts a worker keeps.
WORD_BLOCK, KEPT_WORDS = 16 << 20, 300_000
_LOADED: dict[str, Pieces] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a model file that a text can match, with their scores, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Pieces:
    """The vocabulary as an automaton."""

    def __init__(self, table: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in table:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in table) - PENALTY
        self.kept: dict[bytes, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best path over a word."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces_to = [0] * (n + 1)
        done = 0  # characters up to which the unknown reading has been offered
        alone = False  # a piece is the single character that ends here

        def offer(stop: int) -> None:
            """End the characters up to ``stop`` whose last one is no piece by itself."""
            nonlocal done, alone
            while done < stop:
                if not alone:
                    s = best[done] + self.unknown
                    if best[done + 1] is None or s > best[done + 1]:
                        best[done + 1], pieces_to[done + 1] = s, pieces_to[done] + len(word[done].encode())
                alone = False
                done += 1

        for end, (size, score) in self.automaton.iter(word):
            offer(end)
            s = best[end + 1 - size] + score
            if best[end + 1] is None or s > best[end + 1]:
                best[end + 1], pieces_to[end + 1] = s, pieces_to[end + 1 - size] + 1
            if size == 1:
                alone = True
        offer(n)
        return pieces_to[n], best[n]

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((2, len(words)))
        for i, w in enumerate(words):
            found = self.kept.get(w)
            if found is None:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                found = self.kept[w] = self.count(MARK + w.decode())
            out[:, i] = found
        return out[0].astype(np.int64), out[1]


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs that ``first`` (with a last entry) cuts, each from its own values alone."""
    out, some = np.zeros(len(first) - 1, values.dtype), first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some])
    return out


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(vocabulary(path))
    return _LOADED[path]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = loaded(path)
        for piece in pieces(batches, "text", WORD_BLOCK):
            buf, offs = K.buffer_of(piece.column("text"))
            starts, ends, first = K.word_spans(buf, offs)
            h = K.span_hashes(buf, starts, ends)
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
            where = np.empty(len(h), np.int64)
            where[order] = np.cumsum(new) - 1
            sample = order[new]
            data = buf.tobytes()
            words = [data[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
            tokens, scores = vocab.counts(words)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first)), *(pa.array(_by_row(x[where], first)) for x in (tokens, scores))], ["doc_id", "n_words", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, score`` of whole texts; the score is the sum over the best paths."""
    prepare(docs.sparkSession)
    return narrowed(docs, id_col, text_col).mapInArrow(_counter(model_path), "doc_id long, n_words long, n_tokens long, score double")

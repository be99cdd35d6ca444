"""Token counts of a unigram tokenizer without its tokens: Viterbi over Aho-Corasick matches."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starboard.llm.common import Remembered, ship_code

MARK = "▁"
# A word's best path costs far more than a look at it, so that more of them are remembered than elsewhere.
REMEMBERED_WORDS_BYTES = 192 << 20
# Fixed value: an unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
# A word with the spaces before it, or spaces at the end.
WORD = re.compile(" *[^ ]+| +")


class UnigramCounter:
    """Best score of a text and the number of pieces that has it, for pieces with scores.

    ``best`` goes through the matches by their end; of those that end together the longest comes first, a later
    one has to score more, and a character that is no piece comes last as an unknown of as many pieces as it has
    UTF-8 bytes. These are the tokenizer's own ties: for each place the earliest start wins.
    """

    def __init__(self, pieces: dict[str, float], remembered: int = REMEMBERED_WORDS_BYTES):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece goes on after a space; words can't be counted one by one")
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)
        self.known = Remembered(lambda word: self.best(word.replace(" ", MARK)), size=lambda _: 96, most=remembered)

    def best(self, text: str) -> tuple[float, int]:
        scores, counts = [0.0], [0]
        matches = self.automaton.iter(text) if self.any else iter(())
        at, match = next(matches, (-1, None))
        for end, character in enumerate(text):
            score, count, single = None, 0, False
            while at == end:
                length, own = match
                start = end + 1 - length
                if score is None or scores[start] + own > score:
                    score, count = scores[start] + own, counts[start] + 1
                single = length == 1
                at, match = next(matches, (-1, None))
            if not single and (score is None or scores[end] + self.unknown > score):
                score = scores[end] + self.unknown
                count = counts[end] + len(character.encode("utf-8", "surrogatepass"))
            scores.append(score)
            counts.append(count)
        return scores[-1], counts[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text with a space put before it; (0, 0) for an empty one.

        No piece goes from one word into the next, so the best path of a text is that of its words one after the
        other. Short words are remembered. Scores that are whole numbers add up exactly.
        """
        if not text:
            return 0, 0.0
        scores, counts = zip(*map(self.known.__getitem__, WORD.findall(" " + text)))
        return sum(counts), sum(scores)


def read_pieces(model_file: str) -> dict[str, float]:
    """Pieces of ordinary text and their scores; byte, control and unused pieces are none."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    ids = [i for i in range(model.get_piece_size()) if not any(kind(i) for kind in special)]
    return {model.id_to_piece(i): model.get_score(i) for i in ids}


@functools.lru_cache(maxsize=1)
def unigram_counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(model_file))


def count_tokens(docs: DataFrame, model_file: str, *, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens`` and ``token_score`` of the whole text; null counts as empty: 0 and 0.

    Columns that had these names are replaced. Texts are read whole; of very long ones without a space a task
    remembers nothing. No rows give no rows.
    """
    ship_code(docs.sparkSession)

    @F.pandas_udf("n_tokens long, token_score double")
    def counted(texts: pd.Series) -> pd.DataFrame:
        counter = unigram_counter(model_file)
        return pd.DataFrame([counter.count(t) for t in texts], columns=["n_tokens", "token_score"])

    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "n_tokens", "token_score")]
    found = docs.select(*kept, counted(F.col(text)).alias("_counted"))
    return found.select(*kept, "_counted.n_tokens", "_counted.token_score")

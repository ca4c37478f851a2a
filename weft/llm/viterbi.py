"""Token counts of a unigram model without making tokens: a count-only Viterbi search.

The vocabulary and the scores are a public tokenizer file's. An Aho-Corasick automaton lists all vocabulary pieces in a
string by where they end; for each place the search carries the best score of a split that ends there
and how many pieces it has. Ties follow the unigram model of the tokenizers library: of splits with equal scores the
one whose last piece starts first (the longest) stays. A character that is no piece costs the lowest score
less 10 and, with byte fallback, counts as its UTF-8 bytes.

Spaces become U+2581 and one stands before a text that isn't empty. No piece has U+2581 after another character, so
a text falls apart before each run of U+2581; the parts are searched on their own, and each task keeps the counts of parts it has seen.

Cases: a null or empty text has 0 tokens; texts are read whole; repeated rows count each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._batches import small_batches
from weft.llm._tokens import tokenizer_path
from weft.session import table

UNKNOWN_PENALTY = 10.0
CACHED_PARTS = 1_000_000
SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class UnigramCounter:
    """Counts pieces of the best split under ``pieces``: (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.seen: dict[str, int] = {}

    def search(self, part: str) -> int:
        """Pieces in the best split of ``part``. Only as many places are held as the longest piece has characters, so that a part may be of any length."""
        none, ring = float("-inf"), self.longest + 1
        best, count = [none] * ring, [0] * ring
        best[0] = 0.0
        matches = self.automaton.iter(part)  # by their ends
        match = next(matches, None)
        for end, character in enumerate(part):
            here = []
            while match is not None and match[0] == end:
                here.append(match[1])
                match = next(matches, None)
            top, pieces = none, 0
            # longest first: the earliest start stays on a tie
            for length, score in sorted(here, reverse=True):
                at = (end + 1 - length) % ring
                total = best[at] + score
                if total > top:
                    top, pieces = total, count[at] + 1
            if character not in self.single:
                at = end % ring
                total = best[at] + self.unknown
                if total > top:
                    top, pieces = total, count[at] + len(character.encode("utf-8", "surrogatepass"))
            best[(end + 1) % ring], count[(end + 1) % ring] = top, pieces
        return count[len(part) % ring]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        seen, total = self.seen, 0
        for part in _PARTS.findall(SPACE + text.replace(" ", SPACE)):
            n = seen.get(part)
            if n is None:
                n = self.search(part)
                if len(part) <= 64:
                    if len(seen) >= CACHED_PARTS:
                        seen.clear()
                    seen[part] = n
            total += n
        return total


def file_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file that are text, with their scores (no control, unknown or byte pieces)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


@lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(file_pieces(path))


def token_counts(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id) and n_tokens of each row's text."""
    keep = ["doc_id"] if keep is None else keep
    path = model or tokenizer_path("piece_bpe_32k.model")

    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in parts:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    counted.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return small_batches(docs).select(*keep, F.pandas_udf(counted, "bigint")(text).alias("n_tokens"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

"""Token counts under a score-merged piece vocabulary (SentencePiece BPE with byte fallback), without building the ids.

Two facts are proved from the vocabulary when it is loaded:

* no piece has the space mark after another character, and none holds a line feed: texts can be cut before each run of
  space marks and around line feeds, and each cut (a pre-token) be counted alone;
* which pieces encode alone as one token: merging their characters gives the piece itself.

Pre-tokens among those pieces count one each by a table look-up; only the rest are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, chunks
from .merging import PairTable, merge_words

MARK = "▁"
#: Entries of a worker's table of merged pre-tokens; it is emptied beyond this.
WORD_TABLE = 500_000
_PRE_TOKENS = regex.compile(r"\n|▁*[^▁\n]+|▁+")


class PieceCounter:
    """Compiled tables of a vocabulary file. Raises ValueError if the file breaks a fact that the shortcut rests on."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in every if i not in special}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError(f"{path}: a piece crosses a pre-token's border")
        if sum(sp.is_byte(i) for i in every) != 256 or sp.encode("a  b") != sp.encode("a▁▁b") or sp.encode_as_pieces("ﬁ")[-1] == "fi":
            raise ValueError(f"{path}: another normaliser, or no byte fallback")
        chars = sorted({c for p in pieces for c in p})
        symbol = {s: i for i, s in enumerate(dict.fromkeys([*chars, *pieces]))}
        #: symbols above len(symbol) stand for characters of 1 to 4 bytes that no piece holds
        self.other = len(symbol)
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbol] + [0, 1, 2, 3, 4], np.int64)
        place = {score: r for r, score in enumerate(sorted({*pieces.values()}, reverse=True))}
        order = {p: place[score] for p, score in pieces.items()}  # pieces of one score have one rank: the leftmost goes first
        pairs = [(symbol[p[:k]], symbol[p[k:]], order[p], symbol[p]) for p in pieces for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.table = PairTable(*map(np.array, zip(*pairs)))
        self.char_symbol = np.zeros(0x110000, np.int32)
        for lo, hi, n in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.char_symbol[lo:hi] = self.other + n
        for c in chars:
            self.char_symbol[ord(c)] = symbol[c]
        whole = list(pieces)
        counts = self.merge_counts(whole)
        self.proven = {p for p, n in zip(whole, counts) if n == 1}
        self._reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("counts", "_pairs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _reset(self):
        self.counts = dict.fromkeys(self.proven, 1)
        self.counts[""] = 0
        self._pairs = None

    def merge_counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token by merging."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.char_symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(lens) and lens.max() > 48 and getattr(self, "_pairs", None) is None:
            self._pairs = self.table.as_dict()
        out, sizes = merge_words(flat, lens, self.table, getattr(self, "_pairs", None))
        done = np.concatenate([[0], np.cumsum(self.cost[out])])
        stop = np.cumsum(sizes)
        return (done[stop] - done[stop - sizes]).tolist()

    def count(self, texts: Sequence[str]) -> list[int]:
        cuts = [self._cut(t) for t in texts]
        missing = {w for words, _ in cuts for w in words}.difference(self.counts)
        if len(self.counts) + len(missing) > WORD_TABLE + len(self.proven):
            self._reset()
            missing = {w for words, _ in cuts for w in words}.difference(self.counts)
        if missing:
            fresh = list(missing)
            self.counts.update(zip(fresh, self.merge_counts(fresh)))
        look = self.counts.__getitem__
        return [sum(map(look, words)) + lines for words, lines in cuts]

    @staticmethod
    def _cut(text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of line feeds (a token each)."""
        if not text:
            return [], 0
        if "  " in text or MARK in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            parts = _PRE_TOKENS.findall(marked)
            return [p for p in parts if p != "\n"], text.count("\n")
        return (MARK + text.replace(" ", " " + MARK)).replace("\n", " ").split(" "), text.count("\n")


def token_counts(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text (long): no begin, end or special tokens; null or empty text: 0.

    The tables, bounded by the vocabulary, are compiled on the driver and broadcast. No shuffle. Repeated rows and null ids are
    counted like others; an empty table gives no rows. A column of df that has the output's name is replaced.
    """
    prepare(df.sparkSession)
    counter = df.sparkSession.sparkContext.broadcast(PieceCounter(model_path))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([n for block in chunks(texts) for n in counter.value.count(block)], dtype="int64")

    return df.withColumn(out_col, F.pandas_udf(count, "bigint")(F.col(text_col).cast("string")))

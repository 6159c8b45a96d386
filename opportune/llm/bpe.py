"""BPE encoding and decoding by speculation and verification.

Greedy longest match over the vocabulary proposes tokens for every distinct word. A proposal is the true encoding exactly if
every adjacent pair of its tokens is compatible, that is, if merging the two tokens' joint string gives the two tokens again.
The check undoes the merges of both tokens, latest first, and looks for a pair across their border that would have merged
earlier; it runs over all adjacent pairs of a batch at once. Only words with an incompatible pair are merged exactly.

A word's encoding doesn't depend on its neighbours, so words are encoded once a batch and looked up after that.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, chunks
from .merging import NONE, PairTable, merge_words

#: Entries of a worker's word table (about 200 bytes each), unless told otherwise; it is emptied beyond this.
WORD_TABLE = 250_000


# Letters and numbers of Unicode 16 that Python's tables don't have yet, and their lower case.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# White space of the vocabulary's pattern (Python's also has four control characters).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below this, Python knows all letters.
FIRST_NEW = chr(NEW_LETTERS[0][0])


def char_class(major: str, newer: list[tuple[int, int]]) -> str:
    """Ranges of a pattern's character class: all code points of a major category."""
    ranges: list[list[int]] = []
    for c in sorted([*(c for c in range(0x110000) if unicodedata.category(chr(c))[0] == major), *(c for a, b in newer for c in range(a, b + 1))]):
        if ranges and c <= ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class BpeCodec:
    """Compiled tables of a byte-level BPE vocabulary file (tokenizers JSON: NFC, lower case, word ends), and its words so far.

    Raises ValueError if the file asks for something that the tables don't model.
    """

    def __init__(self, path: str, word_table: int = WORD_TABLE):
        self.word_table = word_table
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"] or not split or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-case word-end BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: an added token is matched otherwise than as it stands in the text")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters, numbers = char_class("L", NEW_LETTERS), char_class("N", NEW_NUMBERS)
        self.word_pattern = split["pattern"]["Regex"].replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]").replace("\\p{L}", letters).replace("\\p{N}", numbers).replace("\\s", SPACE)
        if "\\p" in self.word_pattern:
            raise ValueError(f"{path}: another word pattern")
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        left, right, product = (np.array([vocab[m[k]] if k < 2 else vocab[m[0] + m[1]] for m in merges], np.int32) for k in range(3))
        if len(np.unique(product)) != len(product):
            raise ValueError(f"{path}: a token has two merges")
        self.table = PairTable(left, right, np.arange(len(merges)), product)
        self.rank = np.full(size, -1, np.int32)  # of the merge that makes the token; -1: none
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.rank[product], self.left[product], self.right[product] = np.arange(len(merges)), left, right
        if (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: a merge comes before the merges of its parts")
        letters = byte_letters()
        self.byte_token = np.array([[vocab[c], vocab[c + suffix]] for c in letters], np.int32)  # [byte][1: at a word's end]
        self._compile_trie(vocab, suffix, letters)
        self._reset()

    def _compile_trie(self, vocab, suffix, letters):
        """A trie over byte tokens of all vocabulary strings that encode alone as themselves; only those can be proposed."""
        byte_of = {c: i for i, c in enumerate(letters)}
        spelled, ids = [], []
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            body = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            if body:
                spelled.append([int(self.byte_token[b, int(ends and k == len(body) - 1)]) for k, b in enumerate(body)])
                ids.append(i)
        lens = np.array([len(s) for s in spelled])
        merged, sizes = merge_words(np.concatenate([np.array(s, np.int32) for s in spelled]), lens, self.table)
        alone = (sizes == 1) & (merged[np.cumsum(sizes) - sizes] == np.array(ids))
        children: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for symbols, i, ok in zip(spelled, ids, alone):
            if ok:
                node = 0
                for s in symbols:
                    node = children.setdefault((node, s), len(token_at))
                    if node == len(token_at):
                        token_at.append(-1)
                token_at[node] = i
        keys = np.array(list(children), np.int64)
        self.trie = PairTable(keys[:, 0], keys[:, 1], np.zeros(len(keys)), list(children.values()))
        self.token_at = np.array(token_at, np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "starts", "sizes", "pool", "_find", "_specials", "_special_start")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _reset(self):
        self._find = re.compile(self.word_pattern).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self._special_start = os.path.commonprefix(longest_first)
        self.words: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # ---- words

    def propose(self, flat, lens):
        """Greedy longest match of each word; ragged tokens (flat, lengths)."""
        n, end = len(lens), np.cumsum(lens)
        pos = end - lens
        node, last, last_end = np.zeros(n, np.int64), np.full(n, -1, np.int32), pos.copy()
        who, out_word, out_token = np.flatnonzero(lens > 0), [], []
        while len(who):
            p = pos[who]
            inside = p < end[who]
            child = np.full(len(who), -1, np.int32)
            child[inside] = self.trie.products(node[who[inside]], flat[p[inside]])
            go = child >= 0
            w, c = who[go], child[go]
            node[w] = c
            pos[w] += 1
            token = self.token_at[c]
            hit = token >= 0
            last[w[hit]], last_end[w[hit]] = token[hit], pos[w[hit]]
            w = who[~go]
            if len(w):
                out_word.append(w)
                out_token.append(last[w])
                pos[w], node[w] = last_end[w], 0
                who = who[go | (pos[who] < end[who])]
        word = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        token = np.concatenate(out_token) if out_token else np.zeros(0, np.int32)
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=n)

    def compatible(self, a, b):
        """For each pair: does merging the joint string of tokens a and b give a and b again?"""
        good = np.ones(len(a), bool)
        a, b, limit, who = a.copy(), b.copy(), np.full(len(a), NONE, np.int64), np.arange(len(a))
        while len(who):
            bad = self.table.ranks(a, b) < limit
            good[who[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, who, ra, rb = a[keep], b[keep], who[keep], ra[keep], rb[keep]
            undo_a = ra > rb  # the later of the two merges; among equals the right one is later
            limit = np.where(undo_a, ra.astype(np.int64), rb.astype(np.int64) + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def encode_symbols(self, flat, lens):
        """Ragged byte tokens to ragged encodings: propose, verify all pairs, merge the words that fail."""
        tokens, sizes = self.propose(flat, lens)
        word = np.repeat(np.arange(len(lens)), sizes)
        border = np.flatnonzero(word[1:] == word[:-1])
        key = tokens[border].astype(np.int64) << 32 | tokens[border + 1]
        distinct, back = np.unique(key, return_inverse=True)
        good = self.compatible((distinct >> 32).astype(np.int32), (distinct & 0xFFFFFFFF).astype(np.int32))
        failed = np.zeros(len(lens), bool)
        failed[word[border[~good[back]]]] = True
        if not failed.any():
            return tokens, sizes
        which = np.flatnonzero(failed)
        exact, exact_sizes = merge_words(flat[np.repeat(failed, lens)], lens[which], self.table)
        out_sizes = sizes.copy()
        out_sizes[which] = exact_sizes
        out = np.zeros(int(out_sizes.sum()), np.int32)
        is_exact = np.repeat(failed, out_sizes)
        out[~is_exact] = tokens[~np.repeat(failed, sizes)]
        out[is_exact] = exact
        return out, out_sizes

    def _parts(self, run: str) -> list[str]:
        """Pre-tokens of a run that isn't letters alone; the usual ones, letters and one more character, need no pattern."""
        if run[:-1].isalpha() and run[-1] < FIRST_NEW:
            return [run[:-1], run[-1]]
        return self._find(run.translate(NEW_LOWER) if max(run) >= FIRST_NEW else run)

    def _learn(self, fresh: list[str]):
        """Add runs of non-space characters, and the pre-tokens that they consist of, to the word table."""
        alone, joined = [], []
        for run in fresh:
            if run.isalpha():
                alone.append(run)
                continue
            parts = self._parts(run)
            if len(parts) == 1 and parts[0] == run:
                alone.append(run)
            else:
                joined.append((run, parts))
        known = self.words
        alone += {p for _, parts in joined for p in parts if p not in known}.difference(alone)
        if alone:
            raw = [p.encode() for p in alone]
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            data = np.frombuffer(b"".join(raw), np.uint8)
            ends = np.zeros(len(data), np.int64)
            ends[np.cumsum(lens) - 1] = 1
            self._add(alone, *self.encode_symbols(self.byte_token[data, ends], lens))
        if joined:
            counts = np.fromiter((len(parts) for _, parts in joined), np.int64, len(joined))
            index = np.fromiter((known[p] for _, parts in joined for p in parts), np.int64)
            pool, sizes = gather(self.pool, self.starts[index], self.sizes[index])
            done, stop = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(counts)
            self._add([run for run, _ in joined], pool, done[stop] - done[stop - counts])

    def _add(self, runs: list[str], tokens: np.ndarray, sizes: np.ndarray):
        """Entries of the word table from their ragged tokens."""
        base = len(self.starts)
        self.words.update(zip(runs, range(base, base + len(runs))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, tokens])

    # ---- texts

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text, as little-endian unsigned 32-bit arrays.

        Special strings become their ids only where they stand in the text as they are, before it is lower-cased. In the word
        table they have a space before them, which no run has, so that a run that looks like one after lower-casing is told apart.
        """
        runs: list[str] = []
        counts = []
        for text in texts:
            before = len(runs)
            if self._specials and self._special_start in text:
                for i, part in enumerate(self._specials.split(text)):
                    runs.extend([" " + part] if i % 2 else self._runs(part))
            else:
                runs.extend(self._runs(text))
            counts.append(len(runs) - before)
        index = np.fromiter(map(self.words.get, runs, repeat(-1)), np.int64, len(runs))
        at = np.flatnonzero(index < 0)
        fresh = [runs[i] for i in at.tolist()]
        missing = list(dict.fromkeys(fresh))
        if len(self.words) + len(missing) > self.word_table:
            self._reset()
            at, fresh = slice(None), runs
            missing = list(dict.fromkeys(runs))
        if missing:
            self._learn([w for w in missing if w[0] != " "])
            special = [w for w in missing if w[0] == " "]
            self._add(special, np.array([self.special[w[1:]] for w in special], np.int32), np.ones(len(special), np.int64))
            index[at] = np.fromiter(map(self.words.__getitem__, fresh), np.int64, len(fresh))
        sizes = self.sizes[index]
        flat, _ = gather(self.pool, self.starts[index], sizes)
        done = np.concatenate([[0], np.cumsum(sizes)])
        cuts = done[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        flat = flat.astype("<u4")
        return [flat[cuts[i] : cuts[i + 1]] for i in range(len(counts))]

    def _runs(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split also cuts at these four controls, which aren't white space to the vocabulary's pattern
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return re.findall(f"[^{SPACE}]+", text)
        return text.split()

    def decode(self, ids: np.ndarray) -> str:
        return join_tokens(self.strings, ids)


def join_tokens(strings: list[str], ids: np.ndarray) -> str:
    """The tokens' strings, joined by single spaces (the vocabulary file has no decoder of its own)."""
    return " ".join(map(strings.__getitem__, ids.tolist()))


def gather(pool, starts, sizes):
    """Concatenate pool[start : start + size] for all starts."""
    total = int(sizes.sum())
    step = np.ones(total, np.int64)
    full = np.flatnonzero(sizes)
    s, z = starts[full], sizes[full]
    if total:
        step[0] = s[0]
        step[np.cumsum(z)[:-1]] = s[1:] - (s[:-1] + z[:-1] - 1)
    return pool[np.cumsum(step)] if total else pool[:0], sizes


def _encode_column(codec, decoded: bool):
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([ids.tobytes() for block in chunks(texts) for ids in codec.value.encode(block)], dtype=object)

    def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = [x.tobytes() for block in chunks(texts) for x in codec.value.encode(block)]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.value.decode(np.frombuffer(x, "<u4")) for x in ids]}, dtype=object)

    return F.pandas_udf(round_trip, "ids binary, decoded string") if decoded else F.pandas_udf(encode, "binary")


def _decode_column(strings):
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for packed in batches:
            yield pd.Series([None if x is None else join_tokens(strings.value, np.frombuffer(x, "<u4")) for x in packed], dtype=object)

    return F.pandas_udf(decode, "string")


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """df with each text's token ids as packed little-endian unsigned 32-bit integers (binary) and their number (long).

    decoded_col: also decode the packed ids, in the same Python pass (two passes would hold two workers for each task).
    The file is read on the driver; its tables, bounded by the vocabulary's size, are broadcast. No shuffle. A null or empty
    text has no tokens. Repeated rows and null ids are encoded like others; an empty table gives no rows. Columns of df that
    have the output's names are replaced.
    """
    prepare(df.sparkSession)
    codec = df.sparkSession.sparkContext.broadcast(BpeCodec(vocab_path))
    column = _encode_column(codec, decoded_col is not None)(F.col(text_col).cast("string"))
    out = df.withColumn(ids_col, column)
    if decoded_col is not None:
        out = out.withColumn(decoded_col, F.col(f"{ids_col}.decoded")).withColumn(ids_col, F.col(f"{ids_col}.ids"))
    return out.withColumn(count_col, F.expr(f"cast(octet_length(`{ids_col}`) div 4 as bigint)"))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the decoded text of packed token ids; special tokens are kept, null ids give null, an empty table no rows."""
    prepare(df.sparkSession)
    strings = df.sparkSession.sparkContext.broadcast(BpeCodec(vocab_path).strings)
    return df.withColumn(out_col, _decode_column(strings)(F.col(ids_col)))

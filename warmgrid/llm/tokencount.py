"""Token counts of whole texts under a public piece vocabulary, by array merging.

A text is cut where no vocabulary piece can reach across (before a run of blanks, at line
ends, between a letter and ASCII punctuation), so equal pre-tokens are counted once and remembered. New pre-tokens are laid
end to end as one ragged array of symbols. In each round every sequence finds its
lowest-rank adjacent pair, and all sequences apply theirs at once; a sequence without a
pair leaves the array with the number of its surviving symbols (a symbol outside the
vocabulary counts its UTF-8 bytes).

Within a sequence all occurrences of the round's pair merge together where no better-ranked
piece begins or ends with the merged piece, since then nothing could come between
them; otherwise only the leftmost one merges. Both give the order of the sequential
algorithm (best score first, leftmost on ties).

Defined results: a null text counts as empty and has 0 tokens; equal texts have equal
counts; every row is returned, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.common import bounded

BLANK = "▁"
NONE = np.iinfo(np.int64).max
# a Latin run before an ASCII non-letter stands alone: no piece may hold such a pair (checked on the vocabulary)
PAIR = re.compile(r"[A-Za-zÀ-ɏ][\x00-@\[-`{-\x7f]")
CUTS = re.compile(r"\n| *[A-Za-zÀ-ɏ]+(?=[\x00-@\[-`{-\x7f]|\Z)| *[^ \n]+| +")
MEMO = 1 << 19
LONGEST_KEY = 80
RUN = 16


class PieceMerger:
    """Merge tables of a sentencepiece BPE vocabulary, and the ragged merging itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(m.get_piece_size())]
        pieces = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not special[i]}
        # texts pass unchanged but for blanks and one blank in front; other vocabularies are normalised by their own rules
        self.plain = m.normalize("  ﬁ Ａ  b ") == "▁▁▁ﬁ▁Ａ▁▁b▁"
        self.sound = not any(BLANK in p.lstrip(BLANK) or "\n" in p or PAIR.search(p) for p in pieces)
        score = {p: m.get_score(i) for p, i in pieces.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        self.rank_of = np.full(m.get_piece_size(), NONE >> 1, np.int64)
        keys, merged, bigrams = [], [], set()
        reach: dict[str, int] = {}
        shared = {r for r, n in zip(*np.unique(list(rank.values()), return_counts=True)) if n > 1}
        for p, i in pieces.items():
            self.rank_of[i] = rank[p]
            bigrams.update((ord(a) << 21) | ord(b) for a, b in zip(p, p[1:]))
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                reach[left] = min(reach.get(left, NONE), rank[p])
                reach[right] = min(reach.get(right, NONE), rank[p])
                if left in pieces and right in pieces:
                    keys.append((pieces[left] << 20) | pieces[right])
                    merged.append(i)
        at = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[at], np.array(merged, np.int64)[at]
        self.bigrams = np.array(sorted(bigrams), np.int64)
        self.alone = np.zeros(m.get_piece_size(), bool)
        for p, i in pieces.items():
            self.alone[i] = rank[p] not in shared and reach.get(p, NONE) > rank[p]
        # symbol of a code point: its piece, or minus its number of UTF-8 bytes
        self.symbol = np.full(0x110000, -4, np.int32)
        self.symbol[:0x10000], self.symbol[:0x800], self.symbol[:0x80] = -3, -2, -1
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.memo: dict[str, int] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged piece of each adjacent pair, or -1."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), (left << 20) | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of surviving symbols of each pre-token (blanks already written as the piece blank)."""
        length = np.array([len(t) for t in tokens], np.int64)
        code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.symbol[code].astype(np.int64)
        owner = np.repeat(np.arange(len(tokens)), length)
        total = np.zeros(len(tokens), np.int64)
        if not len(sym):
            return total
        # cut further where no piece holds the two neighbours
        two = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.bigrams, two), len(self.bigrams) - 1)
        joined = (self.bigrams[at] == two) & (owner[:-1] == owner[1:])
        seq = np.concatenate([[0], np.cumsum(~joined)])
        piece = np.full(len(sym), -1, np.int64)
        piece[:-1] = np.where(joined, self.pair(sym[:-1], sym[1:]), -1)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            n = np.diff(np.append(first, len(seq)))
            place = np.arange(len(sym))
            key = np.where(piece >= 0, self.rank_of[piece] * (len(sym) + 1) + place, NONE)
            least = np.minimum.reduceat(key, first)
            done = np.repeat(least == NONE, n)
            if done.any():
                np.add.at(total, owner[done], np.where(sym[done] < 0, -sym[done], 1))
                go = ~done
                sym, seq, owner, piece = sym[go], seq[go], owner[go], piece[go]
                continue
            chosen = np.repeat(least, n)
            hit = key == chosen
            best = chosen % (len(sym) + 1)
            together = self.alone[piece[best]]
            hit |= together & (piece >= 0) & (piece == piece[best])
            # of overlapping neighbours, every second one from the left
            run = hit & ~np.concatenate([[False], hit[:-1]])
            begin = np.maximum.accumulate(np.where(run, place, 0))
            hit &= (place - begin) % 2 == 0
            left = np.flatnonzero(hit)
            sym = sym.copy()
            sym[left] = piece[left]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            where = np.cumsum(keep) - 1
            sym, seq, owner, piece = sym[keep], seq[keep], owner[keep], piece[keep]
            touched = np.zeros(len(sym), bool)
            touched[where[left]] = True
            touched[np.maximum(where[left] - 1, 0)] = True
            fresh = np.flatnonzero(touched)
            right = np.minimum(fresh + 1, len(sym) - 1)
            same = (fresh + 1 < len(sym)) & (seq[fresh] == seq[right])
            piece[fresh] = np.where(same, self.pair(sym[fresh], sym[right]), -1)
        return total

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        memo, cut = self.memo, []
        for t in texts:
            if not t:
                cut.append([])
            elif not self.sound:
                cut.append([self.model.normalize(t)])
            elif self.plain:
                cut.append(CUTS.findall(" " + t.replace(BLANK, " ")))
            else:
                cut.append(CUTS.findall(self.model.normalize(t).replace(BLANK, " ")))
        fresh = {w for words in cut for w in words if w not in memo}
        if fresh:
            new = list(fresh)
            extra = np.zeros(len(new), np.int64)
            written = []
            for i, w in enumerate(new):
                blanks = len(w) - len(w.lstrip(" "))
                if blanks > 4 * RUN:  # the left end of a long run of blanks falls into pieces of RUN blanks
                    extra[i] = (blanks - 3 * RUN) // RUN
                    w = w[extra[i] * RUN :]
                written.append(w.replace(" ", BLANK))
            found = dict(zip(new, (self.count(written) + extra).tolist()))
            look = _Lookup(memo, found)
        else:
            look = memo
        totals = [sum(map(look.__getitem__, words)) for words in cut]
        if fresh:
            if len(memo) + len(found) > MEMO:
                memo.clear()
            memo.update((w, n) for w, n in found.items() if len(w) <= LONGEST_KEY)
        return totals


class _Lookup(dict):
    """The batch's own counts in front of the remembered ones."""

    def __init__(self, memo: dict[str, int], found: dict[str, int]):
        super().__init__(found)
        self.memo = memo

    def __missing__(self, key: str) -> int:
        return self.memo[key]


_MERGERS: dict[str, PieceMerger] = {}


def merger(path: str) -> PieceMerger:
    """One merger for each vocabulary file and Python worker."""
    if path not in _MERGERS:
        _MERGERS[path] = PieceMerger(path)
    return _MERGERS[path]


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text; the vocabulary is resolved on each executor."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(public_vocabulary(vocabulary))
        for b in bounded(batches):
            n = m.lengths(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(apply, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

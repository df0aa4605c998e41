"""Encoder for byte-level vocabularies in the ``tokenizers`` JSON format that
applies the merges of all distinct pieces of a slice together, round by
round.  Pieces of up to 32 bytes are rows of matrices, in which each round
merges the first-ranked pair of every row; in longer ones a round merges all
places of the first-ranked pair of a piece.

Ids equal ``Tokenizer.encode(text, add_special_tokens=False)``.  A text that
holds the string of an added token is given to the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mercato.llm.bpe import SPACE_PATTERN, Bpe, ragged

#: Rank of a pair that is not merged.
NEVER = np.int32(2**31 - 1)
#: Widths of the matrices of short pieces.
WIDTHS = (4, 7, 10, 14, 20, 32)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible
    Latin-1 characters for themselves, the others counted on from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeEncoder(Bpe):
    """Encoder for one ``tokenizers`` JSON file (byte-level, usual pattern)."""

    def __init__(self, spec: bytes):
        parsed = json.loads(spec)
        before, model = parsed["pre_tokenizer"] or {}, parsed["model"]
        if (parsed["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
                or not before.get("use_regex") or model["type"] != "BPE" or model.get("ignore_merges")):
            raise ValueError("not a plain byte-level vocabulary")
        letters, added = byte_letters(), {t["content"]: t["id"] for t in parsed["added_tokens"]}
        ids = model["vocab"]
        self._load({bytes(letters[c] for c in token): i for token, i in ids.items() if token not in added}, SPACE_PATTERN)
        self.spec, self.added = spec.decode(), sorted(added)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        # open addressing: a free slot ends the search
        self.slots = 1 << max(4, int(4 * len(pairs)).bit_length())
        self.keys, self.rank_of = np.full(self.slots, -1, np.int64), np.full(self.slots, NEVER, np.int32)
        keys, waiting = left * self.wide + right, np.arange(len(pairs))
        slot = self._slot(keys)
        while len(waiting):
            free = self.keys[slot[waiting]] == -1
            first = waiting[free][np.unique(slot[waiting[free]], return_index=True)[1]]
            self.keys[slot[first]], self.rank_of[slot[first]] = keys[first], first
            waiting = np.setdiff1d(waiting, first)
            slot[waiting] = (slot[waiting] + 1) & (self.slots - 1)
        every = np.arange(1 << 16)
        self.byte_ranks = self._ranks(self.single[every >> 8], self.single[every & 255])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.wide + right
        slot = self._slot(keys)
        out = self.rank_of[slot]
        there = self.keys[slot]
        other = np.flatnonzero((there != keys) & (there != -1))
        out[there != keys] = NEVER
        while len(other):
            slot[other] = (slot[other] + 1) & (self.slots - 1)
            there = self.keys[slot[other]]
            hit = there == keys[other]
            out[other[hit]] = self.rank_of[slot[other[hit]]]
            other = other[~hit & (there != -1)]
        return out

    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.full(len(data), -1, np.int32)  # at the start of a piece its ids, as many as there are
        sizes = np.diff(np.append(starts, len(data)))
        first = self.single[data]
        follow = np.full(len(data), NEVER, np.int32)
        follow[:-1] = self.byte_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
        group = np.searchsorted(WIDTHS, sizes)
        for k, width in enumerate(WIDTHS):
            rows = np.flatnonzero(group == k)
            if len(rows):
                self._short(out, first, follow, starts[rows], sizes[rows], width)
        rows = np.flatnonzero(group == len(WIDTHS))
        if len(rows):
            at = ragged(np.arange(len(data)), starts[rows], sizes[rows])
            own = np.cumsum(sizes[rows]) - sizes[rows]
            out[at] = self._long(data[at], own)
        places = np.flatnonzero(out >= 0)
        return out[places].astype(np.int64), np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(starts))

    def _short(self, out: np.ndarray, first: np.ndarray, follow: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
               width: int) -> None:
        column = np.arange(width, dtype=np.int32)
        at = np.minimum(starts[:, None] + column, len(first) - 1)
        ids, rank = first[at], follow[at]
        ids[column >= sizes[:, None]] = -1
        rank[column >= sizes[:, None] - 1] = NEVER
        while True:
            j = rank.argmin(axis=1)
            row = np.arange(len(j))
            best = rank[row, j]
            done = best == NEVER
            if done.any():
                r, c = np.nonzero(ids[done] >= 0)
                out[starts[done][r] + c] = ids[done][r, c]
                if done.all():
                    return
                ids, rank, starts, j, best = ids[~done], rank[~done], starts[~done], j[~done], best[~done]
                row = row[:len(j)]
            new = self.made[best]
            shift = column[:-1] > j[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=shift)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=shift)
            ids[:, -1], rank[:, -1] = -1, NEVER
            ids[row, j] = new
            right = ids[row, j + 1]
            rank[row, j] = np.where(right < 0, NEVER, self._ranks(new, right))
            r = np.flatnonzero(j > 0)
            rank[r, j[r] - 1] = self._ranks(ids[r, j[r] - 1], new[r])

    def _long(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.full(len(data), -1, np.int32)
        ids, place = self.single[data], np.arange(len(data), dtype=np.int32)
        heads = starts.copy()  # where each open piece begins
        rank = np.full(len(data), NEVER, np.int32)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[np.append(heads[1:], len(data)) - 1] = NEVER
        while len(ids):
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(ids)))
            going = best < NEVER
            merge = rank == np.repeat(np.where(going, best, -1), sizes)
            at = np.flatnonzero(merge)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of a row of equal symbols every other pair
                fresh = np.append(True, np.diff(at) != 1)
                run = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            open_ = np.repeat(going, sizes)
            out[place[~open_]] = ids[~open_]
            ids[at] = self.made[rank[at]]
            keep = open_
            keep[at + 1] = False
            lost = np.add.reduceat(keep, heads, dtype=np.int64)[going]
            moved = np.cumsum(keep)[at] - 1
            ids, place, rank = ids[keep], place[keep], rank[keep]
            heads = np.cumsum(lost) - lost
            if not len(ids):
                break
            # pairs of a merged symbol with its neighbours
            last = np.zeros(len(ids), bool)
            last[np.append(heads[1:], len(ids)) - 1] = True
            ask = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            ask = ask[~last[ask]]
            rank[ask] = self._ranks(ids[ask], ids[ask + 1])
            rank[last] = NEVER
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, at = super().encode_column(texts)
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not special.any():
            return ids, at
        from tokenizers import Tokenizer

        library, sizes, begin = Tokenizer.from_str(self.spec), np.diff(at), at[:-1].copy()
        pool = [ids]
        for k in np.flatnonzero(special).tolist():
            own = np.array(library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            begin[k], sizes[k] = sum(map(len, pool)), len(own)
            pool.append(own)
        return ragged(np.concatenate(pool), begin, sizes), np.append(0, np.cumsum(sizes))

"""Byte-level BPE encoding and decoding.

The token strings, bytes read as Latin-1, form an Aho-Corasick automaton.
A piece is encoded left to right with the longest token at each place; a
token may follow another only if merging the two token strings together
would give exactly these two tokens, a test that is memoised per pair.  When
the longest token does not fit, shorter ones are tried, then the previous
token is taken back; places that cannot be completed are remembered, so each
place is left at most once and the work is linear in the piece.  The result
equals applying the merges in rank order.  Texts are cut at single spaces
and equal pieces of a slice are encoded once, all of them together in array
steps; only the memory of pairs, of a fixed size, outlives a slice.

Empty and NULL texts give no ids.  Ids outside the vocabulary cannot be
decoded and raise.  Every step is per row, so repeated rows, ties and extra
columns need no special care.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from mercato.llm.common import append_columns, read_table, text_buffer

#: Slots of a worker's memory of token pairs; a pair that falls on a taken slot replaces what is there.
MEMO_PAIRS = 1 << 20
#: Bytes of a rank file that is sent to the tasks; a larger one raises, as it would not fit beside the data.
MAX_RANK_BYTES = 64 << 20
#: FIXED VALUE: the split pattern whose matches start at every space between two other characters.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A character outside Latin-1, which no token holds: it parts pieces in one run of the automaton.
PART = "\u0100"


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def spaced_chunks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where chunks of texts begin: at each text, and at each space
    that stands between two characters that are surely no white space."""
    n = len(data)
    space = np.flatnonzero(data == 0x20)
    space = space[(space > 0) & (space < n - 1)]
    before, after = data[space - 1], data[space + 1]
    plain = (before > 0x20) & (after > 0x20) & (before != 0x7F) & (after != 0x7F)
    # white space beyond ASCII has one of these lead bytes; where one is near, the text is not cut
    lead = np.zeros(256, bool)
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    plain &= ~lead[after]
    plain &= ~((before >= 0x80) & (lead[data[np.maximum(space - 2, 0)]] | lead[data[np.maximum(space - 3, 0)]]))
    mark = np.zeros(n + 1, bool)
    mark[space[plain]] = True
    mark[offsets] = True
    mark[n] = False
    return np.flatnonzero(mark)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` at ``starts``, one after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return values[at]


def value_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large binary values and the n + 1 places where they begin."""
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The stretches of ``data`` from each start to the next as binary values."""
    ends = pa.py_buffer(np.append(starts, len(data)))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(data))])


def _byte_kinds() -> np.ndarray:
    """1 letter, 2 digit, 3 other visible ASCII, 0 what the pattern has to decide.  The lead bytes C4, C5, D0
    and D1 stand for letters only; a byte after a lead byte counts as it."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = 3
    kinds[0x30:0x3A] = 2
    kinds[0x41:0x5B] = kinds[0x61:0x7B] = 1
    kinds[0x27] = 0  # an apostrophe may begin a suffix of the pattern
    kinds[0x80:0xC0] = kinds[[0xC4, 0xC5, 0xD0, 0xD1]] = 1
    kinds[0xC3] = 1  # but for two signs, see simple_pieces
    return kinds


BYTE_KINDS = _byte_kinds()


def simple_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks where a piece begins, chunks that the pattern itself must split).

    For the usual pattern: in a chunk of letters, digits and signs, after one
    space at most, the pieces are the runs of one kind, the first of them
    with the space."""
    kinds = BYTE_KINDS[data]
    bad = kinds == 0
    space = starts[data[starts] == 0x20]
    bad[space] = False
    sign = np.flatnonzero(data[:-1] == 0xC3)  # U+00D7 and U+00F7 are no letters
    bad[sign] |= (data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)
    head = np.ones(len(data), bool)
    head[1:] = kinds[1:] != kinds[:-1]
    head[starts] = True
    after = space + 1
    inside = np.zeros(len(data), bool)
    inside[starts] = True
    head[after[after < len(data)]] &= inside[after[after < len(data)]]
    return head, np.unique(np.searchsorted(starts, np.flatnonzero(bad), "right") - 1)


class Bpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._load(ranks, pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # filled when first asked for (-2): the two tokens a token was merged from, its longest proper prefix
        self.left_part = np.full(self.wide, -2, np.int64)
        self.right_part = np.full(self.wide, -2, np.int64)
        self.prefix = np.full(self.wide, -2, np.int64)
        self.memo_keys = np.full(MEMO_PAIRS, -1, np.int64)
        self.memo_fits = np.zeros(MEMO_PAIRS, bool)

    def _load(self, ranks: dict[bytes, int], pattern: str) -> None:
        """What every encoder of a byte-level vocabulary needs."""
        self.ranks = ranks
        self.words: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.words[rank] = token
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == SPACE_PATTERN
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.sizes = np.array([len(w or b"") for w in self.words], np.int64)
        self.bytes_of = np.frombuffer(b"".join(w or b"" for w in self.words), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.wide = len(self.words)
        joins = sorted((self.ranks[w[:k]] * self.wide + self.ranks[w[k:]], r) for w, r in self.ranks.items()
                       for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks)
        #: pairs of tokens whose strings together are a token, and that token
        self.joins = np.array([k for k, _ in joins] + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([r for _, r in joins] + [0], np.int64)

    # -- merges of one token string -----------------------------------------
    def _know_parts(self, tokens: np.ndarray) -> None:
        for token in np.unique(tokens[self.left_part[tokens] == -2]).tolist():
            word = self.words[token]
            self.left_part[token], self.right_part[token] = self._last_merge(word) if len(word) > 1 else (-1, -1)

    def _last_merge(self, word: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes the token ``word``."""
        symbols = [word[i:i + 1] for i in range(len(word))]
        limit = self.ranks[word]
        while len(symbols) > 2:
            options = [(self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            rank, i = min(options)
            if rank >= limit:
                raise ValueError("a token is not the result of merges")
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return self.ranks[symbols[0]], self.ranks[symbols[1]]

    def _shorter(self, tokens: np.ndarray) -> np.ndarray:
        """The longest token that is a proper prefix of each token; -1 if none."""
        for token in np.unique(tokens[self.prefix[tokens] == -2]).tolist():
            word = self.words[token]
            self.prefix[token] = next((self.ranks[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.ranks), -1)
        return self.prefix[tokens]

    def _pairs_fit(self, keys: np.ndarray) -> np.ndarray:
        """Whether the merges of the joined string of two tokens end in just
        these two: no merge across their border comes before the merges that
        make them."""
        a, b = keys // self.wide, keys % self.wide
        limit = np.full(len(keys), 1 << 62, np.int64)
        verdict = np.ones(len(keys), bool)
        live = np.arange(len(keys))
        while len(live):
            x, y = a[live], b[live]
            pair = x * self.wide + y
            at = np.searchsorted(self.joins, pair)
            across = (self.joins[at] == pair) & (self.joined[at] < limit[live])
            verdict[live[across]] = False
            live, x, y = live[~across], x[~across], y[~across]
            self._know_parts(x)
            self._know_parts(y)
            # undo the later of the two merges that stand at the border; a token of one byte has none
            inner_x, inner_y = self.right_part[x], self.left_part[y]
            from_left = (x > y) & (inner_x >= 0) | (inner_y < 0)
            ends = (inner_x < 0) & (inner_y < 0)
            limit[live] = np.where(from_left, x, y + 1)
            a[live] = np.where(from_left & ~ends, inner_x, x)
            b[live] = np.where(from_left, y, inner_y)
            live = live[~ends]
        return verdict

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Memoised test of neighbouring tokens."""
        keys = left * self.wide + right
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) % len(self.memo_keys)
        out = self.memo_fits[slot]
        new = np.flatnonzero(self.memo_keys[slot] != keys)
        if len(new):
            asked, which = np.unique(keys[new], return_inverse=True)
            told = self._pairs_fit(asked)
            out[new] = told[which]
            first = np.zeros(len(asked), np.int64)
            first[which] = slot[new]
            self.memo_keys[first] = asked
            self.memo_fits[first] = told[np.searchsorted(asked, self.memo_keys[first])]
        return out

    # -- encoding -------------------------------------------------------------
    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has.

        One run of the automaton gives the longest tokens from the left.  Up
        to the first two neighbours that do not fit they stay; from there all
        pieces are backtracked together, one token tried in each at a time.
        """
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(data)))
        starts = starts + np.arange(n)  # a separator after each piece
        ends = starts + sizes
        letters = np.full(len(data) + n, ord(PART), np.uint16)
        mark = np.ones(len(letters), bool)
        mark[ends] = False
        letters[mark] = data
        text = letters.tobytes().decode("utf-16-le")
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        tokens = found[:, 1]
        at = found[:, 0] + 1 - self.sizes[tokens]  # where each token begins
        owner = np.searchsorted(starts, at, "right") - 1
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = inner[~self.fits(tokens[inner], tokens[inner + 1])] + 1  # tokens that do not fit after their left one
        chosen = np.full(len(letters) + 1, -1, np.int64)  # the token that begins at each place
        chosen[at] = tokens
        pieces, first = np.unique(owner[wrong], return_index=True)
        if len(pieces):
            self._backtrack(text, starts[pieces], ends[pieces], at, tokens, wrong[first], chosen)
        places = np.flatnonzero(chosen >= 0)
        return chosen[places], np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=n)

    def _backtrack(self, text: str, starts: np.ndarray, ends: np.ndarray, greedy_at: np.ndarray, greedy: np.ndarray,
                   wrong: np.ndarray, chosen: np.ndarray) -> None:
        """Replace in ``chosen`` the tokens of the pieces at ``starts``, whose
        token number ``wrong`` is the first that does not fit."""
        before = np.full(len(chosen), -1, np.int64)  # the token that ends at each place, on the way taken
        before[greedy_at + self.sizes[greedy]] = greedy
        before[starts] = -1
        longest = chosen.copy()  # the longest token from each place; -1 where not yet known
        dead = np.zeros(len(chosen), bool)  # places that cannot be completed
        at, token = greedy_at[wrong], self._shorter(greedy[wrong])
        reach = int(self.sizes.max())
        live = np.arange(len(starts))
        while len(live):
            place, option = at[live], token[live]
            left = before[place]
            good = option >= 0
            good[good] = ~dead[place[good] + self.sizes[option[good]]]
            check = np.flatnonzero(good & (left >= 0))
            good[check] = self.fits(left[check], option[check])
            # a token that fits is taken, and the longest one tried behind it
            q = live[good]
            to = place[good] + self.sizes[option[good]]
            before[to] = option[good]
            at[q] = to
            more = to < ends[q]
            q, to = q[more], to[more]
            for k in np.unique(to[longest[to] < 0]).tolist():
                longest[k] = next(self.automaton.iter_long(text[k:k + reach]))[1]
            token[q] = longest[to]
            # else a shorter one is tried; if there is none, the place is dead and the last token is taken back
            tried = ~good & (option >= 0)
            token[live[tried]] = self._shorter(option[tried])
            q, to = live[option < 0], place[option < 0]
            last = before[to]
            if (last < 0).any():
                raise ValueError("the merges make no token sequence")
            dead[to] = True
            at[q] = to - self.sizes[last]
            token[q] = self._shorter(last)
            live = live[at[live] < ends[live]]
        inside = np.zeros(len(chosen) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        chosen[np.cumsum(inside[:-1]) > 0] = -1
        live = np.arange(len(starts))
        while len(live):
            last = before[at[live]]
            at[live] -= self.sizes[last]
            chosen[at[live]] = last
            live = live[at[live] > starts[live]]

    def _encode_chunks(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each has, each match of the pattern by itself."""
        if self.by_space:
            head, hard = simple_pieces(data, starts)
        else:
            head, hard = np.zeros(len(data), bool), np.arange(len(starts))
        ends, owners, split = np.append(starts, len(data)), [], []
        for k in hard.tolist():
            found = self.split(data[ends[k]:ends[k + 1]].tobytes().decode("utf-8"))
            split += [m.encode("utf-8") for m in found]
            owners += [k] * len(found)
        head[starts] = True
        heads = np.flatnonzero(head)
        owner = np.searchsorted(starts, heads, "right") - 1
        easy = np.ones(len(starts), bool)
        easy[hard] = False
        easy = easy[owner]
        pieces = pa.concat_arrays([binaries(data, heads).filter(pa.array(easy)), pa.array(split, pa.large_binary())])
        owner = np.append(owner[easy], np.array(owners, np.int64))
        coded = pieces.dictionary_encode()
        letters, bounds = value_buffer(coded.dictionary)
        ids, counts = self._encode_pieces(letters, bounds[:-1])
        order = np.argsort(owner, kind="stable")
        which = coded.indices.to_numpy(zero_copy_only=False)[order]
        first = np.cumsum(counts) - counts
        per_chunk = np.bincount(owner[order], weights=counts[which], minlength=len(starts)).astype(np.int64)
        return ragged(ids, first[which], counts[which]), per_chunk

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another as unsigned 32-bit integers, and
        the n + 1 places where each text's ids begin (NULL: no ids).

        With the usual pattern a match always starts at a single space that
        stands between two other characters, so the texts are cut there first
        and each distinct chunk, and of these each distinct piece, is encoded once.
        """
        data, offsets = text_buffer(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begins = spaced_chunks(data, offsets) if self.by_space else np.unique(offsets[:-1][np.diff(offsets) > 0])
        coded = binaries(data, begins).dictionary_encode()
        letters, bounds = value_buffer(coded.dictionary)
        ids, sizes = self._encode_chunks(letters, bounds[:-1])
        which = coded.indices.to_numpy(zero_copy_only=False)
        sent = sizes[which]
        total = np.append(0, np.cumsum(sent))
        return ragged(ids.astype(np.uint32), (np.cumsum(sizes) - sizes)[which], sent), total[np.searchsorted(begins, offsets, "left")]

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        wanted = np.frombuffer(ids, "<u4")
        if len(wanted) and (int(wanted.max()) >= len(self.words) or not self.sizes[wanted].all()):
            raise ValueError("an id is not in the vocabulary")
        return ragged(self.bytes_of, self.begins[wanted], self.sizes[wanted]).tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_bytes(pack(ids))


_LOADED: dict[tuple[str, str], Bpe] = {}


def _bpe(rank_file: bytes, pattern: str) -> Bpe:
    """One encoder per Python worker and vocabulary."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(rank_file, pattern)
    return _LOADED[key]


def texts_ids(bpe: Bpe, texts: pa.Array) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    ids, at = bpe.encode_column(texts)
    raw, at = ids.astype("<u4", copy=False).tobytes(), (at * 4).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError("the rank file is larger than MAX_RANK_BYTES")
    return data


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with a binary column of ids, little-endian unsigned 32-bit."""
    sent = df.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))

    def factory():
        bpe = _bpe(sent.value, pattern)
        return lambda texts: [pa.array(texts_ids(bpe, texts), pa.binary())]

    return append_columns(df, text_col, [StructField(to, BinaryType())], factory)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes of a column that ``encode`` made (NULL: empty)."""
    sent = df.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))
    base = df.drop(to)
    names = base.columns
    at = names.index(ids_col)
    schema = StructType([*base.schema.fields, StructField(to, BinaryType())])

    def run(batches):
        bpe = _bpe(sent.value, pattern)
        for batch in batches:
            made = [bpe.decode_bytes(i or b"") for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*names, to])

    return base.mapInArrow(run, schema)


def round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256: encodes each text,
    decodes the ids again, and keeps digests of both."""
    sent = df.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))

    def factory():
        bpe = _bpe(sent.value, pattern)
        digest = hashlib.sha256

        def made(texts):
            counts, ids, decoded = [], [], []
            for i in texts_ids(bpe, texts):
                counts.append(len(i) // 4)
                ids.append(digest(i).hexdigest())
                decoded.append(digest(bpe.decode_bytes(i)).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

        return made

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
              StructField("decoded_sha256", StringType())]
    return append_columns(df, text_col, fields, factory)


def vocabulary() -> tuple[str, str]:
    """Path and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digest_table(docs: DataFrame) -> DataFrame:
    path, pattern = vocabulary()
    return round_trip(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_table(read_table(spark, sf_dir, "documents"))

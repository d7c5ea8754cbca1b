"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has one valid encoding, so one valid last token. The table of last tokens, one entry a
byte, is enough: entry i is the token that ends at byte i and may follow the entry before its first byte. The
encoding is read backwards. Appending bytes extends the table, and an edit recomputes it only from the edit to where
the old and new tables agree again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sigloom.llm.common import map_columns, table

#: Pieces remembered per Python worker; beyond it the memory is emptied, so it stays bounded.
MEMO = 200_000
SHORT = (3, 2, 1)


class Vocabulary:
    """Ranks of a byte-level BPE: rank order is merge order, and every single byte has a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.width = max(self.tokens).bit_length()
        self.halves = {token: self._halves(token) for token in self.tokens}
        #: Tokens that merging makes from their bytes; others can only stand for a whole piece.
        self.made = {t: r for t, r in ranks.items() if len(t) == 1 or self.halves[r]}
        #: Lengths of the tokens that end in given three bytes, longest first; shorter tokens may always end there.
        self.tails: dict[bytes, tuple[int, ...]] = {}
        for t in self.made:
            if len(t) > 3:
                self.tails[t[-3:]] = (*self.tails.get(t[-3:], ()), len(t))
        self.tails = {t: (*sorted(set(n), reverse=True), *SHORT) for t, n in self.tails.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for tokens merging never makes."""
        whole, get = self.tokens[token], self.ranks.get
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            merged = [get(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
            rank = min(merged)
            if rank >= token:
                return None
            best = merged.index(rank)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Undoes the merges at the border from the latest back. The pair is wrong if at some moment the two pieces
        that touch the border could have merged before the merge just undone.
        """
        get, tokens, halves = self.ranks.get, self.tokens, self.halves
        before = 1 << 60  # a merge across the border has to come before this moment
        while True:
            if get(tokens[left] + tokens[right], 1 << 60) < before:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]  # of equal ranks, the merge further left comes first

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Adds the entries for the prefixes of ``data`` that ``last`` lacks, as far as length ``upto``."""
        get, pairs, width, tails = self.made.get, self.pairs, self.width, self.tails
        for end in range(len(last) + 1, upto + 1):
            for length in tails.get(data[end - 3 : end], SHORT) if end > 3 else SHORT[-end:]:
                start = end - length
                if start < 0:
                    continue
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    key = last[start - 1] << width | token
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) > 4 * MEMO:
                            pairs.clear()
                        good = pairs[key] = self.follows(last[start - 1], token)
                    if good:
                        break
            else:
                raise ValueError("a byte has no token")
            last.append(token)


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Exact: earlier entries don't depend on what follows."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))
        return self

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Puts ``by`` in place of bytes start:end. Returns how many entries were computed again.

        An entry depends on the bytes of its token and the entry before them, no further back than the longest
        token. So once as many entries in a row agree with the old table, all later ones do.
        """
        data, last = self.data[:start] + by + self.data[end:], self.last[:start]
        shift, same, done = len(by) - (end - start), 0, 0
        for at in range(start + 1, len(data) + 1):
            self.vocabulary.extend(data, last, at)
            done += 1
            same = same + 1 if at > start + len(by) and self.last[at - shift - 1] == last[-1] else 0
            if same >= self.vocabulary.longest and at - same >= start + len(by):
                last += self.last[at - shift :]
                break
        self.data, self.last = data, last
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


def encode_piece(v: Vocabulary, data: bytes) -> tuple[int, ...]:
    """The encoding of one piece. Pieces of ordinary length share one table, keyed by the prefix itself."""
    whole = v.ranks.get(data)  # a piece that is a token is that token, even if merging wouldn't make it
    if whole is not None:
        return (whole,)
    if len(data) > 64:
        return tuple(PrefixTable(v, data).tokens())
    known = v.prefixes
    if len(known) >= 4 * MEMO:
        known.clear()
    end = len(data)
    while end and data[:end] not in known:
        end -= 1
    get, pairs, width, tails = v.made.get, v.pairs, v.width, v.tails
    for end in range(end + 1, len(data) + 1):
        for length in tails.get(data[end - 3 : end], SHORT) if end > 3 else SHORT[-end:]:
            start = end - length
            if start < 0:
                continue
            token = get(data[start:end])
            if token is not None:
                if not start:
                    break
                before = known[data[:start]]
                good = pairs.get(before << width | token)
                if good is None:
                    if len(pairs) > 4 * MEMO:
                        pairs.clear()
                    good = pairs[before << width | token] = v.follows(before, token)
                if good:
                    break
        else:
            raise ValueError("a byte has no token")
        known[data[:end]] = token
    out, sizes = [], v.sizes
    end = len(data)
    while end:
        out.append(known[data[:end]])
        end -= sizes[out[-1]]
    return tuple(out[::-1])


def encode(v: Vocabulary, pattern: regex.Pattern, text: str) -> list[int]:
    """Token ids of a whole text, each match of the pattern by itself."""
    out: list[int] = []
    memo, add = v.pieces, out.extend
    for piece in pattern.findall(text):
        ids = memo.get(piece)
        if ids is None:
            ids = encode_piece(v, piece.encode("utf-8", "replace"))
            if len(piece) <= 64:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[piece] = ids
        add(ids)
    return out


def decode(v: Vocabulary, ids: list[int]) -> bytes:
    return b"".join(map(v.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A vocabulary from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def add_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text", keep: list[str] = ("doc_id",),
    with_ids: bool = False,
) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every whole text; ``with_ids`` adds the ids.

    ``vocabulary`` names a file of the installed tokenizer package, looked up on the executor. Null and empty texts
    have no token. Repeated rows come out as often as they came in; an empty table gives an empty result.
    """

    def make():
        import public_tokenizers

        v, pattern = load(public_tokenizers.path(vocabulary)), regex.compile(public_tokenizers.PATTERN)
        digits = [str(i) for i in range(max(v.tokens) + 1)]

        def run(texts):
            counts, ids_hex, decoded_hex, ids_out = [], [], [], []
            for t in texts:
                ids = encode(v, pattern, t or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded_hex.append(hashlib.sha256(decode(v, ids)).hexdigest())
                if with_ids:
                    ids_out.append(ids)
            return [counts, ids_hex, decoded_hex, *([ids_out] if with_ids else [])]

        return run

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], f"{ddl}, ids array<int>"
    return map_columns(docs, [text], make, pa.schema(fields), ddl, keep)


def op3_bpe(spark, sf_dir):
    return add_tokens(table(spark, sf_dir, "documents"))

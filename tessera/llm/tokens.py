"""Token counts and ids through a worker's cache of pre-tokens.

A byte-level or word-level BPE encodes each pre-token on its own, so the ids of
a text are the ids of its pre-tokens one after another.  ``PieceEncoder`` looks
up whole white-space separated pieces first, then the pre-tokens of a piece it
has not seen, and asks the tokenizers library only for pre-tokens that are new.
Texts for which that split isn't certain (special token strings, unknown kinds
of tokenizer) go to the library whole.

A pre-token is encoded by merging neighbours in the order of the merges' ranks.
Where the vocabulary allows it (see ``merges_by_rank``) tiktoken's merge loop does
that, else the library's own model; both give the same ids.

``token_counts`` counts in two tiers.  A bounded table with the lengths of
frequent pre-tokens is broadcast, looked up first and never changed; misses go
to a cache of the worker, which is filled by encoding and emptied when full.  No
pre-token is ever shuffled.  The table only saves time: its contents don't affect
any result, so it is taken from a bounded sample of rows.
"""

from __future__ import annotations

import json
import os
import struct
from array import array
from collections import Counter
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's cache, and their bytes (about); a full cache is emptied.
CACHE_ENTRIES, CACHE_BYTES = 1_200_000, 320 << 20
#: Pieces of more characters aren't kept: in texts without blanks every stretch between two signs would be one.
LONGEST_KEPT = 64
#: Rows that the table of frequent pre-tokens is taken from, their characters at most, and its entries.
SAMPLE_ROWS, SAMPLE_CHARS, FREQUENT = 2_000, 8_000, 20_000
#: A row is in the sample where the hash of its text is a multiple of this, so that it spreads over more of the table.
SAMPLE_EVERY = 16

# The public patterns of the two kinds of pre-tokenizer, and Unicode's White_Space characters.
GLUED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GLUED_QUICKLY = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"  # the same pieces, without going back
DROPPED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _compiled(pattern: str):
    """With the library's idea of white space, which leaves out some of Python's."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


_GLUED, _DROPPED = _compiled(GLUED_PATTERN), _compiled(DROPPED_PATTERN)
_GLUED_PIECES = regex.compile(rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
_DROPPED_PIECES = regex.compile(rf"[^{WHITE_SPACE}]+")


#: Latin letters before this are their own normal form (the marks that combine with them come later), and
#: have one lower-case letter each, but for the one after.
_PLAIN_END, _DOTTED_I = "\u0250", "\u0130"


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level models write for each byte: itself where it prints, else from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else array("I", ids).tobytes()


class _Tier(dict):
    """Value of each piece: first of the fixed entries, then of the cache; a piece that is in neither is split, looked up and kept.

    Without fixed entries the cache is the dictionary itself.
    """

    def __init__(self, split, encode):
        super().__init__()
        self._split, self._encode, self.cache, self.held = split, encode, self, 0

    def fix(self, entries: dict) -> None:
        """Give the first tier its entries; from now on the cache stands apart."""
        self.clear()
        self.update(entries)
        self.cache, self.held = {}, 0

    def __missing__(self, piece):
        if self.cache is not self and (value := self.cache.get(piece)) is not None:
            return value
        value = self._split(piece)
        if value is None:
            value = self._encode(piece)
        if len(piece) <= LONGEST_KEPT:
            self.cache[piece] = value
            self.held += 160 + (len(piece) if piece.isascii() else 4 * len(piece)) + (len(value) if isinstance(value, bytes) else 0)
        return value

    def forget(self) -> None:
        self.cache.clear()
        self.held = 0


def _model_of(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]


@cache
def merges_by_rank(path: str) -> bool:
    """Whether tiktoken's merge loop gives the ids of the library's model for every pre-token.

    That loop joins two neighbours wherever their bytes make a known token, the
    library only where they are a listed merge.  Both are one if every token
    encodes to itself under the merges alone: were a token ever joined from
    another pair of neighbours, its own encoding would have come to that pair too
    and stopped there.  This is checked for the whole vocabulary, once, on the
    driver.
    """
    from tokenizers.models import BPE

    model = _model_of(path)
    vocab, letters = model["vocab"], {chr(x) for x in _byte_letters().values()}
    suffix = model.get("end_of_word_suffix") or ""
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) or suffix not in ("", "</w>"):
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(x + y, -1) for x, y in pairs]
    single = letters | {x + suffix for x in letters}
    if not made or not single <= set(vocab) or made != sorted(set(made)) or made[0] <= max(vocab[x] for x in single):
        return False  # ranks aren't in the order of the merges
    if set(vocab) - single != {x + y for x, y in pairs}:
        return False
    inner = BPE(vocab=vocab, merges=pairs)
    ending = BPE(vocab=vocab, merges=pairs, end_of_word_suffix=suffix) if suffix else inner
    for x, y in pairs:
        ends = bool(suffix) and y.endswith(suffix)
        found = (ending if ends else inner).tokenize((x + y).removesuffix(suffix) if ends else x + y)
        if len(found) != 1 or found[0].id != vocab[x + y]:
            return False
    return True


def _ranked(model: dict, pattern: str):
    """tiktoken's encoding with the model's tokens as ranks.

    The mark of a word's end is a byte that UTF-8 doesn't have; its joins come first.
    """
    import tiktoken

    letters, suffix, ranks = {chr(v): k for k, v in _byte_letters().items()}, model.get("end_of_word_suffix") or "", {}
    for token, number in model["vocab"].items():
        ends = bool(suffix) and token.endswith(suffix)
        ranks[bytes(letters[c] for c in (token.removesuffix(suffix) if ends else token)) + (b"\xff" if ends else b"")] = number
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """Encodes whole texts; ``count`` gives lengths, ``ids`` little-endian unsigned 32-bit ids.

    ``by_rank`` is ``merges_by_rank(path)``, which the driver finds out for its tasks.
    """

    def __init__(self, path: str, *, lengths_only: bool = False, entries: int = CACHE_ENTRIES, by_rank: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.entries, self.lengths_only = entries, lengths_only
        self._sum = sum if lengths_only else b"".join
        pre = spec.get("pre_tokenizer") or {}
        glued = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        steps = pre.get("pretokenizers", [])
        dropped = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("pattern", {}).get("Regex") == DROPPED_PATTERN
        self.kind = "glued" if glued else "dropped" if dropped else "whole"
        split_head, split_tail = (self._head_pieces, self._tail_pieces) if glued else (self._dropped_pieces, None)
        self.head = _Tier(split_head, self.encode_whole)
        self.tail = _Tier(split_tail, lambda piece: self.encode_whole(" " + piece)) if glued else None
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.fixed = self.merge = self.quick = None
        if by_rank and self.kind != "whole":
            ranked = _ranked(spec["model"], GLUED_QUICKLY if glued else ".")
            merge = ranked._core_bpe.encode_single_piece
            self.merge = merge if glued else lambda raw: merge(raw + b"\xff")
            self.quick = ranked if glued else None

    def fix(self, entries: list[tuple[bool, str, int]]) -> None:
        """The first tier: (has a blank before it, piece, value) of frequent pieces."""
        self.fixed = entries
        self.head.fix({x: n for tail, x, n in entries if not tail})
        if self.tail is not None:
            self.tail.fix({x: n for tail, x, n in entries if tail})

    def encode_whole(self, text: str):
        if self.quick is not None and not any(x in text for x in self.special):
            found = self.quick.encode_to_numpy(text, disallowed_special=())
            return len(found) if self.lengths_only else found.tobytes()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids) if self.lengths_only else array("I", ids).tobytes()

    def _encode_part(self, part: str):
        """A single pre-token, handed to the merges past the pre-tokenizer."""
        if self.merge is not None:
            found = self.merge(part.encode("utf-8", "surrogatepass"))
            return len(found) if self.lengths_only else _packed(found)
        found = self.model.tokenize(part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))
        return len(found) if self.lengths_only else array("I", [x.id for x in found]).tobytes()

    def _head_pieces(self, piece: str):
        if not piece.isascii() and max(piece) >= _PLAIN_END:
            return None  # what is a letter there depends on the library's version of Unicode
        parts = _GLUED.findall(piece)
        return self._sum([self.head[x] for x in parts]) if len(parts) > 1 else self._encode_part(piece)

    def _tail_pieces(self, piece: str):
        if not piece.isascii() and max(piece) >= _PLAIN_END:
            return None
        if piece.isalpha():
            return self._encode_part(" " + piece)
        if piece[:-1].isalpha():  # a word and one sign that isn't a letter
            return self._sum([self.tail[piece[:-1]], self.head[piece[-1]]])
        parts = _GLUED.findall(" " + piece)
        if len(parts) == 1:
            return self._encode_part(" " + piece)
        if parts[0][:1] != " " or parts[0] == " ":
            return None
        return self._sum([self.tail[parts[0][1:]], *[self.head[x] for x in parts[1:]]])

    def _dropped_pieces(self, piece: str):
        if not piece.isascii() and (max(piece) >= _PLAIN_END or _DOTTED_I in piece):
            return None  # its normal form and lower case are the library's business
        low = piece.lower()
        parts = _DROPPED.findall(low)
        if len(parts) == 1 and low == piece:
            return self._encode_part(piece)
        return self._sum([self.head[x] for x in parts])

    def _encode(self, text: str):
        if not text:
            return self._sum([])
        if self.kind == "whole" or any(x in text for x in self.special):
            return self.encode_whole(text)
        tiers = [self.head] if self.tail is None else [self.head, self.tail]
        if sum(len(x.cache) for x in tiers) > self.entries or sum(x.held for x in tiers) > CACHE_BYTES:
            for tier in tiers:
                tier.forget()
        words = text.split()
        gaps = text.count(" ") + text.count("\n")
        simple = len(words) == gaps + 1 and sum(map(len, words)) + gaps == len(text)  # single blanks and line ends, nothing else
        if self.kind == "dropped":
            return self._sum(map(self.head.__getitem__, words if simple else _DROPPED_PIECES.findall(text)))
        if not simple:
            return self._sum([self.tail[x[1:]] if x[0] == " " and len(x) > 1 and not x.isspace() else self.head[x] for x in _GLUED_PIECES.findall(text)])
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.head[first])
            out.extend(map(self.tail.__getitem__, rest))
            out.append(self.head["\n"])
        out.pop()
        return self._sum(out)

    count = ids = _encode


_ENCODERS: dict = {}


def encoder(path: str, *, lengths_only: bool = False, entries: int = CACHE_ENTRIES, by_rank: bool = False) -> PieceEncoder:
    """This worker's encoder for the file; it lives as long as the worker."""
    key = (path, lengths_only, entries, by_rank)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, lengths_only=lengths_only, entries=entries, by_rank=by_rank)
    return _ENCODERS[key]


def frequent_lengths(docs: DataFrame, tokenizer_path: str) -> list[tuple[bool, str, int]]:
    """(has a blank before it, piece, tokens) of frequent pieces, FREQUENT at most."""
    enc, seen = PieceEncoder(tokenizer_path, lengths_only=True, by_rank=merges_by_rank(tokenizer_path)), Counter()
    if enc.kind == "whole":
        return []
    few = docs.select("text").where((F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("text"), F.lit(SAMPLE_EVERY)) == 0))
    for (text,) in few.limit(SAMPLE_ROWS).collect():  # stops as soon as there are enough; nothing is shuffled
        for line in text.split("\n"):
            seen.update((i > 0 and enc.kind == "glued", x) for i, x in enumerate(line.split(" ")) if x and not any(map(str.isspace, x)))
    return [(tail, x, enc.tail[x] if tail else enc.head[x]) for (tail, x), _ in seen.most_common(FREQUENT) if not any(t in x for t in enc.special)]


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Whole texts are counted as the tokenizers library counts them, without
    special tokens of its own.  A null text counts as the empty one (0 tokens);
    a null doc_id is kept.  An empty table gives an empty one; other columns of
    ``docs`` are ignored.
    """
    by_rank = merges_by_rank(tokenizer_path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches):
        enc = encoder(tokenizer_path, lengths_only=True, by_rank=by_rank)
        if enc.fixed is not table.value:
            enc.fix(table.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [enc.count(t) if t else 0 for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

Encoding splits a text at the pre-token pattern, gives each distinct pre-token of a slice to the library once, and
strings the ids of the occurrences together. Every token's character offsets in the text follow from the byte lengths of the
tokens before it and the characters that its bytes belong to. Decoding reverses the byte table: ids become bytes, and bytes
become characters, also where one character was split over several tokens.

A null or empty text has no tokens and decodes to the empty text. Very long texts are encoded whole. Repeated rows and
rows with a null id are encoded each for itself; further columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from glyphshift.llm._shared import id_and_text, map_batches, text_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Rows, and bytes of text, that are encoded together where only digests are returned; ids themselves take more memory.
ROWS, BYTES = 10_000, 8_000_000
#: A space at an end of the text, or beside other white space.
ODD_SPACE = r"^ |[\p{Z}\t\n\v\f\r\x{85}] | [\p{Z}\t\n\v\f\r\x{85}]| $"


def byte_to_char() -> dict[int, str]:
    """The printable stand-in for each byte: itself if it is a visible Latin-1 character, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def parts_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """`token` merged as far as merges of lower rank than its own go."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def take_ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges values[start : start + length], strung together."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


def bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        char = byte_to_char()
        spelled = {token: "".join(char[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            if len(token) > 1 and len(parts := parts_below(token, ranks)) == 2:
                merges.append((spelled[parts[0]], spelled[parts[1]]))
        self.tokenizer = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(pattern).findall
        #: Byte 0xFF is in no UTF-8 text: it parts the pre-tokens of one call, and no stand-in is white space.
        self.stand_in = str.maketrans({b: c for b, c in char.items()} | {0xFF: " "})
        back = {c: b for b, c in char.items()}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in spelled[token])
        self.decimal = pa.array([str(i) for i in range(len(self.bytes_of))], pa.string())
        self.raw = pa.array(self.bytes_of, pa.binary())
        self.byte_length = np.asarray([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, strung together, and the number of each one's. One call of the library: bytes go as
        their stand-in characters, and the ids are cut again by byte lengths."""
        if not pieces:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        raw = [p.encode() for p in pieces]
        mapped = b"\xff".join(raw).decode("latin-1").translate(self.stand_in)
        ids = np.asarray(self.tokenizer.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.byte_length[ids]), np.cumsum([len(r) for r in raw])) + 1
        return ids, np.diff(ends, prepend=0)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, strung together, and the number of each one's. Each chunk is split at the pattern, and
        each distinct pre-token is encoded once."""
        split = list(map(self.split, chunks))
        pieces = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        ids, sizes = self.encode_pieces(pieces.dictionary.to_pylist())
        starts, codes = np.cumsum(sizes) - sizes, pieces.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(sizes[codes])]).astype(np.int64)
        ends = np.cumsum([len(s) for s in split], dtype=np.int64)
        return take_ranges(ids, starts[codes], sizes[codes]), np.diff(total[ends], prepend=0)

    def encode_texts(self, column: pa.Array) -> Encoded:
        """The texts in chunks, each distinct chunk encoded once: a space between characters that are no white space always
        begins a pre-token. Texts with other spaces are one chunk."""
        column = pc.fill_null(column.cast(pa.string()), "")
        odd = pc.match_substring_regex(column, ODD_SPACE).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", column), " ")
        sizes = pc.list_value_length(cut).to_numpy()
        first = np.zeros(int(sizes.sum()), dtype=bool)
        first[(np.cumsum(sizes) - sizes)] = True
        chunks = pc.if_else(pa.array(first), cut.flatten(), pc.binary_join_element_wise("", cut.flatten(), " "))
        if odd.any():
            whole = np.full(len(first), -1, dtype=np.int64)
            whole[(np.cumsum(sizes) - sizes)[odd]] = np.flatnonzero(odd)
            at = pa.array(whole, mask=whole < 0)
            chunks = pc.coalesce(column.take(at), chunks)
        known = chunks.dictionary_encode()
        ids, counts = self.encode_chunks(known.dictionary.to_pylist())
        return Encoded(self, sizes, known.indices.to_numpy(), ids, counts)

    def ids(self, batch: list[str]) -> list[list[int]]:
        return self.encode_texts(pa.array(batch, pa.string())).ids().to_pylist()

    def offsets(self, batch: list[str]) -> list[tuple[list[int], list[int]]]:
        """Character offsets of each text's tokens: starts and ends. Tokens of one split character share its offsets."""
        done = self.encode_texts(pa.array(batch, pa.string()))
        starts, ends = (done.by_text(places).to_pylist() for places in done.offsets([t.encode() for t in batch]))
        return list(zip(starts, ends))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`; bytes that are no whole character, as after a cut, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Encoded:
    """Encoded texts: of each its chunks, by their place in the table of distinct chunks, which holds the ids."""

    def __init__(self, own: Codec, sizes: np.ndarray, codes: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.own, self.sizes, self.codes, self.flat, self.counts = own, sizes, codes, ids, counts
        ends = np.concatenate([[0], np.cumsum(counts[codes])])
        self.n_tokens = np.diff(ends[np.cumsum(sizes)], prepend=0).astype(np.int64)

    def flat_ids(self) -> np.ndarray:
        starts = np.cumsum(self.counts) - self.counts
        return take_ranges(self.flat, starts[self.codes], self.counts[self.codes])

    def by_text(self, values: np.ndarray) -> pa.ListArray:
        """A value for each token as a list for each text."""
        return pa.ListArray.from_arrays(bounds(self.n_tokens), pa.array(values.astype(np.int32, copy=False)))

    def ids(self) -> pa.ListArray:
        return self.by_text(self.flat_ids())

    def offsets(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last, counted in its text; `rows` are the texts as UTF-8."""
        raw = np.frombuffer(b"".join(rows), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)  # characters begun up to each byte
        sizes = self.own.byte_length[self.flat_ids()]
        last = np.cumsum(sizes)
        ends = np.cumsum([0, *map(len, rows)])[:-1]
        before = np.repeat(np.where(ends > 0, char[ends - 1] if len(char) else 0, 0), self.n_tokens)
        return char[last - sizes] - 1 - before, char[last - 1] - before

    def offset_digests(self, rows: list[bytes]) -> list[str]:
        """SHA-256 of each text's starts, then its ends, as little-endian 32-bit numbers."""
        starts, ends = (places.astype("<i4", copy=False) for places in self.offsets(rows))
        at = bounds(self.n_tokens)
        return [hashlib.sha256(starts[a:b].tobytes() + ends[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])]

    def joined(self, of_id: pa.Array, by: str | bytes) -> list:
        """Each text's ids as `of_id` has them, joined: first in the distinct chunks, then in the texts."""
        full = np.flatnonzero(self.counts[self.codes])
        table = pc.binary_join(pa.ListArray.from_arrays(bounds(self.counts), of_id.take(pa.array(self.flat))), by)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)[full]
        sizes = np.bincount(text, minlength=len(self.sizes))
        return pc.binary_join(pa.ListArray.from_arrays(bounds(sizes), table.take(pa.array(self.codes[full]))), by).to_pylist()

    def decimals(self) -> list[str]:
        return self.joined(self.own.decimal, " ")

    def decoded(self) -> list[bytes]:
        return self.joined(self.own.raw, b"")


@lru_cache(maxsize=2)
def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec a Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str = RANKS, decoded: bool = False) -> DataFrame:
    """doc_id, ids, starts and ends (character offsets) of every text and, if asked for, `text`: what its ids decode to."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = codec(path).encode_texts(batch.column("text"))
        starts, ends = done.offsets(text_bytes(batch))
        columns = {"doc_id": batch.column("doc_id"), "ids": done.ids(), "starts": done.by_text(starts), "ends": done.by_text(ends)}
        if decoded:
            columns["text"] = pa.array(done.decoded(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(id_and_text(docs), work, "doc_id long, ids array<int>, starts array<int>, ends array<int>" + ", text string" * decoded)


def decode(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and the text of its ids; null ids decode to the empty text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([own.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"]
        )

    return map_batches(tokens.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and offsets_sha256 of every text: encoded, then decoded from the ids, chunk
    by chunk. The last is the digest of all tokens' starts, then ends, as little-endian 32-bit numbers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        done = own.encode_texts(batch.column("text"))
        digests = [[hashlib.sha256(x).hexdigest() for x in column] for column in ((d.encode() for d in done.decimals()), done.decoded())]
        digests.append(done.offset_digests(text_bytes(batch)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(done.n_tokens), *(pa.array(d, pa.string()) for d in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"]
        )

    return map_batches(id_and_text(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string", ROWS, BYTES)

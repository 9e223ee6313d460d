"""Token counts: unigram segmentation of pre-tokens by dynamic programming over a trie.

A pre-token is a word with a word-begin mark before it. The pieces of a public vocabulary are a unigram model: a piece's
probability falls with its rank as 1 / rank, and a character that no piece covers is spelled in bytes. The distinct
pre-tokens of a slice are walked in sorted order, which is the order of a depth-first walk through their trie: where two
neighbours share a prefix, the forward scores of its nodes are kept and only the nodes below are computed. The number of
tokens at a pre-token's terminal node is stored and counted for each occurrence. The walk holds one path of the trie.

A null or empty text has no pre-tokens and no tokens. Words of any length are walked whole. Of equally good segmentations
that with fewer tokens counts. Repeated rows are counted each for itself; further columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from glyphshift.llm._shared import id_and_text, map_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BEGIN = "▁"
ROWS, BYTES = 10_000, 16_000_000


class Unigram:
    """Scores of pieces: integers, so that sums are exact and ties are ties."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        total = sum(1 / rank for rank in range(1, len(names) + 1))
        price = lambda rank: round(1000 * math.log(rank * total))
        self.price = {name: price(rank) for rank, name in enumerate(names, 1)}
        self.byte_price = price(len(names) + 1)
        self.longest = max(map(len, names))

    def counts(self, ordered: list[str]) -> list[int]:
        """The number of tokens of each pre-token; `ordered` is sorted."""
        price, longest, byte_price = self.price.get, self.longest, self.byte_price
        # cost[d], tokens[d]: cheapest segmentation of the path's first d characters.
        cost, tokens, path, out = [0], [0], "", []
        for word in ordered:
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del cost[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                least, fewest = cost[end - 1] + size * byte_price, tokens[end - 1] + size
                for start in range(end - longest if end > longest else 0, end):
                    p = price(word[start:end])
                    if p is not None:
                        p += cost[start]
                        if p < least or p == least and tokens[start] + 1 < fewest:
                            least, fewest = p, tokens[start] + 1
                cost.append(least)
                tokens.append(fewest)
            path = word
            out.append(tokens[-1])
        return out


@lru_cache(maxsize=2)
def unigram(path: str = VOCABULARY) -> Unigram:
    return Unigram(path)


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text").cast(pa.string()), ""))
        flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
        full = pc.not_equal(flat, "")
        doc = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
        known = flat.filter(full).dictionary_encode()
        words = [BEGIN + w for w in known.dictionary.to_pylist()]
        order = sorted(range(len(words)), key=words.__getitem__)
        terminal = np.zeros(len(words), dtype=np.int64)
        terminal[order] = unigram(path).counts([words[i] for i in order])
        n = np.bincount(doc, minlength=len(sizes))
        tokens = np.bincount(doc, weights=terminal[known.indices.to_numpy()], minlength=len(sizes))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(tokens.astype(np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    return map_batches(id_and_text(docs), work, "doc_id long, n_pretokens long, n_tokens long", ROWS, BYTES)

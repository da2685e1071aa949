"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the pre-tokens."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelane.llm.common import texts
from tracelane.llm.shingles import split_words

#: Trie nodes a worker holds before it starts over; bounds memory, not results.
MAX_NODES = 600_000
MARK = "▁"


class UnigramTrie:
    """Forward scores of a unigram model, once per distinct prefix.

    A piece costs the logarithm of its rank plus 2, as under Zipf's law; a character that no piece
    covers falls back to one byte piece for each of its UTF-8 bytes, at the cost of the rarest rank
    each. A node keeps the least cost at which its prefix can be cut and the fewest pieces among the
    cuts of that cost, so a terminal node answers for its pre-token.
    """

    def __init__(self, pieces: list[str]):
        self.cost: dict[str, float] = {}
        for rank, piece in enumerate(pieces):
            self.cost.setdefault(piece, round(float(np.log(rank + 2)) * 1e6))
        self.byte_cost = round(float(np.log(len(pieces) + 2)) * 1e6)
        self.tails = {p[i:] for p in self.cost for i in range(len(p))}
        self._reset()

    def _reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.char, self.best, self.count = [-1], [""], [0], [0]

    def _grow(self, parent: int, char: str) -> int:
        n = len(char.encode("utf-8", "surrogatepass"))
        least = (self.best[parent] + n * self.byte_cost, self.count[parent] + n)
        tail, at = char, parent
        while tail in self.tails:
            cost = self.cost.get(tail)
            if cost is not None:
                least = min(least, (self.best[at] + cost, self.count[at] + 1))
            if at == 0:
                break
            tail, at = self.char[at] + tail, self.parent[at]
        node = len(self.parent)
        self.parent.append(parent)
        self.char.append(char)
        self.best.append(least[0])
        self.count.append(least[1])
        self.child[parent, char] = node
        return node

    def counts(self, words: list[str]) -> list[int]:
        out = []
        for word in words:
            if len(self.parent) > MAX_NODES:
                self._reset()
            node = 0
            for c in word:
                node = self.child.get((node, c)) or self._grow(node, c)
            out.append(self.count[node])
        return out


@functools.lru_cache(maxsize=2)
def _trie(model_path: str) -> UnigramTrie:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return UnigramTrie(plain)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces are those of a public vocabulary; it has ranks but no unigram scores, so costs follow from the ranks, as in UnigramTrie.

    Per row of docs: its id, n_pretokens and n_tokens (long).

    A pre-token is a run without white space, led by the word mark. A null or empty text and one of
    white space alone have no tokens. Repeated rows and ids each get their own row; an empty table gives
    an empty one; other columns are not read. No shuffle: each worker shares one trie among its rows.
    """

    def count(batches):
        trie = _trie(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                split = split_words(part.column("text"))
                coded = split.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                of = np.array([0, *trie.counts([MARK + w for w in words])])
                of[1:][[not w for w in words]] = 0
                some = np.append(1, np.array([bool(w) for w in words], dtype=np.int64))
                codes, offsets = coded.indices.to_numpy() + 1, split.offsets.to_numpy()
                sums = [np.concatenate([[0], np.cumsum(x[codes])])[offsets] for x in (some, of)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(sums[0]), pa.int64()), pa.array(np.diff(sums[1]), pa.int64())], ["id", "n_pretokens", "n_tokens"])

    rows = texts(docs, id_col, text=text).withColumnRenamed(id_col, "id")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("id", id_col)

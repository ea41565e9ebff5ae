"""Token counts: a linear longest-match automaton over a piece vocabulary.

Greedy longest match from left to right over each word (a word begins with the
vocabulary's word mark), counted without building pieces: a trie holds the
vocabulary; every node has a failure link and the number of tokens popped when
it is followed, both computed beforehand, so each character is looked at a
constant number of times on average. A character that no piece holds counts as
its UTF-8 bytes (byte fallback).

Defined results: null and empty texts have 0 words and 0 tokens; repeated rows
are counted each; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Path of the vocabulary; a parameter of every function that reads one.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words kept with their counts in a worker; a full table is emptied.
MEMO = 400_000


def pieces(path: str = VOCABULARY) -> tuple[str, ...]:
    """Normal pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))


class Automaton:
    def __init__(self, vocabulary: tuple[str, ...]):
        known = set(vocabulary) - {""}
        self.step: list[dict[str, int]] = [{}]
        text = [""]
        # lone characters first: the root must know every character that stands in a piece
        for piece in [*sorted(set("".join(known))), *sorted(known)]:
            at = 0
            for ch in piece:
                if ch not in self.step[at]:
                    self.step[at][ch] = len(self.step)
                    self.step.append({})
                    text.append(text[at] + ch)
                at = self.step[at][ch]
        n = len(self.step)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for ch, v in self.step[u].items():
                queue.append(v)
                if text[v] in known:
                    self.fail[v], self.popped[v] = 0, 1
                elif u == 0:  # a lone character that only stands inside pieces
                    self.fail[v], self.popped[v] = 0, len(ch.encode())
                else:
                    z, total = self.fail[u], self.popped[u]
                    while ch not in self.step[z] and z:
                        total += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = self.step[z][ch], total

    def count(self, word: str) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        at = total = 0
        for ch in word:
            to = step[at].get(ch)
            while to is None and at:
                total += popped[at]
                at = fail[at]
                to = step[at].get(ch)
            if to is None:
                total += len(ch.encode())
            else:
                at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


@lru_cache(maxsize=2)
def _automaton(vocabulary: tuple[str, ...]) -> Automaton:
    return Automaton(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: tuple[str, ...], mark: str = MARK) -> DataFrame:
    """doc_id, n_bytes, n_words and n_tokens for every row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        machine = _automaton(sent.value)
        memo: dict[bytes, int] = {}
        for batch in batches:
            for part, data, offsets in C.chunks(batch):
                raw, n_words, n_tokens = data.tobytes(), [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = raw[a:b].split()
                    got = list(map(memo.get, own))
                    if None in got:
                        for i, n in enumerate(got):
                            if n is None:
                                w = own[i]
                                got[i] = n = memo.get(w) or machine.count(mark + w.decode("utf-8", "replace"))
                                memo[w] = n
                        if len(memo) > MEMO:
                            memo.clear()
                    n_words.append(len(own))
                    n_tokens.append(sum(got))
                yield C.batch_of(kind, doc_id=part.column(0).cast(pa.int64()), n_bytes=offsets[1:] - offsets[:-1], n_words=n_words, n_tokens=n_tokens)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"), pieces(path))

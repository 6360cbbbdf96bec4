"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text's pre-tokens (words between ASCII white space, each with a leading mark) are counted once each: they are put
into a trie whose nodes hold the best forward score and token count of the prefix that they spell, so words that share a
prefix share its scores. A node's values follow from those of its ancestors. Counts of whole words are kept by word; a
document's count is their sum. Nothing is shuffled: each task has its own trie, emptied when it gets large; so a
pre-token is counted once a task and trie, not once a corpus. Words over LONG characters, which hardly share anything,
take the same steps without nodes.

Pieces are those of a public vocabulary; a piece's probability follows Zipf's law from its rank there (no tokenizer is
trained). A character that no piece covers costs one token for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm._shared import small_batches, table, text_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Nodes and (twice) words that a task keeps; words longer than LONG are counted without the trie, in memory in proportion to the longest piece.
NODES, WORDS, LONG = 500_000, 200_000, 48


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unigrams(path: str) -> tuple[dict[str, float], float]:
    """The pieces' scores, ln(1 / (rank + 1)), and the score of a byte, the last rank's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {p: -log(i + 1) for i, p in enumerate(pieces)}, -log(len(pieces) + 1)


class Counter:
    """Counts tokens of words; :meth:`count` gives (tokens, score) of the best segmentation, of several with the fewest tokens."""

    def __init__(self, scores: dict[str, float], byte: float):
        self.scores, self.byte, self.longest = scores, byte, max(map(len, scores), default=1)
        self.backwards: list = [{}, None]  # pieces, last character first: children, score
        for piece, score in scores.items():
            node = self.backwards
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}  # (node, character) -> node; the root is 0
        self.score, self.tokens = [0.0], [0]
        self.words, self.older = {}, {}

    def _step(self, word: str, end: int, scores: list, tokens: list, base: int = 0) -> tuple[float, int]:
        """The best (score, tokens) of word[:end]; ``scores[i - base]`` and ``tokens[i - base]`` are those of word[:i]."""
        best, fewest = None, 0
        state, start = self.backwards, end
        while start and (state := state[0].get(word[start - 1])) is not None:  # pieces that end here, from the shortest
            start -= 1
            if state[1] is not None:
                new, n = scores[start - base] + state[1], tokens[start - base] + 1
                if best is None or new > best or new == best and n < fewest:
                    best, fewest = new, n
        if word[end - 1] not in self.scores:
            size = len(word[end - 1].encode("utf-8", "replace"))
            new = scores[end - 1 - base] + size * self.byte
            if best is None or new > best:
                best, fewest = new, tokens[end - 1 - base] + size
        return best, fewest

    def count(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found is not None:
            return found
        text = MARK + word
        if len(text) > LONG:
            scores, tokens, base = [0.0], [0], 0
            for end in range(1, len(text) + 1):
                s, n = self._step(text, end, scores, tokens, base)
                scores.append(s)
                tokens.append(n)
                if len(scores) > 4 * self.longest + 4096:
                    gone = len(scores) - self.longest - 1
                    del scores[:gone], tokens[:gone]
                    base += gone
            return tokens[-1], scores[-1]
        found = self.older.get(word)
        if found is None:
            if len(self.score) > NODES:
                self.children, self.score, self.tokens = {}, [0.0], [0]
            node, children, scores, tokens = 0, self.children, [0.0], [0]
            for end, c in enumerate(text, 1):
                key = node << 21 | ord(c)
                child = children.get(key)
                if child is None:
                    s, n = self._step(text, end, scores, tokens)
                    child = children[key] = len(self.score)
                    self.score.append(s)
                    self.tokens.append(n)
                else:
                    s, n = self.score[child], self.tokens[child]
                scores.append(s)
                tokens.append(n)
                node = child
            found = (n, s)
        if len(self.words) >= WORDS:
            self.words, self.older = {}, self.words
        self.words[word] = found
        return found


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, log_score (natural logarithm of the best segmentation's score) for every document.

    Null and empty texts have no words and tokens, score 0; words of any length are counted whole; repeated rows have
    the same counts; an empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*unigrams(path))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own = [w.decode() for w in text.as_py().encode("utf-8", "replace").split()]  # bytes: ASCII white space only
                found = [counter.words.get(w) or counter.count(w) for w in own]
                rows.append((len(own), sum([x[0] for x in found]), float(sum([x[1] for x in found]))))
            words, tokens, scores = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "log_score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType())])
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

"""Token counts of a piece vocabulary by byte-pair merging."""

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.llm.common import lists

SPACE = "▁"
#: Words whose count is remembered inside a task.
REMEMBER = 400_000
#: Runs of spaces with the word after them, or a word at the start of a line.
PART = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


@dataclass
class Merger:
    """Counts tokens with the ranks of a vocabulary of scored pieces."""

    ranks: dict[str, int]
    symbols: set[str]
    known: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> "Merger":
        """Read pieces and scores. Byte, control and unknown pieces take no part in
        merging. The model must leave texts as they are except for spaces, and no piece
        may hold a space mark after another character or a line feed: words are then
        counted apart from each other."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        sample = "  Ａ① \tb\r\n"
        if model.normalize(sample) != SPACE + sample.replace(" ", SPACE):
            raise ValueError("the model changes texts before it cuts them")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("the model has pieces that cross words")
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        return Merger({p: order[s] for p, s in pieces.items() if len(p) > 1}, {p for p in pieces if len(p) == 1})

    def merge(self, word: str) -> int:
        """Tokens of a word: its symbols less the merges, and a token for each byte of a
        symbol that the vocabulary lacks.

        Adjacent pairs wait in a heap by rank, then place; symbols are a linked list,
        in which a merged pair's right half is left empty. A pair that no longer stands
        as it was pushed is passed over.
        """
        rank, n = self.ranks.get, len(word)
        extra = 0
        for c in word:
            if c not in self.symbols:
                extra += len(c.encode()) - 1
        text, after, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(word[i:i + 2])
            if r is not None:
                heap.append((r, i, word[i:i + 2]))
        heapq.heapify(heap)
        merges = 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, piece = pop(heap)
            j = after[i]
            if not text[i] or j >= n or len(text[i]) + len(text[j]) != len(piece):
                continue
            text[i], text[j], k = piece, "", after[j]
            merges += 1
            after[i] = k
            if k < n:
                before[k] = i
                both = piece + text[k]
                r = rank(both)
                if r is not None:
                    push(heap, (r, i, both))
            h = before[i]
            if h >= 0:
                both = text[h] + piece
                r = rank(both)
                if r is not None:
                    push(heap, (r, h, both))
        return n - merges + extra

    def count(self, text: str) -> int:
        """Tokens of a text. Pieces never cross words or lines, so words are merged apart
        and their counts remembered."""
        if not text:
            return 0
        known, total = self.known, 0
        if len(known) > REMEMBER:
            known.clear()
        # a line's first word has no space before it, but the text's first word has
        for part in PART.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(part)
            if n is None:
                n = known[part] = self.merge(part)
            total += n
        return total


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per document, without a shuffle.

    Null counts as empty, which has no tokens. Repeated rows and null ids stay as they
    are. The vocabulary file must stand under the same path on every machine, as an
    installed package does.
    """
    source = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"))
    id_type = source.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger.load(model_path)
        for ids, texts in lists(batches, "__doc_id", "__text"):
            counts = [merger.count(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["__doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(
        run, f"__doc_id {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    ).withColumnRenamed("__doc_id", id_col)

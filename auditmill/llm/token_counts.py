"""Token counts of a unigram tokenizer without making the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space, and what an unknown character costs below the worst piece.
SPACE, UNKNOWN_COST = "▁", 10.0
#: Counted words that a worker remembers, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The (piece, score) pairs of a sentencepiece model file, by id, without reserved pieces.

    Control, unknown, unused and byte pieces have no text: a text that spells one does not hold it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    reserved = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in reserved)]


class Counter(dict):
    """Piece counts of parts of texts (each with its leading mark), kept for short ones.

    Viterbi over the characters of a word: an Aho-Corasick automaton gives every piece that ends
    at a character, and each character keeps the best score and the piece count of the path to
    it. Of equal scores the path whose last piece starts first stays, as in the tokenizer. A
    character that is no piece is unknown: it costs UNKNOWN_COST more than the worst piece and
    counts as its UTF-8 bytes (byte fallback), or as one piece if ``byte_fallback`` is off.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        super().__init__()
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_COST
        self.byte_fallback = byte_fallback
        # What stands before a mark inside of a piece: there a text cannot be cut.
        self.before_mark = {p[k - 1] for p, _ in vocabulary for k in range(1, len(p)) if p[k] == SPACE}
        held = "".join(map(re.escape, sorted(self.before_mark)))
        self.segment = re.compile(f"{SPACE}(?:[^{SPACE}]|(?<=[{held}]){SPACE})*") if held else None

    def __missing__(self, word: str) -> int:
        count = self.count(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def count(self, word: str) -> int:
        n = len(word)
        score, counts = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        # The automaton goes through the ends in order and, at one end, from the longest piece
        # (the first start) to the shortest: only a better score replaces a path.
        if self.single.issuperset(word):
            for last, (size, value) in self.pieces.iter(word):
                here = score[last + 1 - size] + value
                if here > score[last + 1]:
                    score[last + 1], counts[last + 1] = here, counts[last + 1 - size] + 1
            return counts[n]
        done = 0
        for last, (size, value) in [*self.pieces.iter(word), (n, (1, 0.0))]:
            while done < last:  # characters that are no pieces come after the pieces that end there
                if word[done] not in self.single and score[done] + self.unknown > score[done + 1]:
                    units = len(word[done].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                    score[done + 1], counts[done + 1] = score[done] + self.unknown, counts[done] + units
                done += 1
            if last < n and score[last + 1 - size] + value > score[last + 1]:
                score[last + 1], counts[last + 1] = score[last + 1 - size] + value, counts[last + 1 - size] + 1
        return counts[n]

    def total(self, text: str | None) -> int:
        """The number of tokens of a text.

        A mark stands for each space, and one before the text if it begins with none. The text is
        cut before each mark that no piece can reach across: the best path over the whole text
        passes all these places, so the parts are counted apart.
        """
        if not text:
            return 0
        if self.segment is not None:
            marked = text.replace(" ", SPACE)
            if any(c + SPACE in marked for c in self.before_mark):
                return sum(map(self.__getitem__, self.segment.findall(marked if marked[0] == SPACE else SPACE + marked)))
        words = text.replace(SPACE, " ").split(" ")
        if not words[0] and len(words) > 1:
            words = words[1:]
        return sum(map(self.__getitem__, [SPACE + w for w in words]))


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens and n_chars for every row of docs, in one pass without a shuffle.

    The vocabulary is broadcast; a tokenizer file bounds its size. Null and empty texts have no
    tokens. Repeated rows repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, byte_fallback)
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            counts = pa.array([counter.total(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, batch.column("n_chars")], ["doc_id", "n_tokens", "n_chars"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    return read.mapInArrow(run, "doc_id long, n_tokens long, n_chars long")

"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each place of a unit;
dynamic programming keeps, for each place, the best score and the number of pieces on that
path - no back pointers and no pieces.  Ties go by the tokenizer's rule: among equal scores the
path found first wins, and starts are visited from left to right, so the longest last piece
wins.  A character that is no piece of its own scores ten below the vocabulary's least score
and falls back to one piece for each of its UTF-8 bytes.

No piece holds a word start mark behind another character, and line feeds are in no piece: a
run of blanks and a line feed are certain cuts, so a text is counted unit by unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick

MARK = "▁"
UNK_PENALTY = 10.0
CACHE = 200_000
LONGEST_CACHED = 48
_UNITS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary(path: str) -> dict[str, float]:
    """Piece to score, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            out.setdefault(model.id_to_piece(i), model.get_score(i))
    return out


class _Cache(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> tuple[int, int, float]:
        made = self.make(unit)
        if len(unit) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = made
        return made


class CountingViterbi:
    def __init__(self, pieces: dict[str, float]) -> None:
        if not pieces:
            raise ValueError("the vocabulary is empty")
        self.unk = min(pieces.values()) - UNK_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.newline_cuts = not any("\n" in p for p in pieces)
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.heads, self.words = _Cache(self.viterbi), _Cache(lambda u: self.viterbi(MARK + u))

    def viterbi(self, unit: str) -> tuple[int, int, float]:
        """(pieces, of them byte pieces, best score) of one unit."""
        n, single = len(unit), self.single
        best: list[float | None] = [None] * (n + 1)
        count, fallback = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        matches = iter(self.automaton.iter(unit))
        end, found = next(matches, (n, None))
        for at in range(n):  # all candidates that end behind character `at`; the automaton gives the longest first
            to = at + 1
            top, top_count, top_fallback = None, 0, 0
            while end == at:
                length, score = found
                start = to - length
                score += best[start]
                if top is None or score > top:
                    top, top_count, top_fallback = score, count[start] + 1, fallback[start]
                end, found = next(matches, (n, None))
            if unit[at] not in single:
                score = best[at] + self.unk
                if top is None or score > top:
                    size = len(unit[at].encode())
                    top, top_count, top_fallback = score, count[at] + size, fallback[at] + size
            best[to], count[to], fallback[to] = top, top_count, top_fallback
        return count[n], fallback[n], best[n]

    def count(self, text: str) -> tuple[int, int, float]:
        """(pieces, of them byte pieces, score) of a whole text; an empty text has none."""
        if not text:
            return 0, 0, 0.0
        if not (self.newline_cuts and self.marks_lead):
            return self.viterbi(MARK + text.replace(" ", MARK))
        found: list[tuple[int, int, float]] = []
        if text[0] == " " or "  " in text or MARK in text or "\n " in text or " \n" in text:
            for i, line in enumerate(text.split("\n")):
                if i:
                    found.append(self.heads["\n"])
                line = line.replace(" ", MARK)
                found += [self.heads[u] for u in _UNITS.findall(MARK + line if not i else line)]
        else:
            heads, words = self.heads, self.words
            for i, line in enumerate(text.split("\n")):
                units = line.split(" ")
                if i:
                    found.append(heads["\n"])
                    if units[0]:
                        found.append(heads[units[0]])
                else:
                    found.append(words[units[0]])
                found += [words[u] for u in units[1:]]
        pieces, fallback, scores = zip(*found)
        return sum(pieces), sum(fallback), sum(scores)


_loaded: dict[str, CountingViterbi] = {}


def loaded(path: str) -> CountingViterbi:
    if path not in _loaded:
        _loaded[path] = CountingViterbi(vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_byte_tokens, score) of every whole text.

    A null or empty text has 0 tokens and score 0.  Repeated rows are counted each on their
    own, a null key stays null, an empty table gives no rows; other columns are not read.
    One narrow pass: nothing is shuffled and a worker keeps a bounded cache.
    """
    rows = pick(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            found = [counter.count(t.as_py() or "") for t in batch.column(1)]
            n, b, s = zip(*found) if found else repeat((), 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=[key, "n_tokens", "n_byte_tokens", "score"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, n_tokens bigint, n_byte_tokens bigint, score double")

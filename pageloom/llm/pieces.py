"""What the piece operators share: the vocabulary of a SentencePiece model, and texts as units that no piece spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass
class Vocabulary:
    """Plain lists, so that it travels to tasks; its size is the model's, some megabytes at most."""

    texts: list[str]            # by id; "" for what no text yields (control, bytes, unknown)
    scores: np.ndarray
    byte_ids: np.ndarray        # 256 ids
    barrier: str                # characters that are in no piece and cut units, for a regular expression
    prefix: bool                # a blank is put before the text

    @property
    def words(self) -> re.Pattern:
        b, s = self.barrier, SPACE
        return re.compile(f"[{b}]|{s}+[^{s}{b}]*|[^{s}{b}]+" if b else f"{s}+[^{s}]*|[^{s}]+")

    def units(self, text: str, words: re.Pattern) -> list[str]:
        """Pieces hold a blank mark only in front, so units begin at runs of marks; what is in no piece stands alone."""
        if not text:
            return []
        return words.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))


def load(path: str = MODEL) -> Vocabulary:
    """Read once, on the driver. The model must leave characters as they are and write blanks as marks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts, byte_ids = [], np.full(256, model.unk_id(), dtype=np.int32)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        texts.append("" if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else piece)
    chars = {c for t in texts for c in t}
    if missing := chars - {t for t in texts if len(t) == 1}:
        raise ValueError(f"characters that are no pieces of their own: {sorted(missing)[:5]}")
    if inner := [t for t in texts if SPACE in t.lstrip(SPACE)]:
        raise ValueError(f"pieces that span words: {inner[:5]}")
    return Vocabulary(texts, np.array([model.get_score(i) for i in range(n)]), byte_ids,
                      "" if "\n" in chars else "\\n", model.encode("a", out_type=str)[0].startswith(SPACE))


def units_of(vocabulary: Vocabulary, texts: list[str | None], words: re.Pattern) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Units of all texts as indexes into the distinct ones, those, and where each text's units end (from 0).

    The empty unit may stand among them; it has no piece.
    """
    # a mark that no text holds, put between units
    mark = next(c for c in map(chr, (*range(9), *range(0xE000, 0xF900))) if not any(t and c in t for t in texts))
    lines = []
    for text in texts:
        if not text:
            lines.append("")
        elif "  " in text or SPACE in text or text[0] == " " or not vocabulary.prefix:
            lines.append(mark.join(vocabulary.units(text, words)))
        else:       # no run of blanks: each blank begins a unit
            line = SPACE + text
            lines.append((line.replace("\n", f"{mark}\n{mark}") if vocabulary.barrier else line).replace(" ", mark + SPACE))
    lists = pc.split_pattern(pa.array(lines, pa.large_string()), mark)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), lists.offsets.to_numpy()


class Store:
    """Results of units that were met before, ragged rows of numbers; forgets all when it holds too many."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.values = np.zeros(0, dtype=np.int32)

    def look_up(self, distinct: list[str], compute) -> np.ndarray:
        """The row of each of the distinct units; ``compute`` makes (values, sizes) of a list of new ones."""
        if len(self.place) > self.most:
            self.forget()
        place = self.place
        if new := [u for u in distinct if u not in place]:
            values, sizes = compute(new)
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
            self.values = np.concatenate((self.values, values))
        return np.array([place[u] for u in distinct], dtype=np.int64)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the rows, one after the other, and how many each has."""
        starts, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        begin = np.cumsum(sizes) - sizes
        return self.values[np.repeat(starts - begin, sizes) + np.arange(sizes.sum())], sizes

"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

The encoder keeps, for each text span, an agenda of adjacent symbol pairs in
score order (then left to right): the best pair is merged, and the pairs that
the new symbol forms with its neighbours join the agenda. Symbols that end
outside the vocabulary fall back to their UTF-8 bytes.

A text is cut first where no piece of the vocabulary can span the cut, so that
repeated words are merged once per worker and looked up after that; the memory
of each worker for this is bounded. Every Arrow batch is checked against the
sentencepiece library: all spans merged anew (those that the library can see
alone), and every ``check_every``-th whole text. A difference raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_PUNCT = r"!-/:-@\[-`{-~"
#: spans remembered per worker; the memory is emptied when it is full
REMEMBERED = 100_000
#: spans up to this length are merged side by side, one row of a matrix each
SHORT = 32
_NEVER = np.float32(np.inf)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary, its merge agenda and a bounded memory of merged spans."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        if any(sp.is_unused(i) for i in range(sp.get_piece_size())):
            raise ValueError("vocabularies with unused pieces are not supported")
        plain = sorted(set(range(sp.get_piece_size())) - set(special))
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.cost = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.memory: dict[str, bytes] = {}
        self._index_pairs()
        pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(p[1] == SPACE != p[0] or "\n" in p for p in pairs):
            raise ValueError("a piece spans a space or a line end")
        # Between a plain character and ASCII punctuation no piece goes on, but for a few characters that pair with it.
        punct = re.compile(f"[{_PUNCT}]").match
        odd = {c for p in pairs for c, other in (p, p[::-1]) if c != SPACE and not punct(c) and punct(other)}
        odd_class = "".join(map(re.escape, sorted(odd))) or "\n"
        self.cut = re.compile(
            f"{SPACE}*[^{SPACE}\n{_PUNCT}{odd_class}]++(?![{odd_class}])|{SPACE}*[{_PUNCT}]++(?![{odd_class}])"
            f"|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def _index_pairs(self) -> None:
        """A hash table from two adjacent symbols to the piece they form."""
        self.first_free = self.library.get_piece_size()
        self.char_of: list[str] = []  # characters outside the vocabulary, by id from first_free on
        self.symbol = np.full(0x110000, -1, "i4")
        for c in {c for p in self.ids for c in p}:
            self._number(c)
        known = lambda s: self.symbol[ord(s)] if len(s) == 1 else self.ids.get(s)
        pairs = {(int(a) << 32) + int(b): i for p, i in self.ids.items() for k in range(1, len(p))
                 if (a := known(p[:k])) is not None and (b := known(p[k:])) is not None}
        self.slots = 1 << (len(pairs) * 8).bit_length()
        self.table, self.made = np.full(self.slots, -1, "i8"), np.full(self.slots, -1, "i4")
        self.steps = 1
        keys = np.array(list(pairs), "i8")
        for key, slot in zip(pairs, self._slot(keys).tolist()):
            step = 1
            while self.table[slot] >= 0:
                slot, step = (slot + 1) % self.slots, step + 1
            self.table[slot], self.made[slot], self.steps = key, pairs[key], max(self.steps, step)
        self.price = np.full(self.first_free, _NEVER, "f4")
        for p, i in self.ids.items():
            self.price[i] = self.cost[p]

    def _number(self, c: str) -> None:
        known = self.ids.get(c)
        if known is None:
            known = self.first_free + len(self.char_of)
            self.char_of.append(c)
        self.symbol[ord(c)] = known

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view("u8") * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slots.bit_length() + 1)).astype("i8")

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each two symbols form (-1: none) and its cost."""
        keys = (a.astype("i8") << 32) + b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        found = np.where(self.table[slot] == keys, self.made[slot], -1)
        for step in range(1, self.steps):
            open_ = np.flatnonzero((found < 0) & (self.table[(slot + step - 1) % self.slots] >= 0))
            if not open_.size:
                break
            at = (slot[open_] + step) % self.slots
            found[open_] = np.where(self.table[at] == keys[open_], self.made[at], -1)
        return found, np.where(found < 0, _NEVER, self.price[found])

    def merge_short(self, spans: list[str]) -> list[bytes]:
        """The packed ids of short spans: one agenda per row, all rows a step at a time."""
        sizes = np.array([len(s) for s in spans])
        points = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), "<u4")
        flat = self.symbol[points]
        for c in np.unique(points[flat < 0]).tolist():
            self._number(chr(c))
        width = int(sizes.max()) + 1  # the last column stays empty
        place = np.arange(width)
        sym = np.full((len(spans), width), -1, "i4")
        sym[place < sizes[:, None]] = self.symbol[points]
        piece, cost = (x.reshape(len(spans), width - 1) for x in self._pair(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        rows, done = np.arange(len(spans)), sym.copy()
        while rows.size:
            best, each = cost.argmin(axis=1), np.arange(len(rows))
            more = cost[each, best] < _NEVER
            if not more.all():
                done[rows[~more]] = sym[~more]
                rows, sym, piece, cost, best = rows[more], sym[more], piece[more], cost[more], best[more]
                each = each[:len(rows)]
            if not rows.size:
                break
            joined = piece[each, best]
            right = place[1:] > best[:, None]  # everything right of the merged pair moves one to the left
            sym[:, 1:] = np.where(right & (place[1:] < width - 1), np.roll(sym[:, 1:], -1, axis=1), sym[:, 1:])
            sym[each, best] = joined
            keep = place[:-1] < best[:, None]
            piece, cost = (np.where(keep, x, np.roll(x, -1, axis=1)) for x in (piece, cost))
            piece[:, -1], cost[:, -1] = -1, _NEVER
            piece[each, best], cost[each, best] = self._pair(joined, sym[each, best + 1])
            back = np.flatnonzero(best > 0)
            at = best[back] - 1
            piece[back, at], cost[back, at] = self._pair(sym[back, at], joined[back])
        filled = done >= 0
        packed, ends = done[filled].astype("<u4").tobytes(), (4 * np.cumsum(filled.sum(axis=1))).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero((done >= self.first_free).any(axis=1)).tolist():
            out[i] = np.array([x for s in done[i][filled[i]].tolist() for x in (
                [s] if s < self.first_free else [self.bytes[b] for b in self.char_of[s - self.first_free].encode()])],
                "<u4").tobytes()
        return out

    def merge(self, span: str) -> list[int]:
        """The ids of one span, by the agenda."""
        cost, sym, n = self.cost, list(span), len(span)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in cost]
        heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            a, b = sym[i], sym[j]
            if not a or not b or len(a) + len(b) != len(pair):
                continue  # one of the two has been merged since
            sym[i], sym[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := pair + sym[k]) in cost:
                    heappush(agenda, (cost[p], i, k, p))
            h = before[i]
            if h >= 0 and (p := sym[h] + pair) in cost:
                heappush(agenda, (cost[p], h, i, p))
        out: list[int] = []
        for s in sym:
            if s:
                known = self.ids.get(s)
                out.extend([known] if known is not None else (self.bytes[b] for b in s.encode()))
        return out

    def encode(self, texts: list[str], check_every: int) -> list[bytes]:
        """The ids of each text, with begin and end, as little-endian 32-bit integers."""
        cut, memory = self.cut, self.memory
        edges = [np.array([x], "<u4").tobytes() for x in (self.begin, self.end)]
        if len(memory) > REMEMBERED:
            memory.clear()
        out = []
        for some in _parts(texts, 1 << 22):
            rows = [cut(SPACE + text.replace(" ", SPACE)) if text else [] for text in some]
            fresh = list(set().union(*rows) - memory.keys())
            for k in range(0, len(fresh), 5_000):
                self._remember(fresh[k:k + 5_000])
            out += [edges[0] + b"".join([memory[s] for s in row]) + edges[1] for row in rows]
        if check_every:
            some = list(range(0, len(texts), check_every))
            real = self.library.encode([texts[i] for i in some], add_bos=True, add_eos=True, num_threads=1)
            for i, ids in zip(some, real):
                if np.array(ids, "<u4").tobytes() != out[i]:
                    raise AssertionError(f"the agenda and the library differ on a text of {len(texts[i])} characters")
        return out

    def _remember(self, spans: list[str]) -> None:
        short = [s for s in spans if len(s) <= SHORT]
        if short:
            self.memory.update(zip(short, self.merge_short(short)))
        for s in spans:
            if len(s) > SHORT:
                self.memory[s] = np.array(self.merge(s), "<u4").tobytes()
        # the library puts a space in front of whatever it reads
        seen = [s for s in spans if s[0] == SPACE and len(s) > 1]
        for s, ids in zip(seen, self.library.encode([s[1:].replace(SPACE, " ") for s in seen], num_threads=1)):
            if np.array(ids, "<u4").tobytes() != self.memory[s]:
                raise AssertionError(f"the agenda and the library differ on {s!r}")

    def decode(self, rows: list[bytes]) -> list[str]:
        # few ids at a time: as Python integers they take nine times their size
        return [text for some in _parts(rows, 1 << 20) for text in
                self.library.decode([np.frombuffer(r, "<u4").tolist() for r in some], num_threads=1)]


def _parts(items: Iterable, size: int) -> Iterator[list]:
    """Consecutive parts of about ``size`` characters or bytes, at least one item each; Arrow values are unpacked."""
    part, held = [], 0
    for item in items:
        item = item.as_py() if isinstance(item, pa.Scalar) else item
        part.append(item)
        held += len(item)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def _loaded(path: str) -> Pieces:
    return Pieces(path)


def encode_and_decode(df: DataFrame, text: str = "text", model: str | None = None, ids: str = "ids",
                      decoded: str = "decoded", packed: bool = False, check_every: int = 16) -> DataFrame:
    """``df`` with the token ids of ``text`` and their decoded text.

    ``ids`` is array<int> with begin and end ids, or with ``packed`` the same
    as little-endian unsigned 32-bit integers in one binary value. ``decoded``
    is the library's decode(ids). A null text counts as empty: two ids, empty
    decoded text. Every row gives one row; equal texts give equal results; an
    empty table gives an empty result; columns of ``df`` named like an output
    are replaced, others pass through. Texts of any length are encoded whole.
    """
    path = model or default_model()

    @F.arrow_udf(f"struct<ids {'binary' if packed else 'array<int>'}, decoded string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _loaded(path)
        for texts in batches:
            # a part at a time: ids of a whole batch would be many times its texts
            for some in _parts(texts, 1 << 20):
                # copies stand side by side and are encoded once
                different = {t: k for k, t in enumerate(dict.fromkeys(some))}
                again = [different[t] for t in some]
                rows = pieces.encode(list(different), check_every)
                plain = pieces.decode(rows)
                rows = [rows[k] for k in again]
                coded = pa.array(rows, pa.binary()) if packed else pa.ListArray.from_arrays(
                    np.cumsum([0, *(len(r) // 4 for r in rows)], dtype="i4"),
                    pa.array(np.frombuffer(b"".join(rows), "<u4").astype("i4")))
                yield pa.StructArray.from_arrays([coded, pa.array([plain[k] for k in again], pa.string())], ["ids", "decoded"])

    coded = run(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return df.withColumn("__coded", coded).withColumns(
        {ids: F.col("__coded.ids"), decoded: F.col("__coded.decoded")}).drop("__coded")

"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The vocabulary is a merge (BPE) model, so the best path is the one that its merges give. It has a local form: a
segmentation is the model's own exactly if every two neighbouring pieces, taken alone, stay these two pieces. So for
each position there is one piece that ends the best path to it, found from the pieces that end there and the best
path to where each begins: a Viterbi step that looks back no further than the longest piece. Only that window of
backpointers is kept. Where all paths that survive in the window go through one boundary, the ids before it are
committed and forgotten. Characters that no piece holds are boundaries by themselves and become byte pieces.

``Viterbi`` takes these steps sign by sign for a text that comes in parts. ``Lanes`` takes the same steps for many
runs at once, in arrays: runs between sure boundaries that fit in the window, so that their end is the commit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SPACE = "▁"
#: Marks at which a run of letters may end for good, if the vocabulary allows it.
MARKS = ",.!?;:*#$%&|"
#: Signs after which the surviving paths are looked at, and signs that are fed at once.
COMMIT_EVERY, PART = 48, 4096
#: Answers that a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Signs of the texts whose runs are encoded together, about.
RUNS_AT_ONCE = 1 << 20
#: Remembered answers on neighbouring pieces: of the window, and half of 2 ** PAIR_BITS of the lanes.
PAIRS, PAIR_BITS = 500_000, 20
#: Stands for a piece without text; no text that can be encoded holds it.
HELD = "\udb00"


_LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    """A vocabulary: pieces with their ranks, the bytes of unknown characters."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unknown: int):
        self.text = pieces
        self.byte_ids, self.unknown, self.special = byte_ids, unknown, special
        self.bytes = {v: k for k, v in byte_ids.items()}
        usable = [i for i in range(len(pieces)) if i not in special and i not in self.bytes]
        self.score = {pieces[i]: scores[i] for i in usable}
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        self.characters = {c for i in usable for c in pieces[i] if c in self.score}
        # the order of merges: ranks of pieces by score; characters come before all merges
        order = {score: k for k, score in enumerate(sorted({v for p, v in self.score.items() if len(p) > 1}, reverse=True))}
        self.rank = {p: order[v] if len(p) > 1 else -1 for p, v in self.score.items()}
        self.split: dict[str, tuple[str, str]] = {}
        self.id: dict[str, int] = {}
        for i in usable:  # pieces that merges can't reach never occur
            last = self.merge(pieces[i], stop=2)
            if len(pieces[i]) == 1 or (len(last) == 2 and last[0] + last[1] == pieces[i]):
                self.id[pieces[i]] = i
                self.split[pieces[i]] = tuple(last)
        self.length = list(map(len, pieces))
        # the vocabulary as a tree: sign -> (tree of what may follow, id of the piece that ends here or -1)
        self.tree: dict[str, tuple[dict, int]] = {}
        for p, i in sorted(self.id.items()):
            under = self.tree
            for c in p[:-1]:
                under = under.setdefault(c, ({}, -1))[0]
            under[p[-1]] = (under[p[-1]][0] if p[-1] in under else {}, i)
        self.pairs: dict[int, bool] = {}
        # where no piece goes on with a space sign after another sign, every such place is a boundary; so is the end
        # of a run of letters before a mark that no piece has after a letter
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        after = {y for p in self.id for x, y in zip(p, p[1:], strict=False) if _LETTER.match(x)}
        alone = "".join(c for c in "\n\t\r" if c not in self.characters)  # becomes bytes, so it bounds all runs
        marks = re.escape("".join(sorted(set(MARKS) - after)) + alone)
        ends = f"{SPACE}*[^\\W\\d_]+(?=[{SPACE}{marks}]|$)|" if marks else ""
        self.words = None if crossing else re.compile(f"{ends}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in n if model.is_byte(i)}
        special = {i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], special, byte_ids, model.unk_id())

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """The merges of a short text one by one, best score first, leftmost of equals: the plain definition."""
        parts = list(text)
        while len(parts) > stop:
            best = None
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def stay(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces, taken alone, stay these two."""
        key = left << 24 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay(self.text[left], self.text[right])
        return known

    def _stay(self, left: str, right: str) -> bool:
        """Undoes the merges of both pieces, the latest first, and asks each time whether a merge over the place
        between them would have come before the one just undone. Of equal ranks the leftmost merge comes first."""
        rank, before = self.rank, len(self.rank) + 1
        while True:
            if rank.get(left + right, before) < before:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                left, before = self.split[left][1], a
            elif b >= 0:
                right, before = self.split[right][0], b + 1
            else:
                return True

    def of_unknown(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


class Viterbi:
    """Streaming encoder of signs (spaces already replaced).

    ``best`` holds, for the positions of the window, the piece that ends the best path there (None: no path, -1: a
    fixed boundary). From each position that a path reaches, pieces go forward through the tree of the vocabulary;
    earlier positions come first, so the longest piece whose neighbours stay is the one that a position keeps. What
    lies before a boundary that all surviving paths go through is committed and leaves the window.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.signs, self.best = "", [-1]
        #: the next position that pieces go forward from, and the last that a path reaches
        self.at = self.reach = 0
        #: signs that went through the window, and the most that it has held between two parts
        self.fed = self.widest = 0

    def _path(self, upto: int, base: int) -> list[int]:
        best, length, ids = self.best, self.pieces.length, []
        while upto > base:
            i = best[upto]
            ids.append(i)
            upto -= length[i]
        return ids[::-1]

    def _converged(self, reach: int, at: int) -> int:
        """The last boundary that all surviving paths share: those to the positions a next piece may begin from."""
        best, length = self.best, self.pieces.length
        paths = {i for i in range(at, reach + 1) if best[i] is not None}
        while len(paths) > 1:  # the foremost path goes one piece back
            foremost = max(paths)
            paths.discard(foremost)
            if best[foremost] < 0:
                return min(paths)
            paths.add(foremost - length[best[foremost]])
        return paths.pop()

    def feed(self, part: str, last: bool = False) -> list[int]:
        """Takes a part of the text (``last``: its end too) -> the ids that are certain by now."""
        pieces = self.pieces
        tree, pairs, stay, longest = pieces.tree, pieces.pairs.get, pieces.stay, pieces.longest
        signs, best, at = self.signs + part, self.best, self.at
        best += [None] * len(part)
        n, base, reach, out = len(signs), 0, self.reach, []
        stop = n if last else n - longest + 1  # pieces from later positions may need signs still to come
        while at < stop:
            before = best[at]
            if before is not None:
                if at >= base + COMMIT_EVERY and (reach <= at or not at % 16):
                    sure = at if reach <= at else self._converged(reach, at)
                    out += self._path(sure, base)
                    base = sure
                step = tree.get(signs[at])
                end = at + 1
                if step is None:  # no piece holds this sign, so all paths end here
                    out += self._path(at, base)
                    out += pieces.of_unknown(signs[at])
                    base = reach = end
                    best[end] = -1
                while step is not None:
                    under, i = step
                    if i >= 0 and best[end] is None and (before < 0 or (stay(before, i) if (ok := pairs(before << 24 | i)) is None else ok)):
                        best[end] = i
                        if end > reach:
                            reach = end
                    if end == n:
                        break
                    step = under.get(signs[end])
                    end += 1
            at += 1
        self.fed += len(part)
        if last:
            out += self._path(n, base)
            self.signs, self.best, self.at, self.reach = "", [-1], 0, 0
        else:
            self.signs, self.best, self.at, self.reach = signs[base:], best[base:], at - base, reach - base
            self.widest = max(self.widest, len(self.signs))
        return out


class Table:
    """Whole numbers (0 and up) -> small whole numbers, looked up for many keys at once: open addressing in arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't held."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):  # another key has the slot: the next one
            slot[on] = (slot[on] + 1) & self.mask
            there = self.keys[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ from each other and from those that are held."""
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]  # of those that want one slot, the last has it
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            self.held += int(done.sum())
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & self.mask


class Lanes:
    """The steps of ``Viterbi`` for many runs in step with each other, in arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        signs = sorted(pieces.characters)
        self.symbols = len(signs) + 1
        self.symbol = np.zeros(max(map(ord, signs), default=0) + 2, np.int32)  # 0: no piece holds it
        self.symbol[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        edges, self.piece = [], [-1]
        waiting = [(0, pieces.tree)]
        while waiting:
            node, under = waiting.pop()
            for c, (below, i) in under.items():
                edges.append((node * self.symbols + int(self.symbol[ord(c)]), len(self.piece)))
                waiting.append((len(self.piece), below))
                self.piece.append(i)
        self.child = Table(max(4, len(edges).bit_length() + 1))
        self.child.put(*(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
        self.piece, self.length = np.array(self.piece, np.int64), np.array(pieces.length, np.int64)
        self.pairs = Table(PAIR_BITS)
        self.fed = 0

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        known = self.pairs.get(key)
        if (missing := known < 0).any():
            new, at = np.unique(key[missing], return_inverse=True)
            text = self.pieces.text
            answers = np.array([self.pieces._stay(text[k >> 24], text[k & 0xFFFFFF]) for k in new.tolist()], np.int32)
            known[missing] = answers[at]
            if self.pairs.held + len(new) > 1 << PAIR_BITS - 1:
                self.pairs = Table(PAIR_BITS)
            self.pairs.put(new[: 1 << PAIR_BITS - 2], answers[: 1 << PAIR_BITS - 2])
        return known > 0

    def encode(self, runs: list[str]) -> list[tuple[int, ...]]:
        return [tuple(np.frombuffer(ids, np.int32).tolist()) for ids in self.packed(runs)]

    def packed(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of known signs, 4 bytes each."""
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))  # lanes that are still open come first
        n = np.array([len(runs[k]) for k in order], np.int64)
        width = int(n[0]) if len(n) else 0
        codes = np.frombuffer("".join(runs[k].ljust(width, "\0") for k in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        sign = self.symbol[codes].reshape(len(n), width)
        best = np.full((len(n), width + 1), -2, np.int64)  # -2: no path, -1: the boundary
        best[:, 0] = -1
        for at in range(width):
            lane = np.flatnonzero(best[: np.searchsorted(-n, -at), at] > -2)
            before, node = best[lane, at], np.zeros(len(lane), np.int64)
            for end in range(at + 1, min(width, at + self.pieces.longest) + 1):
                still = int(np.searchsorted(lane, np.searchsorted(-n, -end, side="right")))
                lane, before, node = lane[:still], before[:still], node[:still]
                node = self.child.get(node * self.symbols + sign[lane, end - 1])
                hit = node >= 0
                lane, before, node = lane[hit], before[hit], node[hit].astype(np.int64)
                if not len(lane):
                    break
                i = self.piece[node]
                new = np.flatnonzero((i >= 0) & (best[lane, end] == -2))
                first = before[new] < 0
                new = new[first | self._stay(np.maximum(before[new], 0), i[new])] if not first.all() else new
                best[lane[new], end] = i[new]
        self.fed += int(n.sum())
        return self._paths(best, n, order)

    def _paths(self, best: np.ndarray, n: np.ndarray, order: list[int]) -> list[bytes]:
        lane, at, back = np.arange(len(n)), n.copy(), []
        while len(lane := lane[at[lane] > 0]):
            i = best[lane, at[lane]]
            back.append((lane, i))
            at[lane] -= self.length[i]
        lanes, ids = (np.concatenate([b[k] for b in back[::-1]]) if back else np.zeros(0, np.int64) for k in (0, 1))
        by = np.argsort(lanes, kind="stable")
        ends, flat = (4 * np.cumsum(np.bincount(lanes, minlength=len(n)))).tolist(), ids[by].astype(np.int32).tobytes()
        out = [b""] * len(n)
        for k, a, b in zip(order, [0, *ends], ends):
            out[k] = flat[a:b]
        return out


class Encoder(dict):
    """Text -> ids by the streaming pass; remembers its answers for runs of signs between sure boundaries.

    Answers are bytes, 4 for each id: they are joined without a number made, and the garbage collector passes them by.

    ``remembered``: runs that are remembered, in each of two generations.
    """

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        super().__init__()
        self.pieces, self.older, self.remembered = pieces, {}, remembered
        self.window, self.lanes = Viterbi(pieces), Lanes(pieces)

    def stream(self, text: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts of any length; no more than the window is held."""
        run, begun = Viterbi(self.pieces), False
        for part in text:
            if part:
                signs = ("" if begun else SPACE) + part.replace(" ", SPACE)
                for at in range(0, len(signs), PART):
                    yield from run.feed(signs[at : at + PART])
                begun = True
        yield from run.feed("", last=True)
        self.window.widest = max(self.window.widest, run.widest)
        self.window.fed += run.fed

    def __missing__(self, run: str) -> bytes:
        ids = []
        for at in range(PART, len(run), PART):
            ids += self.window.feed(run[at - PART : at])
        ids += self.window.feed(run[(len(run) - 1) // PART * PART :], last=True)
        return np.array(ids, np.int32).tobytes()

    def learn(self, runs: set[str]) -> None:
        """Encodes the runs that aren't remembered and fit in the window, together."""
        if len(self) > self.remembered:  # what isn't used again until the next time is forgotten then
            self.older = dict(self)
            self.clear()
        again = runs & self.older.keys()
        self.update({run: self.older[run] for run in again})
        known = self.pieces.characters.issuperset
        new = [run for run in runs - self.keys() if len(run) <= COMMIT_EVERY and known(run)]
        self.update(zip(new, self.lanes.packed(new), strict=True))

    def runs(self, text: str) -> list[str]:
        return self.pieces.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; texts are worked on in groups of about RUNS_AT_ONCE signs."""
        if self.pieces.words is None:  # nothing but the whole text lies between sure boundaries
            yield from (np.fromiter(self.stream([text]), np.int32) for text in texts)
            return
        group, held = [], 0
        for k, text in enumerate(texts):
            group.append(self.runs(text))
            held += len(text)
            if held > RUNS_AT_ONCE or k == len(texts) - 1:
                self.learn(set(chain.from_iterable(group)))
                for runs in group:
                    yield np.frombuffer(b"".join(map(self.__getitem__, runs)), np.int32)
                group, held = [], 0

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        yield from (ids.tolist() for ids in self.arrays(texts))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))


class Decoder:
    """Ids -> text, in parts of any length; only the bytes of an unfinished character are held back."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.parts = ["" if i in pieces.special else None if i in pieces.bytes else p.replace(SPACE, " ") for i, p in enumerate(pieces.text)]
        # for whole texts: ASCII bytes are signs by themselves, other bytes lone surrogates until all are there
        self.whole = [chr(b if b < 128 else 0xDC00 + b) if (b := pieces.bytes.get(i)) is not None else p or HELD for i, p in enumerate(self.parts)]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        held, begun = bytearray(), False
        for i in ids:
            part = self.parts[i]
            if part is None:
                held.append(self.pieces.bytes[i])
                continue
            if held:
                yield held.decode("utf-8", "replace")
                held, begun = bytearray(), True
            if part:
                yield part if begun else part[1:] if part[0] == " " else part
                begun = True
        if held:
            yield held.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.whole.__getitem__, ids))
        if text[:1] == " " and ids[0] not in self.pieces.bytes:
            text = text[1:]
        try:
            text.encode()
            return text
        except UnicodeEncodeError:
            pass
        try:
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        except UnicodeEncodeError:  # a special piece parts the bytes beside it
            return "".join(self.stream(ids))


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def loaded(model_path: str) -> tuple[Encoder, Decoder]:
    """The coders of a model; a worker keeps them, with the words that they remember, from task to task."""
    if model_path not in _LOADED:
        _LOADED.clear()
        pieces = Pieces.load(model_path)
        _LOADED[model_path] = Encoder(pieces), Decoder(pieces)
    return _LOADED[model_path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids array<int>, n_tokens, round_trip), one row for each row of docs.

    A null or empty text has no ids. round_trip says that decoding gives the text back; it can't where the text
    itself holds the sign that stands for a space (U+2581). The model's file must be readable where executors run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(model_path)
        for whole in batches:
            for batch in text_slices(whole):
                values, ends, same = [], [0], []
                texts = [text or "" for text in batch.column("text").to_pylist()]
                for text, ids in zip(texts, encoder.arrays(texts), strict=True):
                    values.append(ids)
                    ends.append(ends[-1] + len(ids))
                    same.append(decoder.decode(ids.tolist()) == text)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """tokens(doc_id, ids, ...) -> (doc_id, text), one row for each row; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = loaded(model_path)[1]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decoder.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

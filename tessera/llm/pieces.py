"""SentencePiece models: the pieces, their lattice, and its max-plus scan.

A byte-pair model's encoding is the one path through the lattice of its pieces in
which each pair of neighbours is what the pair's own text encodes to: merges
never reach past a neighbour. So a path's value in the max-plus semiring is 0
where all its neighbours agree and minus infinity elsewhere, and exactly one path
of a text has the value 0. A chunk of a text is then a matrix from the piece that
reaches into it to the piece that leaves it; matrices combine associatively.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .ragged import WordIds

SPACE = "▁"
#: No piece has a space behind another character, so none crosses these words.
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Where a word begins inside a text.
BEGINS = re.compile(f"(?<=[^{SPACE}]){SPACE}")
#: Before a run of characters inside a word, in a table of words.
RUN = " "
#: Pairs of neighbours whose test a worker remembers.
FITS = 100_000
NORMAL, BYTE, BPE = 1, 6, 2


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """The pieces of a byte-pair model file with byte fallback and the identity
    normaliser; others are refused."""

    def __init__(self, path: str):
        self.names: list[str] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        self.bytes: dict[int, int] = {}
        with open(path, "rb") as f:
            raw = f.read()
        for field, value in _fields(raw):
            if field == 1:
                piece = {k: v for k, v in _fields(value)}
                name, kind = piece[1].decode(), piece.get(3, NORMAL)
                i = len(self.names)
                self.names.append(name)
                if kind == NORMAL:
                    self.ids[name] = i
                    self.score[name] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                elif kind == BYTE:
                    self.byte_ids[int(name[3:5], 16)] = i
                    self.bytes[i] = int(name[3:5], 16)
            elif field == 2 and dict(_fields(value)).get(3) != BPE:
                raise ValueError("not a byte-pair model")
            elif field == 3 and dict(_fields(value)).get(1) != b"identity":
                raise ValueError("only the identity normaliser is known")
        if any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("a piece has a space inside")
        self.longest = max(map(len, self.ids))
        #: The longest piece that begins with so many (1 to 3) characters.
        self.reach: dict[str, int] = {}
        for x in self.ids:
            for n in (1, 2, 3):
                self.reach[x[:n]] = max(self.reach.get(x[:n], 1), len(x))
        self.utf8 = pa.array([bytes([self.bytes[i]]) if i in self.bytes else x.replace(SPACE, " ").encode() for i, x in enumerate(self.names)], pa.binary())
        self._fits: dict[tuple[str, str], bool] = {}
        self._halves: dict[str, tuple[str, str]] = {}
        #: Characters that stand beside each other in a piece: no merge joins others.
        self.beside = {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding by merges, best score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that are merged last when piece is encoded; none of a
        single character, and ('', '') where the encoding isn't the piece alone."""
        if len(piece) == 1:
            return None
        if piece not in self._halves:
            last = ("", "")
            if self.merge(piece) == [piece]:
                # Both halves are encoded as themselves, and they are neighbours.
                for i in range(1, len(piece)):
                    left, right = piece[:i], piece[i:]
                    if self.known(left) and self.known(right) and self.halves(left) != ("", "") != self.halves(right) and self.apart(left, right, self.score[piece]):
                        last = (left, right)
                        break
                else:
                    raise ValueError("merges aren't in the order of the scores")
            self._halves[piece] = last
        return self._halves[piece]

    def apart(self, left: str, right: str, above: float = -math.inf) -> bool:
        """Whether no merge of a score better than above joins left and right, each
        encoded as itself. Their merges are taken back, the last one first; a pair
        that meets where they meet would be joined if that came before the merge
        that was just taken back. Of equal merges the left one comes first."""
        score, low = self.score, above
        strict = True
        while True:
            both = score.get(left + right)
            if both is not None and (both > low if strict else both >= low):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and score[left] < score[right]:
                low, strict, left = score[left], True, a[1]
            else:
                low, strict, right = score[right], False, b[0]

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right may be neighbours ('' is a text's edge)."""
        key = (left, right)
        if key not in self._fits:
            if left and right and left[-1] != SPACE and right[0] == SPACE:
                return self.fits("", right)
            if len(self._fits) > FITS:
                self._fits.clear()
            sound = all(self.known(x) and self.halves(x) != ("", "") for x in key if x)
            self._fits[key] = sound and not (left and right and not self.apart(left, right))
        return self._fits[key]

    def known(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.ids

    def scan(self, text: str, start: int, end: int, first: str) -> list[str | None]:
        """For each place up to end, the last piece of the one fitting path that
        begins at start, behind the piece first; None where no path ends."""
        last: list[str | None] = [None] * (end + 1)
        last[start] = first
        ids, known, longest = self.ids, self._fits, self.longest
        for i in range(start + 1, end + 1):
            for j in range(max(start, i - longest), i):
                left = last[j]
                if left is None:
                    continue
                piece = text[j:i]
                if piece in ids or j == i - 1:
                    fit = known.get((left, piece))
                    if fit if fit is not None else self.fits(left, piece):
                        last[i] = piece
                        break
        return last

    @staticmethod
    def back(last: list[str | None], start: int, end: int) -> list[str]:
        """The pieces of the path that ends at end."""
        out = []
        while end > start:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    def word(self, word: str) -> list[str]:
        """The pieces of the fitting path of a word, searched depth first, longest
        piece first. Only one path fits up to any place, so a place from which
        the search came back is never tried again."""
        ids, known, n = self.ids, self._fits, len(word)
        path: list[str] = []
        dead: set[int] = set()
        reach = self.reach
        at, end, left = 0, min(reach.get(word[:3]) or reach.get(word[:2], 1), n), ""
        while at < n:
            while end > at:
                piece = word[at:end]
                if (piece in ids or end == at + 1) and end not in dead:
                    fit = known.get((left, piece))
                    if fit if fit is not None else self.fits(left, piece):
                        break
                end -= 1
            if end > at:
                path.append(piece)
                at, left = end, piece
                end = min(at + (reach.get(word[at : at + 3]) or reach.get(word[at : at + 2], 1)), n)
            else:
                if not path:
                    raise ValueError("no path fits")
                dead.add(at)
                piece = path.pop()
                end, at = at - 1, at - len(piece)
                left = path[-1] if path else ""
        return path

    def piece_ids(self, pieces: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            pass
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def spaced(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a spaced text, each without its first space: all have one."""
        if text.endswith(SPACE) or SPACE + SPACE in text:
            return [w[1:] for w in WORDS.findall(text)]
        return text.split(SPACE)[1:]

    def word_ids(self, word: str) -> list[int]:
        """The ids of one of words()."""
        return self.piece_ids(self.word(SPACE + word))

    def runs(self, word: str) -> list[str]:
        """The spaced word, cut wherever no merge can join two characters."""
        beside, out, begin = self.beside, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in beside:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:])
        return out

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The UTF-8 bytes of each list's text: byte pieces are their byte, and
        the space before the text goes."""
        ends = ids.offsets.to_numpy()
        pieces = self.utf8.take(ids.values.slice(ends[0], ends[-1] - ends[0]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pieces), b"").to_numpy(zero_copy_only=False)
        return pa.array([t[1:] if t[:1] == b" " else t for t in joined], pa.binary())


class PieceIds(WordIds):
    """Ids of words(); a word that merges can't join as a whole is made of its
    runs, which are held too (behind a space: no word begins with it)."""

    def __init__(self, model: PieceModel, **options):
        super().__init__(**options)
        self.model = model

    def made(self, word: str) -> bytes:
        if word[:1] == RUN:
            return array("i", self.model.piece_ids(self.model.word(word[1:]))).tobytes()
        runs = self.model.runs(SPACE + word)
        if len(runs) == 1:
            return array("i", self.model.piece_ids(self.model.word(runs[0]))).tobytes()
        return b"".join([self[x[1:]] if x[0] == SPACE and len(x) > 1 else self[RUN + x] for x in runs])


# A state at the border between two chunks: how far the piece that covers it
# reaches past it, and that piece. The text's own edges have the state (0, '').
State = tuple[int, str]
EDGE: State = (0, "")


class Chunk:
    """Characters at:at+size of a spaced text, with up to `longest` more on
    either side; begins and ends say whether the text does."""

    def __init__(self, model: PieceModel, text: str, at: int, size: int, begins: bool, ends: bool):
        self.model, self.text, self.at, self.to, self.begins, self.ends = model, text, at, at + size, begins, ends

    def states(self, border: int) -> list[State]:
        """The pieces that may cover or end at a border inside the text."""
        out = []
        for reach in range(min(self.model.longest - 1, len(self.text) - border) + 1):
            for n in range(reach + 1, min(self.model.longest, border + reach) + 1):
                piece = self.text[border + reach - n : border + reach]
                if self.model.known(piece) and self.model.fits("", piece):
                    out.append((reach, piece))
        return out

    def _breaks(self) -> tuple[int, int] | None:
        """The first and the last place in the chunk where a word begins."""
        begins = BEGINS.search(self.text, self.at + 1, self.to)
        if not begins:
            return None
        last = self.text.rfind(SPACE, self.at + 1, self.to)
        while self.text[last - 1] == SPACE:
            last -= 1
        return begins.start(), last

    def _leaving(self, last: list[str | None], leaving: list[State]) -> list[State]:
        out = []
        for reach, piece in leaving:
            begin = self.to + reach - len(piece)
            if (reach, piece) == EDGE:
                fit = last[self.to] is not None
            elif begin < 0 or begin >= len(last):
                fit = False
            else:
                fit = last[begin] is not None and self.model.fits(last[begin], piece)
            if fit:
                out.append((reach, piece))
        return out

    def transfer(self) -> dict[State, set[State]]:
        """The chunk's matrix: the entries of value 0. Behind a word's beginning
        nothing depends on what came before, so only the chunk's first and last
        words are scanned, the first once for each state."""
        entering = [EDGE] if self.begins else self.states(self.at)
        leaving = [EDGE] if self.ends else self.states(self.to)
        breaks, out = self._breaks(), {}
        if breaks:
            ended = set(self._leaving(self.model.scan(self.text, breaks[1], self.to, ""), leaving))
        for state in entering:
            begin = self.at + state[0]
            if breaks and begin <= breaks[0]:
                if self.model.scan(self.text, begin, breaks[0], state[1])[breaks[0]] is not None and ended:
                    out[state] = ended
                continue
            if begin >= self.to:  # a piece longer than the chunk goes through it
                past = (begin - self.to, state[1])
                through = {past} if past in leaving or past[0] == 0 and self.ends else set()
                if past[0] == 0 and self.ends:
                    through = {EDGE}
            else:
                through = set(self._leaving(self.model.scan(self.text, begin, self.to, state[1]), leaving))
            if through:
                out[state] = through
        return out

    def parts(self, entering: State, leaving: State) -> tuple[list[str], list[str], list[str]]:
        """What begins in the chunk, on the path between two states: pieces, whole
        words behind them (see PieceModel.words), and the pieces behind those."""
        begin = self.at + entering[0]
        end = self.to if leaving == EDGE else self.to + leaving[0] - len(leaving[1])
        tail = [] if leaving == EDGE or end < begin else [leaving[1]]
        if begin >= self.to or end < begin:
            return [], [], []
        breaks = self._breaks()
        if not breaks or begin > breaks[0] or end < breaks[1]:
            return self.model.back(self.model.scan(self.text, begin, end, entering[1]), begin, end) + tail, [], []
        head = self.model.back(self.model.scan(self.text, begin, breaks[0], entering[1]), begin, breaks[0])
        rest = self.model.back(self.model.scan(self.text, breaks[1], end, ""), breaks[1], end)
        return head, self.model.words(self.text[breaks[0] : breaks[1]]), rest + tail

    def pieces(self, entering: State, leaving: State) -> list[str]:
        """The pieces that begin in the chunk, on the path between two states."""
        head, words, rest = self.parts(entering, leaving)
        return head + [p for w in words for p in self.model.word(SPACE + w)] + rest


def compose(a: dict[State, set[State]], b: dict[State, set[State]]) -> dict[State, set[State]]:
    """The max-plus product of two matrices with entries 0 and minus infinity."""
    out = {}
    for state, mids in a.items():
        if to := set().union(*(b[m] for m in mids if m in b)):
            out[state] = to
    return out


def borders(matrices: list[dict[State, set[State]]], first: State = EDGE, last: State = EDGE) -> list[State]:
    """The states of the one path from first to last through all matrices: those
    that can be reached from the left, then, from the right, the one of each
    border that goes on."""
    reached = [{first}]
    for m in matrices:
        reached.append(set().union(*(m.get(s, set()) for s in reached[-1])))
    path = [last]
    for m, left in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        (state,) = [s for s in left if path[-1] in m.get(s, ())]
        path.append(state)
    return path[::-1]

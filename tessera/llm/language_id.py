"""Language ID by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held

#: Bounds of the labelled sample: documents of a language, characters of each
#: that are used, characters of a language's reference.
SAMPLE_DOCS, SAMPLE_CHARS, REFERENCE_CHARS = 256, 2_000, 40_000
#: Cells of the table of moves. Letters that it has no room for, the rarest in
#: the references, have their moves in a sorted list; results are the same.
CELLS = 1 << 26
#: Texts are parsed in lanes of this many symbols, all lanes a step at a time;
#: the counts are those of one parse of the whole text.
LANE = 1_024
SPACE = 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, str]:
    """A reference text for each language: of the labelled documents that aren't
    held out, those with the smallest hash of doc_id. The bounds above hold at
    every size; the window keeps SAMPLE_DOCS rows of a language in each task
    before it shuffles ids, and texts follow only for the ids chosen."""
    named = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_DOCS).select(F.col("doc_id").alias("_id"))
    # At most SAMPLE_DOCS ids of each language.
    rows = (
        named.join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
        .select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    )
    out: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        if len(out.get(row["lang"], "")) < REFERENCE_CHARS:
            out[row["lang"]] = out.get(row["lang"], "") + "\n" + row["text"]
    return {k: v[:REFERENCE_CHARS] for k, v in out.items()}


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of symbols; state 0 is the start."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


def _moves(nexts: list[dict[int, int]]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many states, and of all moves the state, the symbol and the next state."""
    of = np.repeat(np.arange(len(nexts), dtype=np.int64), [len(m) for m in nexts])
    by = np.fromiter((c for m in nexts for c in m), np.int64, len(of))
    to = np.fromiter((t for m in nexts for t in m.values()), np.int64, len(of))
    known = by != 0
    return len(nexts), of[known], by[known], to[known]


class CrossParser:
    """Counts, for a text and each language, the phrases of the parse into
    longest matches with the language's reference."""

    def __init__(self, references: dict[str, str]):
        self.names = sorted(references)
        seen = Counter(c for t in references.values() for c in t.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        kinds = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        # 0: a letter that no reference has; 1: all that isn't a letter.
        self.letters = len(letters) + 2
        self.code = np.where(kinds, 0, SPACE).astype(np.min_scalar_type(self.letters))
        self.letter = kinds
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 2
        automata, self.sizes = [], []
        for name in self.names:
            symbols = self.symbols(references[name])
            automata.append(_moves(automaton(symbols.tolist())))
            self.sizes.append(max(2, len(symbols)))
        states = np.array([n for n, _, _, _ in automata], np.int64)
        self.width = max(2, min(self.letters, CELLS // max(1, int(states.sum()))))
        # A move gives the row of the next state in the joint table; the start's row means none.
        self.roots = (np.cumsum([0, *states])[:-1] * self.width).astype(np.int32)
        self.table = np.repeat(np.repeat(self.roots, states), self.width)
        self.first = np.repeat(self.roots[:, None], self.letters, axis=1)
        keys, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for i, (_, of, by, to) in enumerate(automata):
            of, to = of * self.width + self.roots[i], (to * self.width + self.roots[i]).astype(np.int32)
            wide, start = by < self.width, of == self.roots[i]
            self.table[of[wide] + by[wide]] = to[wide]
            self.first[i, by[start]] = to[start]
            keys.append(of[~wide] * self.letters + by[~wide])
            ends.append(to[~wide])
        keys, ends = np.concatenate(keys), np.concatenate(ends)
        order = np.argsort(keys)
        self.keys, self.ends = keys[order], ends[order]

    def moves(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next state of each state (a row a language, a column a lane)."""
        rare = np.flatnonzero(code >= self.width) if self.width < self.letters else code[:0]
        if not len(rare):
            return self.table[state + code]
        to = self.table[state + np.where(code < self.width, code, 0)]
        key = state[:, rare].astype(np.int64) * self.letters + code[rare]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        to[:, rare] = np.where(self.keys[at] == key, self.ends[at], self.roots[:, None])
        return to

    def symbols(self, text: str) -> np.ndarray:
        code = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != SPACE) | (code[:-1] != SPACE)
        return code[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts, a row a text and a column a language, and lengths."""
        parts = [self.symbols(t) for t in texts]
        owner, lanes = [], []
        for i, p in enumerate(parts):
            for at in range(0, len(p), LANE):
                owner.append(i)
                lanes.append(p[at : at + LANE])
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        if not lanes:
            return counts, np.zeros(len(texts), np.int64)
        # A text's lanes begin at the start state; where the lane before ended in
        # another, a lane is parsed again from there until both parses meet.
        owner, k = np.array(owner), len(self.names)
        begin = np.broadcast_to(self.roots[:, None], (k, len(lanes))).copy()
        found, end = self._parse(lanes, begin)
        again = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        while len(again):
            again = again[(begin[:, again] != end[:, again - 1]).any(axis=0)]
            if not len(again):
                break
            start = end[:, again - 1].copy()
            more, last = self._apart([lanes[i] for i in again], begin[:, again], start, end[:, again])
            found[:, again] += more
            changed = again[(last != end[:, again]).any(axis=0)]
            begin[:, again], end[:, again] = start, last
            after = changed + 1
            after = after[after < len(lanes)]
            again = after[owner[after] == owner[after - 1]]
        np.add.at(counts, owner, found.T)
        return counts, np.array([len(p) for p in parts])

    def _grid(self, lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lanes, longest first, as columns; their order and how many have a
        symbol at each step."""
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        sizes = np.array([len(lanes[i]) for i in order])
        grid = np.zeros((len(lanes), sizes[0]), self.code.dtype)
        for row, i in enumerate(order):
            grid[row, : sizes[row]] = lanes[i]
        return np.ascontiguousarray(grid.T), order, np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")

    def _step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind the symbols c, and where a phrase begins with one."""
        to = self.moves(state, c)
        roots = self.roots[:, None]
        new = (to == roots) | (state == roots)
        return np.where(new, self.first[:, c], to), new

    def _parse(self, lanes: list[np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each lane, and its last state (a row a language)."""
        grid, order, live = self._grid(lanes)
        state = begin[:, order].copy()
        found = np.zeros(state.shape, np.int32)
        for step in range(len(grid)):
            n = live[step]
            state[:, :n], new = self._step(state[:, :n], grid[step, :n].astype(np.int32))
            found[:, :n] += new
        back = np.argsort(order)
        return found[:, back], state[:, back]

    def _apart(self, lanes: list[np.ndarray], one: np.ndarray, two: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For parses from the states two instead of one, how many phrases more they
        find, and the last states, of which end has those of one. Lanes whose parses
        have met in all languages are done."""
        grid, order, live = self._grid(lanes)
        one, two, last = one[:, order].copy(), two[:, order].copy(), end[:, order].copy()
        more, open_ = np.zeros(one.shape, np.int32), np.arange(len(lanes))
        for step in range(len(grid)):
            done = open_[open_ >= live[step]]
            last[:, done] = two[:, done]
            open_ = open_[open_ < live[step]]
            open_ = open_[(one[:, open_] != two[:, open_]).any(axis=0)]
            if not len(open_):
                break
            c = grid[step, open_].astype(np.int32)
            one[:, open_], a = self._step(one[:, open_], c)
            two[:, open_], b = self._step(two[:, open_], c)
            more[:, open_] += b.astype(np.int32) - a
        else:
            last[:, open_] = two[:, open_]
        back = np.argsort(order)
        return more[:, back], last[:, back]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language whose parse has the fewest phrases, each weighted with the
        logarithm of its reference's length; ties go to the name that sorts first.
        The score is the share of the best in a soft minimum over languages."""
        given = [t or "" for t in texts]
        spoken = [bool(self.letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in given]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        counts, _ = self.phrases([t if yes else "" for t, yes in zip(given, spoken, strict=True)])
        rates = counts * np.array([math.log2(n) for n in self.sizes])
        best = rates.argmin(axis=1)
        low = np.maximum(rates[np.arange(len(rates)), best], 1e-9)
        share = 1 / np.exp(-20 * (rates / low[:, None] - 1)).sum(axis=1)
        return [self.names[b] if yes else "und" for b, yes in zip(best, spoken, strict=True)], [float(s) if yes else 0.0 for s, yes in zip(share, spoken, strict=True)]


def _parser(references: dict[str, str]) -> CrossParser:
    """A worker builds its automata once and keeps those of the last references."""
    return held(("languages", tuple(sorted(references.items()))), lambda: CrossParser(references))


def annotate(docs: DataFrame, references: dict[str, str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score (in place of those of these names), from
    whole texts alone. A null text or one without a letter is `und` with score 0;
    so is every text where no language was learned. References, not automata, go
    to the workers."""
    rows = docs.drop(pred, score)

    def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in batches:
            parser = parser or _parser(references)
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and chars < 3_000_000:
                    texts.append(batch["text"][at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                names, scores = parser.predict(texts)
                some = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*some.schema.names, pred, score])
                at += len(texts)

    schema = T.StructType([*rows.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(languages, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from docs' labelled rows that aren't held out and predict all rows:
    doc_id, held_out, lang_pred, score. Repeated rows are each predicted, null
    doc_ids aren't held out, other columns are ignored, an empty table gives no
    rows."""
    return annotate(docs.select("doc_id", "text"), sample(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def spoken(docs: DataFrame) -> DataFrame:
    """The rows of docs in which a language is found, with all their columns; lang
    becomes the predicted one, whatever it was. Rejected are rows without a letter
    alone (all rows where no language was learned): letters of any kind have a
    nearest language, and the score rejects nothing."""
    pred, score = fresh(docs, "lang_pred", "score")
    kept = annotate(docs, sample(docs), pred, score).filter(F.col(pred) != "und")
    return kept.select(*(F.col(pred).alias("lang") if c == "lang" else F.col(c) for c in docs.columns))

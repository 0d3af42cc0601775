"""A dual-sorted wavelet tree: postings by impact, navigable by document.

Each term's postings stand together, the highest impact first. A wavelet tree over
their documents sends them level by level to the half of the documents they belong
to and keeps their order on the way, so in every node the first posting of a term's
interval has the term's highest impact among the node's documents: that is the
bound by which subtrees are visited best first.
"""

from __future__ import annotations

import numpy as np

#: Nodes opened at a time, the best ones of all that are left.
WAVE = 256


def _levels(n_docs: int) -> int:
    return max(0, n_docs - 1).bit_length()


def pack(docs: np.ndarray, n_docs: int) -> bytes:
    """The planes of the tree over docs (16-bit numbers): on each level a bit for
    each posting, in the order of the level's nodes, padded to whole words."""
    levels, out = _levels(n_docs), []
    for level in range(levels):
        at = docs[np.argsort(docs >> (levels - level), kind="stable")] if level else docs
        bits = np.packbits((at >> (levels - level - 1)) & 1, bitorder="little")
        out.append(bits.tobytes() + bytes(-len(bits) % 8 + 8))
    return b"".join(out)


def squeeze(impacts: np.ndarray) -> bytes:
    """Impacts as differences, which compress well since each list descends."""
    return np.diff(impacts, prepend=np.int32(0)).astype(np.int32).tobytes()


class Tree:
    """A shard's tree, read from its planes, with each level's impacts beside the
    level's bits: made by one stable partition a level, so that a bound is a look
    at the first place of an interval."""

    def __init__(self, planes: bytes, impacts: bytes, n_docs: int):
        root = np.cumsum(np.frombuffer(impacts, np.int32), dtype=np.int32)
        self.n, self.levels = len(root), _levels(n_docs)
        self.words = np.frombuffer(planes, np.uint64)
        self.width = len(self.words) // self.levels if self.levels else 0
        ones = np.bitwise_count(self.words).reshape(self.levels, self.width) if self.levels else np.zeros((0, 0), np.uint8)
        self.before = (np.cumsum(ones, axis=1, dtype=np.int32) - ones).astype(np.int32).ravel()
        self.impacts = np.empty((self.levels + 1, self.n), np.int32)
        self.impacts[0], prefix = root, np.zeros(self.n, np.uint16)
        for level in range(self.levels):
            own = self.words[level * self.width : (level + 1) * self.width]
            prefix = prefix * np.uint16(2) + np.unpackbits(own.view(np.uint8), count=self.n, bitorder="little")
            order = np.argsort(prefix, kind="stable")
            self.impacts[level + 1], prefix = self.impacts[level][order], prefix[order]

    def rank(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before place at of each level."""
        word = level * self.width + (at >> 6)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def top(self, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k documents with the highest sums of weight * impact over the lists
        [start, end), ties by number, and those that tie with the last of them.

        A node is a level, a prefix of document numbers, its range of the level and
        a bound; pairs are the lists that have postings in it. The best nodes left
        are opened a wave at a time; leaves have one document and their bound is its
        score. What can't reach the k-th score found so far is dropped.
        """
        size = ends - starts
        least = int((weights * np.where(size >= k, self.impacts[0][np.minimum(starts + k - 1, self.n - 1)], 0)).max(initial=0))
        least = max(least, 1)
        level, prefix, b, e = (np.array([x], np.int64) for x in (0, 0, 0, self.n))
        of, w, i, j = np.zeros(len(starts), np.int64), weights.astype(np.int64), starts.astype(np.int64), ends.astype(np.int64)
        bound = np.array([(w * self.impacts[0][i]).sum()], np.int64)
        scores, docs = np.empty(0, np.int64), np.empty(0, np.int64)

        def only(keep: np.ndarray):
            pairs = keep[of]
            return (level[keep], prefix[keep], b[keep], e[keep], bound[keep]), ((np.cumsum(keep) - 1)[of[pairs]], w[pairs], i[pairs], j[pairs])

        while len(level):
            leaf = level == self.levels
            if leaf.any():
                scores, docs = np.concatenate((scores, bound[leaf])), np.concatenate((docs, prefix[leaf]))
                if len(scores) > k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    docs, scores = docs[scores >= least], scores[scores >= least]
            (level, prefix, b, e, bound), (of, w, i, j) = only(~leaf & (bound >= least))
            if not len(level):
                break
            now = np.ones(len(level), bool)
            if len(level) > WAVE:
                now[np.argpartition(bound, len(level) - WAVE)[: len(level) - WAVE]] = False
            rest_nodes, rest_pairs = only(~now)
            (level, prefix, b, e, bound), (of, w, i, j) = only(now)
            ones_b, ones_e = self.rank(level, b), self.rank(level, e)
            right = b + (e - b) - (ones_e - ones_b)
            from_b = ones_b[of]
            ones_i, ones_j = self.rank(level[of], i) - from_b, self.rank(level[of], j) - from_b
            below = level + 1
            sides = []
            for side, (x, y) in enumerate(((i - ones_i, j - ones_j), (right[of] + ones_i, right[of] + ones_j))):
                has = y > x
                node, pw, px, py = of[has], w[has], x[has], y[has]
                gain = np.bincount(node, weights=(pw * self.impacts[below[node], px]).astype(np.float64), minlength=len(level)).astype(np.int64)
                keep = gain >= least
                pairs = keep[node]
                sides.append(((below[keep], prefix[keep] * 2 + side, (b, right)[side][keep], (right, e)[side][keep], gain[keep]), ((np.cumsum(keep) - 1)[node[pairs]], pw[pairs], px[pairs], py[pairs])))
            nodes, pairs, count = [rest_nodes, *(s[0] for s in sides)], [rest_pairs, *(s[1] for s in sides)], 0
            for n, p in enumerate(pairs):
                pairs[n] = (p[0] + count, *p[1:])
                count += len(nodes[n][0])
            level, prefix, b, e, bound = (np.concatenate(x) for x in zip(*nodes, strict=True))
            of, w, i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((docs, -scores))
        if len(order) > k:
            order = order[scores[order] >= scores[order[k - 1]]]
        return docs[order], scores[order]

"""A gated recurrent network over word ids with a class-factored softmax, in numpy.

Frequent words are outputs of their own: a softmax over classes, then one over the words of
the class. All other words fall into classes by their ending; inside such a class a word has
its share of the corpus counts, which the network does not model. Documents run side by side
in lanes, state is carried from window to window, and gradients stop at window edges.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

END = 0


def ending_class(word: str, classes: int) -> int:
    """Class of a word outside the head: by its last two characters."""
    return zlib.crc32(word[-2:].encode()) % classes


@dataclass(frozen=True)
class Head:
    """Frequent words in falling order of count (id 0 is the end of a document), and their classes."""

    words: tuple[str, ...]
    bounds: tuple[int, ...]
    endings: int

    @property
    def size(self) -> int:
        return 1 + len(self.words)

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + self.endings


def make_head(counts: Sequence[tuple[str, int]], documents: int, endings: int, classes: int) -> Head:
    """Head words cut into classes of about equal square-root mass."""
    mass = np.cumsum(np.sqrt(np.array([documents, *(n for _, n in counts)], float) + 1))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes)
    bounds = sorted({0, *(int(c) for c in cuts if 0 < c < len(mass)), len(mass)})
    return Head(tuple(w for w, _ in counts), tuple(bounds), endings)


@dataclass
class Lanes:
    x: np.ndarray
    y: np.ndarray
    first: np.ndarray
    document: np.ndarray
    place: np.ndarray
    filled: np.ndarray

    def window(self, at: int, size: int) -> tuple[slice, slice]:
        """Steps from `at`, and the lanes that still have tokens there; longer lanes come first."""
        return slice(at, at + size), slice(0, int(np.searchsorted(-self.filled, -at, "left")))


def lay_out(documents: list[np.ndarray], width: int) -> Lanes:
    """Documents, the longest first, one after another in the least filled of `width` lanes.

    Lanes come in falling order of length. y holds the tokens, x the token before (END at a
    start), document and place where a token came from; unused cells have document -1.
    """
    width = max(1, min(width, len(documents)))
    load, own = [(0, k) for k in range(width)], [[] for _ in range(width)]
    for d in sorted(range(len(documents)), key=lambda d: -len(documents[d])):
        filled, lane = heapq.heappop(load)
        own[lane].append(d)
        heapq.heappush(load, (filled + len(documents[d]), lane))
    load.sort(reverse=True)
    steps, own = load[0][0], [own[lane] for _, lane in load]
    x, y, place = (np.zeros((steps, width), np.int32) for _ in range(3))
    first, document = np.zeros((steps, width), bool), np.full((steps, width), -1, np.int32)
    for lane, ds in enumerate(own):
        at = 0
        for d in ds:
            one = documents[d]
            y[at:at + len(one), lane] = one
            x[at + 1:at + len(one), lane] = one[:-1]
            x[at, lane] = END
            first[at, lane] = True
            document[at:at + len(one), lane] = d
            place[at:at + len(one), lane] = np.arange(len(one))
            at += len(one)
    return Lanes(x, y, first, document, place, np.array([filled for filled, _ in load]))


class Network:
    """Weights: input gates per token, recurrent gates, class and word outputs; Adagrad sums beside them."""

    NAMES = ("gates", "turn", "out", "out0", "word", "word0")

    def __init__(self, head: Head, hidden: int, seed: int = 1):
        self.head, self.hidden = head, hidden
        rng = np.random.default_rng(seed)
        tokens = head.size + head.endings
        shapes = {"gates": (tokens, 3 * hidden), "turn": (hidden, 3 * hidden), "out": (hidden, head.classes), "out0": (head.classes,),
                  "word": (head.size, hidden), "word0": (head.size,)}
        scale = {"gates": 0.1, "turn": 0.5 / np.sqrt(hidden), "out": 0.1, "word": 0.1}
        self.w = {n: (rng.normal(size=s) * scale.get(n, 0)).astype(np.float32) for n, s in shapes.items()}
        self.sums = {n: np.full(s, 0.1, np.float32) for n, s in shapes.items()}
        self.class_of = np.zeros(tokens, np.int64)
        for c, (a, b) in enumerate(zip(head.bounds, head.bounds[1:])):
            self.class_of[a:b] = c
        self.class_of[head.size:] = len(head.bounds) - 1 + np.arange(head.endings)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for n in self.NAMES:
            size = self.w[n].size
            self.w[n] = np.asarray(flat[at:at + size], np.float32).reshape(self.w[n].shape).copy()
            at += size
        return self

    def _steps(self, h, x, first, trace=None):
        """Last and all states from h on; `trace` gets the states before, both gates, the new states and their recurrent inputs.

        The three parts of the gates lie apart, so that every operation of a step runs over whole arrays.
        """
        hidden, kind = self.hidden, self.w["gates"].dtype
        # Halving is exact, so the sigmoids' halved sums are taken from halved weights.
        halves = np.repeat(np.array([0.5, 0.5, 1], kind), hidden)
        gates, turn = np.ascontiguousarray((self.w["gates"] * halves).reshape(-1, 3, hidden).transpose(1, 0, 2)), self.w["turn"] * halves
        kept, lanes, starts = trace is not None, len(h), first.any(1)
        states, steps = np.empty((len(x), lanes, hidden), kind), len(x) if kept else 1
        zr, (before, new, an) = np.empty((steps, 2, lanes, hidden), kind), np.empty((3, steps, lanes, hidden), kind)
        gx, a = np.empty((2, 3, lanes, hidden), kind)
        for t in range(len(x)):
            at = t if kept else 0
            if starts[t]:
                h = h * ~first[t][:, None]
            for part in range(3):
                np.take(gates[part], x[t], 0, out=gx[part], mode="clip")
            np.copyto(a, (h @ turn).reshape(lanes, 3, hidden).transpose(1, 0, 2))
            own = np.add(gx[:2], a[:2], out=zr[at])
            np.tanh(own, out=own)
            own *= kind.type(0.5)
            own += kind.type(0.5)
            if kept:
                before[t], an[t] = h, a[2]
            one = np.multiply(own[1], a[2], out=new[at])
            one += gx[2]
            np.tanh(one, out=one)
            state = np.subtract(h, one, out=states[t])
            state *= own[0]
            state += one
            h = state
        if kept:
            trace.extend((before, zr, new, an))
        return h, states

    def _groups(self, target: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, end, positions) of each head class of several words among the targets."""
        classes = self.class_of[target]
        order = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[order], np.arange(len(self.head.bounds)))
        for c, (a, b) in enumerate(zip(self.head.bounds, self.head.bounds[1:])):
            if b - a > 1 and edges[c + 1] > edges[c]:
                yield a, b, order[edges[c]:edges[c + 1]]

    @staticmethod
    def _softmax(logits, own, rows: int = 1024):
        """In place the softmax less one at the chosen columns, and their log-softmax; by runs of rows that stay in cache."""
        found = np.empty(len(own), logits.dtype)
        for at in range(0, len(own), rows):
            p, of = logits[at:at + rows], own[at:at + rows]
            row = np.arange(len(of))
            p -= p.max(1, keepdims=True)
            chosen = p[row, of]
            np.exp(p, out=p)
            total = p.sum(1)
            p /= total[:, None]
            found[at:at + rows] = chosen - np.log(total)
            p[row, of] -= 1
        return logits, found

    def _largest(self) -> float:
        """Bound of all logits: states lie within -1 and 1."""
        w = self.w
        return max(float((np.abs(w["out"]).sum(0) + np.abs(w["out0"])).max()), float((np.abs(w["word"]).sum(1) + np.abs(w["word0"])).max()))

    @staticmethod
    def _chosen(logits, own, bounded: bool):
        """Log-softmax of the chosen columns alone; no shift is needed where exp cannot overflow."""
        found = logits[np.arange(len(own)), own]
        if not bounded:
            top = logits.max(1)
            logits -= top[:, None]
            found = found - top
        return found - np.log(np.exp(logits, out=logits).sum(1))

    def _log_probabilities(self, h, target, bounded: bool, rows: int = 4096):
        """As `_out` without gradients; the class softmax goes by runs of rows that stay in cache."""
        classes, score = self.class_of[target], np.empty(len(target))
        for at in range(0, len(target), rows):
            cut = slice(at, at + rows)
            score[cut] = self._chosen(h[cut] @ self.w["out"] + self.w["out0"], classes[cut], bounded)
        for a, b, at in self._groups(target):
            score[at] += self._chosen(h[at] @ self.w["word"][a:b].T + self.w["word0"][a:b], target[at] - a, bounded)
        return score

    def _out(self, h, target, grads):
        """Natural log probability of each target's class and, for head words, of the word in it."""
        w, classes = self.w, self.class_of[target]
        logits = h @ w["out"]
        logits += w["out0"]
        p, found = self._softmax(logits, classes)
        score = found.astype(np.float64)
        grads["out"], grads["out0"] = h.T @ p, p.sum(0)
        dh = p @ w["out"].T
        grads["word"], grads["word0"] = np.zeros_like(w["word"]), np.zeros_like(w["word0"])
        for a, b, at in self._groups(target):
            states, words = h[at], w["word"][a:b]
            logits = states @ words.T
            logits += w["word0"][a:b]
            p, found = self._softmax(logits, target[at] - a)
            score[at] += found
            grads["word"][a:b], grads["word0"][a:b] = p.T @ states, p.sum(0)
            dh[at] += p @ words
        return score, dh

    def score(self, documents: list[np.ndarray], width: int = 256, window: int = 64) -> list[np.ndarray]:
        """Per document the natural log probability of every token's class and head word, state carried throughout."""
        found = [np.zeros(len(d)) for d in documents]
        if not documents:
            return found
        begins = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
        flat = np.zeros(begins[-1])
        lanes = lay_out(documents, width)
        h, bounded = np.zeros((lanes.x.shape[1], self.hidden), np.float32), self._largest() < 80
        for at in range(0, len(lanes.x), window):
            cut = lanes.window(at, window)
            h, states = self._steps(h[cut[1]], lanes.x[cut], lanes.first[cut])
            used = lanes.document[cut] >= 0
            flat[begins[lanes.document[cut][used]] + lanes.place[cut][used]] = self._log_probabilities(states[used], lanes.y[cut][used], bounded)
        return [flat[a:b] for a, b in zip(begins, begins[1:])]

    def train(self, documents: list[np.ndarray], rate: float, width: int = 64, window: int = 24) -> int:
        """One pass over the documents by truncated backpropagation; the number of tokens seen."""
        if not documents:
            return 0
        lanes, tokens = lay_out(documents, width), 0
        h = np.zeros((lanes.x.shape[1], self.hidden), np.float32)
        for at in range(0, len(lanes.x), window):
            cut = lanes.window(at, window)
            trace: list = []
            x, first, used = lanes.x[cut], lanes.first[cut], lanes.document[cut] >= 0
            if not used.any():
                continue
            h, states = self._steps(h[cut[1]], x, first, trace)
            grads: dict = {}
            _, dh_used = self._out(states[used], lanes.y[cut][used], grads)
            dh_all = np.zeros_like(states)
            dh_all[used] = dh_used
            self._back(dh_all, x, first, trace, grads)
            self._update(grads, rate, int(used.sum()))
            tokens += int(used.sum())
        return tokens

    def _back(self, dh_all, x, first, trace, grads):
        hidden, turn = self.hidden, self.w["turn"]
        before, zr, new, an = trace
        z, r = zr[:, 0], zr[:, 1]
        # What a step's gradient is multiplied by depends on the states alone.
        apart, rest, slope = before - new, 1 - zr, 1 - new * new
        dgx, da = np.empty((*x.shape, 3 * hidden), dh_all.dtype), np.empty((x.shape[1], 3 * hidden), dh_all.dtype)
        dturn, dh, starts = np.zeros_like(turn), np.zeros_like(dh_all[0]), first.any(1)
        for t in range(len(x) - 1, -1, -1):
            dh += dh_all[t]
            dnew = dh * rest[t, 0]
            dnew *= slope[t]
            dz, dr = dh * apart[t], dnew * an[t]
            for part, gate, other in ((dz, z[t], rest[t, 0]), (dr, r[t], rest[t, 1])):
                part *= gate
                part *= other
            np.concatenate([dz, dr, dnew], 1, out=dgx[t])
            dnew *= r[t]
            np.concatenate([dz, dr, dnew], 1, out=da)
            dturn += before[t].T @ da
            dh *= z[t]
            dh += da @ turn.T
            if starts[t]:
                dh *= ~first[t][:, None]
        grads["turn"] = dturn
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        rows, begin = np.unique(flat[order], return_index=True)
        grads["gates"] = rows, np.add.reduceat(dgx.reshape(-1, 3 * hidden)[order], begin)

    def _update(self, grads, rate, count, most: float = 1.0):
        scale = np.float32(1 / np.sqrt(count))
        for name, g in grads.items():
            at, g = g if name == "gates" else (slice(None), g)
            g = g * scale
            np.clip(g, -most, most, out=g)
            sums = self.sums[name][at] + g * g
            self.sums[name][at] = sums
            g *= np.float32(rate)
            g /= np.sqrt(sums, out=sums)
            self.w[name][at] -= g

"""A gated recurrent language model in numpy.

Words are the most frequent ones of a corpus, numbered from the most frequent, as many as fit into ``WEIGHT_BYTES``; the
number after them stands for all others, which share one rare class. The output is factored: first a class, then a word in
it. Classes are runs of numbers that grow with the square root of the rank: where shares fall off as one by the rank, that
makes the classes and the words of a token's class fewest on average. Weights begin at zero and biases, the last row or
column of the output's weights, at the logarithms of the corpus's shares, so an untrained model is the corpus's unigram
model and training goes on from there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

HIDDEN = 16
# Of the words' inputs and outputs, which are nearly all weights; they go to every task and come back averaged.
WEIGHT_BYTES = 2 << 20
# The most words that these allow: one has an input to three gates, an output and its bias.
WORDS = WEIGHT_BYTES // (4 * (3 * HIDDEN + HIDDEN + 1))
# Of a window in training, and at least in scoring.
STEPS = 16
SCORED_LANES = 1024
# Steps times lanes of a window in scoring: where few lanes run, a window is longer.
SCORED_CELLS = 32 * SCORED_LANES
# Rows whose classes are scored at a time, so that their logits stay in a core's cache.
SCORED_ROWS = 4096
TRAINED_LANES = 256
RATE = 5e-3
CLIP = 1.0

Weights = dict[str, np.ndarray]


@lru_cache(maxsize=8)
def layout(words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the classes of ``words`` words begin, and end the last; the class of each word and of the rare ones."""
    step = max(1.0, np.sqrt(np.log(words + 1)) / 2)
    edges = np.unique(np.minimum(np.round((step * np.arange(int(np.sqrt(words) / step) + 2)) ** 2), words).astype(np.int64))
    of = np.repeat(np.arange(len(edges)), np.append(np.diff(edges), 1))
    return edges, of.astype(np.uint8 if len(edges) < 256 else np.uint16)


def size(w: Weights) -> int:
    """How many words the model knows; also the number of the rare class."""
    return len(w["word"])


def begin(shares: np.ndarray, rare: float, seed: int = 11) -> Weights:
    """Weights of an untrained model: ``shares`` of its words, most frequent first, and of all others."""
    words = len(shares)
    edges, of = layout(words)
    of_class = np.append(np.add.reduceat(np.asarray(shares, np.float64), edges[:-1]), rare)
    log = lambda x: np.log(np.maximum(x, 1e-30))
    draw = np.random.default_rng(seed)
    small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    w = {
        "input": small(words + 1, 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN), "gates": np.zeros(3 * HIDDEN, np.float32),
        "class": np.zeros((HIDDEN + 1, len(edges)), np.float32), "word": np.zeros((words, HIDDEN + 1), np.float32),
    }
    w["class"][HIDDEN] = log(of_class)
    w["word"][:, HIDDEN] = log(shares) - log(of_class[of[:-1]])
    return w


class Lanes:
    """Documents (arrays of word numbers) laid end to end in lanes of about equal length."""

    def __init__(self, documents: list[np.ndarray], lanes: int, end: int):
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        loads = [(0, lane) for lane in range(min(lanes, max(1, len(documents))))]
        own: list[list[int]] = [[] for _ in loads]
        for i in order:  # the longest first, to the shortest lane
            load, lane = loads[0]
            own[lane].append(i)
            heapq.heapreplace(loads, (load + len(documents[i]), lane))
        own.sort(key=lambda lane: -sum(len(documents[i]) for i in lane))
        self.order = [i for lane in own for i in lane]
        sizes = np.array([len(documents[i]) for i in self.order], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.targets = np.concatenate([documents[i] for i in self.order]) if documents else np.zeros(0, np.int64)
        self.starts = np.zeros(len(self.targets), dtype=bool)
        self.starts[self.first] = True
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[self.first] = end
        self.lengths = np.array([sum(len(documents[i]) for i in lane) for lane in own], dtype=np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths

    def windows(self, cells: int = SCORED_CELLS) -> Iterator[np.ndarray]:
        """(steps, lanes still running): places in the streams, -1 beyond a lane's end."""
        t, last = 0, int(self.lengths.max(initial=0))
        while t < last:
            running = int(np.searchsorted(-self.lengths, -t, side="left"))
            steps = min(max(STEPS, cells // running), last - t)
            t_of = t + np.arange(steps)[:, None]
            yield np.where(t_of < self.lengths[:running], self.at[:running] + t_of, -1)
            t += steps


class Stretches:
    """Documents laid end to end and cut into lanes of one length, for training: no window is nearly empty, whatever the
    lengths of the documents. A lane that begins inside a document begins with an empty state."""

    def __init__(self, documents: list[np.ndarray], lanes: int, end: int):
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        self.targets = np.concatenate(documents)
        self.starts = np.zeros(len(self.targets), dtype=bool)
        self.starts[first] = True
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[first] = end
        self.length = -(-len(self.targets) // lanes)
        self.at = np.arange(0, len(self.targets), self.length)

    def windows(self, steps: int = STEPS) -> Iterator[np.ndarray]:
        """(steps, lanes): places in the streams, -1 beyond the last lane's end."""
        for t in range(0, self.length, steps):
            inside = np.arange(t, min(t + steps, self.length))[:, None]
            places = self.at + inside
            yield np.where(places < len(self.targets), places, -1)


def _by_gate(matrix: np.ndarray) -> np.ndarray:
    """The three gates' columns of a matrix, one after the other: (3, rows, HIDDEN)."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), 3, HIDDEN).transpose(1, 0, 2))


def _rows_by_gate(inputs: np.ndarray) -> np.ndarray:
    """Where the three gates' parts of the words' inputs are, in rows of HIDDEN."""
    return 3 * inputs.astype(np.int64) + np.arange(3).reshape(3, *[1] * inputs.ndim)


def _recur(w: Weights, inputs: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """States after each step (steps, lanes, HIDDEN), and if wanted what a backward pass needs:
    the states before, the gates (2, steps, lanes, HIDDEN), the state's part of the new values, and these values.

    Gates lie side by side, so that each is one run of memory."""
    (steps, lanes), table = inputs.shape, (w["input"] + w["gates"]).astype(np.float32, copy=False).reshape(-1, HIDDEN)
    states, later = np.empty((steps, lanes, HIDDEN), np.float32), np.empty((lanes, HIDDEN), np.float32)
    before, own_part, news = (np.empty((steps if keep else 1, lanes, HIDDEN), np.float32) for _ in range(3))
    to_gates, part = _by_gate(w["state"]).astype(np.float32, copy=False), np.empty((3, lanes, HIDDEN), np.float32)
    at_gates, fresh, going = _rows_by_gate(inputs), starts.any(axis=1), ~starts[:, :, None]
    gates = np.take(table, at_gates, axis=0) if keep else None
    one, h = np.float32(1), h.astype(np.float32)
    for t in range(steps):
        if fresh[t]:
            h = h * going[t]
        given, new = gates[:, t] if keep else np.take(table, at_gates[:, t], axis=0), states[t]
        both = given[:2]
        np.matmul(h, to_gates, out=part)
        both += part[:2]
        np.negative(both, out=both)
        np.exp(both, out=both)
        both += one
        np.divide(one, both, out=both)
        np.multiply(both[1], part[2], out=new)
        new += given[2]
        np.tanh(new, out=new)
        if keep:
            before[t], own_part[t], news[t] = h, part[2], new
        np.subtract(h, new, out=later)
        later *= both[0]
        new += later
        h = new
    return states, (before, gates[:2] if keep else None, own_part, news)


def _with_one(states: np.ndarray) -> np.ndarray:
    """States with a column of ones, which the biases meet."""
    full = np.empty((len(states), HIDDEN + 1), np.float32)
    full[:, :HIDDEN] = states
    full[:, HIDDEN] = 1
    return full


def _may_overflow(weights: np.ndarray) -> bool:
    """Whether exponentials of logits could be too large: states are within -1 and 1. Rows of ``weights`` end with the bias."""
    return float((np.abs(weights[:, :HIDDEN]) @ np.ones(HIDDEN, np.float32) + weights[:, HIDDEN]).max()) > 60


def _exp(x: np.ndarray) -> np.ndarray:
    """In place; returns the sums of the rows."""
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], np.float32)


class _ByClass:
    """Rows sorted by the class of their word, the rare ones last, and of the others the logits of the words in it: those of all
    rows one after the other."""

    def __init__(self, w: Weights, states: np.ndarray, targets: np.ndarray):
        edges, of = layout(size(w))
        classes = of[targets]
        self.order = np.argsort(classes, kind="stable")
        self.full, self.classes, own = _with_one(np.take(states, self.order, axis=0)), classes[self.order], targets[self.order]
        ends = np.searchsorted(self.classes, np.arange(len(edges))).tolist()
        self.known = ends[-1]
        # How many logits a row has, where they begin, and where that of its own word is.
        self.widths = np.diff(edges)[self.classes[:self.known]]
        self.at = np.cumsum(self.widths) - self.widths
        self.mine = self.at + own[:self.known] - edges[self.classes[:self.known]]
        self.logits = np.empty(int(self.widths.sum()), np.float32)
        self.parts, begin, edges = [], 0, edges.tolist()
        for first, last, i, j in zip(edges, edges[1:], ends, ends[1:]):
            if i < j:
                end = begin + (j - i) * (last - first)
                x = self.logits[begin:end].reshape(j - i, last - first)
                np.matmul(self.full[i:j], w["word"][first:last].T, out=x)
                self.parts.append((slice(first, last), slice(i, j), x))
                begin = end
        if _may_overflow(w["word"]):
            for _, _, x in self.parts:
                x -= x.max(axis=1, keepdims=True)

    def exp(self) -> np.ndarray:
        """In place; returns the sums of the rows."""
        np.exp(self.logits, out=self.logits)
        return np.add.reduceat(self.logits, self.at) if self.known else np.zeros(0, np.float32)


def _class_logits(w: Weights, full: np.ndarray) -> np.ndarray:
    x = full @ w["class"]
    if _may_overflow(w["class"].T):
        x -= x.max(axis=1, keepdims=True)
    return x


def log_probabilities(w: Weights, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms; of a rare word that of its class."""
    own = _ByClass(w, states, targets)
    sums = np.empty(len(targets))
    for at in range(0, len(sums), SCORED_ROWS):
        rows = slice(at, at + SCORED_ROWS)
        x = _class_logits(w, own.full[rows])
        sums[rows] = x[np.arange(len(x)), own.classes[rows]]
        sums[rows] -= np.log(_exp(x))
    sums[:own.known] += own.logits[own.mine]
    sums[:own.known] -= np.log(own.exp())
    found = np.empty_like(sums)
    found[own.order] = sums
    return found


def score(w: Weights, documents: list[np.ndarray], end: int) -> np.ndarray:
    """The natural log-likelihood of each whole document, its state carried through all windows."""
    lanes = Lanes(documents, SCORED_LANES, end)
    found = np.zeros(len(lanes.targets))
    h = np.zeros((len(lanes.lengths), HIDDEN), np.float32)
    for places in lanes.windows():
        states, _ = _recur(w, lanes.inputs[places], lanes.starts[places], h[:places.shape[1]])
        h, real = states[-1], places >= 0
        found[places[real]] = log_probabilities(w, states[real], lanes.targets[places[real]])
    totals = np.zeros(len(documents))
    if len(found):
        totals[lanes.order] = np.add.reduceat(found, lanes.first)
    return totals


def gradients(w: Weights, inputs: np.ndarray, starts: np.ndarray, targets: np.ndarray, real: np.ndarray,
              h: np.ndarray) -> tuple[Weights, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Of the mean loss over one window, back to its first step: of all weights but the words' inputs,
    of those the words that occur and theirs; and the state after the window."""
    states, (before, gates, own, new) = _recur(w, inputs, starts, h, keep=True)
    steps, lanes = inputs.shape
    whole = bool(real.all())
    known = _ByClass(w, states.reshape(-1, HIDDEN) if whole else states[real], targets.ravel() if whole else targets[real])
    n, share = known.known, np.float32(1 / max(1, len(known.full)))
    wrong = _class_logits(w, known.full)
    sums = _exp(wrong)
    wrong *= (share / sums)[:, None]
    wrong[np.arange(len(wrong)), known.classes] -= share
    g = {"word": np.zeros_like(w["word"]), "class": known.full.T @ wrong}
    back = wrong @ w["class"][:HIDDEN].T
    own_back = np.empty((n, HIDDEN), np.float32)
    sums = known.exp()
    known.logits *= np.repeat(share / sums, known.widths)
    known.logits[known.mine] -= share
    for words, part, wrong in known.parts:
        np.matmul(wrong.T, known.full[part], out=g["word"][words])
        np.matmul(wrong, w["word"][words, :HIDDEN], out=own_back[part])
    back[:n] += own_back
    errors = np.zeros((steps * lanes, HIDDEN), np.float32)
    errors[known.order if whole else np.flatnonzero(real)[known.order]] = back
    errors = errors.reshape(steps, lanes, HIDDEN)
    z, r = gates
    # How much of a state's error reaches the new value, the two gates and the state before.
    kept = 1 - z
    to_new, to_z, to_r = kept * (1 - new * new), (before - new) * z * kept, own * r * (1 - r)
    given, through = np.empty((3, steps, lanes, HIDDEN), np.float32), np.empty((steps, lanes, HIDDEN), np.float32)
    dh, to_state, fresh, going = np.zeros((lanes, HIDDEN), np.float32), _by_gate(w["state"]).transpose(0, 2, 1), starts.any(axis=1), ~starts[:, :, None]
    step_back = np.empty((3, lanes, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        dh += errors[t]
        dnew = np.multiply(dh, to_new[t], out=given[2, t])
        np.multiply(dh, to_z[t], out=given[0, t])
        np.multiply(dnew, to_r[t], out=given[1, t])
        np.multiply(dnew, r[t], out=through[t])
        np.matmul(given[:2, t], to_state[:2], out=step_back[:2])
        np.matmul(through[t], to_state[2], out=step_back[2])
        dh *= z[t]
        for part in step_back:
            dh += part
        if fresh[t]:
            dh *= going[t]
    rows = given.reshape(3, -1, HIDDEN)
    from_state = before.reshape(-1, HIDDEN).T
    g["state"] = np.concatenate([from_state @ rows[0], from_state @ rows[1], from_state @ through.reshape(-1, HIDDEN)], axis=1)
    g["gates"] = (np.ones(rows.shape[1], np.float32) @ rows).ravel()
    return g, _by_word(inputs.ravel(), rows), states[-1]


def _by_word(inputs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that occur, and the sums of their rows, which come by gate."""
    words, numbers = np.flatnonzero(np.bincount(inputs)), np.empty(int(inputs.max()) + 1, np.int64)
    numbers[words] = np.arange(len(words))
    sums = np.zeros(len(words) * 3 * HIDDEN, np.float32)
    # Single numbers are added up much faster than rows.
    places = np.take(np.arange(len(sums)).reshape(-1, HIDDEN), _rows_by_gate(numbers[inputs]), axis=0)
    np.add.at(sums, places.ravel(), rows.ravel())
    return words, sums.reshape(len(words), 3 * HIDDEN)


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, w: Weights, rate: float = RATE):
        self.w, self.rate, self.n = {k: v.copy() for k, v in w.items()}, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def learn(self, documents: list[np.ndarray], end: int) -> None:
        """One pass. Small inputs get fewer lanes, so that there are steps enough; a window counts by its share of a full one."""
        tokens = sum(map(len, documents))
        lanes = Stretches(documents, int(np.clip(tokens // (STEPS * 100), 8, TRAINED_LANES)), end)
        h = np.zeros((len(lanes.at), HIDDEN), np.float32)
        for places in lanes.windows():
            real = places >= 0
            g, words, h = gradients(self.w, lanes.inputs[places], lanes.starts[places], lanes.targets[places], real, h)
            self._step(g, *words, share=real.sum() / (STEPS * len(lanes.at)))

    def _step(self, g: Weights, words: np.ndarray, inputs: np.ndarray, share: float = 1.0) -> None:
        """One step. Inputs of words that don't occur stay as they are, their averages too."""
        self.n += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in (*g.values(), inputs)))
        scale = np.float32(min(1.0, CLIP / (norm + 1e-12)))
        rate = np.float32(self.rate * share * np.sqrt(1 - 0.999 ** self.n) / (1 - 0.9 ** self.n))
        for name, x in g.items():
            self.w[name] -= self._change(x, self.m[name], self.v[name], scale, rate)
        own = [np.take(x["input"], words, axis=0) for x in (self.w, self.m, self.v)]
        own[0] -= self._change(inputs, *own[1:], scale, rate)
        for x, rows in zip((self.w, self.m, self.v), own):
            x["input"][words] = rows

    @staticmethod
    def _change(x: np.ndarray, m: np.ndarray, v: np.ndarray, scale: np.float32, rate: np.float32) -> np.ndarray:
        """Moves the averages towards ``scale`` times ``x`` in place."""
        m *= np.float32(0.9)
        m += np.float32(0.1) * scale * x
        v *= np.float32(0.999)
        np.multiply(x, x, out=x)
        x *= np.float32(0.001) * scale * scale
        v += x
        np.sqrt(v, out=x)
        x += np.float32(1e-8)
        np.divide(m, x, out=x)
        x *= rate
        return x


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in sorted(w)])


def restore(flat: np.ndarray, like: Weights) -> Weights:
    found, at = {}, 0
    for name in sorted(like):
        found[name] = flat[at:at + like[name].size].reshape(like[name].shape).astype(np.float32)
        at += like[name].size
    return found
